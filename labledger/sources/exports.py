"""Readers for purchasing exports kept as CSV.

* line items  - header in row 0 (names may carry spaces)
* PO summary  - nine preamble lines, header in row 9, then rows
* inventory   - one CSV directory per sheet (``sheet=<name>``); the sheet
                name becomes the grant unless it is ``Sheet1``

All columns are read as text; typing happens once in the import pipelines. Every file is read by its own header, so
files may order their columns differently or lack some. Quotes are doubled inside quoted values, which may span lines.
Each row carries ``file`` and ``line_no``, a number that grows with its position inside the file.
"""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from labledger.schema import PO_SUMMARY_HEADERS
from labledger.session import freed_shuffles, scratch_path

PREAMBLE_LINES = 9
# The quoting of the exports.
QUOTING = {"quote": '"', "escape": '"'}


def _names(header: str) -> list[str]:
    """Trimmed column names of a header line; nameless columns are numbered."""
    return [c.strip() or f"_c{i}" for i, c in enumerate(next(csv.reader([header.lstrip("\ufeff")])))]


def _place(block: Column, mid: Column) -> Column:
    """A number that grows along a file: its block (in steps of 1024 bytes, up to a terabyte), then the row in the block's task."""
    return F.shiftleft(F.floor(block / 1024).cast("bigint"), 33) + mid.bitwiseAND(F.lit((1 << 33) - 1))


def _text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True).text(path)
                 .select("value", F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid")))


# What a line does to the state "inside a quoted value" that it starts in.
KEEPS, LEAVES_OUT, LEAVES_IN, SWAPS = 0, 1, 2, 3


def quote_effect(value: Column) -> Column:
    """KEEPS the state, or ends outside or inside whatever it was, or swaps it. Quotes inside unquoted values don't count."""
    opens = r'(?s)(,|^)"([^"]|"")*$'  # a value that doesn't close
    without = lambda x: F.regexp_replace(x, r'(?<![^,])"([^"]|"")*"(?=,|\r?$)', "")  # noqa: E731  # whole quoted values
    from_out = without(value).rlike(opens)
    closes = r'^([^"]|"")*"(?=,|\r?$)'
    from_in = ~value.rlike(closes) | without(F.regexp_replace(value, closes, "")).rlike(opens)
    return F.when(~value.contains('"'), KEEPS).when(from_out & from_in, LEAVES_IN).when(~from_out & ~from_in, LEAVES_OUT).when(from_out, SWAPS).otherwise(KEEPS)


def _running(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The effect of the rows up to each one: ``fixed``, the state that the last row that sets one left (null without one), and
    ``odd``, 1 if the state was swapped an odd number of times since. Rows say it by ``sets`` (0, 1 or null) and ``swap`` (0 or 1)."""
    over = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("s", F.sum("swap").over(over))
    last = summed.withColumn("last", F.last(F.when(F.col("sets").isNotNull(), F.struct(F.col("sets").alias("v"), "s")), ignorenulls=True).over(over))
    return last.withColumn("fixed", F.col("last.v")).withColumn("odd", (F.col("s") - F.coalesce("last.s", F.lit(0))) % 2).drop("s", "last")


def _kept(df: DataFrame) -> DataFrame:
    """A small table, written so that the planner knows its size when it joins it."""
    path = scratch_path(df.sparkSession, "exports", "blocks")
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_records(lines: DataFrame) -> DataFrame:
    """The CSV records ``(value, file, place)`` of the text lines ``(value, file, block, mid)`` of files in which quoted values span lines.

    Which lines begin a record follows from the quotes before them. Every block of a file is summed up by itself (the
    prefix of its lines' effects), the blocks' sums, one row each, are carried forward, and only the lines of records of
    several lines are grouped, so a large file is read by as many tasks as it has blocks.
    """
    here, along = Window.partitionBy("file", "block").orderBy("mid"), Window.partitionBy("file").orderBy("block")
    rows = (lines.withColumn("effect", quote_effect(F.col("value"))).withColumn("swap", (F.col("effect") == SWAPS).cast("int"))
            .withColumn("sets", F.when(F.col("effect") == LEAVES_OUT, 0).when(F.col("effect") == LEAVES_IN, 1)))
    inside = _running(rows, ["file", "block"], "mid")
    ends = inside.groupBy("file", "block").agg(F.max_by(F.struct("fixed", "odd"), "mid").alias("e"))
    ends = ends.select("file", "block", ((F.col("e.fixed") + F.col("e.odd")) % 2).alias("sets"), F.when(F.col("e.fixed").isNull(), F.col("e.odd")).otherwise(0).alias("swap"))
    after = (F.coalesce("fixed", F.lit(0)) + F.col("odd")) % 2
    start = _kept(_running(ends, ["file"], "block").select("file", "block", F.coalesce(F.lag(after).over(along), F.lit(0)).alias("start")))
    was = F.lag(F.struct("fixed", "odd")).over(here)
    state = (F.coalesce("was.fixed", "start") + F.coalesce("was.odd", F.lit(0))) % 2
    placed = (inside.withColumn("was", was).join(start, ["file", "block"])
              .select("value", "file", "block", "mid", "effect", state.alias("state"), _place(F.col("block"), F.col("mid")).alias("place")))
    begins = F.when(F.col("state") == 0, F.col("place"))
    earlier = placed.groupBy("file", "block").agg(F.max(begins).alias("b"))
    earlier = _kept(earlier.select("file", "block", F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carry")))
    own = F.max(begins).over(here.rowsBetween(Window.unboundedPreceding, 0))
    alone = (F.col("state") == 0) & F.col("effect").isin(KEEPS, LEAVES_OUT)
    several = placed.withColumn("own", own).filter(~alone).join(earlier, ["file", "block"]).withColumn("record", F.coalesce("own", "carry"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n")
    grouped = several.groupBy("file", "record").agg(joined.alias("value")).select("value", "file", F.col("record").alias("place"))
    return placed.filter(alone).select("value", "file", "place").unionByName(grouped).filter(F.col("value") != "")


def _spans() -> Column:
    """Whether a value spans lines, as a set of at most one value: with a set, Spark aggregates by hash, where a text beside
    it would have it sort all lines by file."""
    return F.size(F.collect_set(F.when(quote_effect(F.col("value")) >= LEAVES_IN, True))) > 0


def _heads(lines: DataFrame) -> DataFrame:
    """``(file, header, spans)`` of the text lines of files."""
    top = F.col("block") == 0
    return (lines.groupBy("file").agg(F.min_by(F.when(top, F.col("value")), F.when(top, F.col("mid"))).alias("header"), _spans().alias("spans"))
            .filter("header is not null"))


def read_csv_by_header(spark: SparkSession, path: str | list[str], partitions: list[str] = ()) -> DataFrame:
    """All CSV files at ``path``, each by its own header line, as text; ``partitions`` name text columns that come from
    directory names. The files' header lines go through the driver, as its file listing does; files with the same header
    are one scan. Large files are split: those without line breaks inside values by the CSV reader, the others by ``csv_records``."""
    heads = _heads(_text_lines(spark, path)).collect()
    kinds: dict[tuple[str, bool], list[str]] = {}
    for r in heads:
        kinds.setdefault((r["header"], bool(r["spans"])), []).append(unquote(r["file"]))
    if not kinds:
        return spark.createDataFrame([], "file string, line_no bigint")
    parts = []
    for (header, spans), files in sorted(kinds.items()):
        names = _names(header)
        if spans:
            records = csv_records(_text_lines(spark, sorted(files)))
            first = _kept(records.groupBy("file").agg(F.min("place").alias("head")))
            inner = ", ".join(f"c{i} string" for i in range(len(names)))
            body = records.join(first, "file").filter("place > head").select(F.from_csv("value", inner, QUOTING).alias("r"), "file", "place")
            folders = [F.url_decode(F.regexp_extract("file", f"/{p}=([^/]*)/", 1)).alias(p) for p in partitions]
            parts.append(body.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], *folders, "file", F.col("place").alias("line_no")))
            continue
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, *partitions])
        reader = spark.read.schema(schema).options(header=True, **QUOTING)
        if isinstance(path, str):
            reader = reader.option("basePath", path)
        read = reader.csv(path if len(kinds) == 1 else sorted(files))
        place = _place(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        parts.append(read.select("*", F.col("_metadata.file_path").alias("file"), place.alias("line_no")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_line_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header row; header names trimmed; every value text."""
    return read_csv_by_header(spark, path)


def detect_export_format(columns: list[str]) -> str:
    """S6: 'line_items' when Item and a price column are present, 'po_summary'
    when the summary headers are, else an error (metadata only)."""
    cols = [c.strip() for c in columns]
    if "Item" in cols and ("Unit Price ($)" in cols or "Line Total ($)" in cols):
        return "line_items"
    if all(c in cols for c in PO_SUMMARY_HEADERS[:3]):
        return "po_summary"
    raise ValueError("Unrecognized file format: expected Item + Unit Price / Line Total, "
                     "or PO Number, Supplier, Total Amount")


def _after_preamble(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The text lines of summary files from the header on; ``heads`` marks the header. Only a file's first line number is
    looked up: one row per file, written so that the planner knows its size and broadcasts it while it is small."""
    lines = _text_lines(spark, path)
    first = _kept(lines.filter("block = 0").groupBy("file").agg(F.min("mid").alias("first")))
    pos = F.when(F.col("block") == 0, F.col("mid") - F.col("first"))
    return (lines.join(first, "file").withColumn("pos", F.coalesce(pos, F.lit(PREAMBLE_LINES + 1))).filter(F.col("pos") >= PREAMBLE_LINES)
            .select("value", "file", "block", "mid", (F.col("pos") == PREAMBLE_LINES).alias("heads")))


def _summary_heads(lines: DataFrame) -> DataFrame:
    """``(file, header, spans)`` of the lines of summary files from the header on."""
    below = lines.withColumn("header", F.when(F.col("heads"), F.col("value"))).withColumn("value", F.when(~F.col("heads"), F.col("value")))
    return below.groupBy("file").agg(F.max("header").alias("header"), _spans().alias("spans")).filter("header is not null")


def scan_po_summary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Skip the nine preamble lines of every file, take its header and parse the remaining lines by it.

    The preamble counts as lines of text, so quotes in it open nothing. Values may span lines after it. Files are split into
    blocks as those of ``read_csv_by_header`` are: lines are parsed where they are read, but for files with values over several
    lines, whose records come from ``csv_records``. A file that ends within its preamble has no rows."""
    lines = _after_preamble(spark, path)
    heads = _summary_heads(lines).collect()
    kinds: dict[tuple[str, bool], list[str]] = {}
    for r in heads:
        kinds.setdefault((r["header"], bool(r["spans"])), []).append(unquote(r["file"]))
    if not kinds:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in PO_SUMMARY_HEADERS) + ", file string, line_no bigint")
    parts = []
    for (header, spans), files in sorted(kinds.items()):
        names = _names(header)
        detect_export_format(names)
        own = (lines if len(kinds) == 1 else _after_preamble(spark, sorted(files))).filter(~F.col("heads"))
        records = (csv_records(own) if spans else
                   own.filter(F.col("value") != "").select("value", "file", _place(F.col("block"), F.col("mid")).alias("place")))
        inner = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = records.select(F.from_csv("value", inner, QUOTING).alias("r"), "file", "place")
        parts.append(parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], "file", F.col("place").alias("line_no")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every sheet at once; ``sheet`` comes from the directory name, as text."""
    return read_csv_by_header(spark, path, partitions=["sheet"])


def sheet_grant(sheet_col: str = "sheet"):
    """The grant of an inventory sheet: its name, blank for the default sheet name."""
    return F.when(F.col(sheet_col) == "Sheet1", F.lit(None)).otherwise(F.col(sheet_col))
