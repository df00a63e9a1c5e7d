"""The order table kept as versioned parquet snapshots.

Each save writes a brand-new directory ``v=<version>-<unique>`` (partitioned by ``lab`` so
per-lab reads prune partitions) and then appends one row to ``_log``. The
current version is the largest logged one. A snapshot is never overwritten
while something may read it; a failed write leaves no log row and its folder name is never used
again, so readers keep seeing the previous version and the next write goes through. One writer at a time.

Retention: nothing is removed here. Folders that no log row from the last full version on names can be deleted once no
reader holds them; ``compact()`` makes such a full version.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from labledger.functions.clean import coerce_date, normalize_date_text, strip
from labledger.schema import ORDER, ORDER_COLUMNS, SOURCE_NAMES, conform, empty_orders
from labledger.session import freed_shuffles, scratch_path
from labledger.sources.exports import QUOTING, read_csv_by_header
from labledger.sources.tables import LARGE_ROWS, table

TO_SOURCE = {ours: theirs for theirs, ours in SOURCE_NAMES.items()}


class OrderStore:
    def __init__(self, spark: SparkSession, root: str | None = None, rows: int = 0):
        """``rows``: about how many the store will hold, if that is known; a large one is written in a denser form."""
        self.spark = spark
        self.codec = {"compression": "zstd"} if rows >= LARGE_ROWS else {}
        # A store at a new, unique path has no log until its first commit, so
        # reads need not probe the file system for it.
        self._fresh = root is None
        self.root = (root or scratch_path(spark, "store")).rstrip("/")

    # -- versions -------------------------------------------------------
    def _log_path(self) -> str:
        return f"{self.root}/_log"

    _LOG_SCHEMA = "version bigint, path string, rows bigint, written_at double, kind string, epoch string"

    def versions(self) -> DataFrame:
        if self._fresh:
            return self.spark.createDataFrame([], self._LOG_SCHEMA)
        try:
            return self.spark.read.schema(self._LOG_SCHEMA).parquet(self._log_path())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self._LOG_SCHEMA)

    def current(self) -> tuple[int, str] | None:
        r = self.versions().orderBy(F.desc("version")).limit(1).collect()
        return (r[0]["version"], r[0]["path"]) if r else None

    def _live_paths(self, since: int = 0) -> list[str]:
        """The last full snapshot and the appended parts after it; of these, the versions above ``since``."""
        log = self.versions()
        full = log.filter(F.col("kind") == "full").agg(F.max("version").alias("full"))
        live = log.join(F.broadcast(full), F.col("version") >= F.coalesce("full", F.lit(0))).filter(F.col("version") > since)
        return [r["path"] for r in live.orderBy("version").select("path").collect()]

    # -- S1 -------------------------------------------------------------
    def read(self, since: int = 0) -> DataFrame:
        """The current table, or what versions above ``since`` hold of it, as one scan; an empty typed table when there
        is nothing. All versions lie under the store's folder, which is the base of the partition columns."""
        paths = self._live_paths(since)
        if not paths:
            return empty_orders(self.spark)
        return self.spark.read.schema(ORDER).option("basePath", self.root).parquet(*paths).select(*ORDER_COLUMNS)

    def append(self, rows: DataFrame, epoch: str | None = None) -> DataFrame | None:
        """U1 as storage: write only the new rows as the next version (kind
        append); readers see the last full snapshot plus later parts. An ``epoch`` is logged with the commit; one that
        is logged already is skipped (None), so a replayed batch adds nothing."""
        if epoch is not None and self.has_epoch(epoch):
            return None
        return self._commit(rows, "append", epoch)

    def has_epoch(self, epoch: str) -> bool:
        return not self.versions().filter(F.col("epoch") == epoch).isEmpty()

    def compact(self) -> DataFrame:
        """Rewrite the current table as one full version; run it between appends, not inside them."""
        return self.write(self.read())

    # -- S4 -------------------------------------------------------------
    def write(self, df: DataFrame) -> DataFrame:
        """Save ``df`` as the next version and return the verification
        aggregate (S10: rows and spend re-read from the written files; an error if they aren't those that were sent)."""
        return self._commit(df, "full")

    def _commit(self, df: DataFrame, kind: str, epoch: str | None = None) -> DataFrame:
        cur = self.current()
        version = 1 if cur is None else cur[0] + 1
        path = f"{self.root}/v={version:06d}-{uuid.uuid4().hex[:12]}"
        sent = Observation()
        with freed_shuffles(self.spark):
            (conform(df).observe(sent, F.count(F.lit(1)).alias("rows"), F.sum("total").cast("double").alias("spend"))
                .write.mode("errorifexists").options(**self.codec).partitionBy("lab").parquet(path))
        check = (self.spark.read.schema(ORDER).parquet(path)
                     .agg(F.count(F.lit(1)).alias("rows"), F.sum("total").cast("double").alias("spend")))
        rows = check.collect()[0]
        if rows.asDict() != {k: sent.get[k] for k in ("rows", "spend")}:
            raise OSError(f"{path} holds {rows}, but {sent.get} was written")
        self.spark.createDataFrame([(version, path, rows["rows"], time.time(), kind, epoch)], self._LOG_SCHEMA) \
            .coalesce(1).write.mode("append").parquet(self._log_path())
        self._fresh = False
        return check

    def delete_all(self) -> DataFrame:
        """Replace the table with an empty snapshot."""
        return self.write(empty_orders(self.spark))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row under the original column names (one directory of part files); quotes are doubled."""
    named = df.select(*[F.col(f"`{c}`").alias(TO_SOURCE.get(c, c)) for c in df.columns])
    named.write.mode("errorifexists").options(header=True, **QUOTING).csv(path)


def scan_order_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1 from a stored CSV table with the original column names (any order, some may be missing): the typed order table.

    Blank text is null, dates and amounts are coerced as at import; unreadable ones are null."""
    raw = read_csv_by_header(spark, path)
    named = raw.select(*[F.nullif(strip(f"`{c}`"), F.lit("")).alias(SOURCE_NAMES[c]) for c in raw.columns if c in SOURCE_NAMES])
    typed = {f.name: f.dataType for f in ORDER.fields}
    dates = {"date_ordered", "date_received"}
    return conform(named.select(*[coerce_date(normalize_date_text(c)).alias(c) if c in dates else F.col(c).try_cast(typed[c]).alias(c) for c in named.columns]))


def preview(df: DataFrame, n: int = 20, order: list | None = None) -> DataFrame:
    """The first n rows under an explicit order, plus the total count."""
    order = order or ["req_id"]
    head = df.orderBy(*order).limit(n)
    cnt = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return head.join(F.broadcast(cnt), how="inner", on=F.lit(True))


# ---------------------------------------------------------------------------
# The order table the registered queries read: order_lines built once per
# session and data directory, saved as a snapshot, then scanned from parquet.
_CACHE: dict[tuple[str, str], OrderStore] = {}


def order_table(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    from labledger.sources.fixtures import order_lines

    if not materialize:
        return order_lines(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    store = _CACHE.get(key)
    if store is None:
        store = OrderStore(spark, rows=table(spark, sf_dir, "lineitem").count())
        store.write(order_lines(spark, sf_dir))
        _CACHE[key] = store
    return store.read()
