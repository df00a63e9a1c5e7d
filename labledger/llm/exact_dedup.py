"""Exact dedup by deterministic block naming (operator 10), with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from labledger.llm.common import by_salt, groups, ready, salted, written

BLOCK_BYTES = 4096
WHITE = " \t\n\v\f\r"


def _bucket(x: Column, bits: int) -> Column:
    """The sort bucket of a block or a pair of names."""
    return F.xxhash64(x) if bits == 64 else F.pmod(F.xxhash64(x), F.lit(1 << bits))


def _named(df: DataFrame, items: str, bits: int) -> DataFrame:
    """Replace the array ``items`` by ``names``: equal items get equal names, different items different names.

    The distinct items are sorted by (bucket, item); an item's name is its bucket and its rank in the bucket. The rank
    is 0 but for the buckets that hold several distinct items, which only the distinct items can tell: they are
    found by one aggregation that drops copies before the shuffle. Ranks other than 0 are written and joined back; a row
    number keeps rows that repeat an id and a text apart.
    """
    held = df.withColumn(items, F.transform(items, lambda x: F.struct(_bucket(x, bits).alias("h"), x.alias("x"))))
    distinct = held.select(F.explode(items).alias("i")).select("i.h", "i.x").distinct()
    crowded = written(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"))
    if crowded.isEmpty():
        return held.withColumn("names", F.transform(items, lambda i: F.struct(i["h"].alias("h"), F.lit(0).alias("rank")))).drop(items)
    rank = F.row_number().over(Window.partitionBy("h").orderBy("x")) - 1  # among the distinct items of a bucket
    ranks = written(distinct.join(crowded, "h", "left_semi").withColumn("rank", rank).filter("rank > 0"))
    kept = [*(c for c in df.columns if c != items), "row"]
    spread = (held.withColumn("row", F.monotonically_increasing_id()).select(*kept, F.posexplode_outer(items).alias("pos", "i")).select(*kept, "pos", "i.h", "i.x")
              .join(ranks, ["h", "x"], "left"))
    names = F.transform(F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct(
        "pos", "h", F.coalesce("rank", F.lit(0)).alias("rank"))))), lambda p: F.struct(p["h"].alias("h"), p["rank"].alias("rank")))
    return spread.groupBy(*kept).agg(names.alias("names")).drop("row")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    """Groups of equal texts: one row ``(id_col, keep_id, group_size, kept, text_sha256)`` per row of ``df``.

    Texts are equal if they are identical without the characters space and \\x09-\\x0D; null counts as empty. Of a
    group, the row with the most code points in its original text stays, of several the one with the smallest id (a
    null id comes first).

    The normalised UTF-8 text is cut into blocks of ``block_bytes``, the blocks are named by integers, then adjacent
    pairs of names are named, until one name is left. A text's identity is its length and that name. Names are decided
    on the blocks and pairs themselves, never by a hash alone. The texts are shuffled once, for the distinct
    blocks; later levels hold one 12-byte name per block. A group may hold any share of the rows: it's aggregated before the
    shuffle and joined back by an equi-join over salts. Rows that repeat an id and a text
    are kept or dropped together. ``bits``: buckets of the sort, fewer only to test crowded ones.
    """
    ready(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.encode(reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), WHITE, text), "UTF-8")
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"cast((octet_length(bare) - 1) div {block_bytes} as int)")),
                         lambda i: F.substring(F.col("bare"), i * block_bytes + 1, F.lit(block_bytes)))
    docs = (df.select(F.col(id_col).alias("id"), F.char_length(text).alias("points"), bare.alias("bare"))
            .select("id", "points", F.octet_length("bare").alias("size"), F.sha2("bare", 256).alias("sha"), blocks.alias("items")))
    level = written(_named(docs, "items", bits))
    longest = level.agg(F.max(F.size("names"))).first()[0] or 0
    pairs = F.transform(F.sequence(F.lit(0), F.expr("cast((size(names) - 1) div 2 as int)")),
                        lambda i: F.struct(F.get("names", i * 2).alias("l"), F.get("names", i * 2 + 1).alias("r")))
    while longest > 1:
        level = written(_named(level.withColumn("items", pairs).drop("names"), "items", bits))
        longest = (longest + 1) // 2
    named = level.select("id", "points", "size", "sha", F.get("names", F.lit(0)).alias("name")).select("*", "name.h", "name.rank")
    key = ["size", "h", "rank"]
    named = salted(named, "id")
    best = groups(named, key, best=(F.min(F.struct((-F.col("points")).alias("p"), F.col("id").alias("id"))), F.min), group_size=(F.count(F.lit(1)), F.sum))
    return (named.join(by_salt(best.select(*key, F.col("best.id").alias("keep_id"), "group_size", "salts")), [*key, "salt"])
            .select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("sha").alias("text_sha256")))
