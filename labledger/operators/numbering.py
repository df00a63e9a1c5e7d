"""Consecutive numbering and request ids without a single-partition window.

``consecutive_index`` range-partitions by the order key (sampled bounds, so a
hot key range is split), sorts within partitions and checkpoints the result to
the shared folder so the partitioning is fixed. The row index inside a
partition is the low 33 bits of ``monotonically_increasing_id``; per-partition
counts (one row per partition) give the offsets. ``index_in_place`` does without
the copy where the rows can be read again.
"""

from __future__ import annotations

import datetime as dt
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from labledger.session import freed_shuffles, shared_dir
from labledger.sources.tables import partitions_for

_LOW33 = (1 << 33) - 1


def consecutive_index(df: DataFrame, order: list[str | Column], name: str = "idx", start: int = 1,
                      partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start, start+1, ... following ``order`` (which must be a total order)."""
    return indexed_with_count(df, order, name, start, partitions)[0]


def indexed_with_count(df: DataFrame, order: list[str | Column], name: str = "idx", start: int = 1,
                       partitions: int | None = None) -> tuple[DataFrame, int]:
    """``consecutive_index`` plus the row count it learns on the way."""
    spark = df.sparkSession
    shared_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with freed_shuffles(spark):
        fixed = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).checkpoint(eager=True)
        mid = F.monotonically_increasing_id()
        tagged = fixed.withColumn("_mid", mid)
        counts = (tagged.groupBy(F.shiftright("_mid", 33).alias("pid")).agg(F.count(F.lit(1)).alias("n"))
                        .orderBy("pid").collect())
    offsets, acc = _offsets({int(r["pid"]): int(r["n"]) for r in counts})
    if not offsets:
        return tagged.drop("_mid").withColumn(name, F.lit(None).cast("bigint")), 0
    off = F.get(F.lit(offsets).cast("array<bigint>"), F.shiftright("_mid", 33).cast("int"))
    out = tagged.withColumn(name, off + F.col("_mid").bitwiseAND(F.lit(_LOW33)) + F.lit(start)).drop("_mid")
    return out, acc


def _offsets(sizes: dict[int, int]) -> tuple[list[int], int]:
    """The rows before each partition, as an array literal needs them: a row's offset is one index away. And all rows."""
    upto = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1))]
    return upto[:-1], upto[-1]


SAMPLED_PER_RANGE = 100


def _range_of(key: str, bounds: list[str]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key`` (0 for null): looked up among every w-th bound, then among the next w."""
    w = math.isqrt(len(bounds)) + 1
    groups = [bounds[i:i + w] for i in range(0, len(bounds) + 1, w)]
    upto = lambda texts: F.size(F.filter(texts, lambda b: b <= F.col(key)))
    g = upto(F.lit(bounds[w - 1::w]).cast("array<string>"))
    near = F.get(F.lit(groups).cast("array<array<string>>"), g)
    return F.when(F.col(key).isNull(), 0).otherwise(g * w + upto(near)).cast("int")


def index_in_place(df: DataFrame, key: str, name: str = "idx", start: int = 1, partitions: int | None = None) -> DataFrame:
    """``consecutive_index`` by one text column of rows that are the same whenever they are read (a snapshot's): no sorted
    copy is kept. The i-th partition holds the i-th range of keys.

    Bounds are those between some hundred keys a range, the ones with the smallest hashes (each key once, so a frequent one
    adds no more); the rows of each range are counted, and then dealt by range and numbered within it.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, df.count() // (n * SAMPLED_PER_RANGE))
    with freed_shuffles(df.sparkSession):
        keys = df.select(key).filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).distinct()
        seen = sorted(r[0] for r in keys.collect())
        bounds = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []
        ranged = df.withColumn("_range", _range_of(key, bounds)) if bounds else df.withColumn("_range", F.lit(0))
        offsets, _ = _offsets({r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()})
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    off = F.get(F.lit(offsets).cast("array<bigint>"), F.col("_range"))
    return ranged.repartitionById(n, "_range").withColumn(name, off + place + F.lit(start - 1)).drop("_range")


def request_prefix(as_of: str | dt.date) -> str:
    d = as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))
    return "REQ-" + d.strftime("%y%m%d")


def request_ids(batch: DataFrame, order: list[str | Column], existing: DataFrame, as_of,
                name: str = "req_id", rows: int = 0) -> DataFrame:
    """P25: ``REQ-yymmdd-NNN`` with the smallest unused suffixes >= 1, handed
    out in ``order``. Existing ids of that day are read from ``existing``;
    gaps are filled; suffixes above 999 keep all their digits. ``rows``: as many as ``batch`` may have, if
    that is known; it decides the number of partitions only.
    """
    spark = batch.sparkSession
    prefix = request_prefix(as_of)
    sfx = F.substring_index("req_id", "-", -1).try_cast("bigint")
    used = (existing.select("req_id").filter(F.col("req_id").startswith(prefix + "-"))
                    .select(sfx.alias("s"), "req_id")
                    .filter((F.col("s") >= 1) & (F.format_string(prefix + "-%03d", F.col("s")) == F.col("req_id")))
                    .select("s").distinct())
    ranked, n = indexed_with_count(batch, order, "_k", partitions=partitions_for(spark, rows))
    if n == 0:
        return ranked.drop("_k").withColumn(name, F.lit(None).cast("string"))
    m, last = used.agg(F.count("s"), F.coalesce(F.max("s"), F.lit(0))).first()
    if m == last:
        # Of that day, no id is taken or 1 to m without a gap: the k-th row gets suffix m + k, no join needed.
        return ranked.withColumn(name, F.format_string(prefix + "-%03d", F.col("_k") + F.lit(m))).drop("_k")
    cand = spark.range(1, m + n + 1).join(used, F.col("id") == F.col("s"), "left_anti")
    free = consecutive_index(cand, ["id"], "_k").filter(F.col("_k") <= n)
    return (ranked.join(free, "_k")
                  .withColumn(name, F.format_string(prefix + "-%03d", F.col("id")))
                  .drop("_k", "id"))
