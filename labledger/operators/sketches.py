"""Mergeable sketches for reports at scale: distinct vendors (A2) and quantiles (A24) without a second look at old rows.

A sketch table has one row per lab and month (or per lab). Tables of new rows are added with ``unionByName``; a view unites the
sketches that it covers. Both kinds are Spark's own aggregates, so they are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LG_REGISTERS = 14   # 2**14 registers: a relative standard error of 1.04 / 128
KLL_K = 4096


def distinct_error(lg_registers: int = LG_REGISTERS) -> float:
    """Relative standard error of a count of distinct values."""
    return 1.04 / 2 ** (lg_registers / 2)


def rank_error(k: int = KLL_K) -> float:
    """Rank error of a quantile sketch, as a share of the rows, that is exceeded with a probability of 1 %."""
    return 2.296 / k ** 0.9723


def vendor_sketches(orders: DataFrame, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """``(lab, month, orders, vendors)``: a sketch of the distinct vendors of each lab and month (null month: undated orders)."""
    month = F.trunc("date_ordered", "month").alias("month")
    return orders.groupBy("lab", month).agg(F.count(F.lit(1)).alias("orders"), F.hll_sketch_agg("vendor", lg_registers).alias("vendors"))


def distinct_vendors(sketches: DataFrame, labs: list[str] | None = None) -> DataFrame:
    """``(lab, orders, vendors)``: estimated distinct vendors of each lab and, with a null lab, of all ``labs`` (default: every one)."""
    shown = sketches if labs is None else sketches.filter(F.col("lab").isin(labs))
    united = [F.sum("orders").alias("orders"), F.hll_sketch_estimate(F.hll_union_agg("vendors")).alias("vendors")]
    whole = shown.agg(*united).filter("orders is not null").select(F.lit(None).cast("string").alias("lab"), "orders", "vendors")
    return shown.filter("lab is not null").groupBy("lab").agg(*united).unionByName(whole)


def quantile_sketches(df: DataFrame, col: str, by: str = "lab", k: int = KLL_K) -> DataFrame:
    """``(by, n, sketch)``: a quantile sketch of ``col`` for each group; null and NaN values are left out."""
    value = F.col(col).cast("double")
    return df.filter(value.isNotNull() & ~F.isnan(value)).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def sketch_cut(sketches: DataFrame, q: float, by: str = "lab", k: int = KLL_K) -> DataFrame:
    """``(by, n, cut)``: the ``q`` quantile of each group and, with a null group, of all; its rank is off by ``rank_error(k)`` of the rows."""
    merged = [F.sum("n").alias("n"), F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("sketch", F.lit(k)), F.lit(q)).alias("cut")]
    whole = sketches.agg(*merged).filter("n is not null").select(F.lit(None).cast("string").alias(by), "n", "cut")
    return sketches.filter(F.col(by).isNotNull()).groupBy(by).agg(*merged).unionByName(whole)


def contamination_cut_sketch(df: DataFrame, col: str, contamination: float = 0.1, by: str = "lab") -> DataFrame:
    """A24 at scale: the cut of each lab and of all from one pass, in place of the exact search over several."""
    return sketch_cut(quantile_sketches(df, col, by), contamination, by)
