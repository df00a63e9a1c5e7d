"""Order gaps, reorder dates, spend and demand forecasts.

Skew: a single item may hold a third of all rows. Nothing here windows over
raw rows of an item. Row-level work is done by aggregations with map-side
combine; windows run only over pre-aggregated, calendar-bounded series
(distinct days, weeks or months of one key).
"""

from __future__ import annotations

from labledger.functions.numeric import np_round
from pyspark.sql import Column, DataFrame, Window, functions as F


# Smoothing factor, urgency thresholds (days) and trend words.
ALPHA = 0.3
URGENT_DAYS = 7
SOON_DAYS = 30


def days_between_orders(df: DataFrame, key: str = "item") -> DataFrame:
    """Whole days since the previous order of the same key (null for the first).

    Rows sharing a date are ordered by ``req_id``; only the first of them gets
    the gap to the previous date, the others 0. The lag runs over the distinct
    (key, date) pairs, whose number per key is bounded by the calendar, and is
    joined back to the rows (AQE splits a hot key on the row side).
    """
    dated = df.filter(F.col("date_ordered").isNotNull())
    days = dated.groupBy(key, "date_ordered").agg(F.min("req_id").alias("_first_req"))
    w = Window.partitionBy(key).orderBy("date_ordered")
    days = days.withColumn("_prev", F.lag("date_ordered").over(w))
    j = dated.join(days, [key, "date_ordered"])
    gap = F.when(F.col("req_id") == F.col("_first_req"),
                 F.datediff("date_ordered", "_prev")).otherwise(F.lit(0))
    return j.select("req_id", key, "date_ordered", gap.alias("days_diff"))


def item_order_gap(df: DataFrame) -> DataFrame:
    """Mean whole-day gap between successive orders and the last order date.

    The successive gaps of a sorted series telescope: their sum is
    last - first, so the mean is (last - first) / (dated rows - 1). One
    aggregation, no window.
    """
    g = df.groupBy("item").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("date_ordered").alias("n_dated"),
        F.min("date_ordered").alias("first_order"),
        F.max("date_ordered").alias("last_order"))
    mean_gap = F.when(F.col("n_dated") >= 2,
                      F.datediff("last_order", "first_order").cast("double") / (F.col("n_dated") - 1).cast("double"))
    return g.select("item", "n_rows", "last_order", mean_gap.alias("mean_gap_days"))


def urgency(days: Column) -> Column:
    """P20."""
    return F.when(days <= URGENT_DAYS, "Urgent").when(days <= SOON_DAYS, "Soon").otherwise("Normal")


def usual_vendor(df: DataFrame, key: str = "item") -> DataFrame:
    """Most frequent non-null vendor per key, ties to the smallest name.

    Two aggregations with map-side combine: (key, vendor) counts, then the
    minimum of (-count, vendor) per key.
    """
    c = (df.filter(F.col("vendor").isNotNull())
           .groupBy(key, "vendor").agg(F.count(F.lit(1)).alias("_n")))
    return c.groupBy(key).agg(
        F.min_by("vendor", F.struct((-F.col("_n")).alias("a"), F.col("vendor").alias("b"))).alias("usual_vendor"))


def reorder_predictions(df: DataFrame, as_of: str) -> DataFrame:
    """M1: per item with >= 2 rows and a defined mean gap: predicted reorder
    date, days until then (floored, at least 0), mean quantity (1 dp), usual
    vendor (Unknown when none), mean gap (1 dp) and urgency; sorted by days.

    ``as_of`` replaces "now" (a midnight date). Since order dates are whole
    days, last + mean gap floors to last + floor(mean gap).
    """
    per_vendor = df.filter(F.col("item").isNotNull()).groupBy("item", "vendor").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("date_ordered").alias("nd"),
        F.min("date_ordered").alias("d0"),
        F.max("date_ordered").alias("d1"),
        F.sum(F.col("qty").cast("decimal(24,4)")).alias("sq"),
        F.count("qty").alias("nq"))
    key = F.struct((-F.col("n")).alias("a"), F.col("vendor").alias("b"))
    g = per_vendor.groupBy("item").agg(
        F.sum("n").alias("n_rows"),
        F.sum("nd").alias("n_dated"),
        F.min("d0").alias("first_order"),
        F.max("d1").alias("last_order"),
        F.sum("sq").alias("sum_qty"),
        F.sum("nq").alias("n_qty"),
        F.min_by(F.col("vendor"), F.when(F.col("vendor").isNotNull(), key)).alias("usual_vendor"))
    g = g.filter((F.col("n_rows") >= 2) & (F.col("n_dated") >= 2))
    span = F.datediff("last_order", "first_order")
    avg_days = span.cast("double") / (F.col("n_dated") - 1).cast("double")
    whole = F.floor(avg_days).cast("int")
    days_until = F.greatest(F.datediff("last_order", F.lit(as_of).cast("date")) + whole, F.lit(0))
    out = g.select(
        "item",
        F.date_add("last_order", whole).alias("predicted_reorder_date"),
        days_until.alias("days_until_reorder"),
        np_round(F.col("sum_qty").cast("double") / F.col("n_qty").cast("double"), 1).alias("avg_quantity"),
        F.coalesce("usual_vendor", F.lit("Unknown")).alias("recommended_vendor"),
        np_round(avg_days, 1).alias("order_frequency_days"))
    return (out.withColumn("urgency", urgency(F.col("days_until_reorder")))
               .orderBy("days_until_reorder", "item"))


def _monthly(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("date_ordered").isNotNull() & F.col("total").isNotNull())
              .groupBy(F.trunc("date_ordered", "month").alias("month"))
              .agg(F.sum("total").alias("spend_dec")))


def spend_moving_avg(df: DataFrame) -> DataFrame:
    """Rolling mean of monthly spend over min(3, months) months with data,
    null until the window is full. The series has one row per month (bounded)."""
    m = _monthly(df)
    w = Window.orderBy("month")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    win = F.least(F.col("m"), F.lit(3))
    ranked = m.select("*", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(whole).alias("m"))
    s = F.col("spend_dec")
    s1, s2 = F.lag(s, 1).over(w), F.lag(s, 2).over(w)
    total = F.when(win == 1, s).when(win == 2, s + s1).otherwise(s + s1 + s2)
    ma = F.when(F.col("rn") >= win, total.cast("double") / win.cast("double"))
    return ranked.select(F.date_format("month", "yyyy-MM").alias("month"),
                         s.cast("double").alias("spend"), ma.alias("moving_avg"))


def spend_recent_trend(df: DataFrame) -> DataFrame:
    """(last - third-last) / 3 over the last three months with data (3+ months)."""
    m = _monthly(df).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("month"))))
    agg = m.agg(F.count(F.lit(1)).alias("n_months"),
                F.sum(F.when(F.col("rn") == 1, F.col("spend_dec"))).alias("last"),
                F.sum(F.when(F.col("rn") == 3, F.col("spend_dec"))).alias("third_last"))
    trend = F.when(F.col("n_months") >= 3,
                   (F.col("last").cast("double") - F.col("third_last").cast("double")) / 3)
    return agg.select("n_months", trend.alias("trend"))


def spend_forecast(df: DataFrame, months: int = 3) -> DataFrame:
    """M2: the next ``months`` months of spend.

    base = mean of the last min(3, m) monthly sums; with 3+ months month i adds
    trend * i, trend = (last - third-last) / 3; flat with exactly 2 months. With
    fewer than 2 months there is one row without a month: total = all spend,
    monthly_avg = mean per order.
    """
    base = df.filter(F.col("date_ordered").isNotNull() & F.col("total").isNotNull())
    # One scan: the all-orders total and count are sums of the monthly ones
    # (exact decimals, so the sum of sums is the same number).
    m = (base.groupBy(F.trunc("date_ordered", "month").alias("month"))
             .agg(F.sum("total").alias("s"), F.count(F.lit(1)).alias("c"))
             .withColumn("rn", F.row_number().over(Window.orderBy(F.desc("month")))))
    j = m.agg(F.count(F.lit(1)).alias("m"),
              F.sum(F.when(F.col("rn") <= 3, F.col("s"))).alias("s_win"),
              F.sum(F.when(F.col("rn") == 1, F.col("s"))).alias("s_last"),
              F.sum(F.when(F.col("rn") == 3, F.col("s"))).alias("s_third"),
              F.max("month").alias("last_month"),
              F.sum("s").alias("all_total"),
              F.sum("c").alias("n_orders"))
    win = F.least(F.col("m"), F.lit(3)).cast("double")
    avg = F.col("s_win").cast("double") / win
    trend = F.when(F.col("m") >= 3, (F.col("s_last").cast("double") - F.col("s_third").cast("double")) / 3).otherwise(0.0)
    j = j.select("m", "last_month", "all_total", "n_orders", avg.alias("avg"), trend.alias("trend"))
    N = int(months)
    horizons = F.when(F.col("m") >= 2, F.sequence(F.lit(1), F.lit(N)))
    e = j.select("*", F.explode_outer(horizons).alias("horizon"))
    amount = F.col("avg") + F.col("trend") * F.col("horizon").cast("double")
    total_fc = F.when(F.col("m") >= 2,
                      F.col("avg") * float(N) + F.col("trend") * float(N * (N + 1) // 2)).otherwise(
        F.col("all_total").cast("double"))
    monthly_avg = F.when(F.col("m") >= 2, F.col("avg")).otherwise(
        F.col("all_total").cast("double") / F.col("n_orders").cast("double"))
    return e.select(
        F.col("m").alias("n_months"),
        "horizon",
        F.date_format(F.add_months("last_month", F.col("horizon")), "yyyy-MM").alias("forecast_month"),
        F.round(amount, 6).alias("amount"),
        F.round(monthly_avg, 6).alias("monthly_avg"),
        F.round(total_fc, 6).alias("total_forecast"))


def repeated_sum(x: Column, n: int) -> Column:
    """x added n times in sequence (the total of n equal future weeks)."""
    return F.aggregate(F.array_repeat(x, n), F.lit(0.0), lambda acc, v: acc + v)


def weekly_order_count(df: DataFrame) -> DataFrame:
    """Rows per (item, Monday-start week) for all items in one pass."""
    return (df.filter(F.col("date_ordered").isNotNull())
              .groupBy("item", F.date_trunc("week", "date_ordered").cast("date").alias("week"))
              .agg(F.count(F.lit(1)).alias("orders")))


def demand_forecast(df: DataFrame, days_ahead: int = 90, min_weeks: int = 4) -> DataFrame:
    """M7: exponential smoothing (alpha 0.3, seeded with the first week) of
    weekly order counts, for every item and for all items together.

    The weekly series of one key is bounded by the calendar (one entry per
    week with data), so it is gathered per key and folded in week order,
    which reproduces the recursive formula exactly. Keys with fewer than
    ``min_weeks`` weeks report ``insufficient``.
    """
    weekly = (df.filter(F.col("date_ordered").isNotNull())
                .withColumn("week", F.date_trunc("week", "date_ordered").cast("date"))
                .groupingSets([["item", "week"], ["week"]], "item", "week")
                .agg(F.count(F.lit(1)).alias("y"), F.grouping_id().alias("gid")))
    series = weekly.groupBy("gid", "item").agg(
        F.array_sort(F.collect_list(F.struct("week", F.col("y").cast("double").alias("y")))).alias("s"))
    first = F.col("s")[0]["y"]
    level = F.aggregate(F.slice("s", 2, 1 << 30), first,
                        lambda acc, x: F.lit(ALPHA) * x["y"] + F.lit(1 - ALPHA) * acc)
    weeks_ahead = days_ahead // 7
    out = series.select(
        F.when(F.col("gid") == 0, "item").otherwise("all").alias("scope"),
        "item",
        F.size("s").alias("n_weeks"),
        level.alias("level"),
        first.alias("first"))
    ok = F.col("n_weeks") >= min_weeks
    return out.filter((F.col("scope") == "all") | F.col("item").isNotNull()).select(
        "scope", "item", "n_weeks",
        F.when(ok, "ok").otherwise("insufficient").alias("status"),
        F.when(ok, np_round("level", 2)).alias("current_weekly_avg"),
        F.when(ok, np_round(repeated_sum(F.col("level"), weeks_ahead), 0)).alias("predicted_total"),
        F.when(ok, F.when(F.col("level") > F.col("first"), "increasing").otherwise("decreasing")).alias("trend"))
