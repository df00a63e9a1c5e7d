"""KPIs, grouped spend reports, top-k lists.

Money is summed as decimal (exact, so partial/final aggregation order never
changes the answer) and cast to double only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labledger.functions.clean import owner_to_lab
from labledger.operators.filters import assigned, is_pending


def money(c: Column | str) -> Column:
    """Coerced amount: null -> 0 (the original fills unparsable totals with 0)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0))


def dsum(c: Column | str) -> Column:
    """Exact decimal sum, returned as double."""
    return F.sum(money(c)).cast("double")


def kpi_overview(df: DataFrame) -> DataFrame:
    """A1: orders, spend, pending, received."""
    return df.agg(
        F.count(F.lit(1)).alias("orders"),
        dsum("total").alias("spend"),
        F.count_if(is_pending()).alias("pending"),
        F.count_if(~is_pending()).alias("received"),
    )


def kpi_analytics(df: DataFrame, approx: bool = False) -> DataFrame:
    """A2: A1 plus the number of distinct vendors (null not counted)."""
    vendors = F.approx_count_distinct("vendor") if approx else F.count_distinct("vendor")
    return df.agg(
        F.count(F.lit(1)).alias("orders"),
        dsum("total").alias("spend"),
        vendors.alias("vendors"),
        F.count_if(is_pending()).alias("pending"),
    )


def owner_labs(df: DataFrame, email: str, labs: DataFrame, admin_email: str) -> DataFrame:
    """P17 with a table ``labs(domain, lab)``: ``df`` with the ``lab`` of each owner. A domain in the table gives its lab (of several, the first
    by name); others are named as ``owner_to_lab`` does. The planner broadcasts the table while it is small."""
    domain = F.lower(F.split_part(email, F.lit("@"), F.lit(2)))
    table = labs.groupBy(F.lower("domain").alias("_domain")).agg(F.min("lab").alias("_lab")).filter("_domain is not null")
    plain = owner_to_lab(email, admin_email, None, None)
    found = df.drop("lab").withColumn("_domain", domain).join(table, "_domain", "left")
    return found.withColumn("lab", F.when(F.col(email) == admin_email, plain).otherwise(F.coalesce("_lab", plain))).drop("_domain", "_lab")


def spend_by_grant(df: DataFrame) -> DataFrame:
    """A3: spend and order count per assigned grant, largest first."""
    return (df.filter(assigned("grant"))
              .groupBy("grant")
              .agg(dsum("total").alias("total_spent"), F.count("req_id").alias("orders"))
              .orderBy(F.desc("total_spent"), "grant"))


def assigned_spend_total(df: DataFrame) -> DataFrame:
    """A4: spend over rows with a grant."""
    return df.filter(assigned("grant")).agg(dsum("total").alias("assigned_total"))


def spend_by_project(df: DataFrame) -> DataFrame:
    """A5: spend per (project, grant); rows without project or grant are dropped."""
    return (df.filter(assigned("rf_project") & F.col("grant").isNotNull())
              .groupBy("rf_project", "grant")
              .agg(dsum("total").alias("total_spent"), F.count("req_id").alias("orders"))
              .orderBy(F.desc("total_spent"), "rf_project", "grant"))


def split_summary(df: DataFrame) -> DataFrame:
    """Orders with a split, their share of all orders (percent) and their spend."""
    has = assigned("split_pct")
    agg = df.agg(
        F.count_if(has).alias("split_orders"),
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.when(has, money("total"))).cast("double").alias("split_total"),
    )
    share = F.when(F.col("total_orders") > 0,
                   F.col("split_orders").cast("double") / F.col("total_orders").cast("double") * 100).otherwise(0.0)
    return agg.select("split_orders", "total_orders", share.alias("split_share_pct"),
                      F.coalesce("split_total", F.lit(0.0)).alias("split_total"))


def top_counts(df: DataFrame, key: str, n: int = 8) -> DataFrame:
    """The n most frequent non-null values, ties broken by value."""
    return (df.filter(F.col(key).isNotNull())
              .groupBy(key).agg(F.count(F.lit(1)).alias("orders"))
              .orderBy(F.desc("orders"), key).limit(n))


def top_items(df: DataFrame, n: int = 8) -> DataFrame:
    return top_counts(df, "item", n)


def top_vendors(df: DataFrame, n: int = 8) -> DataFrame:
    return top_counts(df, "vendor", n)


def year_total(df: DataFrame, year: int | None = None) -> DataFrame:
    """Spend in the newest year with dated rows (all grants, even unassigned)."""
    dated = df.filter(F.col("date_ordered").isNotNull()).withColumn("year", F.year("date_ordered"))
    if year is None:
        # One scan: per-year sums (bounded by the calendar), then the newest.
        per_year = dated.groupBy("year").agg(F.sum(money("total")).alias("_s"))
        return (per_year.agg(F.max("year").alias("current_year"),
                             F.max_by("_s", "year").cast("double").alias("year_total"))
                        .filter(F.col("current_year").isNotNull()))
    return dated.filter(F.col("year") == year).agg(F.lit(year).alias("current_year"), dsum("total").alias("year_total"))


def missing_price_check(df: DataFrame, total_col: str = "total") -> DataFrame:
    """Rows exist but every total is 0 / missing."""
    return (df.agg(F.count(F.lit(1)).alias("rows"), dsum(total_col).alias("total_sum"))
              .withColumn("has_price_issue", (F.col("total_sum") == 0) & (F.col("rows") > 0)))


def column_profile(df: DataFrame, cols=("qty", "unit_price", "total")) -> DataFrame:
    """Type, non-null count and sum of each numeric column, one row per column.

    One aggregation pass over all columns, then an unpivot of the single row.
    """
    types = dict(df.dtypes)
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"n__{c}"), F.sum(c).cast("double").alias(f"s__{c}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                     F.col(f"n__{c}").alias("non_null"), F.col(f"s__{c}").alias("col_sum")) for c in cols]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def truncate_text(c: Column | str, n: int) -> Column:
    """Cut to n characters and add an ellipsis when longer."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def status(c="date_received", text: bool = False) -> Column:
    """P2 receipt status; ``text``: of a raw text column, where blank counts as not received."""
    return F.when(is_pending(c, text), "Pending").otherwise("Received")


def recent_orders(df: DataFrame, n: int = 5) -> DataFrame:
    """K1: newest n orders by order date (null dates last), ties by id."""
    return (df.orderBy(F.col("date_ordered").desc_nulls_last(), "req_id").limit(n)
              .select("req_id", truncate_text("item", 50).alias("item"), "vendor",
                      F.col("total").cast("double").alias("total"), status().alias("status")))


def pending_top(df: DataFrame, n: int = 5) -> DataFrame:
    """K2: first n pending orders and how many more are pending.

    The count comes from one global aggregate (a single row) joined by
    broadcast onto at most n rows.
    """
    p = df.filter(is_pending())
    head = p.orderBy("req_id").limit(n).select(
        "req_id", F.substring("item", 1, 40).alias("item"), "date_ordered")
    cnt = p.agg(F.count(F.lit(1)).alias("pending_total"))
    return (head.join(F.broadcast(cnt), how="inner", on=F.lit(True))
                .withColumn("more_pending", F.greatest(F.col("pending_total") - n, F.lit(0))))


def ranked(df: DataFrame, order: list, n: int = 5) -> DataFrame:
    """K3: a report sorted with an explicit tie-break, first n rows."""
    return df.orderBy(*order).limit(n)


def monthly_spend(df: DataFrame) -> DataFrame:
    """Spend per calendar month (months with data only)."""
    return (df.filter(F.col("date_ordered").isNotNull() & F.col("total").isNotNull())
              .groupBy(F.date_format("date_ordered", "yyyy-MM").alias("month"))
              .agg(F.sum("total").cast("double").alias("spend")))


def grant_spend_all_time(df: DataFrame) -> DataFrame:
    """Spend per grant over dated rows with a total; null grants dropped."""
    return (df.filter(F.col("date_ordered").isNotNull() & F.col("total").isNotNull() & F.col("grant").isNotNull())
              .groupBy("grant").agg(F.sum("total").cast("double").alias("spend")))
