"""Year x grant spend, margins and next-year projection.

Years are calendar years, so the date type bounds their number; they are read once as
metadata and expanded per grant with ``explode`` (no cross join of two
data-sized sides). Grants are not bounded and stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from labledger.operators.filters import assigned
from labledger.operators.reports import dsum, money


def year_grant_sums(df: DataFrame) -> DataFrame:
    """Spend per (year, grant) over dated rows with a grant (not null, not blank)."""
    return (df.filter(F.col("date_ordered").isNotNull() & assigned("grant"))
              .groupBy(F.year("date_ordered").alias("year"), "grant")
              .agg(F.sum(money("total")).alias("spend_dec")))


def _years(yg: DataFrame) -> list[int]:
    return sorted(r[0] for r in yg.select("year").distinct().collect())


def year_grant_grid(df: DataFrame) -> DataFrame:
    """J7 + A7 (long form): every (year, grant) of the pivot, zero-filled.

    Years and grants are those of the grouped (year, grant) sums, as in a pivot
    whose missing cells are filled with 0.

    One scan in the plan: each grant's (year -> spend) map holds at most one
    entry per calendar year, so it is built in one aggregation and every
    year of the bounded list is looked up in it (no join back).
    """
    yg = year_grant_sums(df)
    years = _years(yg)
    if not years:
        return yg.select("year", "grant", F.col("spend_dec").alias("spend_dec")).limit(0)
    per_grant = yg.groupBy("grant").agg(F.map_from_entries(F.collect_list(F.struct("year", "spend_dec"))).alias("_m"))
    return (per_grant.select("grant", "_m", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
                     .select("year", "grant", F.coalesce(F.col("_m")[F.col("year")], F.lit(0)).alias("spend_dec")))


def year_grant_pivot(df: DataFrame) -> DataFrame:
    """A7 long form: (year, grant, spend)."""
    return year_grant_grid(df).select("year", "grant", F.col("spend_dec").cast("double").alias("spend"))


def year_grant_wide(df: DataFrame, grants: list[str]) -> DataFrame:
    """A7 wide form: one column per listed grant."""
    yg = year_grant_sums(df)
    return (yg.groupBy("year").pivot("grant", grants).agg(F.sum("spend_dec").cast("double"))
              .fillna(0.0).orderBy("year"))


def year_grant_margins(df: DataFrame) -> DataFrame:
    """Cells, per-year totals, per-grant totals and the grand total.

    ``level`` is the grouping id: 0 cell, 1 year total, 2 grant total, 3 grand total. Dated spend without a grant is
    one explicit row with a null grant per year that has some (level 0) and over all (level 2), and part of the totals.
    """
    unassigned = (df.filter(F.col("date_ordered").isNotNull() & ~F.coalesce(assigned("grant"), F.lit(False)))
                    .groupBy(F.year("date_ordered").alias("year")).agg(F.sum(money("total")).alias("spend_dec"))
                    .select("year", F.lit(None).cast("string").alias("grant"), "spend_dec"))
    return (year_grant_grid(df).unionByName(unassigned).cube("year", "grant")
              .agg(F.grouping_id().alias("level"), F.sum("spend_dec").cast("double").alias("spend")))


def year_ordinal(df: DataFrame) -> DataFrame:
    """Position of each year among the years of the year x grant grid."""
    years = year_grant_sums(df).select("year").distinct()
    return years.select("year", (F.dense_rank().over(Window.orderBy("year")) - 1).alias("year_ordinal"))


def _year_facts(df: DataFrame) -> list[tuple[int, bool]]:
    """Each year with dated rows, and whether any of its rows has a grant
    (bounded by the calendar; one aggregation, collected)."""
    rows = (df.filter(F.col("date_ordered").isNotNull())
              .groupBy(F.year("date_ordered").alias("year"))
              .agg(F.bool_or(F.coalesce(assigned("grant"), F.lit(False))).alias("has_grant"))
              .collect())
    return sorted((int(r["year"]), bool(r["has_grant"])) for r in rows)


_PROJECTION_SCHEMA = ("grant string, current_year int, n_years bigint, last_spend double, projected double, "
                      "growth_pct double, trend string")


def _projection(df: DataFrame, facts: list[tuple[int, bool]]) -> DataFrame:
    years = [y for y, has_grant in facts if has_grant]
    if not years:
        return df.sparkSession.createDataFrame([], _PROJECTION_SCHEMA)
    current_year = max(y for y, _ in facts)
    k = len(years)
    ordinal = F.create_map(*[v for i, y in enumerate(years) for v in (F.lit(y), F.lit(i))])
    # Over the zero-filled grid every grant has all k years, so n, sum(x) and
    # sum(x^2) are the same for every grant and zero cells add nothing to
    # sum(y) or sum(x*y): the sums come straight from the (year, grant) sums.
    g = (year_grant_sums(df).withColumn("x", ordinal[F.col("year")])
           .groupBy("grant")
           .agg(F.sum("spend_dec").alias("sy"),
                F.sum(F.col("x").cast("decimal(10,0)") * F.col("spend_dec")).alias("sxy"),
                F.max("x").alias("_xmax"),
                F.max_by("spend_dec", "x").alias("_last"))
           .select("grant", "sy", "sxy",
                   F.lit(k).cast("bigint").alias("n"),
                   F.lit(sum(range(k))).cast("bigint").alias("sx"),
                   F.lit(sum(i * i for i in range(k))).cast("bigint").alias("sxx"),
                   F.when(F.col("_xmax") == k - 1, F.col("_last")).otherwise(F.lit(0)).alias("last_dec")))
    n = F.col("n").cast("double")
    sx = F.col("sx").cast("double")
    sy = F.col("sy").cast("double")
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    slope = num.cast("double") / den
    intercept = (sy - slope * sx) / n
    last = F.col("last_dec").cast("double")
    proj = F.when(F.col("n") >= 2, F.greatest(intercept + slope * n, F.lit(0.0))).otherwise(last)
    out = g.select("grant", F.col("n").alias("n_years"), last.alias("last_spend"), proj.alias("projected"))
    growth = F.when((F.col("n_years") >= 2) & (F.col("last_spend") > 0),
                    (F.col("projected") - F.col("last_spend")) / F.col("last_spend") * 100).otherwise(0.0)
    out = out.withColumn("growth_pct", growth)
    trend = F.when(F.col("growth_pct") > 5, "Up").when(F.col("growth_pct") < -5, "Down").otherwise("Stable")
    return (out.withColumn("trend", trend)
               .select("grant", F.lit(current_year).alias("current_year"), "n_years", "last_spend",
                       F.round("projected", 6).alias("projected"), F.round("growth_pct", 6).alias("growth_pct"),
                       "trend"))


def yearly_projection(df: DataFrame) -> DataFrame:
    """M9: next-year spend per grant by least squares on the year ordinal.

    x = ordinal of the year among the years with a grant, y = spend (0 for a
    year without spend of that grant). Sums are exact decimals; the closed
    form is then evaluated in double. Projection floored at 0; growth against
    the last year (0 when the last year is not positive); Up/Down/Stable at
    +-5 %. One year only -> same value, Stable. The years (bounded by the
    calendar) are read once; the plan itself is one aggregation.
    """
    return _projection(df, _year_facts(df))


def projection_total(df: DataFrame, assigned_only: bool = False) -> DataFrame:
    """Spend of the current year (all grants, or with ``assigned_only`` the assigned ones, as the projections have them)
    against the sum of the projections rounded to cents, and the change in percent."""
    facts = _year_facts(df)
    if not facts:
        return df.sparkSession.createDataFrame(
            [], "current_year int, total_current double, total_projected double, change_pct double")
    cy = max(y for y, _ in facts)
    proj = _projection(df, facts).agg(F.sum(F.round("projected", 2)).alias("total_projected"))
    # A date range (not year(date) = cy) so the filter reaches the parquet scan.
    this_year = F.col("date_ordered").between(F.lit(f"{cy:04d}-01-01").cast("date"), F.lit(f"{cy:04d}-12-31").cast("date"))
    shown = this_year & assigned("grant") if assigned_only else this_year
    tot = df.filter(shown).agg(F.lit(cy).alias("current_year"), dsum("total").alias("total_current"))
    j = tot.join(F.broadcast(proj), how="inner", on=F.lit(True))
    change = F.when(F.col("total_current") > 0,
                    (F.col("total_projected") - F.col("total_current")) / F.col("total_current") * 100).otherwise(0.0)
    return j.select("current_year", "total_current", F.round("total_projected", 6).alias("total_projected"),
                    F.round(change, 6).alias("change_pct"))
