"""Sketches: error bounds against exact results, and merging as if all rows had been there at once."""

import pytest
from pyspark.sql import functions as F

from labledger.operators import reports as rep
from labledger.operators import sketches as sk
from labledger.operators import yearly as yr
from labledger.sources.store import order_table
from conftest import SMALL


@pytest.fixture(scope="module")
def rows(spark):
    """Skewed values; lab ``hot`` holds most rows; some are null."""
    k = F.col("id")
    return spark.range(200_000).select(
        F.when(k % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("lab"), (k % 5).cast("string"))).alias("lab"),
        F.when(k % 97 > 0, F.pmod(F.xxhash64("id"), F.lit(30_000)).cast("string")).alias("vendor"),
        F.when(k % 89 > 0, F.exp(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 1000)).alias("total"),
        F.date_add(F.lit("2001-01-01").cast("date"), (k % 400).cast("int")).alias("date_ordered"))


def test_distinct_vendors_within_the_error(rows):
    exact = {r["lab"]: r["c"] for r in rows.groupBy("lab").agg(F.count_distinct("vendor").alias("c")).collect()}
    exact[None] = rows.agg(F.count_distinct("vendor")).first()[0]
    got = {r["lab"]: (r["orders"], r["vendors"]) for r in sk.distinct_vendors(sk.vendor_sketches(rows)).collect()}
    assert got.keys() == exact.keys() and got[None][0] == 200_000
    assert all(abs(got[x][1] - exact[x]) <= 4 * sk.distinct_error() * exact[x] for x in exact)


def test_sketches_of_parts_merge(rows):
    whole = sk.vendor_sketches(rows)
    parts = sk.vendor_sketches(rows.filter("date_ordered < '2001-07-15'")).unionByName(sk.vendor_sketches(rows.filter("date_ordered >= '2001-07-15'")))
    a, b = ({r["lab"]: (r["orders"], r["vendors"]) for r in sk.distinct_vendors(x, ["hot", "lab1"]).collect()} for x in (whole, parts))
    assert a.keys() == b.keys() == {"hot", "lab1", None} and all(a[x][0] == b[x][0] and abs(a[x][1] - b[x][1]) <= 4 * sk.distinct_error() * a[x][1] for x in a)


def test_cut_within_the_rank_error(rows):
    halves = [rows.filter(F.col("date_ordered") < "2001-07-01"), rows.filter(F.col("date_ordered") >= "2001-07-01")]
    merged = sk.quantile_sketches(halves[0], "total").unionByName(sk.quantile_sketches(halves[1], "total"))
    for sketches in (sk.quantile_sketches(rows, "total"), merged):
        for q in (0.1, 0.5, 0.99):
            for r in sk.sketch_cut(sketches, q).collect():
                own = rows.filter("total is not null" if r["lab"] is None else f"lab = '{r['lab']}' and total is not null")
                n, below, upto = own.agg(F.count(F.lit(1)), F.count_if(F.col("total") < r["cut"]), F.count_if(F.col("total") <= r["cut"])).first()
                off = 3 * sk.rank_error() * n
                assert r["n"] == n and below - off <= q * n <= upto + off


def test_empty(rows):
    none = rows.filter("lab = 'x'")
    assert sk.distinct_vendors(sk.vendor_sketches(none)).count() == 0 and sk.contamination_cut_sketch(none, "total").count() == 0


def test_owner_labs(spark):
    owners = spark.createDataFrame([("a@x.org",), ("b@Y.org",), ("c@z.org",), ("admin@x.org",), ("nobody",), (None,)], "email string")
    labs = spark.createDataFrame([("x.org", "B"), ("x.org", "A"), ("y.ORG", "Y lab"), (None, "none")], "domain string, lab string")
    got = {r["email"]: r["lab"] for r in rep.owner_labs(owners, "email", labs, "admin@x.org").collect()}
    assert got == {"a@x.org": "A", "b@Y.org": "Y lab", "c@z.org": "Z Lab", "admin@x.org": "Admin", "nobody": "Unknown Lab", None: got[None]}


def test_projection_total_of_assigned_grants(spark):
    t = order_table(spark, SMALL)
    every, own = yr.projection_total(t).first(), yr.projection_total(t, assigned_only=True).first()
    want = t.filter(f"year(date_ordered) = {own['current_year']} and `grant` is not null").agg(F.sum("total").cast("double")).first()[0]
    assert own["total_current"] == pytest.approx(want) and own["total_current"] <= every["total_current"] and own["total_projected"] == every["total_projected"]
