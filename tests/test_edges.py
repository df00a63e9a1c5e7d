"""Literal edge tables (5-20 rows) with hand-computed expectations."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from labledger.functions import clean as cl
from labledger.operators import filters as flt
from labledger.operators import forecast as fc
from labledger.operators import maintenance as mt
from labledger.operators import reports as rep
from labledger.operators import sourcing as src
from labledger.operators import yearly as yr
from labledger.operators.numbering import consecutive_index, request_ids


def col_of(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_status_and_pending(spark):
    df = spark.createDataFrame([("a", "2001-01-01"), ("b", None), ("c", "")], "id string, date_received string")
    got = dict(df.select("id", rep.status("date_received", text=True)).collect())
    assert got == {"a": "Received", "b": "Pending", "c": "Pending"}
    assert flt.pending_orders(df).count() == 2
    assert flt.received_orders(df).count() == 1


def test_item_names(spark):
    long = "x" * 120
    df = spark.createDataFrame([("A - B - C",), ("no separator",), (long,), (None,), ("ab",), ("  pad  - Pkg",)], "item string")
    got = col_of(df.select(cl.clean_item_name("item").alias("c")), "c")
    assert got == ["A", "no separator", "x" * 100, "", "ab", "pad"]
    named = flt.named_lines(df.select(cl.clean_item_name("item").alias("item")), "item", 3)
    assert sorted(col_of(named, "item")) == sorted(["no separator", "x" * 100, "pad"])


def test_integer_ids(spark):
    df = spark.createDataFrame([("118490.0",), ("118490",), ("",), ("abc",), (None,), ("-7.9",)], "g string")
    assert col_of(df.select(cl.integer_id_text("g").alias("x")), "x") == ["118490", "118490", "", None, "", "-7"]


def test_pack_qty(spark):
    df = spark.createDataFrame([("12 EA",), ("3CS",), ("",), ("x",), (None,), ("nan",)], "q string")
    assert col_of(df.select(cl.parse_pack_qty("q").alias("x")), "x") == [12.0, 3.0, 1.0, 1.0, 1.0, 1.0]


def test_split_percent(spark):
    df = spark.createDataFrame([("50",), ("2.5",), ("3.5",), ("50%",), (None,), ("0.4",)], "s string")
    assert col_of(df.select(cl.split_percent_text("s").alias("x")), "x") == ["50%", "2%", "4%", "", "", "0%"]


def test_vendor_and_dates(spark):
    df = spark.createDataFrame([("Acme Contract no value",), ("Plain",), (None,)], "v string")
    assert col_of(df.select(cl.clean_vendor("v").alias("x")), "x") == ["Acme", "Plain", ""]
    d = spark.createDataFrame([("2001-08-01 00:00:00",), ("08/01/2001",), ("not a date",), (None,)], "d string")
    out = d.select(cl.coerce_date(cl.normalize_date_text("d")).alias("x"))
    assert col_of(out, "x") == [date(2001, 8, 1), date(2001, 8, 1), None, None]


def test_origin_notes(spark):
    df = spark.createDataFrame([("Original Req#: 12",), ("Original Req#: 12.0",),
                                ("Original Req#: 7. Original Req#: 8",), ("none",), (None,)], "n string")
    assert col_of(df.select(cl.extract_origin_req("n").alias("x")), "x") == ["12", "12", "7", None, None]
    ids = spark.createDataFrame([("12.0",), ("  5 ",), ("*",), ("nan",), (None,)], "r string")
    assert col_of(ids.select(cl.origin_note("r").alias("x")), "x") == [
        "Original Req#: 12.0", "Original Req#: 5", "", "", ""]
    assert col_of(ids.select(cl.origin_key("r").alias("x")), "x")[0] == "12"


def test_request_ids_fill_gaps(spark, orders_df):
    existing = orders_df([{"req_id": f"REQ-010802-{s}"} for s in ["001", "003", "999", "1000"]] +
                         [{"req_id": "REQ-010801-002"}, {"req_id": "REQ-010802-02"}])
    batch = spark.createDataFrame([(i,) for i in (30, 10, 20)], "line bigint")
    got = request_ids(batch, ["line"], existing, "2001-08-02").orderBy("line").collect()
    assert [r["req_id"] for r in got] == ["REQ-010802-002", "REQ-010802-004", "REQ-010802-005"]


def test_request_ids_never_truncate(spark, orders_df):
    existing = orders_df([{"req_id": f"REQ-010802-{s:03d}"} for s in range(1, 1000)])
    batch = spark.createDataFrame([(1,), (2,)], "line bigint")
    got = [r["req_id"] for r in request_ids(batch, ["line"], existing, "2001-08-02").orderBy("line").collect()]
    assert got == ["REQ-010802-1000", "REQ-010802-1001"]


def test_request_ids_first_of_day(spark, orders_df):
    # no id of the as-of day is taken (only other days'): suffixes 1..n in order
    existing = orders_df([{"req_id": "REQ-010801-001"}, {"req_id": "L1-1"}])
    batch = spark.range(0, 1200, 1, 5).select((F.col("id") * 7 % 1200).alias("line"))
    got = request_ids(batch, ["line"], existing, "2001-08-02").collect()
    assert sorted((r["line"], r["req_id"]) for r in got) == [(i, f"REQ-010802-{i + 1:03d}") for i in range(1200)]


def test_consecutive_index(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    out = consecutive_index(df, ["k"], "i", start=1)
    rows = out.collect()
    assert sorted(r["i"] for r in rows) == list(range(1, 5001))
    assert all(r["i"] == r["k"] + 1 for r in rows)


def test_validation_first_rule_wins(spark):
    df = spark.createDataFrame([("", 1.0, 1.0, "v"), ("i", 0.0, 1.0, "v"), ("i", 1.0, 0.0, "v"),
                                ("i", 1.0, 1.0, " "), ("", 0.0, 0.0, ""), ("i", 2.0, 3.0, "v")],
                               "item string, qty double, unit_price double, vendor string")
    assert col_of(flt.validate_orders(df), "reason") == [
        "Item name is required", "Quantity must be greater than 0", "Price must be greater than 0",
        "Vendor name is required", "Item name is required", "OK"]


def test_reorder_edges(spark, orders_df):
    rows = [
        {"item": "A", "date_ordered": "2001-07-01", "qty": 1, "vendor": "V"},
        {"item": "B", "date_ordered": "2001-07-01", "qty": 1, "vendor": "V"},
        {"item": "B", "date_ordered": None, "qty": 1, "vendor": "V"},
        {"item": "C", "date_ordered": "2001-07-01", "qty": 1, "vendor": "V"},
        {"item": "C", "date_ordered": "2001-07-01", "qty": 3, "vendor": "V"},
        {"item": "D", "date_ordered": "2001-07-01", "qty": 1, "vendor": None},
        {"item": "D", "date_ordered": "2001-07-31", "qty": 1, "vendor": None},
        {"item": "E", "date_ordered": "2001-01-01", "qty": 1, "vendor": "Zed"},
        {"item": "E", "date_ordered": "2001-03-02", "qty": 1, "vendor": "Acme"},
        {"item": "E", "date_ordered": "2001-05-01", "qty": 1, "vendor": None},
        {"item": "H", "date_ordered": "2001-06-01", "qty": 1, "vendor": "V"},
        {"item": "H", "date_ordered": "2001-07-17", "qty": 2, "vendor": "V"},
        {"item": "H", "date_ordered": "2001-08-01", "qty": 4, "vendor": "W"},
    ]
    got = {r["item"]: r for r in fc.reorder_predictions(orders_df(rows), "2001-08-02").collect()}
    assert set(got) == {"C", "D", "E", "H"}
    assert got["C"]["predicted_reorder_date"] == date(2001, 7, 1) and got["C"]["days_until_reorder"] == 0
    assert got["C"]["urgency"] == "Urgent" and got["C"]["avg_quantity"] == 2.0
    assert got["D"]["recommended_vendor"] == "Unknown" and got["D"]["days_until_reorder"] == 28
    assert got["D"]["urgency"] == "Soon"
    assert got["E"]["recommended_vendor"] == "Acme" and got["E"]["order_frequency_days"] == 60.0
    assert got["H"]["predicted_reorder_date"] == date(2001, 8, 31)
    assert got["H"]["days_until_reorder"] == 29 and got["H"]["order_frequency_days"] == 30.5
    assert got["H"]["avg_quantity"] == 2.3 and got["H"]["recommended_vendor"] == "V"
    gaps = {r["req_id"]: r["days_diff"] for r in fc.days_between_orders(orders_df(rows)).collect()}
    assert gaps["R0011"] == 46 and gaps["R0012"] == 15 and gaps["R0010"] is None
    assert sorted([gaps["R0003"], gaps["R0004"]], key=lambda v: (v is not None, v)) == [None, 0]


def _months(orders_df, amounts):
    return orders_df([{"date_ordered": d, "total": t} for d, t in amounts])


def test_spend_forecast_three_months_with_gap(orders_df):
    df = _months(orders_df, [("2001-01-05", 100), ("2001-02-05", 150), ("2001-02-06", 50), ("2001-04-05", 400)])
    rows = fc.spend_forecast(df, 3).orderBy("horizon").collect()
    assert [r["forecast_month"] for r in rows] == ["2001-05", "2001-06", "2001-07"]
    assert [r["amount"] for r in rows] == pytest.approx([333.333333, 433.333333, 533.333333])
    assert rows[0]["total_forecast"] == pytest.approx(1300.0)
    assert rows[0]["monthly_avg"] == pytest.approx(233.333333)


def test_spend_forecast_two_and_one_month(orders_df):
    two = fc.spend_forecast(_months(orders_df, [("2001-01-05", 100), ("2001-02-05", 300)]), 3).collect()
    assert [r["amount"] for r in two] == [200.0, 200.0, 200.0] and two[0]["total_forecast"] == 600.0
    one = fc.spend_forecast(_months(orders_df, [("2001-01-05", 100), ("2001-01-09", 50)]), 3).collect()
    assert len(one) == 1 and one[0]["horizon"] is None
    assert one[0]["total_forecast"] == 150.0 and one[0]["monthly_avg"] == 75.0


def test_moving_average_and_trend(orders_df):
    df = _months(orders_df, [("2001-01-05", 100), ("2001-02-05", 200), ("2001-04-05", 400), ("2001-05-05", 700)])
    ma = {r["month"]: r["moving_avg"] for r in fc.spend_moving_avg(df).collect()}
    assert ma["2001-01"] is None and ma["2001-02"] is None
    assert ma["2001-04"] == pytest.approx(700 / 3) and ma["2001-05"] == pytest.approx(1300 / 3)
    tr = fc.spend_recent_trend(df).collect()[0]
    assert tr["trend"] == pytest.approx((700 - 200) / 3)


def test_demand_smoothing(orders_df):
    # Mondays of five consecutive weeks, counts 4, 7, 1, 9, 3
    weeks = ["2001-07-02", "2001-07-09", "2001-07-16", "2001-07-23", "2001-07-30"]
    rows = [{"item": "W", "date_ordered": w} for w, n in zip(weeks, [4, 7, 1, 9, 3]) for _ in range(n)]
    rows += [{"item": "S", "date_ordered": w} for w in weeks[:3]]
    out = {(r["scope"], r["item"]): r for r in fc.demand_forecast(orders_df(rows), 90).collect()}
    w = out[("item", "W")]
    assert w["current_weekly_avg"] == 4.62 and w["predicted_total"] == 55.0 and w["trend"] == "increasing"
    assert out[("item", "S")]["status"] == "insufficient"
    assert out[("all", None)]["n_weeks"] == 5


def test_vendor_ranking_edges(orders_df):
    rows = [
        {"item": "EQ", "vendor": "A", "unit_price": 10, "date_received": "2001-01-02"},
        {"item": "EQ", "vendor": "B", "unit_price": 10, "date_received": None},
        {"item": "ONE", "vendor": "S", "unit_price": 5, "date_received": "2001-01-02"},
        {"item": "ONE", "vendor": "S", "unit_price": 7, "date_received": None},
        {"item": "SOLO", "vendor": "S", "unit_price": 5},
        {"item": "TIE", "vendor": "Y", "unit_price": 10, "date_received": "2001-01-02"},
        {"item": "TIE", "vendor": "X", "unit_price": 10, "date_received": "2001-01-02"},
        {"item": "TIE", "vendor": "Z", "unit_price": 10, "date_received": "2001-01-02"},
        {"item": "TIE", "vendor": "W", "unit_price": 10, "date_received": "2001-01-02"},
        # a null-vendor row counts towards the item's rows but is never ranked
        {"item": "NV", "vendor": "S", "unit_price": 4, "date_received": "2001-01-02"},
        {"item": "NV", "vendor": None, "unit_price": 1},
        {"item": "NONE", "vendor": None, "unit_price": 1},
        {"item": "NONE", "vendor": None, "unit_price": 2},
    ]
    out = src.vendor_ranking(orders_df(rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r["item"], []).append((r["rank"], r["vendor"], r["score"]))
    assert sorted(by["EQ"]) == [(1, "A", pytest.approx(1.0)), (2, "B", pytest.approx(0.6))]
    assert by["ONE"] == [(1, "S", pytest.approx(0.8))]
    assert "SOLO" not in by
    assert [v for _, v, _ in sorted(by["TIE"])] == ["W", "X", "Y"]
    assert by["NV"] == [(1, "S", pytest.approx(1.0))]
    assert "NONE" not in by


def test_bulk_threshold(orders_df):
    rows = [{"item": "AT", "qty": q, "unit_price": 250} for q in (1, 1, 2)]
    rows += [{"item": "OVER", "qty": q, "unit_price": 250.03} for q in (1, 1, 2)]
    rows += [{"item": "FEW", "qty": 100, "unit_price": 1000}] * 2
    out = src.bulk_opportunities(orders_df(rows)).collect()
    assert [r["item"] for r in out] == ["OVER"]
    assert out[0]["suggested_qty"] == 4.0 and out[0]["current_avg_qty"] == 1.3


def test_yearly_projection_edges(orders_df):
    rows = [
        {"grant": "G1", "date_ordered": "2019-03-01", "total": 100},
        {"grant": "G1", "date_ordered": "2020-03-01", "total": 200},
        {"grant": "G1", "date_ordered": "2021-03-01", "total": 300},
        {"grant": "G2", "date_ordered": "2019-03-01", "total": 300},
        {"grant": "G2", "date_ordered": "2021-03-01", "total": 100},
        {"grant": "G3", "date_ordered": "2019-03-01", "total": 50},
        {"grant": None, "date_ordered": "2021-05-01", "total": 1000},
    ]
    df = orders_df(rows)
    p = {r["grant"]: r for r in yr.yearly_projection(df).collect()}
    assert p["G1"]["projected"] == pytest.approx(400.0) and p["G1"]["trend"] == "Up"
    assert p["G1"]["growth_pct"] == pytest.approx(100 / 3)
    assert p["G2"]["projected"] == 0.0 and p["G2"]["growth_pct"] == pytest.approx(-100.0) and p["G2"]["trend"] == "Down"
    assert p["G3"]["projected"] == 0.0 and p["G3"]["growth_pct"] == 0.0 and p["G3"]["trend"] == "Stable"
    assert p["G1"]["current_year"] == 2021
    tot = yr.projection_total(df).collect()[0]
    assert tot["total_current"] == 1400.0 and tot["total_projected"] == pytest.approx(400.0)
    assert tot["change_pct"] == pytest.approx((400 - 1400) / 1400 * 100, abs=1e-6)
    grid = yr.year_grant_pivot(df).collect()
    assert len(grid) == 9 and {(r["year"], r["grant"]) for r in grid if r["spend"] == 0} == {
        (2020, "G2"), (2020, "G3"), (2021, "G3")}
    # the newest year has only ungranted rows: it is the current year, not a regression year
    late = {r["grant"]: r for r in yr.yearly_projection(
        orders_df(rows + [{"grant": None, "date_ordered": "2022-01-01", "total": 7}])).collect()}
    assert late["G1"]["current_year"] == 2022 and late["G1"]["projected"] == pytest.approx(400.0)
    assert yr.projection_total(orders_df(rows + [{"grant": None, "date_ordered": "2022-01-01", "total": 7}])
                               ).collect()[0]["total_current"] == 7.0
    one = yr.yearly_projection(orders_df([{"grant": "G", "date_ordered": "2020-01-01", "total": 5}])).collect()[0]
    assert one["projected"] == 5.0 and one["trend"] == "Stable"
    margins = {(r["year"], r["grant"], r["level"]): r["spend"] for r in yr.year_grant_margins(df).collect()}
    assert margins[(None, None, 3)] == 2050.0 and margins[(2021, None, 1)] == 1400.0 and margins[(None, None, 2)] == 1000.0
    assert margins[(None, "G2", 2)] == 400.0


def test_delete_rules(spark, orders_df):
    rows = [{"vendor": None, "po_no": "1", "item": "x"}, {"vendor": "nano", "po_no": None, "item": "y"},
            {"vendor": "other", "po_no": "2", "item": "[Add item details]"}, {"vendor": "keep", "po_no": "3", "item": "z"}]
    df = orders_df(rows)
    out = mt.delete_matching(df, vendor="n", po="1", imported_placeholders=True)
    assert sorted(col_of(out, "vendor")) == ["keep"]
    assert mt.delete_matching(df, po="2").count() == 3
    ids = spark.createDataFrame([(None,), ("a",), ("b",)], "req_id string")
    assert sorted(mt.delete_by_id(ids, "a").collect(), key=str) == sorted([(None,), ("b",)], key=str)


def test_edit_rejects_duplicate_ids(spark, orders_df):
    t = orders_df([{"req_id": "a", "qty": 1, "unit_price": 2, "total": 2, "date_received": "2001-01-01",
                    "received_by": "x"},
                   {"req_id": "b", "qty": 1, "unit_price": 2, "total": 2}])
    edits = spark.createDataFrame(
        [("a", "it", None, None, None, None, 3.0, 2.5, "n", "loc", False, None, None),
         ("b", "it", None, None, None, None, 3.0, 2.5, "n", "loc", True, date(2001, 2, 1), "y"),
         ("b", "it", None, None, None, None, 9.0, 2.5, "n", "loc", True, date(2001, 2, 1), "y")],
        "req_id string, item string, cat_no string, grant string, rf_project string, split_pct string, qty double, "
        "unit_price double, notes string, location string, mark_received boolean, edit_date_received date, "
        "edit_received_by string")
    out = {r["req_id"]: r for r in mt.edit_orders(t, edits).collect()}
    assert float(out["a"]["total"]) == 7.5 and out["a"]["date_received"] is None and out["a"]["received_by"] is None
    assert out["b"]["qty"] == 1.0 and float(out["b"]["total"]) == 2.0


def test_receive_all_and_recalc(orders_df):
    t = orders_df([{"qty": None, "unit_price": 3, "total": 0}, {"qty": 2, "unit_price": None, "date_received": "2001-01-01"}])
    got = mt.recalculate_totals(t).collect()
    assert [float(r["total"]) for r in got] == [3.0, 0.0]
    rec = mt.receive_all(t, "2001-08-02", "clerk").collect()
    assert rec[0]["date_received"] == date(2001, 8, 2) and rec[0]["received_by"] == "clerk"
    assert rec[1]["date_received"] == date(2001, 1, 1) and rec[1]["received_by"] is None


def test_year_total_newest_year(orders_df):
    rows = [{"grant": "G", "date_ordered": "2020-02-01", "total": 10},
            {"grant": None, "date_ordered": "2021-03-01", "total": 5},
            {"grant": "G", "date_ordered": "2021-04-01", "total": None},
            {"grant": "G", "date_ordered": None, "total": 99}]
    assert [tuple(r) for r in rep.year_total(orders_df(rows)).collect()] == [(2021, 5.0)]
    assert rep.year_total(orders_df([{"date_ordered": None, "total": 1}])).count() == 0
    assert [tuple(r) for r in rep.year_total(orders_df(rows), 2020).collect()] == [(2020, 10.0)]


def test_money_and_percent_text(spark):
    df = spark.createDataFrame([(1234.5, 5.25), (0.0, -2.0), (1000000.0, 12.34)], "m double, p double")
    out = df.select(cl.money_text("m").alias("m"), cl.percent_text("p").alias("s"),
                    cl.percent_text("p", signed=False).alias("u")).collect()
    assert [tuple(r) for r in out] == [("$1,234.50", "+5.3%", "5.3%"), ("$0.00", "-2.0%", "-2.0%"),
                                       ("$1,000,000.00", "+12.3%", "12.3%")]
