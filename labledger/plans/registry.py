"""One callable per operator key: (spark, sf_dir) -> DataFrame.

Every query reads the supplied tables (through the order table derived from
them) over their whole extent; nothing is sampled or capped unless the limit is
the feature (top-k lists, previews).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from labledger.operators import filters as flt
from labledger.operators import reports as rep
from labledger.operators import yearly as yr
from labledger.sources.store import order_table
from labledger.sources.tables import LARGE_ROWS, ROWS_PER_TASK, partitions_for

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(key: str):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = fn
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_table(spark, sf_dir)


# ---- filters ---------------------------------------------------------------
@register("pending_orders")
def q_pending(spark, d):
    return flt.pending_orders(T(spark, d)).select("req_id", "item", "date_ordered")


@register("received_orders")
def q_received(spark, d):
    return flt.received_orders(T(spark, d)).select("req_id", "item", "date_received")


@register("visible_rows")
def q_visible(spark, d):
    return flt.visible_rows(T(spark, d), "AMERICA").select("req_id", "lab", "total")


@register("order_search")
def q_search(spark, d):
    return (flt.order_search(T(spark, d), vendor="supplier#0000000[1-3]", grant="build",
                             source="ShopBlue", status="Pending")
            .select("req_id", "vendor", "grant", "po_source"))


@register("order_search_counts")
def q_search_counts(spark, d):
    return flt.order_search_counts(T(spark, d), vendor="0001", source="Stock Room", status="Received",
                                   literal=True)


@register("positive_totals")
def q_positive(spark, d):
    return flt.positive_totals(T(spark, d)).agg(F.count(F.lit(1)).alias("rows"))


@register("min_support")
def q_min_support(spark, d):
    return flt.min_support(T(spark, d), ["item", "vendor"], 2)


@register("validate_orders")
def q_validate(spark, d):
    return (flt.validate_orders(T(spark, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("rows")))


# ---- aggregates ------------------------------------------------------------
@register("kpi_overview")
def q_kpi_overview(spark, d):
    return rep.kpi_overview(T(spark, d))


@register("kpi_analytics")
def q_kpi_analytics(spark, d):
    return rep.kpi_analytics(T(spark, d))


@register("spend_by_grant")
def q_spend_by_grant(spark, d):
    return rep.spend_by_grant(T(spark, d))


@register("assigned_spend_total")
def q_assigned_total(spark, d):
    return rep.assigned_spend_total(T(spark, d))


@register("spend_by_project")
def q_spend_by_project(spark, d):
    return rep.spend_by_project(T(spark, d))


@register("split_summary")
def q_split(spark, d):
    return rep.split_summary(T(spark, d))


@register("top_items")
def q_top_items(spark, d):
    return rep.top_items(T(spark, d))


@register("top_vendors")
def q_top_vendors(spark, d):
    return rep.top_vendors(T(spark, d))


@register("monthly_spend")
def q_monthly(spark, d):
    return rep.monthly_spend(T(spark, d))


@register("grant_spend_all_time")
def q_grant_all(spark, d):
    return rep.grant_spend_all_time(T(spark, d))


@register("year_total")
def q_year_total(spark, d):
    return rep.year_total(T(spark, d))


@register("missing_price_check")
def q_missing_price(spark, d):
    return rep.missing_price_check(T(spark, d))


@register("column_profile")
def q_profile(spark, d):
    return rep.column_profile(T(spark, d))


# ---- sorts / top-k ---------------------------------------------------------
@register("recent_orders")
def q_recent(spark, d):
    return rep.recent_orders(T(spark, d))


@register("pending_top5")
def q_pending_top5(spark, d):
    return rep.pending_top(T(spark, d), 5)


@register("ranked_reports")
def q_ranked(spark, d):
    return rep.ranked(rep.spend_by_project(T(spark, d)),
                      [F.desc("total_spent"), "rf_project", "grant"], 5)


# ---- year x grant ----------------------------------------------------------
@register("year_grant_grid")
def q_grid(spark, d):
    return yr.year_grant_grid(T(spark, d)).select("year", "grant", F.col("spend_dec").cast("double").alias("spend"))


@register("year_grant_pivot")
def q_pivot(spark, d):
    return yr.year_grant_pivot(T(spark, d))


@register("year_grant_margins")
def q_margins(spark, d):
    return yr.year_grant_margins(T(spark, d))


@register("year_ordinal")
def q_year_ordinal(spark, d):
    return yr.year_ordinal(T(spark, d))


@register("yearly_projection")
def q_projection(spark, d):
    return yr.yearly_projection(T(spark, d))


@register("projection_total")
def q_projection_total(spark, d):
    return yr.projection_total(T(spark, d))


# ---- forecasts -------------------------------------------------------------
from labledger.operators import forecast as fc  # noqa: E402
from labledger.operators import sketches as sk  # noqa: E402
from labledger.operators import sourcing as src  # noqa: E402


@register("days_between_orders")
def q_days_between(spark, d):
    return fc.days_between_orders(T(spark, d))


@register("item_order_gap")
def q_item_gap(spark, d):
    return fc.item_order_gap(T(spark, d))


@register("usual_vendor")
def q_usual_vendor(spark, d):
    return fc.usual_vendor(T(spark, d))


@register("reorder_predictions")
def q_reorder(spark, d):
    return fc.reorder_predictions(T(spark, d), fx.AS_OF)


@register("spend_moving_avg")
def q_moving_avg(spark, d):
    return fc.spend_moving_avg(T(spark, d))


@register("spend_recent_trend")
def q_recent_trend(spark, d):
    return fc.spend_recent_trend(T(spark, d))


@register("spend_forecast")
def q_spend_forecast(spark, d):
    return fc.spend_forecast(T(spark, d), 3)


@register("weekly_order_count")
def q_weekly(spark, d):
    return fc.weekly_order_count(T(spark, d))


@register("demand_smoothing")
def q_demand_smoothing(spark, d):
    return fc.demand_forecast(T(spark, d)).select("scope", "item", "n_weeks", "current_weekly_avg")


@register("demand_forecast")
def q_demand(spark, d):
    return fc.demand_forecast(T(spark, d), 90)


# ---- sourcing --------------------------------------------------------------
@register("vendor_item_stats")
def q_vendor_stats(spark, d):
    return src.vendor_item_stats(T(spark, d))


@register("item_order_stats")
def q_item_stats(spark, d):
    return src.item_order_stats(T(spark, d))


@register("vendor_price_spread")
def q_spread(spark, d):
    return src.vendor_price_spread(T(spark, d))


@register("top3_vendors")
def q_top3(spark, d):
    return src.vendor_ranking(T(spark, d), 3).select("item", "rank", "vendor")


@register("vendor_ranking")
def q_vendor_ranking(spark, d):
    return src.vendor_ranking(T(spark, d), 3)


@register("bulk_opportunities")
def q_bulk(spark, d):
    return src.bulk_opportunities(T(spark, d))


# ---- cleaning on the raw-text fixture ---------------------------------------
from labledger.functions import clean as cl  # noqa: E402
from labledger.operators import ingest as ing  # noqa: E402
from labledger.operators import maintenance as mt  # noqa: E402
from labledger.operators.numbering import request_ids  # noqa: E402
from labledger.schema import ORDER_COLUMNS, conform  # noqa: E402
from labledger.sources import exports as ex  # noqa: E402
from labledger.sources import fixtures as fx  # noqa: E402
from labledger.sources.fixture_files import export_files  # noqa: E402
from labledger.sources.keys import OrderKeys, may_match, order_keys  # noqa: E402
from labledger.sources.store import OrderStore  # noqa: E402


def R(spark, d):
    return fx.order_lines_raw(T(spark, d))


def STORED(spark, d):
    return fx.stored_orders(T(spark, d))


def LINES(spark, d):
    return ex.scan_line_items(spark, export_files(spark, d).line_items)


def NUMBERED(spark, d):
    """The line items with the line number that the fixture writes into a column of its own; only queries that return
    line numbers need it, the imports go by the readers' positions."""
    return LINES(spark, d).withColumn("line_no", F.col("Line").cast("bigint"))


def NUMBERED_INVENTORY(spark, d):
    return INVENTORY(spark, d).withColumn("line_no", F.col("Line").cast("bigint"))


def SUMMARY(spark, d):
    return ex.scan_po_summary(spark, export_files(spark, d).po_summary)


def INVENTORY(spark, d):
    return ex.scan_inventory(spark, export_files(spark, d).inventory)


@register("line_total")
def q_line_total(spark, d):
    return T(spark, d).select("req_id", cl.line_total("qty", "unit_price").alias("line_total"))


@register("receipt_status")
def q_status(spark, d):
    return R(spark, d).select("req_id", rep.status("date_received", text=True).alias("status"))


@register("coerce_amount")
def q_coerce_amount(spark, d):
    return R(spark, d).select("req_id", cl.coerce_amount("total").alias("total_amt"))


@register("coerce_date")
def q_coerce_date(spark, d):
    return R(spark, d).select("req_id", cl.coerce_date(cl.normalize_date_text("date_ordered")).alias("date_ordered"))


@register("date_parts")
def q_date_parts(spark, d):
    return T(spark, d).select("req_id", *cl.date_parts("date_ordered"))


@register("clean_item_name")
def q_clean_item(spark, d):
    return R(spark, d).select("req_id", cl.clean_item_name("item").alias("item"))


@register("clean_vendor")
def q_clean_vendor(spark, d):
    return R(spark, d).select("req_id", cl.clean_vendor("vendor").alias("vendor"))


@register("integer_id_text")
def q_int_id(spark, d):
    return R(spark, d).select("req_id", cl.integer_id_text("cat_no").alias("cat_id"),
                              cl.integer_id_text("grant").alias("grant_id"))


@register("split_percent_text")
def q_split_text(spark, d):
    return R(spark, d).select("req_id", cl.split_percent_text("split_pct").alias("split_raw"),
                              cl.split_percent_text(F.replace("split_pct", F.lit("%"), F.lit(""))).alias("split_num"))


@register("normalize_date_text")
def q_norm_date(spark, d):
    return R(spark, d).select("req_id", cl.normalize_date_text("date_ordered").alias("date_text"))


@register("parse_pack_qty")
def q_pack_qty(spark, d):
    return R(spark, d).select("req_id", cl.parse_pack_qty("qty").alias("qty"))


@register("amount_fallbacks")
def q_fallbacks(spark, d):
    q, p, t = cl.amount_fallbacks("qty", "unit_price", "total")
    return R(spark, d).select("req_id", q.alias("qty"), p.alias("unit_price"), t.alias("total"))


@register("extract_origin_req")
def q_origin(spark, d):
    return fx.noted_orders(T(spark, d)).select("req_id", cl.extract_origin_req("notes").alias("orig"))


@register("origin_note")
def q_origin_note(spark, d):
    return INVENTORY(spark, d).select(F.col("Line").cast("bigint").alias("line_no"),
                                      cl.origin_note("Req#").alias("note"))


@register("truncate_text")
def q_truncate(spark, d):
    return T(spark, d).select("req_id", rep.truncate_text("item", 30).alias("item30"),
                              rep.truncate_text("item", 40).alias("item40"),
                              rep.truncate_text("vendor", 10).alias("vendor10"))


@register("money_text")
def q_money_text(spark, d):
    g = rep.spend_by_grant(T(spark, d))
    return g.select("grant", cl.money_text("total_spent").alias("spent_text"),
                    cl.percent_text(F.col("orders") / 100.0).alias("change_text"))


@register("percent_text")
def q_percent_text(spark, d):
    p = yr.yearly_projection(T(spark, d))
    return p.select("grant", cl.percent_text("growth_pct").alias("growth_text"),
                    cl.percent_text(F.abs("growth_pct"), signed=False).alias("change_text"))


# Fixed values for the owner-to-lab fixture: the unrestricted account, the
# home domain and its lab.
ADMIN_EMAIL = "admin@example.edu"
HOME_DOMAIN = "example.edu"
HOME_LAB = "Main Lab"


def owner_email():
    dom = F.when(F.col("lab") == "AMERICA", F.lit(HOME_DOMAIN)).otherwise(
        F.concat(F.lower(F.replace("lab", F.lit(" "), F.lit(""))), F.lit(".org")))
    return F.concat(F.lower(F.replace("ordered_by", F.lit("#"), F.lit("."))), F.lit("@"), dom)


@register("owner_to_lab")
def q_owner_lab(spark, d):
    e = T(spark, d).select(owner_email().alias("email")).distinct()
    return e.select("email", cl.owner_to_lab("email", ADMIN_EMAIL, HOME_DOMAIN, HOME_LAB).alias("lab"))


@register("owner_labs")
def q_owner_labs(spark, d):
    """Owners looked up in a table of domains (two rows for each, and none for one of the labs)."""
    t = T(spark, d)
    pairs = t.select(F.split_part(owner_email(), F.lit("@"), F.lit(2)).alias("domain"), "lab").filter(F.col("lab") != "EUROPE").distinct()
    pairs = pairs.unionByName(pairs.withColumn("lab", F.concat(F.lit("Lab of "), "lab")))
    return rep.owner_labs(t.select(owner_email().alias("email")).distinct(), "email", pairs, ADMIN_EMAIL)


@register("column_subset")
def q_subset(spark, d):
    return T(spark, d).select("req_id", "item", "vendor", F.col("total").cast("double").alias("total"),
                              "po_no", "date_ordered", rep.status().alias("alert"))


@register("urgency_bucket")
def q_urgency(spark, d):
    return fc.reorder_predictions(T(spark, d), fx.AS_OF).select("item", "days_until_reorder", "urgency")


@register("trend_bucket")
def q_trend(spark, d):
    return yr.yearly_projection(T(spark, d)).select("grant", "growth_pct", "trend")


@register("finite_only")
def q_finite(spark, d):
    feats = an.finite_features(T(spark, d))
    return feats.select("req_id", *[F.col(c).cast("double").alias(f) for c, f in (("qty", "f_qty"), ("unit_price", "f_price"), ("total", "f_total"))])


@register("next_periods")
def q_next_periods(spark, d):
    return fc.spend_forecast(T(spark, d), 3).select("horizon", "forecast_month")


@register("add_fractional_days")
def q_frac_days(spark, d):
    return fc.reorder_predictions(T(spark, d), fx.AS_OF).select("item", "predicted_reorder_date", "days_until_reorder")


@register("request_id")
def q_request_id(spark, d):
    lines = NUMBERED(spark, d)
    p = ing.prepared_line_items(lines).filter(ing.is_named()).select("line_no")
    return request_ids(p, ["line_no"], T(spark, d), fx.AS_OF, rows=lines.count())


# ---- joins for imports ------------------------------------------------------------
@register("import_anti_join")
def q_import_anti(spark, d):
    return ing.import_anti_join(NUMBERED(spark, d), STORED(spark, d)).select("line_no", "k_po", "k_item")


@register("import_dup_count")
def q_import_dups(spark, d):
    return ing.import_dup_count(LINES(spark, d), STORED(spark, d))


@register("po_anti_join")
def q_po_anti(spark, d):
    return ing.po_anti_join(SUMMARY(spark, d), STORED(spark, d)).select("k_po", "Supplier")


@register("origin_req_anti_join")
def q_origin_anti(spark, d):
    return ing.origin_req_anti_join(NUMBERED_INVENTORY(spark, d), STORED(spark, d)).select("line_no", "sheet", "orig")


@register("first_per_key")
def q_first_per_key(spark, d):
    fresh = ing.import_anti_join(NUMBERED(spark, d), STORED(spark, d)).withColumn("_own", ing.own_line("k_po"))
    first = ing.first_per_key(fresh.select("k_po", "_own", "k_item", "file", "line_no"), ["k_po", "_own", "k_item"], ["file", "line_no"])
    return first.select("k_po", "k_item", "line_no")


@register("map_line_items")
def q_map_lines(spark, d):
    p = ing.prepared_line_items(NUMBERED(spark, d)).filter(ing.is_named())
    return ing.map_line_items(p, "Admin").drop("_bad", "file", "notes", "date_received", "received_by", "location")


@register("map_inventory")
def q_map_inventory(spark, d):
    return ing.map_inventory(ing.prepared_inventory(NUMBERED_INVENTORY(spark, d)), "Admin").drop("file")


@register("import_line_items")
def q_import_lines(spark, d):
    return ing.import_line_items(LINES(spark, d), STORED(spark, d), "Admin", fx.AS_OF)


@register("import_po_summary")
def q_import_summary(spark, d):
    return ing.import_po_summary(SUMMARY(spark, d), STORED(spark, d), "Admin", fx.AS_OF)


@register("import_inventory")
def q_import_inventory(spark, d):
    return ing.import_inventory(INVENTORY(spark, d), STORED(spark, d), "Admin", fx.AS_OF)


def KEYED(spark, d):
    """The stored orders in two versions, and their key tables, refreshed after each."""
    store, orders = OrderStore(spark, rows=T(spark, d).count()), STORED(spark, d)
    late = F.coalesce(F.col("date_ordered") >= F.lit("2000-01-01").cast("date"), F.lit(False))
    store.write(orders.filter(~late))
    keys = OrderKeys(store).refresh()
    store.append(orders.filter(late))
    return store.read(), keys.refresh()


@register("import_line_items_keyed")
def q_import_lines_keyed(spark, d):
    """I1 with the stored keys from tables laid out by key."""
    stored, keys = KEYED(spark, d)
    return ing.import_line_items(LINES(spark, d), stored, "Admin", fx.AS_OF, keys=keys.table("line"))


@register("import_po_summary_keyed")
def q_import_po_keyed(spark, d):
    stored, keys = KEYED(spark, d)
    return ing.import_po_summary(SUMMARY(spark, d), stored, "Admin", fx.AS_OF, keys=keys.table("po"))


@register("import_inventory_keyed")
def q_import_inventory_keyed(spark, d):
    stored, keys = KEYED(spark, d)
    return ing.import_inventory(INVENTORY(spark, d), stored, "Admin", fx.AS_OF, keys=keys.table("origin"))


@register("import_anti_join_prefiltered")
def q_import_anti_prefiltered(spark, d):
    """J1 with the stored rows reduced by a bit set of the export's keys before they are shuffled."""
    lines = NUMBERED(spark, d)
    stored = may_match(order_keys(STORED(spark, d), "line"), ing.prepared_line_items(lines), ["k_po", "k_item"])
    return ing.import_anti_join(lines, None, stored, laid_out=False).select("line_no", "k_po", "k_item")


# ---- maintenance -------------------------------------------------------------------
@register("append_orders")
def q_append(spark, d):
    new = ing.import_po_summary(SUMMARY(spark, d), STORED(spark, d), "Admin", fx.AS_OF)
    return mt.append_orders(STORED(spark, d), new).select("req_id", "item", "total", "lab")


@register("enter_orders")
def q_enter_orders(spark, d):
    """All orders entered anew, some with a quantity of 0."""
    t = T(spark, d)
    entries = (t.withColumn("entry", F.col("req_id")).withColumn("qty", F.when(F.col("qty") <= 2, F.lit(0.0)).otherwise(F.col("qty"))))
    return mt.enter_orders(entries, t, ["entry"], fx.AS_OF)[0].select("req_id", "item", "qty", "total", "vendor")


@register("store_entries")
def q_store_entries(spark, d):
    """All orders entered anew into a store that holds the table, some with a quantity of 0: new rows and rejects."""
    t = T(spark, d)
    store = OrderStore(spark, rows=t.count())
    store.write(t)
    rejected = mt.store_entries(store, t.withColumn("qty", F.when(F.col("qty") <= 2, F.lit(0.0)).otherwise(F.col("qty"))).withColumn("entry", F.col("req_id")), ["entry"], fx.AS_OF)
    return (store.read(since=1).select("req_id", "item", "qty", F.lit(None).cast("string").alias("reason"))
            .unionByName(rejected.select(F.lit(None).cast("string").alias("req_id"), "item", "qty", "reason")))


@register("adopt_orders")
def q_adopt_orders(spark, d):
    """The orders as another table, small ones twice, brought into a store of those before 1996: its rows and the rejects."""
    t = T(spark, d)
    store = OrderStore(spark, rows=t.count())
    store.write(t.filter("date_ordered < date'1996-01-01'"))
    rejected = mt.adopt_orders(store, t.unionByName(t.filter("qty <= 2")))
    return (store.read().select("req_id", "item", F.lit(None).cast("string").alias("reason"))
            .unionByName(rejected.select("req_id", "item", "reason")))


@register("receive_all")
def q_receive_all(spark, d):
    return mt.receive_all(T(spark, d), fx.AS_OF, "clerk").select("req_id", "date_received", "received_by")


@register("recalculate_totals")
def q_recalc(spark, d):
    return mt.recalculate_totals(T(spark, d)).select("req_id", "total")


def EDITS(t):
    recent = t.filter(F.col("date_ordered") >= F.lit("2001-07-01").cast("date"))
    e = recent.select(
        "req_id", "item", "cat_no", "grant", "rf_project", "split_pct",
        (F.col("qty") + 1).alias("qty"), "unit_price",
        F.lit("edited").alias("notes"), F.concat(F.lit("shelf "), F.col("lab")).alias("location"),
        (F.col("lab") != "ASIA").alias("mark_received"),
        F.lit(fx.AS_OF).cast("date").alias("edit_date_received"), F.lit("clerk").alias("edit_received_by"))
    return e.unionByName(e.filter(F.col("qty") == 2))


@register("edit_order")
def q_edit(spark, d):
    t = T(spark, d)
    return mt.edit_orders(t, EDITS(t)).select("req_id", "qty", "total", "notes", "location",
                                             "date_received", "received_by")


@register("keyed_update")
def q_keyed_update(spark, d):
    t = T(spark, d)
    e = EDITS(t)
    return mt.edit_orders(t, e).join(e.select("req_id").distinct(), "req_id", "left_semi").select(
        "req_id", "item", "qty", "total", "notes")


@register("key_lookup")
def q_lookup(spark, d):
    t = T(spark, d)
    latest = t.agg(F.max("date_ordered").alias("date_ordered"))
    ids = t.join(latest, "date_ordered", "left_semi").select("req_id")
    return mt.key_lookup(t, ids).select("req_id", "item", F.col("total").cast("double").alias("total"))


@register("delete_by_id")
def q_delete_id(spark, d):
    t = T(spark, d)
    first = t.agg(F.min("req_id")).collect()[0][0]
    return mt.delete_by_id(t, first).select("req_id")


@register("delete_matching")
def q_delete_matching(spark, d):
    new = ing.import_po_summary(SUMMARY(spark, d), STORED(spark, d), "Admin", fx.AS_OF)
    before = mt.append_orders(STORED(spark, d), new)
    after = mt.delete_matching(before, vendor="supplier#0000000(1|2)", po="7", imported_placeholders=True)
    return (before.agg(F.count(F.lit(1)).alias("rows_before"))
                  .join(after.agg(F.count(F.lit(1)).alias("rows_after")), how="inner", on=F.lit(True))
                  .withColumn("deleted", F.col("rows_before") - F.col("rows_after")))


@register("delete_all")
def q_delete_all(spark, d):
    store = OrderStore(spark)
    store.write(T(spark, d))
    store.delete_all()
    return store.read()


# ---- sources -------------------------------------------------------------------------
@register("scan_orders")
def q_scan(spark, d):
    return T(spark, d)


@register("schema_backfill")
def q_backfill(spark, d):
    upload = T(spark, d).drop("rf_project", "split_pct")
    return conform(upload)


@register("required_projection")
def q_required(spark, d):
    extra = T(spark, d).withColumn("alert", rep.status()).withColumn("year", F.year("date_ordered"))
    return extra.select(*ORDER_COLUMNS)


@register("write_snapshot")
def q_write_snapshot(spark, d):
    store = OrderStore(spark)
    store.write(T(spark, d))
    return store.read()


@register("scan_line_items")
def q_scan_lines(spark, d):
    return LINES(spark, d).drop("file", "line_no")


@register("detect_export_format")
def q_detect(spark, d):
    """Every export through the dispatching import: the order rows that each adds."""
    parts = [ing.import_export(e(spark, d), STORED(spark, d), "Admin", fx.AS_OF).agg(F.count(F.lit(1)).alias("imported"))
             .select(F.lit(name).alias("export"), "imported")
             for name, e in (("line_items", LINES), ("po_summary", SUMMARY), ("inventory", INVENTORY))]
    return reduce(DataFrame.unionByName, parts)


@register("import_report")
def q_import_report(spark, d):
    """What becomes of every row of each export."""
    parts = [ing.import_report(e(spark, d), STORED(spark, d), "Admin").select(F.lit(name).alias("export"), "disposition", F.col("rows").cast("bigint").alias("rows"))
             for name, e in (("line_items", LINES), ("po_summary", SUMMARY), ("inventory", INVENTORY))]
    return reduce(DataFrame.unionByName, parts)


@register("scan_po_summary")
def q_scan_summary(spark, d):
    return SUMMARY(spark, d).select("PO Number", "Supplier", "Total Amount", "PO Owner")


@register("scan_inventory")
def q_scan_inventory(spark, d):
    return INVENTORY(spark, d).drop("file", "line_no")


@register("export_csv")
def q_export_csv(spark, d):
    from labledger.session import scratch_path
    from labledger.sources.store import export_csv, scan_order_csv
    path = scratch_path(spark, "export_csv")
    export_csv(T(spark, d), path)
    return scan_order_csv(spark, path)


@register("verify_after_write")
def q_verify(spark, d):
    return OrderStore(spark).write(T(spark, d))


@register("preview")
def q_preview(spark, d):
    from labledger.sources.store import preview
    return preview(T(spark, d).select("req_id", "item", "vendor", F.col("total").cast("double").alias("total")), 20)


# ---- anomaly ---------------------------------------------------------------------------
from labledger.operators import anomaly as an  # noqa: E402


@register("standardize")
def q_standardize(spark, d):
    return an.standardize_sql_exact(an.finite_features(flt.positive_totals(T(spark, d))))


@register("minmax_invert")
def q_minmax(spark, d):
    return an.minmax_invert(T(spark, d).select("req_id", "total"), "total", "inv").select("req_id", "inv")


@register("contamination_cut")
def q_contamination(spark, d):
    t = T(spark, d).select("req_id", F.col("total").cast("double").alias("total"))
    flagged, _ = an.contamination_cut(t, "total", 0.1)
    return flagged


@register("contamination_cut_sketch")
def q_contamination_sketch(spark, d):
    """Each lab's and the whole table's cut from a quantile sketch, and whether its exact rank is within three times the bound."""
    t = T(spark, d).select("lab", F.col("total").cast("double").alias("total"))
    cuts = sk.contamination_cut_sketch(t, "total", 0.1).withColumnRenamed("lab", "_lab")
    both = t.unionByName(t.withColumn("lab", F.lit(None).cast("string"))).join(cuts, F.col("lab").eqNullSafe(F.col("_lab")))
    off = 3 * sk.rank_error() * F.col("n")
    return (both.groupBy("lab", "n").agg(F.count_if(F.col("total") < F.col("cut")).alias("below"), F.count_if(F.col("total") <= F.col("cut")).alias("upto"))
            .select("lab", "n", ((F.col("below") <= 0.1 * F.col("n") + off) & (F.col("upto") >= 0.1 * F.col("n") - off)).alias("within")))


@register("distinct_vendors_sketch")
def q_distinct_vendors(spark, d):
    """Distinct vendors of each lab and of all: the exact number, and whether the sketches' estimate is within four standard errors."""
    t = T(spark, d)
    est = sk.distinct_vendors(sk.vendor_sketches(t)).select(F.col("lab").alias("_lab"), F.col("vendors").alias("estimate"))
    exact = t.unionByName(t.withColumn("lab", F.lit(None).cast("string"))).groupBy("lab").agg(F.count_distinct("vendor").alias("vendors"))
    return (exact.join(est, F.col("lab").eqNullSafe(F.col("_lab")))
            .select("lab", "vendors", (F.abs(F.col("estimate") - F.col("vendors")) <= 4 * sk.distinct_error() * F.col("vendors") + 1).alias("within")))


@register("anomalies")
def q_anomalies(spark, d):
    return an.anomalies(T(spark, d))


@register("fit_anomaly_model")
def q_fit_model(spark, d):
    t = T(spark, d)
    model = an.fit_anomaly_model(t)
    path = an.save_model(spark, model)
    return spark.read.parquet(f"{path}/score_range")


def STATE(spark, d):
    """The forest state of the orders, merged from those of two parts."""
    t = T(spark, d)
    late = F.coalesce(F.col("date_ordered") >= F.lit("2000-01-01").cast("date"), F.lit(False))
    return an.forest_state(t.filter(~late)).merge(an.forest_state(t.filter(late)))


@register("feature_moments")
def q_feature_moments(spark, d):
    """Means and deviations of the forest's features from merged moments."""
    scaler = an.scaler_of(STATE(spark, d).moments)
    rows = [(c, scaler["n"], *(round(x, 6) for x in scaler[c])) for c in an.FEATURES]
    return spark.createDataFrame(rows, "feature string, n bigint, mean double, sd double")


@register("refit_anomaly_model")
def q_refit_model(spark, d):
    """M5 from merged states, without a pass over the old rows."""
    path = an.save_model(spark, an.fit_from_state(STATE(spark, d)))
    return spark.read.parquet(f"{path}/score_range")


@register("score_new_orders")
def q_score_new(spark, d):
    t = T(spark, d)
    model = an.fit_anomaly_model(t)
    new = t.filter(F.col("date_ordered") >= F.lit("2001-01-01").cast("date"))
    return an.score_new_orders(new, model)


# ---- streaming -------------------------------------------------------------------------
from labledger.session import scratch_path  # noqa: E402
from labledger.streaming import jobs as sj  # noqa: E402


@register("stream_score_orders")
def q_stream_score(spark, d):
    t = T(spark, d)
    model = an.fit_anomaly_model(t)
    src = scratch_path(spark, "stream", "orders_in")
    rows = t.count()
    if rows < LARGE_ROWS:
        dealt = t.repartition(4 * math.ceil(partitions_for(spark, rows) / 4)).write
    else:  # cut where it lies, without a shuffle; of sixteen files or more, a quarter, rounded up, makes four parts
        dealt = t.write.option("maxRecordsPerFile", min(ROWS_PER_TASK, rows // 16))
    dealt.parquet(src)
    files = len(spark.read.schema(t.schema).parquet(src).inputFiles())
    sink = sj.stream_score_orders(spark, src, model, max_files_per_trigger=math.ceil(files / 4))  # they arrive in four parts
    return spark.read.parquet(sink)


@register("stream_import")
def q_stream_import(spark, d):
    store = OrderStore(spark)
    store.write(STORED(spark, d))
    sj.stream_import(spark, export_files(spark, d).line_items, store, fx.AS_OF)
    return store.read().filter(F.col("req_id").startswith("REQ-")).select("item", "po_no", "total")


@register("import_outcomes")
def q_import_outcomes(spark, d):
    """What became of every line that the stream read."""
    store, checkpoint = OrderStore(spark), scratch_path(spark, "stream", "import_ckpt")
    store.write(STORED(spark, d))
    sj.stream_import(spark, export_files(spark, d).line_items, store, fx.AS_OF, checkpoint=checkpoint)
    return sj.import_outcomes(spark, checkpoint).groupBy("disposition").agg(F.count(F.lit(1)).alias("rows"))


# ---- single predicates and small pieces used inside the pipelines ----------------------
@register("vendor_match")
def q_vendor_match(spark, d):
    return T(spark, d).filter(flt.pattern_match("vendor", "supplier#00000001[0-9]")).select("req_id", "vendor")


@register("grant_match")
def q_grant_match(spark, d):
    return T(spark, d).filter(flt.pattern_match("grant", "^(auto|mach)")).select("req_id", "grant")


@register("source_equals")
def q_source_equals(spark, d):
    return T(spark, d).filter(flt.source_equals("po_source", "Stock Room")).select("req_id", "po_source")


@register("priced_lines")
def q_priced(spark, d):
    lines = LINES(spark, d)
    col = ing.price_column(lines.columns)
    return flt.priced_lines(lines, col).select(F.col("Line").cast("bigint").alias("line_no"), F.col(col).try_cast("double").alias("price"))


@register("named_lines")
def q_named(spark, d):
    p = ing.prepared_line_items(NUMBERED(spark, d))
    return flt.named_lines(p, "item_clean", 3).select("line_no", "item_clean")


@register("dated_rows")
def q_dated(spark, d):
    r = R(spark, d).withColumn("d", cl.coerce_date(cl.normalize_date_text("date_ordered")))
    return flt.dated_rows(r, "d").select("req_id", "d")


@register("assigned_only")
def q_assigned(spark, d):
    return T(spark, d).filter(flt.assigned("rf_project")).select("req_id", "rf_project")


@register("import_total")
def q_import_total(spark, d):
    lines = LINES(spark, d)
    priced = flt.priced_lines(lines.withColumn("_p", F.col("Unit Price ($)").try_cast("double")), "_p")
    return priced.agg(F.sum(F.col("Line Total ($)").try_cast("decimal(18,2)")).cast("double").alias("import_total"),
                      F.count(F.lit(1)).alias("lines"))


@register("map_po_summary")
def q_map_summary(spark, d):
    rows = ing.map_po_summary(ing.prepared_po_summary(SUMMARY(spark, d)), "Admin")
    return rows.select("po_no", "item", "qty", "total", "vendor", "ordered_by", "po_source")
