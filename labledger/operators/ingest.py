"""Import pipelines from raw exports to order rows.

Each pipeline is one plan: clean -> key -> anti join against the stored keys
(deduplicated first, so a hot stored key cannot skew the join) -> first row
per key inside the file (an aggregation with map-side combine, not a window)
-> request ids -> typed order rows. Every line gets a disposition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labledger.functions import clean as cl
from labledger.operators.filters import priced_lines
from labledger.operators.numbering import request_ids
from labledger.schema import INVENTORY_HEADERS, LINE_ITEM_HEADERS, PO_SUMMARY_HEADERS, conform
from labledger.sources.exports import detect_export_format, sheet_grant
from labledger.sources.tables import LARGE_ROWS, outgrows, partitions_for

# Constants written by the importers.
IMPORT_SOURCE = "ShopBlue"
SUMMARY_ITEM = "[Add item details]"
KEY_ITEM_CHARS = 30


def nullif_blank(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def with_optional(df: DataFrame, names: list[str]) -> DataFrame:
    """Absent columns as null text."""
    return df.select("*", *[F.lit(None).cast("string").alias(n) for n in names if n not in df.columns])


def with_position(df: DataFrame) -> DataFrame:
    """``file`` and ``line_no`` as the readers give them; the present order for frames from elsewhere."""
    if "file" not in df.columns:
        df = df.withColumn("file", F.lit(""))
    return df if "line_no" in df.columns else df.withColumn("line_no", F.monotonically_increasing_id())


def own_line(key: str) -> Column:
    """A key part that keeps rows without a key apart: null for a real key, else the row's place."""
    return F.when(F.col(key).isNull(), F.struct("file", "line_no"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row (smallest ``order``) of each key; map-side combined."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def _stored_keys(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct stored keys among those of the batch: the stored side is reduced before it is made distinct."""
    return stored.join(batch.select(*keys).distinct(), keys, "left_semi").distinct()


def _meeting(batch: DataFrame, stored: DataFrame, keys: list[str], rows: int, laid_out: bool = False,
             real: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``batch`` and the distinct stored keys, ready for a join by ``keys``.

    A batch of few ``rows`` reduces the stored keys first (by its ``real`` rows, if some meet nothing). A large one, or one
    that needs more partitions than the session's, would shuffle and sort twice for that, so there both sides are dealt by
    key once, in partitions by rows; stored keys that are ``laid_out`` by key stay where they are."""
    spark = batch.sparkSession
    if rows < LARGE_ROWS and not outgrows(spark, rows):
        return batch, _stored_keys(stored, batch if real is None else real, keys)
    stored = stored.dropna(subset=keys[:1])  # a null PO or id meets nothing
    if laid_out:
        return batch, stored.distinct()
    n = partitions_for(spark, rows)
    return batch.repartition(n, *keys), stored.repartition(n, *keys).distinct()


# ---- line items ---------------------------------------------------------------
def price_column(columns: list[str]) -> str:
    return "Unit Price ($)" if "Unit Price ($)" in columns else "Line Total ($)"


def prepared_line_items(export: DataFrame) -> DataFrame:
    """F7 + P6 + key columns for a line-item export (headers already trimmed)."""
    price = price_column(export.columns)
    export = with_position(with_optional(export, LINE_ITEM_HEADERS))
    priced = priced_lines(export, price)
    item_clean = cl.clean_item_name("Item")
    return priced.select(
        "*",
        item_clean.alias("item_clean"),
        cl.po_key("PO #").alias("k_po"),
        F.substring(item_clean, 1, KEY_ITEM_CHARS).alias("k_item"))


def stored_line_keys(existing: DataFrame) -> DataFrame:
    """The keys of stored orders, ``(k_po, k_item)``."""
    return existing.select(cl.po_key("po_no").alias("k_po"), F.substring(F.coalesce("item", F.lit("")), 1, KEY_ITEM_CHARS).alias("k_item"))


def is_named() -> Column:
    """F8: a cleaned item name of three characters or more."""
    return F.length("item_clean") >= 3


def import_anti_join(export: DataFrame, existing: DataFrame, keys: DataFrame | None = None, rows: int | None = None,
                     laid_out: bool = True) -> DataFrame:
    """Named lines whose (PO, first 30 chars of item) is not stored yet: in ``keys`` (a table ``(k_po, k_item)``, which is
    ``laid_out`` by key unless told otherwise) if given, else in ``existing``. ``rows``: of the export, if they were counted."""
    p = prepared_line_items(export).filter(is_named())
    stored = keys if keys is not None else stored_line_keys(existing)
    p, stored = _meeting(p, stored, ["k_po", "k_item"], export.count() if rows is None else rows, keys is not None and laid_out)
    return p.join(stored, ["k_po", "k_item"], "left_anti")


def import_dup_count(export: DataFrame, existing: DataFrame) -> DataFrame:
    """Preview counts. ``duplicates`` counts priced lines whose key is
    stored (as the preview does); ``in_file_duplicates`` counts later lines of
    a key that repeats inside the file (which the import also skips)."""
    p, held = _meeting(prepared_line_items(export), stored_line_keys(existing), ["k_po", "k_item"], export.count())
    flagged = p.join(held.withColumn("_stored", F.lit(True)), ["k_po", "k_item"], "left")
    stored = F.coalesce(F.col("_stored"), F.lit(False))
    # One pass: per-key counts (map-side combined), then one global sum.
    per_key = flagged.groupBy("k_po", "k_item").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(stored).alias("n_stored"),
        F.count_if(~stored & is_named()).alias("n_new"))
    a = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
                    F.coalesce(F.sum("n_stored"), F.lit(0)).alias("duplicates"),
                    F.coalesce(F.sum(F.greatest(F.col("n_new") - 1, F.lit(0))), F.lit(0)).alias("in_file_duplicates"))
    return a.select(F.col("lines").cast("bigint").alias("lines"),
                    (F.col("lines") - F.col("duplicates")).cast("bigint").alias("new_items"),
                    F.col("duplicates").cast("bigint").alias("duplicates"),
                    F.col("in_file_duplicates").cast("bigint").alias("in_file_duplicates"))


def map_line_items(p: DataFrame, lab: str, keep: tuple = (), source: str = IMPORT_SOURCE) -> DataFrame:
    """P19 (line items) + P7-P12: export columns -> order columns (no id yet);
    ``keep`` columns are carried along unchanged."""
    qty, price, total = cl.amount_fallbacks("Quantity", "Unit Price ($)", "Line Total ($)")
    grant = cl.integer_id_text("Grant")
    project = cl.integer_id_text("RF Project")
    return p.select(
        "file", "line_no",
        F.substring("item_clean", 1, 200).alias("item"),
        qty.alias("qty"), price.alias("unit_price"), total.alias("total"),
        nullif_blank(cl.clean_vendor("Vendor")).alias("vendor"),
        F.col("Catalog #").alias("cat_no"),
        nullif_blank(grant).alias("grant"),
        nullif_blank(project).alias("rf_project"),
        nullif_blank(cl.split_percent_text("Split %")).alias("split_pct"),
        F.lit(source).alias("po_source"),
        nullif_blank(cl.po_key("PO #")).alias("po_no"),
        F.lit(None).cast("string").alias("notes"),
        F.col("Ordered By").alias("ordered_by"),
        cl.coerce_date(cl.normalize_date_text("Date Ordered")).alias("date_ordered"),
        F.lit(None).cast("date").alias("date_received"),
        F.lit(None).cast("string").alias("received_by"),
        F.lit(None).cast("string").alias("location"),
        F.lit(lab).alias("lab"),
        (grant.isNull() | project.isNull() | total.isNull()).alias("_bad"),
        *keep)


#: What a line is judged by, besides the columns of its order row.
JUDGED_BY = ("k_po", "k_item", "_lone", "_named")


def _mapped_lines(export: DataFrame, existing: DataFrame | None, lab: str) -> DataFrame:
    """Priced lines mapped to order columns, with the key columns and the
    stored-key flag (one left join against the deduplicated stored keys; none without ``existing``)."""
    p, lone = prepared_line_items(export).withColumn("_named", is_named()), own_line("k_po")
    if existing is None:
        # Dealt by key before the mapping: a few compressed files are read by as many tasks, and mapped by all.
        dealt = p.withColumn("_lone", lone).repartition("k_po", "k_item", "_lone")
        return map_line_items(dealt, lab, JUDGED_BY).withColumn("_stored", F.lit(False))
    # Mapped before the join: where only the flags are asked for, only those are shuffled.
    mapped = map_line_items(p, lab, ("k_po", "k_item", "_named"))
    mapped, held = _meeting(mapped, stored_line_keys(existing), ["k_po", "k_item"], export.count())
    flagged = mapped.join(held.withColumn("_stored", F.lit(True)), ["k_po", "k_item"], "left")
    return flagged.withColumn("_stored", F.coalesce("_stored", F.lit(False))).withColumn("_lone", lone)


def line_item_dispositions(export: DataFrame, existing: DataFrame | None, lab: str) -> DataFrame:
    """Every priced line with its disposition and mapped order columns. Without ``existing`` (None) the lines are judged
    among themselves: "imported" then means the first line of its key in this export."""
    mapped = _mapped_lines(export, existing, lab)
    pre = F.when(~F.col("_named"), "unnamed").when(F.col("_stored"), "duplicate").when(F.col("_bad"), "quarantined")
    # Only candidates share a key. They lie where the deal or the join by the key left them, so that the lines are shuffled once.
    mapped = mapped.withColumn("_pre", pre).withColumn("_own", F.when(pre.isNotNull(), F.struct("file", "line_no")))
    place = F.row_number().over(Window.partitionBy("k_po", "k_item", "_lone", "_own").orderBy("file", "line_no"))
    disp = F.coalesce(F.col("_pre"), F.when(place == 1, "imported").otherwise("duplicate"))
    return mapped.withColumn("disposition", disp).drop("_pre", "_own", "_stored", *JUDGED_BY)


def unpriced_lines(export: DataFrame) -> DataFrame:
    """The lines without a positive price: ``(file, line_no)``."""
    return with_position(export).filter(~F.coalesce(F.col(price_column(export.columns)).try_cast("double") > 0, F.lit(False))).select("file", "line_no")


def import_line_items(export: DataFrame, existing: DataFrame, lab: str, as_of: str, source: str = IMPORT_SOURCE,
                      keys: DataFrame | None = None) -> DataFrame:
    """The order rows a line-item export adds (ids in file order).

    Lines whose grant or project is no number, or whose total exceeds the money type, are quarantined:
    ``line_item_dispositions`` returns them and ``import_report`` counts them.

    Candidates (named, not stored, not quarantined) keep the first line of
    each key by one ``min_by`` aggregation; no join back to the lines. ``keys``: see ``import_anti_join``.
    """
    rows = export.count()
    # Stored lines leave before the mapping, whose columns are the costly ones.
    mapped = map_line_items(import_anti_join(export, existing, keys, rows), lab, ("k_po", "k_item"), source)
    cand = mapped.filter(~F.col("_bad")).withColumn("_own", own_line("k_po"))
    first = first_per_key(cand, ["k_po", "_own", "k_item"], ["file", "line_no"])
    return conform(request_ids(first, ["file", "line_no"], existing, as_of, rows=rows))


# ---- PO summary ----------------------------------------------------------------
def map_po_summary(p: DataFrame, lab: str, source: str = IMPORT_SOURCE) -> DataFrame:
    """P19 (summary): columns of a PO summary -> order columns."""
    amount = F.coalesce(F.col("Total Amount").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return p.select(
        "file", "line_no",
        F.lit(SUMMARY_ITEM).alias("item"), F.lit(1.0).alias("qty"),
        amount.cast("decimal(18,4)").alias("unit_price"), amount.alias("total"),
        F.col("Supplier").alias("vendor"),
        F.lit(source).alias("po_source"),
        F.col("k_po").alias("po_no"),
        F.col("PO Owner").alias("ordered_by"),
        F.lit(lab).alias("lab"))


def prepared_po_summary(summary: DataFrame) -> DataFrame:
    return with_position(with_optional(summary, PO_SUMMARY_HEADERS)).withColumn("k_po", cl.po_key("PO Number"))


def po_anti_join(summary: DataFrame, existing: DataFrame, keys: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Summary rows whose PO is not stored: in ``keys`` (a table ``(k_po)`` laid out by key) if given, else in ``existing``.
    ``rows``: of the summary, if they were counted."""
    stored = keys if keys is not None else existing.select(cl.po_key("po_no").alias("k_po")).filter(F.col("k_po").isNotNull())
    p, stored = _meeting(prepared_po_summary(summary), stored, ["k_po"], summary.count() if rows is None else rows, keys is not None)
    return p.join(stored, "k_po", "left_anti")


def import_po_summary(summary: DataFrame, existing: DataFrame, lab: str, as_of: str, source: str = IMPORT_SOURCE,
                      keys: DataFrame | None = None) -> DataFrame:
    """I2 (+J3): one order row per PO not stored yet; the first line of a PO by (file, line) wins, lines without a PO
    are all kept. ``keys``: see ``po_anti_join``."""
    rows = summary.count()
    fresh = po_anti_join(summary, existing, keys, rows).withColumn("_own", own_line("k_po"))
    first = first_per_key(fresh.select("k_po", "_own", "file", "line_no", "Supplier", "Total Amount", "PO Owner"), ["k_po", "_own"], ["file", "line_no"])
    return conform(request_ids(map_po_summary(first, lab, source), ["file", "line_no"], existing, as_of, rows=rows))


# ---- inventory -------------------------------------------------------------------
def stored_origin_ids(existing: DataFrame) -> DataFrame:
    """The original ids in the notes of stored orders, ``(k_orig)``."""
    return existing.select(cl.extract_origin_req("notes").alias("k_orig")).filter(F.col("k_orig").isNotNull())


def prepared_inventory(inv: DataFrame) -> DataFrame:
    """F8 for inventory (item present, longer than 2) + origin id columns."""
    inv = with_position(with_optional(inv, [*INVENTORY_HEADERS, "sheet"]))
    named = inv.filter(F.col("Item").isNotNull() & (F.length("Item") > 2))
    return named.select("*", cl.origin_id("Req#").alias("orig"), cl.origin_key("Req#").alias("k_orig"))


def origin_req_anti_join(inv: DataFrame, existing: DataFrame, keys: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Inventory rows whose original id is not stored: in ``keys`` (a table ``(k_orig)`` laid out by key) if given, else in
    the notes of ``existing``; blank, "*" and "nan" ids always pass. ``rows``: of the inventory, if they were counted."""
    p = prepared_inventory(inv)
    blank = cl.is_blank_id(F.col("orig"))
    # Rows with a blank id meet no stored one. Each has a join key of its own (stored ids hold no "."), so that the many
    # of them aren't dealt to one task.
    p = p.withColumn("_j", F.when(blank, F.concat_ws("#", F.lit("."), "file", "line_no")).otherwise(F.col("k_orig")))
    stored = (keys if keys is not None else stored_origin_ids(existing)).withColumnRenamed("k_orig", "_j")
    p, stored = _meeting(p, stored, ["_j"], inv.count() if rows is None else rows, keys is not None, real=p.filter(~blank))
    return p.join(stored, "_j", "left_anti").drop("_j")


def map_inventory(p: DataFrame, lab: str, keep: tuple = (), source: str = IMPORT_SOURCE) -> DataFrame:
    """P19 (inventory) + P11, P12, P14; ``keep`` columns ride along."""
    qty = cl.parse_pack_qty("#")
    amount = F.coalesce(F.col("Amount").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    total = F.coalesce(F.col("Total").try_cast("decimal(18,2)"), F.try_multiply(qty.try_cast("decimal(18,4)"), amount).try_cast("decimal(18,2)"))
    return p.select(
        "sheet", "file", "line_no",
        F.substring("Item", 1, 200).alias("item"), qty.alias("qty"), amount.alias("unit_price"), total.alias("total"),
        F.col("Vendor").alias("vendor"),
        sheet_grant("sheet").alias("grant"),
        F.lit(source).alias("po_source"),
        nullif_blank(cl.origin_note("Req#")).alias("notes"),
        F.lit(lab).alias("lab"),
        *keep)


def import_inventory(inv: DataFrame, existing: DataFrame, lab: str, as_of: str, source: str = IMPORT_SOURCE,
                     keys: DataFrame | None = None) -> DataFrame:
    """Inventory rows not imported before (by original id), first row of an
    id wins inside the workbook (one ``min_by`` aggregation, no join back), rows with a blank id are all kept;
    ids in (sheet, file, line) order. Rows whose total exceeds the money type are quarantined. ``keys``: see ``origin_req_anti_join``."""
    rows = inv.count()
    passed = origin_req_anti_join(inv, existing, keys, rows)
    real = F.when(~cl.is_blank_id(F.col("orig")), F.col("k_orig"))
    mapped = map_inventory(passed.withColumn("_key", real).withColumn("_own", F.when(real.isNull(), F.struct("sheet", "file", "line_no"))),
                           lab, ("_key", "_own"), source).filter(F.col("total").isNotNull())
    first = first_per_key(mapped, ["_key", "_own"], ["sheet", "file", "line_no"])
    return conform(request_ids(first, ["sheet", "file", "line_no"], existing, as_of, rows=rows))


def import_export(export: DataFrame, existing: DataFrame, lab: str, as_of: str, source: str = IMPORT_SOURCE) -> DataFrame:
    """The importer that the columns call for (an error if none does); ``source`` is the purchase source of its orders."""
    if "sheet" in export.columns and "Item" in export.columns:
        return import_inventory(export, existing, lab, as_of, source)
    if detect_export_format(export.columns) == "line_items":
        return import_line_items(export, existing, lab, as_of, source)
    return import_po_summary(export, existing, lab, as_of, source)


def import_report(export: DataFrame, existing: DataFrame, lab: str) -> DataFrame:
    """What becomes of every row of an export: ``(disposition, rows)``, whose rows sum to the rows read.

    imported, duplicate (stored already, or a later row of its key), unnamed, unpriced (line items without a positive
    price) and quarantined."""
    if "sheet" in export.columns and "Item" in export.columns:
        rows = with_position(with_optional(export, INVENTORY_HEADERS))
        fresh = origin_req_anti_join(rows, existing)
        mapped = map_inventory(fresh, lab, keep=("orig", "k_orig"))
        key = F.when(~cl.is_blank_id(F.col("orig")), F.col("k_orig"))
        counts = (mapped.groupBy(F.col("total").isNull().alias("bad"), key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
                  .agg(F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("quarantined"),
                       F.coalesce(F.sum(F.when(~F.col("bad"), F.when(F.col("k").isNull(), F.col("n")).otherwise(1))), F.lit(0)).alias("imported")))
        named = F.coalesce(F.length("Item") > 2, F.lit(False))
        seen = rows.agg(F.count_if(~named).alias("unnamed"), F.count_if(named).alias("named"))
    elif detect_export_format(export.columns) == "po_summary":
        counts = (po_anti_join(export, existing).groupBy("k_po").agg(F.count(F.lit(1)).alias("n"))
                  .agg(F.lit(0).cast("bigint").alias("quarantined"), F.coalesce(F.sum(F.when(F.col("k_po").isNull(), F.col("n")).otherwise(1)), F.lit(0)).alias("imported")))
        seen = export.agg(F.lit(0).cast("bigint").alias("unnamed"), F.count(F.lit(1)).alias("named"))
    else:
        priced = line_item_dispositions(export, existing, lab).groupBy("disposition").agg(F.count(F.lit(1)).alias("rows"))
        return priced.unionByName(unpriced_lines(export).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("unpriced").alias("disposition"), "rows")).filter("rows > 0")
    both = counts.join(F.broadcast(seen), how="inner", on=F.lit(True))  # one row each
    duplicate = F.col("named") - F.col("imported") - F.col("quarantined")
    return both.select(F.explode(F.create_map(F.lit("imported"), F.col("imported"), F.lit("quarantined"), F.col("quarantined"), F.lit("unnamed"), F.col("unnamed"),
                                              F.lit("duplicate"), duplicate)).alias("disposition", "rows")).filter("rows > 0")
