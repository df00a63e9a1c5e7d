"""The oracle-checked order table derived from the supplied TPC-H-like tables.

``order_lines`` maps one lineitem to one purchase-order line of the typed order
table. ``order_lines_sql`` is the same definition as text for DuckDB.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from labledger.schema import conform
from labledger.sources.tables import dealt_by_rows, files_for, table

# The as-of instant used wherever the original used "now".
AS_OF = "2001-08-02"

_S = "string"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lineitem is the fact table: it never becomes a broadcast build side. It meets part while it is narrow, then orders in a
    # sort-merge join, with as many partitions as its rows ask for, so that no task sorts more than fits its memory.
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    # Dimensions (nation, region, part, supplier, customer) are broadcast by the
    # planner only while their measured size is under the broadcast threshold.
    geo = n.join(r, n.n_regionkey == r.r_regionkey)
    # Customer attributes are joined onto orders (a quarter of lineitem's size)
    # before orders meets lineitem, so the wide lineitem stream is shuffled
    # once less.
    cust = c.join(geo, c.c_nationkey == geo.n_nationkey)
    oc = o.join(cust, o.o_custkey == cust.c_custkey)

    j = lines.join(p, lines.l_partkey == p.p_partkey).join(s, lines.l_suppkey == s.s_suppkey)
    j = dealt_by_rows(j, lines.count(), "l_orderkey").hint("merge").join(oc, F.col("l_orderkey") == oc.o_orderkey)

    ship = F.col("l_shipdate").cast("date")
    req_id = F.concat(F.lit("L"), F.col("l_orderkey").cast(_S), F.lit("-"), F.col("l_linenumber").cast(_S),
                      F.lit("-"), F.col("l_partkey").cast(_S), F.lit("-"), F.col("l_suppkey").cast(_S),
                      F.lit("-"), ship.cast(_S))
    unit_price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000 + 0.5).cast("bigint")
                  * F.lit(Decimal("0.0001")).cast("decimal(5,4)")).cast("decimal(18,4)")
    out = j.select(
        req_id.alias("req_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast(_S)).alias("item"),
        F.col("l_quantity").alias("qty"),
        unit_price.alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total"),
        F.col("s_name").alias("vendor"),
        F.col("p_partkey").cast(_S).alias("cat_no"),
        F.when((F.col("c_custkey") % 10).isin(0, 1), F.lit(None)).otherwise(F.col("c_mktsegment")).alias("grant"),
        F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(F.col("n_name")).alias("rf_project"),
        F.when(F.col("l_discount") > 0,
               F.concat(F.round(F.col("l_discount") * 100).cast("int").cast(_S), F.lit("%"))).alias("split_pct"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "ShopBlue")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "Stock Room")
         .otherwise("External Vendor").alias("po_source"),
        F.col("o_orderkey").cast(_S).alias("po_no"),
        F.lit(None).cast(_S).alias("notes"),
        F.col("c_name").alias("ordered_by"),
        F.col("o_orderdate").cast("date").alias("date_ordered"),
        F.when(F.col("l_linestatus") == "F",
               F.greatest("l_shipdate", "o_orderdate").cast("date")).alias("date_received"),
        F.lit(None).cast(_S).alias("received_by"),
        F.lit(None).cast(_S).alias("location"),
        F.col("r_name").alias("lab"),
    )
    return conform(out)


# The same definition for DuckDB (used by oracle_sql()).
ORDER_LINES_SQL = """
SELECT
  concat('L', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-', CAST(l_partkey AS VARCHAR),
         '-', CAST(l_suppkey AS VARCHAR), '-', CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS req_id,
  concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS item,
  l_quantity AS qty,
  CAST(CAST(floor(l_extendedprice / l_quantity * 10000 + 0.5) AS BIGINT)
       * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(18,4)) AS unit_price,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS total,
  s_name AS vendor,
  CAST(p_partkey AS VARCHAR) AS cat_no,
  CASE WHEN c_custkey % 10 IN (0, 1) THEN NULL ELSE c_mktsegment END AS "grant",
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE n_name END AS rf_project,
  CASE WHEN l_discount > 0
       THEN concat(CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR), '%') END AS split_pct,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ShopBlue'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'Stock Room' ELSE 'External Vendor' END AS po_source,
  CAST(o_orderkey AS VARCHAR) AS po_no,
  CAST(NULL AS VARCHAR) AS notes,
  c_name AS ordered_by,
  CAST(o_orderdate AS DATE) AS date_ordered,
  CASE WHEN l_linestatus = 'F' THEN CAST(greatest(l_shipdate, o_orderdate) AS DATE) END AS date_received,
  CAST(NULL AS VARCHAR) AS received_by,
  CAST(NULL AS VARCHAR) AS location,
  r_name AS lab
FROM lineitem
JOIN orders   ON l_orderkey  = o_orderkey
JOIN part     ON l_partkey   = p_partkey
JOIN supplier ON l_suppkey   = s_suppkey
JOIN customer ON o_custkey   = c_custkey
JOIN nation   ON c_nationkey = n_nationkey
JOIN region   ON n_regionkey = r_regionkey
"""


# ---------------------------------------------------------------------------
# Derived fixtures. Damage and variants are keyed on the order number so that
# Spark and the DuckDB oracle agree row by row; every row of the order table
# is carried, none is dropped.

def _k():
    return F.col("po_no").cast("bigint") % 20


def order_lines_raw(orders: DataFrame) -> DataFrame:
    """Every column as text, with typical export damage (see FIXTURES.md section 4)."""
    k = _k()
    s = lambda c: F.col(c).cast(_S)
    return orders.select(
        "req_id",
        F.when(k == 4, F.concat("item", F.lit(" - Pkg 10 EA"))).otherwise(F.col("item")).alias("item"),
        F.when(k == 5, F.concat(F.col("qty").cast("bigint").cast(_S), F.lit(" EA"))).otherwise(s("qty")).alias("qty"),
        s("unit_price").alias("unit_price"),
        F.when(k == 1, F.lit("n/a")).otherwise(s("total")).alias("total"),
        F.when(k == 3, F.concat("vendor", F.lit(" Contract no value"))).otherwise(F.col("vendor")).alias("vendor"),
        "cat_no", "grant", "rf_project", "split_pct", "po_source", "po_no", "notes", "ordered_by",
        F.when(k == 0, F.date_format("date_ordered", "MM/dd/yyyy"))
         .when(k == 6, F.lit("not a date")).otherwise(s("date_ordered")).alias("date_ordered"),
        F.when(k == 2, F.lit("")).otherwise(s("date_received")).alias("date_received"),
        "received_by", "location", "lab")


ORDER_LINES_RAW_SQL = """order_lines_raw AS (SELECT req_id,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 4 THEN item || ' - Pkg 10 EA' ELSE item END AS item,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 5 THEN CAST(CAST(qty AS BIGINT) AS VARCHAR) || ' EA' ELSE CAST(qty AS VARCHAR) END AS qty,
  CAST(unit_price AS VARCHAR) AS unit_price,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 1 THEN 'n/a' ELSE CAST(total AS VARCHAR) END AS total,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 3 THEN vendor || ' Contract no value' ELSE vendor END AS vendor,
  cat_no, "grant", rf_project, split_pct, po_source, po_no, notes, ordered_by,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 0 THEN strftime(date_ordered, '%m/%d/%Y')
       WHEN CAST(po_no AS BIGINT) % 20 = 6 THEN 'not a date' ELSE CAST(date_ordered AS VARCHAR) END AS date_ordered,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 2 THEN '' ELSE CAST(date_received AS VARCHAR) END AS date_received,
  received_by, location, lab FROM order_lines)"""

# The stored table the imports run against: orders placed before this date.
STORED_BEFORE = "1999-01-01"


def noted_orders(orders: DataFrame) -> DataFrame:
    """All orders; notes carry the original request id the way inventory imports write it (some with a float ".0")."""
    note = F.concat(F.lit("Original Req#: "), F.col("po_no"),
                    F.when(F.col("qty") > 30, F.lit(".0")).otherwise(F.lit("")), F.lit("."))
    return orders.withColumn("notes", note)


def stored_orders(orders: DataFrame) -> DataFrame:
    """Existing table for the import fixtures: the noted orders before a date."""
    return noted_orders(orders).filter(F.col("date_ordered") < F.lit(STORED_BEFORE).cast("date"))


NOTED_SQL = """noted AS (SELECT * REPLACE (
    'Original Req#: ' || po_no || CASE WHEN qty > 30 THEN '.0' ELSE '' END || '.' AS notes) FROM order_lines)"""
STORED_SQL = f"""{NOTED_SQL},
stored AS (SELECT * FROM noted WHERE date_ordered < DATE '{STORED_BEFORE}')"""


def numbered(orders: DataFrame) -> DataFrame:
    """The orders with ``Line``, their place by request id; the exports share one numbering."""
    from labledger.operators.numbering import index_in_place

    if "Line" in orders.columns:
        return orders
    return index_in_place(orders, "req_id", "Line", partitions=files_for(orders.sparkSession, orders.count()))


# What each export takes of an order, its id aside: only that is sorted and numbered.
LINE_ITEM_COLUMNS = ["po_no", "item", "vendor", "qty", "unit_price", "total", "grant", "rf_project", "split_pct", "cat_no", "ordered_by", "date_ordered"]
INVENTORY_COLUMNS = ["po_no", "item", "vendor", "qty", "unit_price", "total", "grant"]


def numbered_columns(orders: DataFrame, columns: list[str]) -> DataFrame:
    return numbered(orders if "Line" in orders.columns else orders.select("req_id", *columns))


def line_item_export(orders: DataFrame) -> DataFrame:
    """Incoming line-item export: one line per order line, text columns with
    line-item headers (two with stray spaces), ``Line`` = file order."""
    k = _k()
    s = lambda c: F.col(c).cast(_S)
    grant_id = F.concat((F.length("grant") * 1000 + F.ascii("grant") + 100000).cast(_S), F.lit(".0"))
    return numbered_columns(orders, LINE_ITEM_COLUMNS).select(
        F.when(k == 9, F.concat("po_no", F.lit(".0"))).otherwise(F.col("po_no")).alias("PO #"),
        F.when(k == 4, F.concat("item", F.lit(" - Pkg 10 EA"))).when(k == 10, F.lit("ab"))
         .otherwise(F.col("item")).alias(" Item"),
        F.when(k == 3, F.concat("vendor", F.lit(" Contract no value"))).otherwise(F.col("vendor")).alias("Vendor"),
        F.when(k == 5, F.lit(None).cast(_S)).otherwise(s("qty")).alias("Quantity"),
        F.when(k == 7, F.lit(None).cast(_S)).otherwise(s("unit_price")).alias("Unit Price ($)"),
        F.when(k == 1, F.lit(None).cast(_S)).otherwise(s("total")).alias("Line Total ($) "),
        F.when(k == 11, F.lit("abc")).when(F.col("grant").isNotNull(), grant_id).alias("Grant"),
        F.when(F.col("rf_project").isNotNull(),
               F.concat(F.substring("rf_project", 8, 100), F.lit(".0"))).alias("RF Project"),
        F.when(k == 8, F.col("split_pct")).otherwise(F.replace("split_pct", F.lit("%"), F.lit(""))).alias("Split %"),
        F.col("cat_no").alias("Catalog #"),
        F.col("ordered_by").alias("Ordered By"),
        F.when(k == 0, F.date_format("date_ordered", "MM/dd/yyyy"))
         .otherwise(F.concat(s("date_ordered"), F.lit(" 00:00:00"))).alias("Date Ordered"),
        "Line")


LINE_ITEM_SQL = """li AS (SELECT row_number() OVER (ORDER BY req_id) AS line_no,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 9 THEN po_no || '.0' ELSE po_no END AS po_raw,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 4 THEN item || ' - Pkg 10 EA'
       WHEN CAST(po_no AS BIGINT) % 20 = 10 THEN 'ab' ELSE item END AS item_raw,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 3 THEN vendor || ' Contract no value' ELSE vendor END AS vendor_raw,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 5 THEN NULL ELSE CAST(qty AS VARCHAR) END AS qty_raw,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 7 THEN NULL ELSE CAST(unit_price AS VARCHAR) END AS price_raw,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 1 THEN NULL ELSE CAST(total AS VARCHAR) END AS total_raw,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 11 THEN 'abc'
       WHEN "grant" IS NOT NULL THEN CAST(length("grant") * 1000 + ascii("grant") + 100000 AS VARCHAR) || '.0' END AS grant_raw,
  CASE WHEN rf_project IS NOT NULL THEN substring(rf_project, 8, 100) || '.0' END AS project_raw,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 8 THEN split_pct ELSE replace(split_pct, '%', '') END AS split_raw,
  cat_no AS cat_raw, ordered_by AS by_raw,
  CASE WHEN CAST(po_no AS BIGINT) % 20 = 0 THEN strftime(date_ordered, '%m/%d/%Y')
       ELSE CAST(date_ordered AS VARCHAR) || ' 00:00:00' END AS date_raw
  FROM order_lines)"""


def po_summary_rows(orders: DataFrame) -> DataFrame:
    """Incoming PO summary: one row per order number."""
    return (orders.groupBy("po_no").agg(
                F.min("vendor").alias("Supplier"),
                F.sum("total").cast(_S).alias("Total Amount"),
                F.max("ordered_by").alias("PO Owner"),
                F.min("date_ordered").alias("_d"))
                  .select(F.col("po_no").alias("PO Number"), "Supplier", "Total Amount", "PO Owner",
                          F.date_format("_d", "yyyy-MM").alias("export_month")))


PO_SUMMARY_SQL = """pos AS (SELECT po_no AS po_raw, min(vendor) AS supplier_raw, CAST(sum(total) AS VARCHAR) AS amount_raw,
  max(ordered_by) AS owner_raw, strftime(min(date_ordered), '%Y-%m') AS export_month
  FROM order_lines GROUP BY po_no)"""


def inventory_rows(orders: DataFrame) -> DataFrame:
    """Incoming inventory workbook: one sheet per grant (``Sheet1`` without one)."""
    q = F.col("qty")
    qty_text = F.col("qty").cast("bigint").cast(_S)
    return numbered_columns(orders, INVENTORY_COLUMNS).select(
        F.coalesce("grant", F.lit("Sheet1")).alias("sheet"),
        F.when(q <= 2, F.lit("*")).when(q <= 4, F.lit(None).cast(_S))
         .when(q <= 8, F.concat("po_no", F.lit(".0"))).otherwise(F.col("po_no")).alias("Req#"),
        F.when(q == 50, F.lit("ab")).otherwise(F.col("item")).alias("Item"),
        F.when(q <= 25, F.concat(qty_text, F.lit(" EA"))).when(q <= 40, F.concat(qty_text, F.lit(" CS")))
         .alias("#"),
        F.col("unit_price").cast(_S).alias("Amount"),
        F.when(q > 45, F.lit(None).cast(_S)).otherwise(F.col("total").cast(_S)).alias("Total"),
        F.col("vendor").alias("Vendor"),
        "Line")


INVENTORY_SQL = """inv AS (SELECT row_number() OVER (ORDER BY req_id) AS line_no,
  coalesce("grant", 'Sheet1') AS sheet,
  CASE WHEN qty <= 2 THEN '*' WHEN qty <= 4 THEN NULL WHEN qty <= 8 THEN po_no || '.0' ELSE po_no END AS req_raw,
  CASE WHEN qty = 50 THEN 'ab' ELSE item END AS item_raw,
  CASE WHEN qty <= 25 THEN CAST(CAST(qty AS BIGINT) AS VARCHAR) || ' EA'
       WHEN qty <= 40 THEN CAST(CAST(qty AS BIGINT) AS VARCHAR) || ' CS' END AS count_raw,
  CAST(unit_price AS VARCHAR) AS amount_raw,
  CASE WHEN qty > 45 THEN NULL ELSE CAST(total AS VARCHAR) END AS total_raw,
  vendor AS vendor_raw FROM order_lines)"""
