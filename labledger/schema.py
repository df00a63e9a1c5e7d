"""The typed order table (19 columns) and the raw export shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The order table's column list, as the original tool names them,
# paired with this library's names, in the original order.
SOURCE_NAMES = {
    "REQ#": "req_id",
    "ITEM": "item",
    "NUMBER OF ITEM": "qty",
    "AMOUNT PER ITEM": "unit_price",
    "TOTAL": "total",
    "VENDOR": "vendor",
    "CAT #": "cat_no",
    "GRANT USED": "grant",
    "RF PROJECT": "rf_project",
    "SPLIT %": "split_pct",
    "PO SOURCE": "po_source",
    "PO #": "po_no",
    "NOTES": "notes",
    "ORDERED BY": "ordered_by",
    "DATE ORDERED": "date_ordered",
    "DATE RECEIVED": "date_received",
    "RECEIVED BY": "received_by",
    "ITEM LOCATION": "location",
    "LAB": "lab",
}

MONEY = T.DecimalType(18, 2)
PRICE = T.DecimalType(18, 4)

ORDER = T.StructType([
    T.StructField("req_id", T.StringType(), False),
    T.StructField("item", T.StringType()),
    T.StructField("qty", T.DoubleType()),
    T.StructField("unit_price", PRICE),
    T.StructField("total", MONEY),
    T.StructField("vendor", T.StringType()),
    T.StructField("cat_no", T.StringType()),
    T.StructField("grant", T.StringType()),
    T.StructField("rf_project", T.StringType()),
    T.StructField("split_pct", T.StringType()),
    T.StructField("po_source", T.StringType()),
    T.StructField("po_no", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("ordered_by", T.StringType()),
    T.StructField("date_ordered", T.DateType()),
    T.StructField("date_received", T.DateType()),
    T.StructField("received_by", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("lab", T.StringType()),
])

ORDER_COLUMNS = [f.name for f in ORDER.fields]

# Raw export headers.
LINE_ITEM_HEADERS = ["PO #", "Item", "Vendor", "Quantity", "Unit Price ($)", "Line Total ($)",
                     "Grant", "RF Project", "Split %", "Catalog #", "Ordered By", "Date Ordered"]
PO_SUMMARY_HEADERS = ["PO Number", "Supplier", "Total Amount", "PO Owner"]
INVENTORY_HEADERS = ["Req#", "Item", "#", "Amount", "Total", "Vendor"]


def conform(df: DataFrame) -> DataFrame:
    """S2 + S3: add each missing order column as a typed null, drop extras,
    fix the column order and types, turn blank text into null."""
    have = set(df.columns)
    cols = []
    for f in ORDER.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        c = c.cast(f.dataType)
        cols.append((F.nullif(c, F.lit("")) if f.dataType == T.StringType() and f.name in have else c).alias(f.name))
    return df.select(*cols)


def empty_orders(spark) -> DataFrame:
    return spark.createDataFrame([], ORDER)
