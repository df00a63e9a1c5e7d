"""Export files written from the supplied tables (each kind once per session and data
directory, when first asked for) into the shared folder, for the import pipelines and readers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import SparkSession, functions as F

from labledger.schema import PO_SUMMARY_HEADERS
from labledger.session import freed_shuffles, scratch_path
from labledger.sources import fixtures as fx
from labledger.sources.store import order_table
from labledger.sources.tables import partitions_for

# The preamble of a PO summary export (nine lines before the header).
PREAMBLE = ["Purchase Orders Completed", "", "Report: purchase orders by month", "Export month: {m}",
            "Currency: USD", "", "Source: purchasing system", "Rows: one per purchase order", ""]
# Line items and inventory: a file holds the rows of one task of the numbering, so compressed files needn't be split.
CSV_FILES = {"header": True, "compression": "gzip"}


class ExportFiles:
    """The paths of the three kinds of exports; a kind that nobody asks for isn't written."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def write(self) -> ExportFiles:
        """All three kinds."""
        self.line_items, self.po_summary, self.inventory  # noqa: B018
        return self

    @cached_property
    def line_items(self) -> str:
        path = scratch_path(self.spark, "exports", "line_items")
        lines = fx.line_item_export(order_table(self.spark, self.sf_dir))
        with freed_shuffles(self.spark):
            lines.write.options(**CSV_FILES).csv(path)
        return path

    @cached_property
    def inventory(self) -> str:
        path = scratch_path(self.spark, "exports", "inventory")
        rows = fx.inventory_rows(order_table(self.spark, self.sf_dir))
        with freed_shuffles(self.spark):
            rows.write.partitionBy("sheet").options(**CSV_FILES).csv(path)
        return path

    @cached_property
    def po_summary(self) -> str:
        path = scratch_path(self.spark, "exports", "po_summary")
        orders = order_table(self.spark, self.sf_dir)
        rows = fx.po_summary_rows(orders)
        header = ",".join(PO_SUMMARY_HEADERS)
        months = rows.select("export_month").distinct()
        pre = months.select("export_month", F.posexplode(F.array(*[F.lit(p) for p in PREAMBLE])).alias("ord", "value"))
        pre = pre.select("export_month", "ord", F.lit(0).cast("bigint").alias("po"),
                         F.replace("value", F.lit("{m}"), F.col("export_month")).alias("value"))
        hdr = months.select("export_month", F.lit(len(PREAMBLE)).alias("ord"), F.lit(0).cast("bigint").alias("po"),
                            F.lit(header).alias("value"))
        body = rows.select("export_month", F.lit(len(PREAMBLE) + 1).alias("ord"),
                           F.col("PO Number").cast("bigint").alias("po"),
                           F.to_csv(F.struct(*PO_SUMMARY_HEADERS)).alias("value"))
        with freed_shuffles(self.spark):
            (pre.unionByName(hdr).unionByName(body)
                .repartition(partitions_for(self.spark, orders.count()), "export_month").sortWithinPartitions("export_month", "ord", "po")
                .select("export_month", "value")
                .write.partitionBy("export_month").text(path))
        return path


_CACHE: dict[tuple[str, str], ExportFiles] = {}


def export_files(spark: SparkSession, sf_dir: str) -> ExportFiles:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        _CACHE[key] = ExportFiles(spark, sf_dir)
    return _CACHE[key]
