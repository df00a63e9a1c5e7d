"""The batch operators applied to file streams.

X1 scores arriving order files with a fitted (static) anomaly model: a
stateless ``mapInPandas`` per micro-batch, appended to a parquet sink.

X2 imports arriving line-item export files in two steps that share one epoch:

1. Staging. The files of a micro-batch are read by their own headers and mapped; every line gets the disposition that the
   batch alone can tell (unnamed, unpriced, quarantined, duplicate of an earlier line of the batch, or candidate) and is
   written to a new folder, which a log then names for the epoch. An epoch that is logged isn't staged again.
2. Import. A second query streams the staged candidates through ``dropDuplicates`` on the import key (PO, first 30
   characters of the item). The keys live in Spark's state store (RocksDB, one partition of keys per task, kept in the
   checkpoint), seeded once with the stored table's keys. What passes is numbered and appended to the store under the epoch.

So a batch reads its own files and its state, never the stored table. ``import_outcomes`` gives every line read with
what became of it. Both steps can be replayed: state rejects lines that it has seen, and the store skips an epoch that is logged.

A query resumes where it stopped if it is started again with the same ``checkpoint`` folder and, for X1, the same sink;
without one it takes a new folder under the shared one and reads everything.
"""

from __future__ import annotations

import math
import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labledger.functions import clean as cl
from labledger.operators import anomaly as an
from labledger.operators import ingest as ing
from labledger.operators.numbering import request_ids, request_prefix
from labledger.schema import ORDER
from labledger.session import freed_shuffles, scratch_path, with_conf
from labledger.sources.exports import scan_line_items
from labledger.sources.store import OrderStore
from labledger.sources.tables import ROWS_PER_TASK


def stream_score_orders(spark: SparkSession, source_dir: str, model: an.ForestModel,
                        sink_dir: str | None = None, max_files_per_trigger: int = 1, checkpoint: str | None = None) -> str:
    """readStream (parquet order files) -> M4 scoring -> append to parquet."""
    sink_dir = sink_dir or scratch_path(spark, "stream", "scores")
    ckpt = checkpoint or scratch_path(spark, "stream", "scores_ckpt")
    src = (spark.readStream.schema(ORDER).option("maxFilesPerTrigger", max_files_per_trigger)
                .parquet(source_dir))
    scored = an.score_new_orders(src, model)
    q = (scored.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
               .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return sink_dir


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# A commit writes what changed, and a new key costs no second lookup that keeps a number of keys nobody reads.
STATE_CHANGES = ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
STATE_UNCOUNTED = ("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
#: A staged line: the order columns but for the id, its place, its disposition so far, and the attempt that staged it.
STAGED = T.StructType([f for f in ORDER.fields if f.name != "req_id"] + [T.StructField("file", T.StringType()), T.StructField("line_no", T.LongType()),
                                                                        T.StructField("disposition", T.StringType()), T.StructField("attempt", T.StringType())])
CANDIDATE, STORED = "candidate", "stored"


def _staged(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in STAGED.fields])


def stage_lines(export: DataFrame, lab: str) -> DataFrame:
    """Every line of an export with the disposition that needs no stored key; ``candidate``: the state decides."""
    judged = ing.line_item_dispositions(export, None, lab)
    judged = judged.withColumn("disposition", F.when(F.col("disposition") == "imported", CANDIDATE).otherwise(F.col("disposition")))
    return _staged(judged).unionByName(_staged(ing.unpriced_lines(export).withColumn("disposition", F.lit("unpriced"))))


def _read(spark: SparkSession, schema: str | T.StructType, path: str) -> DataFrame:
    """A table that may not exist yet, with the folders below it."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class ImportStream:
    """Line-item CSV files, as they arrive, into an order store."""

    IMPORTED = "file string, line_no bigint, req_id string"
    SEEDED = "version bigint"
    STAGE_LOG = "epoch bigint, attempt string"

    def __init__(self, spark: SparkSession, store: OrderStore, as_of: str, lab: str, checkpoint: str):
        self.spark, self.store, self.as_of, self.lab, self.root = spark, store, as_of, lab, checkpoint.rstrip("/")

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    # -- the state ---------------------------------------------------------
    def seed(self) -> None:
        """Bring the keys and the day's ids of versions that others wrote into the state; a full version counts whole.

        A stored order that is deleted later stays in the state: its line isn't imported again.
        """
        log = self.store.versions()
        done = _read(self.spark, self.SEEDED, self._path("seeded")).agg(F.max("version")).first()[0] or 0
        mine = F.coalesce(F.col("epoch").startswith(f"{self.root}#"), F.lit(False))
        fresh = [r["version"] for r in log.filter((F.col("version") > done) & ~mine).select("version").collect()]  # one row per version
        if not fresh:
            return
        table = self.store.read(since=done)
        keys = table.select("po_no", F.substring(F.coalesce("item", F.lit("")), 1, ing.KEY_ITEM_CHARS).alias("item")).filter("po_no is not null").distinct()
        _staged(keys.withColumn("disposition", F.lit(STORED))).write.parquet(self._path("staged", f"stored-{max(fresh)}-{uuid.uuid4().hex[:12]}"))
        ids = table.select("req_id").filter(F.col("req_id").startswith(request_prefix(self.as_of) + "-"))
        ids.write.mode("overwrite").parquet(self._path("ids", f"epoch=stored-{max(fresh)}"))
        self.import_staged()
        self.spark.createDataFrame([(max(fresh),)], self.SEEDED).coalesce(1).write.mode("append").parquet(self._path("seeded"))

    # -- step 1 ------------------------------------------------------------
    def stage(self, batch: DataFrame, epoch_id: int) -> None:
        files = [unquote(r["file"]) for r in batch.distinct().collect()]  # at most max_files_per_trigger
        if files and _read(self.spark, self.STAGE_LOG, self._path("staged_log")).filter(F.col("epoch") == epoch_id).isEmpty():
            attempt = f"{epoch_id}-{uuid.uuid4().hex[:12]}"
            staged = stage_lines(scan_line_items(self.spark, sorted(files)), self.lab).withColumn("attempt", F.lit(attempt))
            with freed_shuffles(self.spark):
                staged.write.parquet(self._path("staged", f"lines-{attempt}"))
            self.spark.createDataFrame([(epoch_id, attempt)], self.STAGE_LOG).coalesce(1).write.mode("append").parquet(self._path("staged_log"))
        self.import_staged()

    # -- step 2 ------------------------------------------------------------
    def import_staged(self) -> None:
        """Run what is staged through the state."""
        staged = self.spark.readStream.schema(STAGED).option("recursiveFileLookup", True).parquet(self._path("staged"))
        own = F.when(F.col("po_no").isNull(), F.concat_ws("#", "file", "line_no"))  # lines without a PO have no key
        keyed = (staged.filter(F.col("disposition").isin(CANDIDATE, STORED)).withColumn("own", own)
                 .withColumn("k_po", cl.po_key("po_no")).withColumn("k_item", F.substring(F.coalesce("item", F.lit("")), 1, ing.KEY_ITEM_CHARS))
                 .dropDuplicates(["k_po", "own", "k_item"]))
        with with_conf(self.spark, *STATE_STORE), with_conf(self.spark, *STATE_CHANGES), with_conf(self.spark, *STATE_UNCOUNTED):
            q = (keyed.filter(F.col("disposition") == CANDIDATE).writeStream.foreachBatch(self._append)
                 .option("checkpointLocation", self._path("import_ckpt")).trigger(availableNow=True).start())
            q.awaitTermination()

    def _append(self, batch: DataFrame, epoch_id: int) -> None:
        epoch, path = f"{self.root}#{epoch_id}", self._path("imported", f"epoch={epoch_id}")
        passed = scratch_path(self.spark, "stream", "passed")
        batch.select(*STAGED.names).write.parquet(passed)  # run once, also for a replay: that's what commits the state
        if self.store.has_epoch(epoch):
            return
        ids = _read(self.spark, "req_id string", self._path("ids"))
        new = self.spark.read.schema(STAGED).parquet(passed).drop("disposition", "attempt")
        request_ids(new, ["file", "line_no"], ids, self.as_of).write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(T.StructType([*STAGED.fields[:-2], ORDER["req_id"]])).parquet(path)
        if not rows.isEmpty():
            rows.select("req_id").write.mode("overwrite").parquet(self._path("ids", f"epoch={epoch_id}"))
            self.store.append(ing.conform(rows), epoch)


def stream_import(spark: SparkSession, source_dir: str, store: OrderStore, as_of: str, lab: str = "Admin",
                  max_files_per_trigger: int = 4, checkpoint: str | None = None) -> OrderStore:
    """readStream (line-item CSV files) -> staged lines -> keyed state -> append to the store.

    Imports what arrived since the last run with the same ``checkpoint`` and returns. A key's first line by arrival is
    imported, within a micro-batch by (file, line). A quarantined line counts as such, whether its key is stored or not.
    """
    job = ImportStream(spark, store, as_of, lab, checkpoint or scratch_path(spark, "stream", "import_ckpt"))
    with with_conf(spark, "spark.sql.shuffle.partitions", str(stream_partitions(spark, store))):
        job.seed()
        # The stream delivers which files are new; each batch reads them by their own headers.
        raw = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(source_dir)
                    .select(F.col("_metadata.file_path").alias("file")))
        q = (raw.writeStream.foreachBatch(job.stage).option("checkpointLocation", job._path("stage_ckpt"))
                .trigger(availableNow=True).start())
        q.awaitTermination()
    return store


def stream_partitions(spark: SparkSession, store: OrderStore) -> int:
    """Partitions of an import stream's state and batches: a batch is a few files and every partition of the state is opened and
    committed for it, so there are as many as cores, or as the stored rows ask for, and no more than the session's."""
    asked = max(spark.sparkContext.defaultParallelism, math.ceil(store.read().count() / ROWS_PER_TASK))
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), asked)


def import_outcomes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Every line that an import stream has read: ``(file, line_no, disposition, req_id)`` and the mapped order columns.

    imported (with its id), duplicate, unnamed, unpriced or quarantined; each line has one row, after replays too.
    """
    log = _read(spark, ImportStream.STAGE_LOG, f"{checkpoint}/staged_log")
    staged = _read(spark, STAGED, f"{checkpoint}/staged").join(log.select("attempt"), "attempt", "left_semi").drop("attempt")
    imported = _read(spark, ImportStream.IMPORTED, f"{checkpoint}/imported")
    became = F.when(F.col("disposition") != CANDIDATE, F.col("disposition")).when(F.col("req_id").isNotNull(), "imported").otherwise("duplicate")
    return staged.join(imported, ["file", "line_no"], "left").withColumn("disposition", became)


__all__ = ["stream_score_orders", "stream_import", "stage_lines", "import_outcomes", "ImportStream"]
