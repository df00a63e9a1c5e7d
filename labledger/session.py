"""Session construction and the shared scratch folder.

Work that must cut lineage (checkpoints, snapshots) goes to the folder the
cluster names in ``spark.checkpoint.dir``. Only when that setting is absent
*and* the master is local (tests, benches) do we create one under /tmp.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "labledger", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and snapshots.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir). If unset
    on a local master, a fresh folder under /tmp is registered; on a cluster
    an unset value is an error, because a machine-local folder would lose
    data with its executor.
    """
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover - conf lookup is best effort
            d = None
    if not d:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="labledger-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir()
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A new, never reused path under the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return "/".join([base, "labledger", *parts, uuid.uuid4().hex])


@contextmanager
def with_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends, not when the driver's garbage is collected: for
    queries whose result is written, so that the disk holds the result and not what led to it."""
    return with_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``labledger`` importable in executor Python workers (the
    ``--py-files`` mechanism): zip the package once per application and hand
    it to ``addPyFile``, which distributes it with the job."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="labledger-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


__all__ = ["get_session", "shared_dir", "ship_package", "scratch_path", "with_conf", "freed_shuffles", "DEFAULT_CONF"]
