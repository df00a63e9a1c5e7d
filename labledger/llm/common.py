"""Helpers shared by the operators of this package: written intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labledger.session import scratch_path, shared_dir, ship_package


def ready(spark: SparkSession) -> SparkSession:
    """Register the shared folder and ship the package to the executors (once per application)."""
    shared_dir(spark)
    ship_package(spark)
    return spark


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder of the shared scratch space and read it back.

    The files outlive executors, cut the lineage, and give the planner the size of what it joins next.
    """
    path = scratch_path(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-independent checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


SALTS = 64  # tasks that share the rows of one group


def salted(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with a column ``salt`` that deals the rows of any group out by ``by``."""
    return df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def groups(rows: DataFrame, keys: list[str], **aggs) -> DataFrame:
    """Aggregates of the groups of ``salted`` rows, in two steps, and the ``salts`` that each group's rows have (at most SALTS).

    ``aggs``: name = (aggregate of the rows, function that combines such aggregates).
    """
    parts = rows.groupBy(*keys, "salt").agg(*[a.alias(n) for n, (a, _) in aggs.items()])
    return parts.groupBy(*keys).agg(*[f(n).alias(n) for n, (_, f) in aggs.items()], F.collect_list("salt").alias("salts"))


def by_salt(df: DataFrame) -> DataFrame:
    """A row of ``groups`` once for each of its salts. Joined by the keys and the salt to the salted rows, it brings a group's
    aggregates back to its rows while no task meets a whole group; copies number no more than rows."""
    return df.withColumn("salt", F.explode("salts")).drop("salts")


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(u, v)`` as rows ``(node, component)``.

    ``component`` is the smallest node that can be reached. Nodes without an edge to another node have no row.
    The large-star / small-star iteration: every round is an aggregation and two equi-joins over the edges and is
    written to the shared folder, so lost executors repeat one round at most. A hub's edges are pre-aggregated
    before the shuffle, and adaptive execution splits them in the joins. (Dealing them out by ``salted`` doubles the
    shuffles of a round, which costs more than a hub of edges of 16 bytes does.)
    """
    e = written(edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = written(small)
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
