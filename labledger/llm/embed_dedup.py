"""Near-duplicate embeddings by int8 tile products with rigorous error bounds (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labledger.llm.common import by_salt, connected_components, groups, ready, salted, written

TILE_BYTES = 8 << 20  # of float64 vectors in one side of a tile
BLOCK_CELLS = 2 << 20  # products that a tile holds at once
LINK_SCHEMA = "rep bigint, linked bigint, partner bigint"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes q and scales s of unit rows x, with |x - s q| and |s q| of each row."""
    s = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / s[:, None]).astype(np.int8)
    approx = q * s[:, None]
    slack = 1e-12  # above any rounding of these norms
    return q, s, np.linalg.norm(x - approx, axis=1) + slack, np.linalg.norm(approx, axis=1) + slack


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: partial sums of 1024 terms stay below 2**24, so float32 holds them."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k:k + 1024].astype(np.float32) @ b[:, k:k + 1024].astype(np.float32).T
    return out


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine(x[i], y[j]) >= threshold in double precision, by blocks of rows of x; i < j if both
    sides are the same.

    The int8 product of two unit vectors is off by at most |ex| |sy qy| + |sx qx| |ey| + |ex| |ey|; only pairs
    that reach the threshold within this bound are computed in full precision.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex, mx = quantise(x / nx[:, None])
    qy, sy, ey, my = quantise(y / ny[:, None])
    rows, step = max(1, BLOCK_CELLS // len(y)), max(1, BLOCK_CELLS // x.shape[1])
    for at in range(0, len(x), rows):
        b = slice(at, at + rows)
        near = int8_products(qx[b], qy) * sx[b, None] * sy[None, :]
        near += ex[b, None] * my[None, :] + mx[b, None] * ey[None, :] + ex[b, None] * ey[None, :]
        i, j = np.nonzero(near >= threshold - 1e-9)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        keep = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), step):
            p, r = i[k:k + step], j[k:k + step]
            keep[k:k + step] = np.einsum("ij,ij->i", x[p], y[r]) / (nx[p] * ny[r]) >= threshold
        yield i[keep], j[keep]


def spanning(nodes: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each node over the links (i, j): minimum labels with pointer jumping."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tiles(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        side, same = t["first_side"].to_numpy(), t["i"][0].as_py() == t["j"][0].as_py()
        t, na = t.take(np.argsort(~side, kind="stable")), int(side.sum())
        rep, mult = t["rep"].to_numpy(), t["mult"].to_numpy()
        vec = t["vec"].combine_chunks()
        size = vec.value_lengths().to_numpy()
        linked, left, right = np.zeros(len(rep), dtype=np.int64), [], []
        for d in np.unique(size):  # vectors of different lengths aren't compared
            a = np.flatnonzero(size[:na] == d)
            b = a if same else na + np.flatnonzero(size[na:] == d)
            if not len(a) or not len(b):
                continue
            rows = lambda k: vec.take(pa.array(k)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(k), d)  # noqa: E731,B023
            for i, j in tile_links(rows(a), rows(b), threshold, same):
                i, j = a[i], b[j]
                linked += np.bincount(i, mult[j], len(rep)).astype(np.int64) + np.bincount(j, mult[i], len(rep)).astype(np.int64)
                label = spanning(len(rep), i, j)  # a block keeps no more links than rows
                hit = np.flatnonzero(label != np.arange(len(rep)))
                left.append(hit)
                right.append(label[hit])
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
        label = spanning(len(rep), i, j)
        hit = np.flatnonzero(linked > 0)
        return pa.table({"rep": rep[hit], "linked": linked[hit], "partner": rep[label[hit]]})

    return run


def embedding_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
                    threshold: float = 0.93, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Direct links and components of near-duplicate vectors: one row ``(id_col, n_links, component_id, kept)`` per row.

    Two vectors are linked if their labels are equal and not null (``label_col=None``: all vectors share one
    label) and their cosine in double precision is at least ``threshold``. A vector that is null, empty or zero, holds
    a null or non-finite component, or has another length than its partner links with nothing.

    Rows with equal label and vector form one class that is compared once and counts as often as it has rows, so
    copies are never expanded into pairs. The classes of a label are dealt by hash into chunks of bounded size; each
    pair of chunks is one tile: an int8 matrix product with error bounds, followed by an exact check of the pairs
    that may reach the threshold. A tile returns one row per linked class (number of linked rows and the smallest
    class it reaches inside the tile), never pairs. Empty input gives an empty result. Repeated ids count as rows of
    their own, whatever their vectors, as classes are numbered. A row with a null id gets the links and component of the rows with its vector, but is no one's partner.
    """
    spark = ready(df.sparkSession)
    ok = (F.col("vec").isNotNull() & (F.size("vec") > 0)
          & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
          & F.exists("vec", lambda x: x != 0.0))
    label = F.col(label_col) if label_col else F.lit(0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"),
                     F.col(vec_col).cast("array<double>").alias("vec"))
    valid = F.coalesce(ok, F.lit(False)) & F.col("label").isNotNull()
    rows = salted(rows, "id")
    key = ["label", "vec"]
    classes = written(groups(rows.filter(valid), key, least=(F.min("id"), F.min), mult=(F.count("id"), F.sum)).filter("mult > 0")
                      .withColumn("rep", F.monotonically_increasing_id()))
    sizes = (classes.groupBy("label").agg(F.ceil(F.sum(F.size("vec") * 8.0) / tile_bytes).alias("chunks")))
    dealt = (classes.join(sizes, "label")
             .withColumn("mine", F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("chunks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep", "mult",
                     "vec", (F.col("mine") <= F.col("other")).alias("first_side")))
    tiles = written(dealt.groupBy("label", "i", "j").applyInArrow(_tiles(threshold), LINK_SCHEMA))
    comp = connected_components(tiles.select(F.col("rep").alias("u"), F.col("partner").alias("v")))
    linked = tiles.groupBy("rep").agg(F.sum("linked").alias("linked"))
    joined = salted(classes.join(linked, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
                    .withColumn("component", F.coalesce("component", "rep")).withColumnRenamed("salts", "own"), "rep")
    named = groups(joined, ["component"], component_id=(F.min("least"), F.min))
    per_class = (joined.join(by_salt(named), ["component", "salt"])
                 .select(*key, "mult", F.coalesce("linked", F.lit(0)).alias("linked"), "component_id", F.col("own").alias("salts")))
    joined = (rows.join(by_salt(per_class), [*key, "salt"], "left")
              .select(F.col("id").alias(id_col),
                      F.coalesce(F.col("mult") - F.when(F.col("id").isNull(), 0).otherwise(1) + F.col("linked"), F.lit(0)).alias("n_links"),
                      F.when(F.col("id").isNull(), F.col("component_id")).otherwise(F.coalesce("component_id", "id")).alias("component_id")))
    return joined.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
