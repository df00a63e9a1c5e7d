"""Merkle manifest of a dataset with a proof for every row, by time-forward processing (operator 11)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window, functions as F

from labledger.llm.common import ready, written

ARITY = 8
BLOCK_LEVELS = 4  # a block holds up to ARITY ** BLOCK_LEVELS nodes of its lowest level

NODES = "tree binary, total bigint, idx bigint, digest string"
PROOFS = "tree binary, idx bigint, subroot string, lefts array<string>, rights array<string>"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(total: int) -> int:
    """Levels above ``total`` nodes: while several are left, every ARITY of them become one."""
    levels = 0
    while total > 1:
        total, levels = -(-total // ARITY), levels + 1
    return levels


class Sweep:
    """The nodes of one block, by time-forward processing.

    A node's label is (its last leaf, its level, its index), so children come before parents. Going up, every node puts
    its digest into a priority queue under its parent's label; a node is due when its label is the smallest, and takes
    all that was sent to it. In this order the queue never holds more than ARITY digests a level. Going down, the labels
    are reversed and the queue delivers to each child the siblings on its path to the top.
    """

    def __init__(self, first: int, leaves: list[str], total: int, levels: int):
        self.total, self.levels = total, levels
        self.children: dict[tuple, list[tuple]] = {}
        self.longest = 0
        queue: list[tuple] = []
        for at, leaf in enumerate(leaves, first):
            self._send(queue, 0, at, leaf)
            while queue and queue[0][0][0] == at:
                label, got = queue[0][0], []
                while queue and queue[0][0] == label:
                    got.append(heapq.heappop(queue)[1:])
                self.children[label] = got
                self._send(queue, label[1], label[2], digest([d for _, d in got]))

    def label(self, level: int, index: int) -> tuple[int, int, int]:
        return min((index + 1) * ARITY ** level, self.total) - 1, level, index

    def _send(self, queue: list[tuple], level: int, index: int, value: str) -> None:
        if level == self.levels:
            self.top = index, value
        else:
            heapq.heappush(queue, (self.label(level + 1, index // ARITY), index, value))
            self.longest = max(self.longest, len(queue))

    def down(self, proof: tuple | None) -> Iterator[tuple[int, tuple | None]]:
        """Each leaf's index and proof, from the last to the first. A proof is (left siblings, right siblings, rest) or None."""
        queue = [(self._reversed(self.label(self.levels, self.top[0])), proof)]
        while queue:
            (last, level, index), proof = heapq.heappop(queue)
            if not level:
                yield -index, proof
                continue
            got = self.children[-last, -level, -index]
            for k, (child, _) in enumerate(got):
                left, right = ("".join(d for _, d in part) for part in (got[:k], got[k + 1:]))
                heapq.heappush(queue, (self._reversed(self.label(-level - 1, child)), (left, right, proof)))

    @staticmethod
    def _reversed(label: tuple) -> tuple:
        return tuple(-x for x in label)


def _steps(proof: tuple | None) -> Iterator[tuple[str, str]]:
    while proof is not None:
        left, right, proof = proof
        yield left, right


def _linked(lefts: list[str], rights: list[str]) -> tuple | None:
    return reduce(lambda rest, step: (*step, rest), zip(reversed(lefts), reversed(rights)), None)


def fold(leaf: str, proof: tuple | None) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in _steps(proof):
        leaf = digest([left, leaf, right])
    return leaf


def _block(t: pa.Table, levels: int) -> tuple[pa.Table, Sweep]:
    t = t.sort_by("idx")
    total = t["total"][0].as_py()
    return t, Sweep(t["idx"][0].as_py(), t["digest"].to_pylist(), total, min(levels, height(total)))


def _tops(t: pa.Table, levels: int) -> pa.Table:
    t, sweep = _block(t, levels)
    index, value = sweep.top
    total = -(-t["total"][0].as_py() // ARITY ** sweep.levels)
    return pa.table({"tree": t["tree"][:1], "total": [total], "idx": [index], "digest": [value]})


def _proofs(t: pa.Table, above: pa.Table, levels: int) -> Iterator[tuple[pa.Table, list[tuple | None]]]:
    if t.num_rows:
        t, sweep = _block(t, levels)
        top = _linked(above["lefts"][0].as_py(), above["rights"][0].as_py()) if above.num_rows else None
        yield t, [p for _, p in reversed(list(sweep.down(top)))]


def _deliver(t: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    for t, proofs in _proofs(t, above, levels):
        steps = [list(_steps(p)) for p in proofs]
        return pa.table({"tree": t["tree"], "idx": t["idx"], "subroot": pa.array(above["subroot"].to_pylist() * t.num_rows, pa.string()),
                         "lefts": pa.array([[s[0] for s in x] for x in steps], pa.list_(pa.string())),
                         "rights": pa.array([[s[1] for s in x] for x in steps], pa.list_(pa.string()))})
    return above.slice(0, 0).rename_columns([{"block": "idx"}.get(c, c) for c in above.column_names]).select(["tree", "idx", "subroot", "lefts", "rights"])


def _checked(t: pa.Table, above: pa.Table, levels: int) -> pa.Table:
    names, rows, kept = ("subroot", "proof_sha256", "folded_root"), [], t.slice(0, 0)
    for kept, proofs in _proofs(t, above, levels):
        subroot = above["subroot"][0].as_py()
        for proof, leaf, tampered in zip(proofs, kept["digest"].to_pylist(), kept["tampered"].to_pylist()):
            rows.append((subroot, digest([x for step in _steps(proof) for x in step]), fold(tampered or leaf, proof)))
    columns = list(zip(*rows)) if rows else ([], [], [])
    return pa.table({"id": kept["id"], "leaf": kept["digest"], **{n: pa.array(c, pa.string()) for n, c in zip(names, columns)}})


def _blocks(nodes: DataFrame, levels: int) -> GroupedData:
    return nodes.withColumn("block", F.expr(f"idx div {ARITY ** levels}")).groupBy("tree", "block")


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of every round up to the trees' roots. A round's table is what the queue holds for the next labels; it's
    written, so that lost executors repeat one round at most."""
    rounds = [nodes]
    while not rounds[-1].filter("total > 1").isEmpty():
        rounds.append(written(_blocks(rounds[-1].select("tree", "total", "idx", "digest"), levels).applyInArrow(lambda t: _tops(t, levels), NODES)))
    return rounds


def descend(rounds: list[DataFrame], proofs: DataFrame, levels: int) -> DataFrame:
    """The proofs of the nodes of the lowest of ``rounds``, from those of the roots (PROOFS)."""
    for nodes in reversed(rounds[:-1]):
        above = proofs.withColumnRenamed("idx", "block").groupBy("tree", "block")
        held = _blocks(nodes.select("tree", "total", "idx", "digest"), levels)
        proofs = written(held.cogroup(above).applyInArrow(lambda t, a: _deliver(t, a, levels), PROOFS))
    return proofs


def placed(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``idx``, the position of each row of a tree under ``order`` (null first), and ``total``, the tree's number of rows.

    Rows are dealt by ranges of (tree, order) and numbered inside a range; a range's offset is a sum over the ranges before
    it, one row per range and tree. No tree has to fit one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, tree, *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy(tree)
    offsets = written(sizes.withColumn("before", F.sum("n").over(over.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(over)).drop("n"))
    at = F.row_number().over(Window.partitionBy(tree, "part").orderBy(*order)) - 1
    return ranged.withColumn("at", at).join(offsets, [tree, "part"]).withColumn("idx", F.col("at") + F.col("before")).drop("at", "before", "part")


def field(c: Column) -> Column:
    """A value with its length in bytes, so that no two rows give the same text; ``-`` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def merkle_manifest(df: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "lang",
                    tamper: dict[str, Column] | None = None, tampered: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Merkle trees over the rows of ``df``: one row ``(id_col, leaf, subroot, root, proof_sha256, folded_root, verified)`` each.

    H is the lowercase hex sha256 of its inputs, concatenated; digests enter as hex text. A leaf is H of the row's
    ``columns``, each as length in bytes, ``:`` and value, or ``-`` if null. The rows of each ``tree_col`` ascend by id (null first;
    rows that repeat an id by leaf, then in any order, which changes no digest but that of the rows' own places); while several
    nodes remain, every 8 consecutive ones become their H. The last one is the tree's ``subroot``. The subroots, ordered
    by ``tree_col`` (null first, by bytes), give ``root`` in the same way. ``proof_sha256`` is H of the siblings on the way from the leaf to
    the root. ``folded_root`` is the root that these siblings give with the row's leaf, or, where ``tampered`` holds, with the
    leaf of the row with the columns of ``tamper`` in place of its own; ``verified`` tells whether it is the root. A single leaf is
    its tree's subroot, and an empty table has no rows. Other columns of ``df`` take no part.

    Leaves are hashed in one pass by the JVM. Then blocks of 8**block_levels nodes are swept (``Sweep``), and the blocks' tops are the
    nodes of the next round; a reversed sweep delivers the siblings from the roots to the leaves. A round is one shuffle
    of digests by block; a tree of any size is spread over all tasks, also while its rows are numbered.
    """
    ready(df.sparkSession)
    leaf = lambda own: F.sha2(F.concat(*[field(own.get(c, F.col(f"`{c}`"))) for c in columns]), 256)
    name = F.col(tree_col).cast("string")
    tree = F.when(name.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), F.encode(name, "UTF-8")))
    leaves = written(df.select(F.col(id_col).cast("bigint").alias("id"), tree.alias("tree"), leaf({}).alias("digest"),
                               F.when(F.lit(False) if tampered is None else tampered, leaf(tamper or {})).alias("tampered"),
                               F.monotonically_increasing_id().alias("row")))
    levels = block_levels
    trees = climb(written(placed(leaves, "tree", ["id", "digest", "row"]).drop("row")), levels)
    subroots = written(placed(trees[-1].select(F.lit(b"").alias("all"), "tree", "digest"), "all", ["tree"]))
    top = climb(subroots.select(F.col("all").alias("tree"), "total", "idx", "digest"), levels)
    none = F.array().cast("array<string>")
    above = descend(top, top[-1].select("tree", "idx", F.col("digest").alias("subroot"), none.alias("lefts"), none.alias("rights")), levels)
    above = written(subroots.select("tree", "idx", F.col("digest").alias("subroot")).join(above.select("idx", "lefts", "rights"), "idx")
                    .withColumn("idx", F.lit(0).cast("bigint")))
    above = descend(trees[1:], above, levels).withColumnRenamed("idx", "block").groupBy("tree", "block")
    checked = _blocks(trees[0], levels).cogroup(above).applyInArrow(
        lambda t, a: _checked(t, a, levels), "id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.broadcast(top[-1].select(F.col("digest").alias("root")))  # one row
    return (checked.join(root, how="inner", on=F.lit(True))
            .select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))
