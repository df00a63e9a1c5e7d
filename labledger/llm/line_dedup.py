"""Line dedup by probing a sharded minimal perfect hash of the repeated lines (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labledger.llm.common import ready, written
from labledger.llm.hashing import U, mix, string_column

WHITE = " \t\n\v\f\r"
MIN_POINTS, MIN_DOCS = 40, 5
CHUNK_BYTES = 6 << 20    # of text in a chunk, about
SHARD_LINES = 1 << 20    # distinct lines in a shard of the index, about
SPREAD = 2               # slots for each line that a level of the hash places

INDEX = "shard bigint, n bigint, sizes array<bigint>, bits array<binary>, prints binary, counts binary, owners binary"


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: each key's number below their count, from about 3 bits a key.

    A level deals the keys that are left to slots; those alone in their slot are placed and set its bit, the others go on to
    the next level. A key's number is the count of bits before its own. Other keys get some number, or none (-1).
    """

    def __init__(self, sizes: list[int], bits: list[bytes]):
        self.levels = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=s).astype(bool) for s, b in zip(sizes, bits)]
        self.ranks, before = [], 0
        for level in self.levels:
            count = np.cumsum(level)
            self.ranks.append(before + count - 1)
            before += int(count[-1])

    @staticmethod
    def slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + U(level + 1))) % U(size)).view(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[bytes]]:
        sizes, bits = [], []
        while len(a):
            size = SPREAD * len(a)
            at = cls.slots(a, b, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone).tobytes())
            left = ~alone[at]
            a, b = a[left], b[left]
        return sizes, bits

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        number, todo = np.full(len(a), -1), np.arange(len(a))
        for k, level in enumerate(self.levels):
            at = self.slots(a[todo], b[todo], k, len(level))
            hit = level[at]
            number[todo[hit]] = self.ranks[k][at[hit]]
            todo = todo[~hit]
        return number


def line_key(line: str, min_points: int) -> bytes | None:
    """The line without white space at both ends, A-Z lower-cased; None if it's too short to be judged."""
    line = line.strip(WHITE)
    return line.encode().lower() if len(line) >= min_points else None  # bytes.lower() folds A-Z only


def line_hashes(text: str, min_points: int) -> list[tuple[int, bytes]]:
    """Place and 128-bit hash of each line that is judged."""
    keys = ((at, line_key(line, min_points)) for at, line in enumerate(text.split("\n")))
    return [(at, hashlib.blake2b(k, digest_size=16).digest()) for at, k in keys if k is not None]


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _counted(min_points: int):
    """Distinct lines of a batch, with the number of its documents that hold them and the largest of their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list] = {}
            for i, text in zip(batch["id"].to_pylist(), string_column(batch["text"])):
                for h in {h for _, h in line_hashes(text.as_py(), min_points)}:
                    held = seen.setdefault(h, [0, None])
                    held[0] += 1
                    held[1] = i if held[1] is None or i is not None and i > held[1] else held[1]
            a, b = _halves(list(seen))
            count, owner = zip(*seen.values()) if seen else ((), ())
            yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64), "docs": pa.array(count, pa.int64()), "owner": pa.array(owner, pa.int64())})
    return run


def _shard(t: pa.Table) -> pa.Table:
    """The index of a shard: the perfect hash; and by a line's number its fingerprint, count and owner."""
    a, b = (t[c].to_numpy().view(np.uint64) for c in "ab")
    sizes, bits = PerfectHash.build(a, b)
    at = np.argsort(PerfectHash(sizes, bits).find(a, b))
    counts = np.minimum(t["docs"].to_numpy()[at], 0xFFFF).astype("<u2")
    owners = t["owner"].to_numpy()[at].astype("<i8")
    return pa.table({"shard": t["shard"][:1], "n": [len(a)], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.list_(pa.binary())),
                     "prints": [b[at].astype("<u8").tobytes()], "counts": [counts.tobytes()], "owners": [owners.tobytes()]})


def _probes(min_points: int, shards: int):
    """A chunk's distinct lines, one row for each shard that they fall into."""
    schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        found = list({h for text in string_column(t["text"]) for _, h in line_hashes(text.as_py(), min_points)})
        a, b = _halves(found)
        shard = a.view(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        both = np.column_stack([a, b])[order]
        rows = [(s, t["chunk"][0].as_py(), both[cuts[s]:cuts[s + 1]].astype("<u8").tobytes()) for s in np.flatnonzero(np.diff(cuts)).tolist()]
        return pa.table(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema) if rows else schema.empty_table()
    return run


def _answers(min_docs: int):
    """For each chunk, those of its lines that enough documents hold, with their owners."""
    schema = pa.schema([("chunk", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary())])

    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        if not probes.num_rows or not index.num_rows:
            return schema.empty_table()
        column = lambda c, dtype: np.frombuffer(index[c][0].as_py(), dtype=dtype)
        hash_ = PerfectHash(index["sizes"][0].as_py(), index["bits"][0].as_py())
        prints, counts, owners = column("prints", "<u8"), column("counts", "<u2"), column("owners", "<i8")
        rows = []
        for chunk, data in zip(probes["chunk"].to_pylist(), probes["hashes"]):
            both = np.frombuffer(data.as_py(), dtype="<u8").reshape(-1, 2)
            number = hash_.find(both[:, 0], both[:, 1])
            hit = (number >= 0) & (prints[number] == both[:, 1]) & (counts[number] >= min_docs)
            if hit.any():
                rows.append((chunk, both[hit].tobytes(), owners[number[hit]].tobytes()))
        return pa.table(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema) if rows else schema.empty_table()
    return run


def _cut(min_points: int):
    schema = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        owner: dict[bytes, int] = {}
        for hashes, owners in zip(answers["hashes"].to_pylist(), answers["owners"].to_pylist()) if answers.num_rows else ():
            owner.update(zip((hashes[k:k + 16] for k in range(0, len(hashes), 16)), np.frombuffer(owners, dtype="<i8").tolist()))
        rows = []
        for i, text in zip(docs["id"].to_pylist(), string_column(docs["text"])):
            text = text.as_py()
            lines = text.split("\n")
            gone = {at for at, h in line_hashes(text, min_points) if owner.get(h, i) != i}
            rows.append((i, len(lines), len(gone), "\n".join(x for at, x in enumerate(lines) if at not in gone) if gone else text))
        return pa.table(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema) if rows else schema.empty_table()
    return run


def line_index(rows: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """The index of the lines of ``rows(id, text)`` that at least two documents hold, and its number of shards.

    Lines of one document can't be repeated, so they take no room in it; a probe for one is told by its fingerprint.
    """
    lines = (rows.mapInArrow(_counted(min_points), "a bigint, b bigint, docs bigint, owner bigint").groupBy("a", "b")
             .agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner")).filter(F.col("docs") >= min(2, min_docs)))
    lines = written(lines.filter("owner is not null"))
    shards = max(1, lines.count() // shard_lines)
    home = F.pmod("a", F.lit(shards)).cast("bigint")
    return written(lines.withColumn("shard", home).groupBy("shard").applyInArrow(_shard, INDEX)), shards


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS,
                        chunk_bytes: int = CHUNK_BYTES, shard_lines: int = SHARD_LINES) -> DataFrame:
    """Drop lines that many documents hold: one row ``(id_col, n_lines, n_dropped, kept_text)`` per row of ``df``.

    A text is split at \\n (null or empty: one empty line). A line's key is the line without space and \\x09-\\x0D at both
    ends and with A-Z lower-cased. Keys of at least ``min_points`` code points that at least ``min_docs`` documents hold lose all
    their lines but those of the largest id that holds them; a document that holds a key several times counts once.
    ``n_lines`` counts all lines, ``kept_text`` joins those that stay by \\n (none: empty). Rows count as documents, also if
    they repeat an id; rows of the largest id all keep their lines. A null id is smaller than any other; lines that only rows with a
    null id hold stay.

    1. One pass counts lines by 128-bit hash; batches send each distinct line once, with its count and largest id.
    2. The hashes that several documents hold are dealt into shards of bounded size. A shard is a minimal perfect hash and three arrays:
       64-bit fingerprints, counts (up to 65535) and owners, about 18 bytes a line.
    3. The documents are dealt by hash into chunks. A chunk probes the shards with its distinct hashes, in one row a shard, and
       learns which of them to drop. Texts and lines are never joined, and a line that a third of all documents hold is
       asked for once a chunk.
    """
    ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    index, shards = line_index(rows, min_points, min_docs, shard_lines)
    chunks = max(1, int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes)
    docs = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(chunks)).cast("bigint")).groupBy("chunk")
    probes = docs.applyInArrow(_probes(min_points, shards), "shard bigint, chunk bigint, hashes binary")
    answers = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_answers(min_docs), "chunk bigint, hashes binary, owners binary")
    cut = docs.cogroup(answers.groupBy("chunk")).applyInArrow(_cut(min_points), "id bigint, n_lines bigint, n_dropped bigint, kept_text string")
    return cut.withColumnRenamed("id", id_col)
