"""Removal of repeated word windows through a count-min prefilter (operator 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labledger.llm.common import ready
from labledger.llm.hashing import U, mix, rolled_grams, rolled_words, split_words, string_column

CHUNK_BYTES = 6 << 20      # of text in a chunk, about
DEPTH = 2                  # rows of the count-min sketch
CELLS_PER_WINDOW = 4       # width of a row against the number of words of the corpus
SEGMENT_WINDOWS = 8 << 20  # windows that meet in one segment of the sketch, about
BLOCK_WINDOWS = 1 << 20    # a segment is merged block by block
GROUP_WINDOWS = 2 << 20    # of the corpus for each group of candidates
WORD_BYTES = 6             # of a word and the gap after it, about
SECOND = 0xA0761D6478BD642F

SKETCH = "segment bigint, chunk bigint, n array<bigint>, data array<binary>"
MARKS = "chunk bigint, segment bigint, n array<bigint>, data array<binary>"
CANDIDATES = "grp bigint, chunk bigint, n bigint, a binary, b binary, least binary, place binary"
REMOVED = "chunk bigint, n array<bigint>, data array<binary>"
_BLOCKS = [("n", pa.list_(pa.int64())), ("data", pa.list_(pa.binary()))]


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unzip(data: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype=dtype)


def _pack(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as the compressed low byte planes of their differences."""
    delta = np.diff(x, prepend=x.dtype.type(0))
    planes = max(1, (int(delta.max()).bit_length() + 7) // 8) if len(delta) else 1
    return bytes([planes]) + _zip(delta.view(np.uint8).reshape(-1, 8)[:, :planes].T)


def _unpack(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :data[0]] = _unzip(data[1:], n * data[0], np.uint8).reshape(data[0], n).T
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


class _Chunk:
    """The windows of a chunk's texts, in the order of the texts' ids, whatever the order in which the rows arrive."""

    def __init__(self, t: pa.Table, n: int):
        t = t.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = t["id"].to_numpy(zero_copy_only=False)
        self.text = string_column(t["text"])
        self.words = split_words(self.text)
        self.n = n

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words; the first word of each window; the windows' hashes."""
        h = rolled_words(self.words)
        last = np.repeat(np.cumsum(self.words.counts), self.words.counts)
        g = rolled_grams(h, self.n)
        first = np.flatnonzero(np.arange(len(g)) + self.n <= last[:len(g)])
        return h, first, g[first]

    def owners(self, places: np.ndarray) -> np.ndarray:
        """The ids of the documents that hold the words at ``places``."""
        return self.ids[np.searchsorted(np.cumsum(self.words.counts), places, side="right")]


def _cells(g: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cells of a row of the sketch that windows count up."""
    return mix(g ^ U(0x9E37 + row)) % U(cells)


def _cuts(cells: np.ndarray, parts: int, width: int) -> np.ndarray:
    return np.searchsorted(cells, np.arange(parts + 1, dtype=np.uint64) * U(width))


def _sketch(n: int, segments: int, blocks: int, width: int):
    """A chunk's partial sketch: for each row and segment, block by block, the cells that its windows count up."""
    def run(t: pa.Table) -> pa.Table:
        _, _, g = _Chunk(t, n).windows()
        rows = []
        for row in range(DEPTH):
            cells = np.sort(_cells(g, row, segments * blocks * width))
            cut = _cuts(cells, segments * blocks, width)
            for s in np.unique(np.flatnonzero(np.diff(cut)) // blocks).tolist():
                parts = [cells[cut[k]:cut[k + 1]] - U(k * width) for k in range(s * blocks, (s + 1) * blocks)]
                rows.append((row * segments + s, t["chunk"][0].as_py(), [len(p) for p in parts], [_pack(p) for p in parts]))
        return pa.table(dict(zip(("segment", "chunk", "n", "data"), map(list, zip(*rows)) if rows else ([], [], [], []))),
                        schema=pa.schema([("segment", pa.int64()), ("chunk", pa.int64()), *_BLOCKS]))
    return run


def _merge(blocks: int, width: int):
    """Add up a segment's partial sketches; for each chunk, which of its cells (in order) hold a count above one.

    Counts above one needn't be told apart, so a cell is two bits: once, twice.
    """
    def run(t: pa.Table) -> pa.Table:
        sizes, parts = t["n"].to_pylist(), t["data"]
        marks = [[] for _ in sizes]
        for k in range(blocks):
            once, twice = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
            cells = [_unpack(p[k].as_py(), n[k]).view(np.int64) for n, p in zip(sizes, parts)]
            for x in cells:
                twice[x[once[x]]] = True
                once[x] = True
                twice[x[1:][x[1:] == x[:-1]]] = True
            for m, x in zip(marks, cells):
                m.append(np.packbits(twice[x]).tobytes())
        return pa.table({"chunk": t["chunk"], "segment": t["segment"], "n": t["n"], "data": pa.array(marks, pa.list_(pa.binary()))})
    return run


def _estimated(g: np.ndarray, marks: pa.Table, cells: int) -> np.ndarray:
    """The windows whose smallest count in the sketch is above one."""
    found = np.ones(len(g), dtype=bool)
    segments = marks["segment"].to_numpy()
    low = U(max(1, int(len(g)).bit_length()))
    order = np.argsort(segments)
    sizes, data = marks["n"].to_pylist(), marks["data"].to_pylist()
    bits = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=k).astype(bool)
                           for s in order for k, b in zip(sizes[s], data[s])] or [np.zeros(0, dtype=bool)])
    for row in range(DEPTH):
        c = _cells(g, row, cells)
        if int(cells).bit_length() + int(low) <= 64:  # sort cell and window as one number
            at = (np.sort((c << low) | np.arange(len(c), dtype=np.uint64)) & ((U(1) << low) - U(1))).view(np.int64)
        else:
            at = np.argsort(c, kind="stable")
        found[at] &= bits[row * len(g):(row + 1) * len(g)]
    return np.flatnonzero(found)


def _candidates(n: int, cells: int, groups: int):
    """The windows that the sketch takes for repeated, by 128-bit names.

    What a chunk can settle alone, windows that it also holds under a smaller id, leaves it as places of words; for the
    other windows, those of the smallest id that has them here, the groups decide.
    """
    schema = pa.schema([(f, pa.int64()) for f in ("grp", "chunk", "n")] + [(f, pa.binary()) for f in ("a", "b", "least", "place")])

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not docs.num_rows or not marks.num_rows:
            return schema.empty_table()
        c, chunk, rows = _Chunk(docs, n), docs["chunk"][0].as_py(), []
        h, first, g = c.windows()
        k = _estimated(g, marks, cells)
        place, a, b = first[k], g[k], rolled_grams(h, n, SECOND)[first[k]]
        order = np.lexsort((place, b, a))  # places ascend with the ids
        place, a, b = place[order], a[order], b[order]
        ids = c.owners(place)
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a) else ids
        settled = np.sort(place[ids > least]).astype(np.uint64)
        if len(settled):
            rows.append((-1 - chunk, chunk, len(settled), _pack(settled), b"", b"", b""))
        open_ = ids == least
        place, a, b, ids = place[open_].astype("<u4"), a[open_], b[open_], ids[open_].astype("<i8")
        group = ((a >> U(32)) * U(groups)) >> U(32)  # ascends with a
        cut = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            p = slice(cut[s], cut[s + 1])
            rows.append((s, chunk, int(cut[s + 1] - cut[s]), _pack(a[p]), b[p].tobytes(), _zip(ids[p]), _zip(place[p])))
        return pa.table(dict(zip(schema.names, map(list, zip(*rows)))), schema=schema) if rows else schema.empty_table()
    return run


def _first_owner(t: pa.Table) -> pa.Table:
    """Group candidates exactly; for each chunk, the places of its windows that another chunk has under a smaller id."""
    sizes, chunks = t["n"].to_pylist(), t["chunk"].to_pylist()
    if t["grp"][0].as_py() < 0:
        out = [(c, [n], [x.as_py()]) for c, n, x in zip(chunks, sizes, t["a"])]
    else:
        a = np.concatenate([_unpack(x.as_py(), n) for x, n in zip(t["a"], sizes)])
        b = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in t["b"]])
        least = np.concatenate([_unzip(x.as_py(), n, "<i8") for x, n in zip(t["least"], sizes)])
        order = np.lexsort((least, b, a))
        x, y, z = a[order], b[order], least[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        gone = np.empty(len(x), dtype=bool)
        gone[order] = z[np.flatnonzero(new)][np.cumsum(new) - 1] < z
        out, at = [], 0
        for c, n, p in zip(chunks, sizes, t["place"]):
            places = np.sort(_unzip(p.as_py(), n, "<u4")[gone[at:at + n]]).astype(np.uint64)
            at += n
            if len(places):
                out.append((c, [len(places)], [_pack(places)]))
    return pa.table(dict(zip(("chunk", "n", "data"), map(list, zip(*out)) if out else ([], [], []))), schema=pa.schema([("chunk", pa.int64()), *_BLOCKS]))


def _cut_out(n: int):
    """Leave out the words covered by a removed window; the other words of a text are joined by one space."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(docs: pa.Table, removed: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        c = _Chunk(docs, n)
        w, total = c.words, len(c.words.starts)
        step = np.zeros(total + 1, dtype=np.int64)
        for sizes, parts in zip(removed["n"].to_pylist(), removed["data"].to_pylist()) if removed.num_rows else ():
            for k, x in zip(sizes, parts):
                places = _unpack(x, k).view(np.int64)  # each place is told once
                step[places] += 1
                step[places + n] -= 1
        gone = np.cumsum(step[:total]) > 0
        edge = np.append(w.first, total)
        dropped = np.concatenate([[0], np.cumsum(gone)])
        kept = np.flatnonzero(~gone)
        follows = np.zeros(len(kept), dtype=bool)  # by another kept word of the same text, so by a byte between them
        text = np.searchsorted(edge[1:], kept, side="right")
        follows[:-1] = text[1:] == text[:-1]
        data = w.data.copy()
        data[w.ends[kept[follows]]] = 0x20
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[w.starts[kept]] = 1
        stop = w.ends[kept] + follows
        inside[stop] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        bounds = np.frombuffer(c.text.buffers()[1], dtype=np.int64)[c.text.offset:c.text.offset + len(c.text) + 1]
        offsets = np.concatenate([[0], np.cumsum(inside)])[bounds - bounds[0]]
        texts = pa.LargeStringArray.from_buffers(len(c.ids), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])).cast(pa.string())
        return pa.table([pa.array(c.ids), pa.array(w.counts), pa.array(dropped[edge[1:]] - dropped[edge[:-1]]), texts], schema=schema)
    return run


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                            chunk_bytes: int = CHUNK_BYTES, segment_windows: int = SEGMENT_WINDOWS,
                            block_windows: int = BLOCK_WINDOWS, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Cut repeated passages: one row ``(id_col, n_words, n_removed, kept_text)`` per row of ``df``.

    A word (a run without space and \\x09-\\x0D, unchanged) goes if a window of ``window`` consecutive words that
    covers it also starts in a document with a smaller id; windows are judged on the input. ``kept_text`` joins the
    other words by one space. Null, empty and wordless texts give 0 words and an empty text; texts shorter than a
    window lose nothing; rows with equal ids count as one document; rows with a null id are kept whole and cut nothing.

    The texts are dealt by hash into chunks of bounded size, in one shuffle that all passes read.
    1. Each chunk counts all its windows in a partial count-min sketch, cut into segments; a segment's partial
       sketches are merged in one task, block by block, and each chunk learns which of its cells hold a count above
       one. The width follows the corpus (four cells per word and row), so the error rate doesn't grow with it.
    2. Only the windows whose smallest count is above one are sorted and grouped, by 128-bit names; counts are never
       too low, so none is lost. A window that a third of all documents share leaves each chunk for one document only.
    3. The places of the removed windows go back to the chunks, which cut the texts.

    Every chunk sends a part to every segment and group that it has windows of. For a corpus of many terabytes raise
    ``chunk_bytes`` and ``segment_windows`` as far as a worker's memory allows (about 40 bytes a byte of text of a
    chunk, 3 bytes a window of a segment); blocks keep the cells of a segment in bounded memory.
    """
    ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    chunks = max(1, size // chunk_bytes)
    words = size // WORD_BYTES + 1  # about; only sizes depend on it
    segments = max(1, words // segment_windows)
    blocks = max(1, words // segments // block_windows)
    width = max(1024, CELLS_PER_WINDOW * words // (segments * blocks))
    groups = max(1, words // group_windows)
    named = rows.filter("id is not null").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("bigint"))
    docs = named.groupBy("chunk")
    partial = docs.applyInArrow(_sketch(window, segments, blocks, width), SKETCH)
    marks = partial.groupBy("segment").applyInArrow(_merge(blocks, width), MARKS)
    candidates = docs.cogroup(marks.groupBy("chunk")).applyInArrow(_candidates(window, segments * blocks * width, groups), CANDIDATES)
    removed = candidates.groupBy("grp").applyInArrow(_first_owner, REMOVED)
    cut = docs.cogroup(removed.groupBy("chunk")).applyInArrow(_cut_out(window), "id bigint, n_words bigint, n_removed bigint, kept_text string")
    whole = (rows.filter("id is null")
             .withColumn("words", F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
             .select("id", F.coalesce(F.size("words").cast("bigint"), F.lit(0)).alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"),
                     F.coalesce(F.array_join("words", " "), F.lit("")).alias("kept_text")))
    return cut.unionByName(whole).withColumnRenamed("id", id_col)
