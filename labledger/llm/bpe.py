"""BPE encoding by a priority queue of merge ranks, and decoding (operator 6)."""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from labledger.llm.common import ready
from labledger.llm.hashing import string_column
from labledger.llm.setsketch import slices

CACHED_RUNS, CACHED_PIECES = 150_000, 200_000  # of each of the two generations of a worker's caches
CACHED_LENGTH = 64  # characters of the longest run or pre-token that is held, so the caches' bytes are bounded too
SLICE_BYTES = 1 << 20   # of text encoded before its ids are handed on


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def runs(text: str) -> list[str]:
    """Runs without white space. Unlike str.split, the tokenizers' \\s leaves \\x1c-\\x1f alone."""
    if text.isprintable() or not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return regex.findall(r"\S+", text)


class Cache(dict):
    """Results of ``make`` by key, in two generations of bounded size; those of keys above ``longest`` aren't held."""

    def __init__(self, make: Callable | None, size: int, longest: int | None = None):
        super().__init__()
        self.make, self.size, self.older, self.longest = make, size, {}, longest

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        value = self.older.get(key)
        value = self[key] = self.make(key) if value is None else value
        return value

    def age(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()


def _newer(kind: str) -> str:
    """Characters of the category that the regex module knows and unicodedata doesn't, as ranges of a set."""
    chars = regex.findall(rf"\p{{{kind}}}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    codes = [ord(c) for c in chars if not unicodedata.category(c).startswith(kind)]
    cuts = [i for i in range(len(codes) + 1) if i in (0, len(codes)) or codes[i] != codes[i - 1] + 1]
    return "".join(f"\\U{codes[a]:08X}-\\U{codes[b - 1]:08X}" for a, b in zip(cuts, cuts[1:]))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pattern whose \\p{L} and \\p{N} are those of unicodedata.

    The regex module may follow a newer Unicode version; the letters that this adds are symbols to the tokenizers
    library. Only texts that hold one take the narrower pattern.
    """
    plain, newer = regex.compile(pattern), {k: _newer(k) for k in "LN"}
    if not any(newer.values()):
        return plain.findall
    narrow = pattern.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
    for kind in "LN":
        narrow = narrow.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{newer[kind]}]]")
    narrow, odd = regex.compile(narrow, regex.V1), regex.compile(f"[{''.join(newer.values())}]")
    return lambda text: plain.findall(text) if text.isascii() or not odd.search(text) else narrow.findall(text)


class Vocabulary:
    """A tokenizer file of the word-end BPE kind: NFC, white space to one space, lower case, split, bytes, merges."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank_of = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(merges)}.get
        self.merged = [self.ids[a + b] for a, b in merges]
        symbols = byte_symbols()
        self.inner = [self.ids[c] for c in symbols]
        self.final = [self.ids[c + self.suffix] for c in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = splitter(split)
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        self.chunks, self.pieces = Cache(self.chunk, CACHED_RUNS, CACHED_LENGTH), Cache(self.piece, CACHED_PIECES, CACHED_LENGTH)

    def normalise(self, text: str) -> str:
        # Lower case is taken character by character, so a final sigma has no form of its own.
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges: the pair of lowest rank first, of equal rank the leftmost.

        The symbols form a doubly linked list. A queue entry holds a rank and a place in one integer; it is stale if
        that place no longer begins a pair of that rank (``ranks``: of the pair that begins at each place now).
        """
        rank_of, merged = self.rank_of, self.merged
        ranks = [rank_of(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:])]
        queue = [rank << 32 | i for i, rank in enumerate(ranks) if rank >= 0]
        if not queue:
            return symbols
        heapq.heapify(queue)
        n = len(symbols)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        ranks.append(-1)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            if ranks[i] != entry >> 32:
                continue
            j = after[i]
            new = symbols[i] = merged[ranks[i]]
            symbols[j] = ranks[i] = ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks[i] = rank_of(new << 32 | symbols[k], -1)
                if rank >= 0:
                    heapq.heappush(queue, rank << 32 | i)
            k = before[i]
            if k >= 0:
                rank = ranks[k] = rank_of(symbols[k] << 32 | new, -1)
                if rank >= 0:
                    heapq.heappush(queue, rank << 32 | k)
        return [s for s in symbols if s >= 0]

    def piece(self, word: str) -> bytes:
        """Ids of a pre-token."""
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        return pack(self.merge(symbols))

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space. No step looks across white space, so runs are encoded one by one."""
        return b"".join(map(self.pieces.__getitem__, self.split(self.normalise(chunk))))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; special strings in it get their own ids."""
        self.chunks.age()
        self.pieces.age()
        if self.special_pattern is None or not self.special_pattern.search(text):
            return b"".join(map(self.chunks.__getitem__, runs(text)))
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += map(self.chunks.__getitem__, runs(text[at:m.start()]))
            out.append(pack([self.special[m[0]]]))
            at = m.end()
        return b"".join([*out, *map(self.chunks.__getitem__, runs(text[at:]))])

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, one space between each two (the file names no decoder that would join them otherwise)."""
        return " ".join(map(self.strings.__getitem__, ids))


_LOADED: dict[int, Vocabulary] = {}


def vocabulary(shared) -> Vocabulary:
    """The vocabulary of a broadcast file, built once per Python worker, so the word cache outlives a task."""
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(shared.value)
    return _LOADED[key]


def _file(df: DataFrame, path: str):
    """The tokenizer file as a broadcast text; its size is that of the vocabulary, not of the data."""
    with open(path, encoding="utf-8") as f:
        return ready(df.sparkSession).sparkContext.broadcast(f.read())


def _coded(df: DataFrame, path: str, source: str, kept: list[str], outputs: dict[str, str]) -> DataFrame:
    """One Arrow pass over ``source``, a text to encode or an array of ids: the columns ``kept`` and of ``outputs``
    (name in the result by kind: ids, decoded, n_tokens, ids_bytes) those asked for. Without kept columns only the outputs."""
    shared = _file(df, path)
    given = dict(df.dtypes)[source] == "array<int>"
    names = [f"c{i}" for i in range(len(kept))]
    value = F.col(f"`{source}`") if given else F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], value.alias("t"))
    types = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_bytes": "binary"}

    def parts(column: pa.Array) -> Iterator[tuple[int, int, list]]:
        if given:
            for a in range(0, len(column), 256):
                some = column.slice(a, 256)
                yield a, a + len(some), [s.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes() if s.is_valid else None for s in some]
        else:
            v, text = vocabulary(shared), string_column(column)
            for a, b in slices(text, SLICE_BYTES):
                yield a, b, [v.encode(t) for t in text.slice(a, b - a).to_pylist()]

    def made(kind: str, ids: list) -> pa.Array:
        if kind == "decoded":
            v = vocabulary(shared)
            return pa.array([None if x is None else v.decode(np.frombuffer(x, dtype="<i4").tolist()) for x in ids], pa.string())
        if kind == "n_tokens":
            return pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64())
        if kind == "ids_bytes":
            return pa.array(ids, pa.binary())
        ends = np.cumsum([0, *(len(x or b"") // 4 for x in ids)]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), dtype="<i4"))
        return pa.ListArray.from_arrays(ends, flat, mask=pa.array([x is None for x in ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids in parts(batch["t"]):
                yield pa.RecordBatch.from_arrays([*(batch[n].slice(a, b - a) for n in names), *(made(k, ids) for k in outputs)], names=[*names, *outputs])

    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + [f"{k} {types[k]}" for k in outputs])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], *[F.col(k).alias(name) for k, name in outputs.items()])


def _others(df: DataFrame, keep: list[str] | None, *new: str) -> list[str]:
    return [c for c in (df.columns if keep is None else keep) if c not in new]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Append ``ids_col array<int>``, the BPE ids of each whole text (null: empty, so no ids), and keep the columns
    ``keep`` (default: all but ``text_col``).

    A special token's string inside a text is that token. Nothing is truncated or padded and no token added.
    Every row is encoded on its own in a Python task, so nothing is shuffled; a worker holds a slice of texts and a
    bounded cache of words. Empty tables and repeated rows need no care; a column named ``ids_col`` is replaced.
    """
    kept = _others(df, keep, ids_col, *([text_col] if keep is None else []))
    return _coded(df, path, text_col, kept, {"ids": ids_col})


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Append ``text_col``, the text that the ids decode to, special tokens included, and ``n_tokens``.

    Null ids give null for both, no ids an empty text; an id outside the vocabulary is an error. Columns with the names
    of the new ones are replaced."""
    typed = df.withColumn(ids_col, F.col(f"`{ids_col}`").cast("array<int>"))
    return _coded(typed, path, ids_col, _others(df, None, text_col, "n_tokens"), {"decoded": text_col, "n_tokens": "n_tokens"})


def encode_decode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None,
                  outputs: tuple[str, ...] = ("ids", "n_tokens", "ids_bytes", "decoded")) -> DataFrame:
    """``encode`` and ``decode`` in one Python pass, so that a task needs one worker: appends ``ids``, ``n_tokens``,
    ``ids_bytes`` (the ids as little-endian 32-bit integers) and ``decoded``, or those of them in ``outputs``."""
    outputs = {k: k for k in outputs}
    kept = _others(df, keep, *outputs, *([text_col] if keep is None else []))
    return _coded(df, path, text_col, kept, outputs)
