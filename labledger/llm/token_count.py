"""Token counts by rank-synchronous merging of ragged arrays (operator 9)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, functions as F

from labledger.llm.bpe import Cache, byte_symbols, splitter
from labledger.llm.common import ready
from labledger.llm.hashing import string_column
from labledger.llm.setsketch import slices

CACHED_UNITS = 250_000
SLICE_BYTES = 2 << 20
#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.iinfo(np.int32).max


class RankedMerges:
    """Merges of a byte-level BPE file as arrays sorted by pair."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = np.array([(ids[a] << 32) | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs, self.rank = pairs[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)  # by rank
        self.byte_ids = np.array([ids[c] for c in byte_symbols()], dtype=np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = splitter(PATTERN)
        self.known = Cache(None, CACHED_UNITS)

    def ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each symbol; NEVER if it isn't a merge or crosses into another sequence."""
        pair = (symbols[:-1] << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        rank = np.where((self.pairs[at] == pair) & (owner[1:] == owner[:-1]), self.rank[at], NEVER)
        return np.append(rank, NEVER)

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token. The pre-tokens are one ragged array of symbols; in each step every sequence merges
        all places of its lowest-ranked pair (from the left where they overlap), and finished sequences leave."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        out = np.zeros(len(raw), dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        while len(symbols):
            rank = self.ranks(symbols, owner)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(symbols)))
            done = low == NEVER
            out[owner[first[done]]] = length[done]
            live = np.repeat(~done, length)
            best = np.repeat(low, length)
            hit = (rank == best) & live
            run = hit & np.append(False, hit[:-1])  # overlaps only where a pair of twins repeats: every second goes
            if run.any():
                places = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~run, places, 0))
                hit &= (places - begin) % 2 == 0
            symbols = np.where(hit, self.merged[np.where(hit, rank, 0)], symbols)
            live &= ~np.append(False, hit[:-1])
            symbols, owner = symbols[live], owner[live]
        return out

    def learn(self, units: set[str]) -> None:
        """Count the tokens of units that aren't known yet."""
        self.known.age()
        new = {u: self.split(u) for u in units if u not in self.known}
        pieces = list(set(chain.from_iterable(new.values())))
        count = dict(zip(pieces, self.counts(pieces).tolist())).__getitem__
        self.known.update((u, sum(map(count, p))) for u, p in new.items())

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text; a special token's string inside a text is one token."""
        split = []
        for t in texts:
            parts = [t] if self.special is None or not self.special.search(t) else self.special.split(t)
            split.append((len(parts) - 1, [units(p) for p in parts]))
        self.learn(set(chain.from_iterable(chain.from_iterable(p for _, p in split))))
        known = self.known.__getitem__
        return [extra + sum(sum(map(known, p)) for p in parts) for extra, parts in split]


def units(text: str) -> list[str]:
    """Runs without white space, each with the white space before it; white space at the end is a unit of its own.

    The split pattern never joins what lies on both sides of such a border, so units are split one by one."""
    if text.isprintable() or not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return re.findall(r"\s*\S+|\s+", text)
    return regex.findall(r"\s*\S+|\s+", text)


_LOADED: dict[int, RankedMerges] = {}


def _merges(shared) -> RankedMerges:
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = RankedMerges(shared.value)
    return _LOADED[key]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Token counts under a byte-level BPE file: one row ``(id_col, n_bytes, n_tokens, over_limit)`` per row of ``df``.

    Whole texts; null counts as empty (0 bytes, 0 tokens). No token is added, nothing truncated or padded; the string
    of a special token inside a text counts as that one token. Repeated rows and null ids are rows like others.
    Nothing is shuffled; a worker holds one slice of texts, its distinct pre-tokens and a bounded cache of counts.
    """
    with open(path, encoding="utf-8") as f:
        shared = ready(df.sparkSession).sparkContext.broadcast(f.read())  # the size of the vocabulary
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared)
        for batch in batches:
            text = string_column(batch["text"])
            for a, b in slices(text, SLICE_BYTES):
                part = text.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({"id": batch["id"].slice(a, b - a),
                                                  "n_bytes": pa.compute.binary_length(part).cast(pa.int64()),
                                                  "n_tokens": pa.array(merges.texts(part.to_pylist()), pa.int64())})

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
