"""Word splitting and hashing of whole Arrow string columns with numpy.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``. All offsets are byte offsets into the
joined UTF-8 data of the column, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LONGEST = 64  # bytes hashed position by position; longer words go through blake2b
ROLL = 1 << 16  # bytes or words that share a running sum


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    data: np.ndarray    # bytes of all texts
    starts: np.ndarray  # of each word
    ends: np.ndarray
    counts: np.ndarray  # words of each text
    first: np.ndarray   # index of each text's first word


def string_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def split_words(column: pa.Array | pa.ChunkedArray) -> Words:
    column = string_column(column)
    n = len(column)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, np.uint8), z, z, z, z)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    gap = np.ones(len(data) + 1, dtype=bool)  # gap[i]: no word continues from byte i - 1 to byte i
    solid = ~SPACE[data]
    if len(data):
        gap[1:-1] = ~solid[:-1] | ~solid[1:]
        gap[bounds] = True
    starts = np.flatnonzero(solid & gap[:-1])
    ends = np.flatnonzero(solid & gap[1:]) + 1
    edge = np.searchsorted(starts, bounds)
    return Words(data, starts, ends, np.diff(edge), edge[:-1])


def word_hashes(w: Words, lower: bool = False, seeds: tuple[int, ...] = (1,)) -> list[np.ndarray]:
    """A 64-bit hash of each word for every seed; ``lower`` folds A-Z first."""
    size = w.ends - w.starts
    order = np.argsort(-np.minimum(size, LONGEST).astype(np.int16), kind="stable")
    starts, clipped = w.starts[order], np.minimum(size, LONGEST)[order]
    active = len(order) - np.searchsorted(clipped[::-1], np.arange(1, LONGEST + 1))
    tables, hs = [], []
    for seed in seeds:
        t = _table(seed)
        if lower:
            t[65:91] = t[97:123]
        tables.append(t)
        hs.append(np.full(len(order), U(seed), dtype=np.uint64))
    for j in range(LONGEST):
        k = active[j]
        if not k:
            break
        byte = w.data[starts[:k] + j]
        for h, t in zip(hs, tables):
            h[:k] = h[:k] * U(0x9E3779B97F4A7C15) + t[byte]
    out = []
    for seed, h in zip(seeds, hs):
        r = np.empty_like(h)
        r[order] = mix(h)
        out.append(r)
    for i in np.flatnonzero(size > LONGEST):
        word = w.data[w.starts[i]:w.ends[i]].tobytes()
        word = word.lower() if lower else word  # bytes.lower() folds A-Z only
        for seed, r in zip(seeds, out):
            r[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n consecutive words from each position on; the last n - 1 positions are left out."""
    weights = np.random.default_rng(1000 + n + 7919 * salt).integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)
    size = max(0, len(h) - n + 1)
    g = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        g += mix(h[j:j + size] + weights[j]) * weights[j]
    return mix(g)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd ``base`` and of its inverse modulo 2**64."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, U(b), dtype=np.uint64)
        p[0] = 1
        both.append(np.cumprod(p))
    return tuple(both)


def _rolled(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """sum(x[s + j] * base**j) modulo 2**64 of every range [s, e) of ``x``, from differences of one running sum."""
    up, down = _powers(base, ROLL + LONGEST)
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * up[:len(x)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def rolled_words(w: Words) -> np.ndarray:
    """A 64-bit hash of each word; blocks of bytes that fit a processor's cache are hashed at a time."""
    table, size = _table(17), w.ends - w.starts
    long = size > LONGEST
    ends = np.where(long, w.starts, w.ends)  # longer words are left out here
    out, at = np.empty(len(size), dtype=np.uint64), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(w.starts, w.starts[at] + ROLL, side="right")))
        lo = w.starts[at]
        data = w.data[lo:max(lo, ends[at:to].max())]
        out[at:to] = mix(_rolled(table[data], w.starts[at:to] - lo, ends[at:to] - lo, 0x9E3779B97F4A7C15) + size[at:to].view(np.uint64))
        at = to
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(w.data[w.starts[i]:w.ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def rolled_grams(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of the n consecutive words from each position on; the last n - 1 positions are left out."""
    size = max(0, len(h) - n + 1)
    out = np.empty(size, dtype=np.uint64)
    for at in range(0, size, ROLL):
        to = min(size, at + ROLL)
        k = np.arange(to - at)
        for j in range(0, n, LONGEST):  # a running sum covers ROLL + LONGEST words
            part = min(n - j, LONGEST)
            rolled = _rolled(h[at + j:to + j + part - 1], k, k + part, base)
            out[at:to] = rolled if not j else mix(out[at:to]) + rolled
    return mix(out)


def ragged_index(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first[k] .. first[k] + length[k] - 1 of every k, joined, and the k of each."""
    owner = np.repeat(np.arange(len(length)), length)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    return first[owner] + within, owner
