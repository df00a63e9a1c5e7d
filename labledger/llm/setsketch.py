"""MinHash near-dedup with SetSketch registers (operator 3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labledger.llm.common import by_salt, connected_components, groups, ready, salted, written
from labledger.llm.embed_dedup import spanning
from labledger.llm.hashing import U, grams, mix, split_words, string_column, word_hashes

BASE = 1.001          # of the exponentially spaced register values
RATE = 20.0           # of the exponential variables
LIMIT = 65534         # largest register value but one
BAND_ROWS, BANDS = 6, 40
REGISTERS = 241       # prime, at least BAND_ROWS * BANDS
DOUBT = 20.0          # log-likelihood ratio beyond which an estimate rules a pair out
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 20
SLICE = 2 << 20       # bytes of text handled at once


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes of text each, or of one row."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end
        at = end


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted within the text, joined; and the set sizes."""
    w = split_words(column)
    (h,) = word_hashes(w, lower=True)
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    g = grams(h, words)
    last = np.repeat(np.cumsum(w.counts), w.counts)
    inside = np.arange(len(g)) + words <= last[:len(g)]
    values, owners = [g[inside]], [owner[:len(g)][inside]]
    for n in range(1, words):  # texts with fewer words: the whole sequence is the one shingle
        short = np.flatnonzero(w.counts == n)
        values.append(grams(h, n, salt=1)[w.first[short]] if len(short) else np.zeros(0, dtype=np.uint64))
        owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(w.counts))


def registers(value: np.ndarray, sizes: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (one row of uint16 per set) of the sets whose elements are joined in ``value``.

    Every element owns m increasing exponential variables, dealt to the registers by an affine permutation (m is
    prime); a register keeps the smallest, x, as floor(1 - log_BASE x). Variables beyond a bound that the minima of a
    set of this size rarely reach are skipped; sets with a register left open are computed anew without the bound.
    """
    out = np.zeros((len(sizes), m), dtype=np.uint16)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    todo = np.flatnonzero(sizes > 0)
    for margin in (3.0, 12.0, np.inf):
        place = np.full(len(sizes), -1)
        place[todo] = np.arange(len(todo))
        pick = place[owner] >= 0
        h, row = value[pick], place[owner[pick]]
        if not len(todo):
            break
        bound = (np.log(m) + margin) / (RATE * sizes[todo])
        low = np.full(len(todo) * m, np.inf)
        start = (mix(h ^ U(0x5851F42D4C957F2D)) >> U(11)) % U(m)
        stride = (mix(h ^ U(0x14057B7EF767814F)) >> U(11)) % U(m - 1) + U(1)
        x, steps = np.zeros(len(h)), np.arange(m + 1, dtype=np.uint64)
        draws = steps * U(0x9E3779B97F4A7C15)
        for j in range(m):
            u = ((mix(h + draws[j + 1]) >> U(11)).astype(np.float64) + 1.0) * 2.0 ** -53
            x = x - np.log(u) / (RATE * (m - j))
            live = x <= bound[row]
            if not live.all():
                h, row, start, stride, x = h[live], row[live], start[live], stride[live], x[live]
            if not len(h):
                break
            np.minimum.at(low, row * m + ((start + steps[j] * stride) % U(m)).astype(np.int64), x)
        low = low.reshape(len(todo), m)
        full = np.isfinite(low).all(axis=1)
        out[todo[full]] = np.clip(np.floor(1 - np.log(low[full]) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
        todo = todo[~full]
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, rows: int = BAND_ROWS, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key of each band of registers."""
    parts = regs[:, :rows * bands].reshape(len(regs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(regs), bands)).copy()
    for r in range(rows):
        key = mix(key ^ (parts[:, :, r] + U(1)) * U(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def _log_likelihood(up: np.ndarray, down: np.ndarray, m: int, u: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return (up * np.log(np.maximum(a, tiny)) + down * np.log(np.maximum(b, tiny))
            + (m - up - down) * np.log(np.maximum(1 - a - b, tiny)))


def joint_estimate(up: np.ndarray, down: np.ndarray, m: int, nx: np.ndarray, ny: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood Jaccard similarity from the counts of larger and smaller registers and the set sizes, and
    by how much its log-likelihood exceeds that of ``share``."""
    u, v = nx / (nx + ny), ny / (nx + ny)
    most = np.minimum(u / v, v / u)
    lo, hi = np.zeros_like(u), most.copy()
    for _ in range(14):  # the likelihood is unimodal; a coarser maximum rules out less
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = _log_likelihood(up, down, m, u, v, a) > _log_likelihood(up, down, m, u, v, b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    best = (lo + hi) / 2
    return best, _log_likelihood(up, down, m, u, v, best) - _log_likelihood(up, down, m, u, v, np.minimum(share, most))


def plausible(rx: np.ndarray, ry: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sketches and exact sizes don't rule out 100 * intersection >= percent * union."""
    m, found_i, found_j = rx.shape[1], [], []
    for k in range(0, len(rx), 64):
        part = rx[k:k + 64]
        a, b = nx[k:k + 64, None].astype(np.float64), ny[None, :].astype(np.float64)
        fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        if same:
            fits &= (np.arange(k, k + len(part))[:, None] < np.arange(len(ry))[None, :])
        i, j = np.nonzero(fits)
        for s in range(0, len(i), 1 << 15):
            p, r = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
            x, y = part[p], ry[r]
            up, down = (x > y).sum(axis=1), (x < y).sum(axis=1)
            best, gain = joint_estimate(up, down, m, nx[k + p].astype(float), ny[r].astype(float), percent / 100)
            ok = (best >= percent / 100) | (gain <= DOUBT)
            found_i.append(k + p[ok])
            found_j.append(r[ok])
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (found_i, found_j))


def common_counts(value: np.ndarray, row: np.ndarray, rows: int, dense: int = 24) -> np.ndarray:
    """How many elements each two of ``rows`` sets have in common: elements of many sets by a matrix product, the
    others by their neighbours in sorted order."""
    order = np.lexsort((row, value))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    group = np.cumsum(new) - 1
    times = np.bincount(group)
    counts = np.zeros(rows * rows, dtype=np.float64)
    often = times[group] > dense
    column = np.cumsum(times > dense) - 1
    g, r = column[group[often]], row[often]
    for k in range(0, int((times > dense).sum()), 4096):
        part = (g >= k) & (g < k + 4096)
        x = np.zeros((rows, 4096), dtype=np.float32)
        x[r[part], g[part] - k] = 1
        counts += (x @ x.T).ravel()
    group, row = group[~often], row[~often]
    for k in range(1, dense):
        pair = group[k:] == group[:-k]
        if not pair.any():
            break
        counts += np.bincount(row[:-k][pair] * rows + row[k:][pair], minlength=rows * rows)
    counts = counts.reshape(rows, rows)
    return np.triu(counts, 1)


def _by_tile(t: pa.Table) -> Iterator[pa.Table]:
    """The tiles of a batch of tiles."""
    key = np.stack([t[c].to_numpy() for c in ("cluster", "i", "j")])
    order = np.lexsort(key[::-1])
    t, key = t.take(order).combine_chunks(), key[:, order]
    cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
    for a, b in zip([0, *cuts], [*cuts, t.num_rows]):
        if b - a > 1:
            yield t.slice(a, b - a)


def _edges(rep: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs (i, j)."""
    if not len(i):
        return rep[:0], rep[:0]
    label = spanning(len(rep), i, j)
    hit = np.flatnonzero(label != np.arange(len(rep)))
    return rep[hit], rep[label[hit]]


def _tile_function(pairs: Callable) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        us, vs = [], []
        for tile in _by_tile(t):
            rep = tile["rep"].to_numpy()
            u, v = _edges(rep, *pairs(tile))
            us.append(u)
            vs.append(v)
        none = np.zeros(0, dtype=np.int64)
        return pa.table({"u": np.concatenate([none, *us]), "v": np.concatenate([none, *vs])})
    return run


def _estimated(percent: int) -> Callable:
    def pairs(tile: pa.Table):
        n = tile["n"].to_numpy()
        regs = np.frombuffer(b"".join(tile["data"].to_pylist()), dtype=np.uint16).reshape(len(n), -1)
        return plausible(regs, regs, n, n, percent, True)
    return _tile_function(pairs)


def _verified(percent: int) -> Callable:
    def pairs(tile: pa.Table):
        n = tile["n"].to_numpy()
        value = np.frombuffer(b"".join(tile["data"].to_pylist()), dtype=np.uint64)
        both = common_counts(value, np.repeat(np.arange(len(n)), n), len(n))
        i, j = np.nonzero(100 * both >= percent * (n[:, None] + n[None, :] - both))
        return i[i < j], j[i < j]
    return _tile_function(pairs)


def _digests(value: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """128 bits that name each set."""
    at = np.minimum(np.cumsum(n) - n, len(value))
    sums = [np.add.reduceat(np.append(mix(value ^ U(s)), U(0)), at) for s in (11, 12)]
    return {f"d{k}": np.where(n > 0, x, U(0)).view(np.int64) for k, x in enumerate(sums, 1)}


def _sketch_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = string_column(batch["text"])
            for a, b in slices(text):
                value, n = shingle_sets(text.slice(a, b - a), words)
                regs = registers(value, n)
                yield pa.RecordBatch.from_pydict({"id": batch["id"].slice(a, b - a), "n": n, **_digests(value, n),
                                                  "regs": pa.array([r.tobytes() for r in regs], pa.binary())})
    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            regs = np.frombuffer(b"".join(batch["regs"].to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_pydict({"rep": np.repeat(batch["id"].to_numpy(), BANDS), "band": band_keys(regs).ravel()})


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = string_column(batch["text"])
            for a, b in slices(text):
                value, n = shingle_sets(text.slice(a, b - a), words)
                cut = np.cumsum(n)[:-1]
                yield pa.RecordBatch.from_pydict({"id": batch["id"].slice(a, b - a), "n": n, **_digests(value, n),
                                                  "data": pa.array([x.tobytes() for x in np.split(value, cut)], pa.binary())})
    return run


def _tiled(members: DataFrame, chunks, batches) -> DataFrame:
    """Deal the members ``(cluster, rep, n, data)`` of each cluster into ``chunks``; every two chunks meet in a tile.

    ``batch`` names the rows of one Python call: a tile of a cluster of several chunks is a batch of its own, so a batch
    stays bounded however large its cluster is; clusters of one tile are dealt by hash into ``batches`` so that one call
    serves many small ones. Both are functions of a cluster's number of members ``c`` and sum ``s`` of n.
    """
    members = salted(members, "rep")
    size = written(groups(members, ["cluster"], c=(F.count(F.lit(1)), F.sum), s=(F.sum("n"), F.sum))
                   .select("cluster", F.ceil(chunks).cast("int").alias("chunks"), batches.alias("load"), "salts"))
    packs = max(1, int(size.filter("chunks = 1").agg(F.sum("load")).first()[0] or 0))
    return (members.join(by_salt(size.select("cluster", "chunks", "salts")), ["cluster", "salt"])
            .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .filter("chunks = 1 or mine <> other")  # a tile compares all its rows, also those of one chunk
            .select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rep", "n", "data",
                    F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs)))
                    .otherwise(F.xxhash64("cluster", F.least("mine", "other"), F.greatest("mine", "other"))).alias("batch")))


def distinct_buckets(bands: DataFrame) -> DataFrame:
    """The buckets ``(rep, band)`` of several classes, one of those that hold the same classes.

    Buckets are told apart by their number of classes and a 128-bit sum of class hashes, so near copies that share many
    bands are compared once for each different set of classes, not once for each band.
    """
    wide = lambda seed: F.sum(F.xxhash64("rep", F.lit(seed)).cast("decimal(20,0)"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c"), wide(1).alias("s1"), wide(2).alias("s2")).filter("c > 1")
    once = written(shared.groupBy("c", "s1", "s2").agg(F.min("band").alias("band")).select("band"))
    return bands.join(once, "band")


def minhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate texts: one row ``(id_col, n_shingles, component_id, kept)`` per row of ``df``.

    Two texts are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct ``words``-word shingles
    (A-Z lower-cased; words are runs without space and \\x09-\\x0D; a text with fewer words is one shingle). Null
    or wordless texts have n_shingles = 0 and link with nothing. ``component_id`` is the smallest id reachable over
    links. Rows with a null id are no one's partner; repeated rows and copies count as one set. Rows that repeat an id with
    another text are texts of their own, with links of their own.

    1. One pass over the texts makes every set's size, digest and SetSketch registers. Rows with the same set
       (size and 128-bit digest) become one numbered class.
    2. Classes that share a band of registers meet in its bucket. There the joint likelihood of each two sketches and the
       exact sizes rules out pairs that can't reach the threshold. The rule errs with probability exp(-20) per pair.
    3. The components of the pairs that are left are decided on the full sets. Buckets and components are cut into chunks
       of bounded size and every two chunks meet in one tile, so no task holds a whole group, and a tile returns
       spanning links, never all pairs. Texts that share little are compared in their own buckets only, so a chain of
       them doesn't grow into one large comparison.

    With 40 bands of 6 registers a pair at 85 % (80 %) similarity meets in no band with probability 6e-9 (6e-6).
    Shingles are 64-bit hashes: within a pair of sets a false match is less likely than 1e-9.
    """
    spark = ready(df.sparkSession)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    key = ["n", "d1", "d2"]
    sketched = salted(written(rows.mapInArrow(_sketch_rows(words), "id bigint, n bigint, d1 bigint, d2 bigint, regs binary")), "id")
    classes = written(groups(sketched.filter("n > 0"), key, least=(F.min("id"), F.min), regs=(F.min("regs"), F.min))  # equal sets have equal registers
                      .filter("least is not null").withColumn("rep", F.monotonically_increasing_id()))
    bands = classes.select(F.col("rep").alias("id"), "regs").mapInArrow(_band_rows, "rep bigint, band bigint")
    drawn = classes.select("rep", "n", F.col("regs").alias("data"))
    near = _tiled(written(distinct_buckets(bands).withColumnRenamed("band", "cluster").join(drawn, "rep")), F.col("c") / TILE_ROWS, F.col("c") / 1_000)
    close = connected_components(near.groupBy("batch").applyInArrow(_estimated(percent), "u bigint, v bigint"))
    wanted = (close.select(F.col("component").alias("cluster"), F.col("node").alias("rep"))
              .unionByName(close.select(F.col("component").alias("cluster"), F.col("component").alias("rep")).distinct()))
    wanted = written(wanted.join(classes.select("rep", *key, F.col("least").alias("id")), "rep"))
    full = (rows.join(wanted.select("id").distinct(), "id", "left_semi")
            .mapInArrow(_set_rows(words), "id bigint, n bigint, d1 bigint, d2 bigint, data binary"))
    held = full.join(wanted, ["id", *key]).select("cluster", "rep", "n", "data").dropDuplicates(["rep"])  # repeated rows count once
    sets = _tiled(written(held), F.greatest(F.col("c") / TILE_ROWS, F.col("s") / TILE_SHINGLES), F.col("s") / (TILE_SHINGLES / 4))
    linked = connected_components(sets.groupBy("batch").applyInArrow(_verified(percent), "u bigint, v bigint"))
    member = salted(classes.drop("regs").withColumnRenamed("salts", "own").join(linked, F.col("rep") == F.col("node"), "left")
                    .withColumn("component", F.coalesce("component", "rep")), "rep")
    named = groups(member, ["component"], component_id=(F.min("least"), F.min))
    named = by_salt(member.join(by_salt(named), ["component", "salt"]).select(*key, "component_id", F.col("own").alias("salts")))
    return (sketched.select("id", *key, "salt").join(named, [*key, "salt"], "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))
