import random
import re

import numpy as np
import pytest

from labledger.llm import setsketch as S
from llm_fixtures import by, make  # noqa: F401

SCHEMA = "doc_id bigint, text string, n_shingles string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def planted(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "A", "a", " x", "|"]
    base = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 20, 60, 200]))] for _ in range(n // 10)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(int(len(w) * r.choice([0, 0, 0.02, 0.04, 0.06, 0.1]))):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((r.randrange(10 ** 12), r.choice([" ", "\n", " \t"]).join(w)))
    return rows


@pytest.mark.parametrize("seed,words,percent", [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_matches_brute_force(make, by, seed, words, percent):
    rows = planted(seed, 250)
    got = by(S.minhash_components(make(SCHEMA, [(*r, "x") for r in rows]), words=words, percent=percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute(rows, words, percent)


def test_large_group_in_many_tiles(make, by, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 16)
    r = random.Random(7)
    base = [f"t{r.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 240):
        w = list(base)
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    got = by(S.minhash_components(make(SCHEMA, [(*x, None) for x in rows], parts=5), words=3, percent=85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute(rows, 3, 85)


def test_batches_stay_bounded_as_a_cluster_grows(make):
    largest = {}
    for size in (60, 600, 1200):
        rows = [(0, i, 1, b"") for i in range(size)] + [(-i, 10 ** 6 + i, 1, b"") for i in range(1, 3000)]
        tiles = S._tiled(make("cluster bigint, rep bigint, n bigint, data binary", rows), S.F.col("c") / 16, S.F.col("c") / 100)
        got = tiles.groupBy("batch").agg(S.F.count(S.F.lit(1)).alias("c"), S.F.countDistinct("cluster").alias("k"), S.F.max("j").alias("j")).collect()
        largest[size] = max(r.c for r in got if r.j)
        assert sum(r.c for r in got if not r.j) == 2999 and max(r.k for r in got) > 50  # small clusters share their batches
        assert sum(r.c for r in got if r.j) == size * (-(-size // 16) - 1)
    assert max(largest.values()) <= 80, largest  # two chunks of about 16


def test_defined_cases(make, spark):
    long = "ab " * 50_000
    rows = [(1, None), (2, ""), (3, " \t\n\v\f\r"), (4, "one two"), (5, "ONE\ttwo"), (6, "one"), (None, "one two"), (7, long), (8, long + "ab"), (9, "x" * 200_000),
            (9, "x" * 200_000), (10, "É one"), (11, "é one")]
    got = sorted(map(tuple, S.minhash_components(make(SCHEMA, [(*r, None) for r in rows]), words=3, percent=85).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, 4, False),
                          (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (9, 1, 9, True), (10, 1, 10, True), (11, 1, 11, True)], key=str)
    assert S.minhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_with_other_texts(make):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, "q " * 9), (4, a + " x"), (1, a)]
    got = sorted(map(tuple, S.minhash_components(make(SCHEMA, [(*r, None) for r in rows]), words=3, percent=85).collect()))
    assert got == sorted([(1, 58, 1, True), (1, 58, 1, True), (1, 58, 1, True), (2, 59, 1, False), (3, 59, 1, False), (4, 1, 4, True), (4, 59, 1, False)])


def test_chains_of_little_similarity_are_compared_in_their_buckets(spark, make):
    """10,000 texts, each sharing a third of its shingles with the next: compared pairs stay near-linear."""
    n = 10_000
    rows = [(i, " ".join(f"p{i // 2 if i % 2 else i // 2 - 1}w{k}" for k in range(30)) + " " + " ".join(f"t{i}w{k}" for k in range(20)), None) for i in range(0, n)]
    df = make(SCHEMA, rows, parts=8).select(S.F.col("doc_id").alias("id"), "text")
    sketched = df.mapInArrow(S._sketch_rows(3), "id bigint, n bigint, d1 bigint, d2 bigint, regs binary")
    bands = S.written(sketched.select("id", "regs").mapInArrow(S._band_rows, "rep bigint, band bigint"))
    sizes = S.distinct_buckets(bands).groupBy("band").agg(S.F.count(S.F.lit(1)).alias("c"))
    pairs = sizes.agg(S.F.sum(S.F.expr("c * (c - 1) div 2"))).first()[0]
    assert 0 < pairs < 2 * n


def test_buckets_with_equal_classes_count_once(make):
    rows = [(r, b) for b in (1, 2, 3) for r in (7, 8, 9)] + [(7, 4), (8, 4), (7, 5), (9, 6), (10, 6)]
    got = {tuple(sorted(r.reps)) for r in S.distinct_buckets(make("rep bigint, band bigint", rows)).groupBy("band").agg(S.F.collect_list("rep").alias("reps")).collect()}
    assert got == {(7, 8, 9), (7, 8), (9, 10)}


def test_registers_are_mergeable_minima():
    g = np.random.default_rng(1)
    a, b = (np.unique(g.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (900, 40))
    both = np.union1d(a, b)
    one = lambda x: S.registers(x, np.array([len(x)]))[0]
    assert (S.merged(one(a), one(b)) == one(both)).all()
    sizes = np.array([1, 0, 3, 500])
    value = g.integers(0, 1 << 63, 504, dtype=np.uint64)
    joined = S.registers(value, sizes)
    assert (joined[0] == one(value[:1])).all() and (joined[3] == one(value[4:])).all() and (joined[1] == 0).all()


def test_likelihood_estimate_and_bands():
    g = np.random.default_rng(2)
    errors, met = [], 0
    for _ in range(40):
        x = np.unique(g.integers(0, 1 << 63, 460, dtype=np.uint64))
        a, b = x[:430], x[30:]
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = (S.registers(y, np.array([len(y)])) for y in (a, b))
        est, _ = S.joint_estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), ra.shape[1], np.array([len(a)]), np.array([len(b)]), 0.85)
        errors.append(est[0] - j)
        met += bool((S.band_keys(ra) == S.band_keys(rb)).any())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05 and met == 40


def test_common_counts():
    r = random.Random(3)
    sets = [sorted({r.randrange(80) if k % 3 else r.randrange(8) for _ in range(40)}) for k in range(50)]
    value = np.array([x for s in sets for x in s], dtype=np.uint64)
    row = np.repeat(np.arange(50), [len(s) for s in sets])
    for dense in (2, 24, 60):
        got = S.common_counts(value, row, 50, dense)
        assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(50) for j in range(i + 1, 50))
