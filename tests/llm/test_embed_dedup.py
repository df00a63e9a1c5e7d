import numpy as np
import pytest

from labledger.llm import embed_dedup as E
from llm_fixtures import by, make  # noqa: F401

SCHEMA = "vec_id bigint, embedding array<float>, label int, kept string"


def brute(rows, threshold):
    ok = [(i, np.array(v, dtype=np.float32).astype(float), l) for i, v, l in rows
          if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, x, l in ok:
        for b, y, m in ok:
            if a != b and l == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a].add(b)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def planted(seed, n, d, labels):
    g = np.random.default_rng(seed)
    base = g.normal(size=(max(1, n // 12), d))
    rows = []
    for i in range(n):
        v = base[g.integers(len(base))] + g.normal(size=d) * g.choice([0.0, 0.2, 0.25, 0.3, 2.0])
        rows.append((int(i * 7 % (n * 7)), [float(np.float32(x)) for x in v * g.choice([0.01, 1.0, 30.0])], int(g.integers(labels))))
    return rows


@pytest.mark.parametrize("seed,n,d,labels,tile", [(1, 300, 16, 3, 8 << 20), (2, 300, 64, 1, 64 * 8 * 20), (3, 120, 5, 2, 5 * 8 * 7)])
def test_matches_brute_force(make, by, seed, n, d, labels, tile):
    rows = planted(seed, n, d, labels)
    got = by(E.embedding_links(make(SCHEMA, [(*r, "x") for r in rows]), tile_bytes=tile), "vec_id", "n_links", "component_id", "kept")
    assert got == brute(rows, 0.93)


def test_odd_vectors_and_copies(make, by):
    v, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0], 0), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0),
            (9, [1.0, nan, 3.0], 0), (10, [inf, 1.0, 1.0], 0), (11, v, 1), (12, [1.0, 2.0], 0), (13, [-1.0, -2.0, -3.0], 0)]
    got = by(E.embedding_links(make(SCHEMA, [(*r, None) for r in rows])), "vec_id", "n_links", "component_id", "kept")
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in range(4, 14))


def test_many_copies_count_as_rows(make, by):
    rows = [(i, [1.0, 0.5], 0, None) for i in range(500)] + [(1000 + i, [1.0, 0.51], 0, None) for i in range(3)]
    got = by(E.embedding_links(make(SCHEMA, rows)), "vec_id", "n_links", "component_id")
    assert set(got.values()) == {(502, 0)}


def test_null_and_repeated_ids_and_empty(make, spark):
    rows = [(None, [1.0, 2.0], 0, None), (5, [1.0, 2.0], 0, None), (5, [1.0, 2.0], 0, None), (None, [9.0, -2.0], 0, None)]
    got = sorted(map(tuple, E.embedding_links(make(SCHEMA, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 1, 5, True), (5, 1, 5, True), (None, 0, None, True)], key=str)
    assert E.embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_with_other_vectors(make):
    rows = [(1, [1.0, 0.0], 0, None), (1, [0.0, 1.0], 0, None), (2, [1.0, 0.01], 0, None), (3, [0.01, 1.0], 0, None), (4, [0.02, 1.0], 0, None)]
    got = sorted(map(tuple, E.embedding_links(make(SCHEMA, rows)).collect()))
    assert got == sorted([(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)])


def test_error_bound_is_rigorous():
    g = np.random.default_rng(5)
    x, y = g.normal(size=(200, 33)), g.standard_cauchy(size=(200, 33))
    x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    qx, sx, ex, mx = E.quantise(x)
    qy, sy, ey, my = E.quantise(y)
    near = E.int8_products(qx, qy) * sx[:, None] * sy[None, :]
    assert (np.abs(near - x @ y.T) <= ex[:, None] * my + mx[:, None] * ey + ex[:, None] * ey + 1e-12).all()
    assert (E.int8_products(np.full((1, 3000), 127, np.int8), np.full((1, 3000), -127, np.int8)) == -127 * 127 * 3000).all()


def test_without_labels(make, by):
    rows = [(1, [1.0, 0.0], 0, None), (2, [1.0, 0.1], 5, None), (3, [0.0, 1.0], None, None)]
    assert by(E.embedding_links(make(SCHEMA, rows), label_col=None), "vec_id", "component_id") == {1: (1,), 2: (1,), 3: (3,)}
