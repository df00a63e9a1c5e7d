import random
import re

import numpy as np
import pyarrow as pa
import pytest

from labledger.llm import substring as D
from llm_fixtures import by, make  # noqa: F401

SCHEMA = "doc_id bigint, text string, n_words string"


def brute(rows, n):
    words = {}
    for i, t in rows:
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k:k + n]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < i:
                gone |= set(range(k, k + n))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def planted(seed, docs, vocabulary):
    r = random.Random(seed)
    words = [f"w{k}é" for k in range(vocabulary)] + ["A", "a", " "]
    passages = [[r.choice(words) for _ in range(r.choice([5, 13, 14, 40]))] for _ in range(8)]
    rows = []
    for _ in range(docs):
        w = [r.choice(words) for _ in range(r.choice([0, 3, 12, 13, 50, 200]))]
        for _ in range(r.randrange(4)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(passages)
        rows.append((r.randrange(-10 ** 9, 10 ** 9), r.choice([" ", "\n\n", " \t"]).join(w)))
    return rows + [(r.randrange(10 ** 12), rows[0][1]) for _ in range(30)]


@pytest.mark.parametrize("seed,vocabulary,chunk,segment,block,group", [(1, 400, 6 << 20, 4 << 20, 1 << 20, 2 << 20), (2, 400, 2000, 500, 100, 300), (3, 2, 3000, 700, 700, 90)])
def test_matches_brute_force(make, by, seed, vocabulary, chunk, segment, block, group):
    rows = planted(seed, 120, vocabulary)
    df = make(SCHEMA, [(*r, "x") for r in rows])
    cut = D.remove_repeated_windows(df, chunk_bytes=chunk, segment_windows=segment, block_windows=block, group_windows=group)
    assert by(cut, "doc_id", "n_words", "n_removed", "kept_text") == brute(rows, 13)


def test_only_windows_estimated_repeated_are_grouped():
    g = np.random.default_rng(1).integers(0, 1 << 63, 30_000, dtype=np.uint64)
    g = np.concatenate([g, g[:500]])  # 500 repeated windows; four cells a window
    cells, tables = 4 * len(g), []
    for row in range(D.DEPTH):
        c = np.sort(D._cells(g, row, cells))
        tables.append(pa.table({"segment": [row], "chunk": [0], "n": [[len(c)]], "data": [[D._pack(c)]]}))
    marks = pa.concat_tables([D._merge(1, cells)(t) for t in tables])
    found = set(D._estimated(g, marks, cells).tolist())
    assert found >= {*range(500), *range(30_000, 30_500)} and len(found) < 1000 + 0.08 * len(g)  # (1 - e^-1/4)^2 = 0.049


def test_packed_numbers_come_back():
    for x in ([], [0], [5, 5, 7], [1, 2 ** 63, 2 ** 64 - 1], sorted(random.Random(1).randrange(2 ** 40) for _ in range(999))):
        x = np.array(x, dtype=np.uint64)
        assert (D._unpack(D._pack(x), len(x)) == x).all()


def test_equal_ids_count_as_one_document(make, by):
    p = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    rows = [(1, f"{p[0]} x"), (1, f"y {p[0]}"), (2, p[0]), (2, p[1]), (3, p[1]), (1, p[2]), (1, p[2])]
    for chunk in (6 << 20, 40):
        got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in D.remove_repeated_windows(make(SCHEMA, [(*r, None) for r in rows]), chunk_bytes=chunk).collect())
        assert got == sorted([(1, 0, f"{p[0]} x"), (1, 0, f"y {p[0]}"), (2, 20, ""), (2, 0, p[1]), (3, 20, ""), (1, 0, p[2]), (1, 0, p[2])])


def test_defined_cases(make, spark):
    p = " ".join(f"p{i}" for i in range(13))
    long = " ".join(f"q{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, p), (5, f"a {p}  b"), (6, "short text"), (7, "short text"), (None, f"{p} x"), (8, long), (9, long), (10, "z" * 300_000), (11, p), (11, p)]
    got = sorted(map(tuple, D.remove_repeated_windows(make(SCHEMA, [(*r, None) for r in rows])).collect()), key=str)
    assert got == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, 13, 0, p), (5, 15, 13, "a b"), (6, 2, 0, "short text"), (7, 2, 0, "short text"),
                          (None, 14, 0, f"{p} x"), (8, 60_000, 0, long), (9, 60_000, 60_000, ""), (10, 1, 0, "z" * 300_000), (11, 13, 13, ""), (11, 13, 13, "")], key=str)
    assert D.remove_repeated_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_copy_but_the_first_goes(make, by):
    text = " ".join(f"c{i}" for i in range(30))
    rows = [(i, text, None) for i in range(400)]
    got = by(D.remove_repeated_windows(make(SCHEMA, rows), chunk_bytes=2000, segment_windows=200), "doc_id", "n_removed")
    assert got == {i: (30 if i else 0,) for i in range(400)}
