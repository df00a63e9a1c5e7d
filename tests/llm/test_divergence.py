import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from labledger.llm import divergence as D
from llm_fixtures import make  # noqa: F401

SCHEMA = "text string, lang string, source string, term string, rank int, level int"


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


def brute(rows, min_docs=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        counts[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731,B023
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            parts = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}],
                     "term": [(-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def got(df, **more):
    return sorted(map(tuple, D.source_divergence(df, **more).collect()))


def planted(seed, docs, sources, vocabulary):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 9, 17]))) for _ in range(vocabulary)] + ["é", "日本", "ab", "abab", "ababab"]
    weights = {s: [r.random() ** 4 for _ in words] for s in sources}
    rows = []
    for _ in range(docs):
        s, lang = r.choice(sources), r.choice(["en", "en", "de", None])
        picked = r.choices(words, weights[s], k=r.choice([0, 1, 5, 40]))
        rows.append((r.choice([" ", "1", "-", "\n"]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in picked), lang, s))
    return rows


@pytest.mark.parametrize("seed,sources,block,tile,bucket", [(1, ["a", "B", None, "é", "zz"], 64, 1 << 19, 8 << 20), (2, [f"s{k}" for k in range(23)], 5, 60, 3000), (3, ["x", "y"], 1, 10, 300)])
def test_matches_brute_force(make, seed, sources, block, tile, bucket):
    rows = planted(seed, 500, sources, 120)
    df = make(SCHEMA, [(*r, "x", 1, 1) for r in rows], parts=4)
    want = brute(rows)
    assert got(df, block_sources=block, tile_rows=tile, bucket_bytes=bucket) == want and {w[2] for w in want} == {"pair", "term"}


def test_defined_cases(make, spark):
    long = "x" * 100_000
    rows = [(None, "en", "a"), ("", "en", "b"), ("word " * 5, "de", "a")] + [(f"{long} B", "fr", "s")] * 10 + [("b" + "\x7f" + "c", "fr", None)] * 3 + [("b", "fr", "t")] * 9
    want = brute(rows)
    assert got(make(SCHEMA, [(*r, None, None, None) for r in rows])) == want
    assert [w for w in want if w[0] == "en"] == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] and not [w for w in want if w[0] == "de"]
    assert any(w[2:4] == ("term", long) for w in want)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_term_column():
    texts = ["Ab,c  Éa1b", "", "-", "zz", None, "日本X"]
    found, counts = D.term_column(pa.array(texts))
    assert [t.decode() for t in found.to_pylist()] == ["ab", "c", "Éa", "b", "zz", "日本x"] and counts.tolist() == [4, 0, 0, 1, 0, 1]


def test_rare_prefixes_are_not_extended(make):
    rows = [("common commons rare", "en", "s", None, None, None)] * 12 + [(f"seldom{k * 'x'}", "en", "s", None, None, None) for k in range(9)]
    counts = make(SCHEMA, rows, parts=2).select("text", "lang", "source").mapInArrow(D._counts(4, 2), D.COUNTS)
    kept = {(r.level, bytes(r.stem).decode()) for r in D.frequent_prefixes(counts, 10).collect()}
    assert kept == {(1, "c"), (1, "r"), (2, "co"), (2, "ra"), (4, "comm"), (4, "rare")}


def test_large_counts_are_exact(spark):
    n, total = 4 * 10 ** 12, 10 ** 13 + 7
    df = spark.createDataFrame([(n, total, 5)], "n bigint, total bigint, terms bigint")
    assert df.select(D.share("n", "total", "terms")).first()[0] == 1 + 10 ** 9 * (n + 2) // (total + 10)
    assert np.array_equal(D.LOWER[[0x40, 0x41, 0x5A, 0x5B, 0xC9]], [0x40, 0x61, 0x7A, 0x5B, 0xC9])
