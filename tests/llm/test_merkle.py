import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from labledger.llm import merkle as M
from llm_fixtures import make  # noqa: F401

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, root string, tree string"
OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def path(tree, at):
    """(left siblings, right siblings) on the way up."""
    out = []
    for level in tree[:-1]:
        run = at // 8 * 8
        out.append((level[run:at], level[at + 1:run + 8]))
        at //= 8
    return out


def brute(rows, tampered):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    for t in trees.values():
        t.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    whole = {k: levels([leaf(*r) for r in trees[k]]) for k in order}
    top = levels([whole[k][-1][0] for k in order])
    out = []
    for n, k in enumerate(order):
        for at, r in enumerate(trees[k]):
            proof = path(whole[k], at) + path(top, n)
            cur = leaf(*tampered(r))
            for a, b in proof:
                cur = h(*a, cur, *b)
            out.append((r[0], leaf(*r), whole[k][-1][0], top[-1][0], h(*[x for a, b in proof for x in a + b]), cur, cur == top[-1][0]))
    return out


def lowered(r):
    text = r[1] if r[1] is None or zlib.crc32(str(r[0]).encode()) % 3 else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
    return (r[0], text, *r[2:])


def got(df, **more):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = M.merkle_manifest(df, tamper={"text": lower}, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, **more)
    return sorted((tuple(r[c] for c in OUT) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed,n,langs,block", [(1, 700, ["en", "de", "", None, "é"], 4), (2, 700, [f"l{k}" for k in range(90)], 1), (3, 600, ["one"], 2), (4, 9, ["a", "b"], 1)])
def test_matches_brute_force(make, seed, n, langs, block):
    r = random.Random(seed)
    ids = r.sample(range(-50, 10 * n), n)
    rows = [(i, r.choice(["Text é", "no capitals", "", None, "Y" * 9]) , r.choice(langs) if k % 3 else langs[0], r.choice(["s", None, "É"]), r.choice([None, 5, -7])) for k, i in enumerate(ids)]
    df = make(SCHEMA, [(*x, "leaf", "root", "tree") for x in rows])
    want = brute(rows, lowered)
    assert got(df, block_levels=block) == sorted(want, key=str)  # few levels: several rounds
    assert {w[6] for w in want} == {True, False} or n < 10


def test_defined_cases(make, spark):
    long = "Long " * 60_000
    one = [(5, "Only", "en", "s", 4)]
    assert got(make(SCHEMA, [(*one[0], None, None, None)])) == brute(one, lowered)
    rows = [(1, None, None, None, None), (None, "A", "en", None, None), (None, None, None, None, 3), (7, long, "en", "s", 9), (7, long, "en", "s", 9), (7, "other", "en", "s", 9), (8, "", "", "", 0)]
    plain = lambda r: r if r[0] is None else lowered(r)
    want, have = brute(rows, plain), got(make(SCHEMA, [(*x, None, None, None) for x in rows]))
    assert have == sorted(want, key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert M.merkle_manifest(empty).count() == 0
    assert all(r.verified for r in M.merkle_manifest(make(SCHEMA, [(*x, None, None, None) for x in rows])).collect())


def test_the_queue_stays_small():
    sweep = M.Sweep(0, [h(str(k)) for k in range(4096)], 4096, 4)
    assert sweep.longest <= M.ARITY * 4 and sweep.top[1] == levels([h(str(k)) for k in range(4096)])[-1][0]
    assert [k for k, _ in sweep.down(None)] == list(range(4095, -1, -1))


def test_fields_of_different_rows_differ():
    assert len({leaf(*r) for r in [(1, "a", "b", None, 1), (1, "a", "b", "", 1), (1, "a", "b", "-", 1), (1, "1:a", "b", "-", 1), (11, "a", "b", "-", 1)]}) == 5
