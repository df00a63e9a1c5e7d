import hashlib
import random

import numpy as np
import pytest

from labledger.llm import bpe, queries, token_count
from labledger.llm.queries import BYTE_BPE, WORD_BPE
from llm_fixtures import make  # noqa: F401

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id bigint, text string, n_tokens string"


def fuzz(seed, n):
    r = random.Random(seed)
    alphabet = "aaaabcdeé ΣσςİIıǅﬁßͅ'stre  \t\n\r\x0b\x0c\x1c\x1d\x85\u3000\u2028\u200b\xa0中文한글\U0001f600٣½²12!?.,—᠎\ufeff_^`\u0301A\u030a"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(n)]
    return texts + ["", " ", "\n", "<|endoftext|>", "a<|endoftext|> b<|startoftext|><|endoftext|>x", "<|endoftext|", "a" * 3000, "ab" * 2000, "he'll can't 'S 'LL",
                    " ".join(f"word{i}" for i in range(5000)), "x \x1c y", "e\u0301 E\u0301", "a  b   c \n\n d \t", "1234567 ²³"]


def hex_of(ids):
    return hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_bpe_matches_the_library(make):
    texts = fuzz(1, 1500)
    t = tokenizers.Tokenizer.from_file(WORD_BPE)
    df = make(SCHEMA, [(i, x, "n") for i, x in enumerate(texts)])
    coded = bpe.encode(df, WORD_BPE)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    apart = {r.doc_id: (list(r.ids), r.n_tokens, r.decoded) for r in bpe.decode(coded.withColumn("kept", bpe.F.col("ids")), WORD_BPE).collect()}
    rows = {r.doc_id: r for r in bpe.encode_decode(df, WORD_BPE).collect()}
    assert apart == {i: (list(r.ids), r.n_tokens, r.decoded) for i, r in rows.items()}
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert rows[i].n_tokens == len(e.ids) and bytes(rows[i].ids_bytes) == np.array(e.ids, dtype="<u4").tobytes(), texts[i]
        assert rows[i].decoded == t.decode(e.ids, skip_special_tokens=False), texts[i]


def test_bpe_defined_cases(make, spark):
    df = make("doc_id bigint, text string, ids string, `a.b` int", [(1, None, "x", 1), (2, "", "x", None), (2, "", "x", None), (None, "one two", None, 3)])
    rows = sorted(map(tuple, bpe.encode(df, WORD_BPE).select("doc_id", "`a.b`", "ids").collect()), key=str)
    t = tokenizers.Tokenizer.from_file(WORD_BPE)
    assert rows == sorted([(1, 1, []), (2, None, []), (2, None, []), (None, 3, t.encode("one two", add_special_tokens=False).ids)], key=str)
    both = bpe.encode_decode(df, WORD_BPE)
    assert both.columns == ["doc_id", "a.b", "ids", "n_tokens", "ids_bytes", "decoded"]
    assert {(r.doc_id, r.decoded, r.n_tokens) for r in both.collect()} == {(1, "", 0), (2, "", 0), (None, "one</w> two</w>", 2)}
    nothing = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert tuple(bpe.decode(nothing, WORD_BPE).first()) == (1, None, None, None)
    assert bpe.encode(spark.createDataFrame([], SCHEMA), WORD_BPE).count() == 0


def test_stale_queue_entries():
    v = bpe.Vocabulary(open(WORD_BPE, encoding="utf-8").read())
    t = tokenizers.Tokenizer.from_file(WORD_BPE)
    r = random.Random(2)
    for _ in range(1500):
        word = "".join(r.choice("aabbinthre") for _ in range(r.randint(1, 60)))
        assert np.frombuffer(v.piece(word), dtype="<u4").tolist() == t.encode(word, add_special_tokens=False).ids


def test_cache_stays_bounded():
    c = bpe.Cache(lambda k: k + 1, 10)
    for i in range(100):
        c.age()
        assert c[i] == i + 1 and len(c) <= 11 and len(c.older) <= 11


def test_counts_match_the_library(make, spark):
    texts = fuzz(3, 1500)
    t = tokenizers.Tokenizer.from_file(BYTE_BPE)
    df = make(SCHEMA, [(i, x, "n") for i, x in enumerate(texts)])
    rows = {r.doc_id: r for r in token_count.count_tokens(df, BYTE_BPE).collect()}
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len(texts[i].encode()), len(e.ids), len(e.ids) > 1024), texts[i]
    odd = make(SCHEMA, [(None, "a b", None), (1, None, None), (2, "a", None), (2, "a", None)])
    assert sorted(map(tuple, token_count.count_tokens(odd, BYTE_BPE, limit=1).collect()), key=str) == sorted(
        [(None, 3, 2, True), (1, 0, 0, False), (2, 1, 1, False), (2, 1, 1, False)], key=str)
    assert token_count.count_tokens(spark.createDataFrame([], SCHEMA), BYTE_BPE).count() == 0


def test_synchronous_merging_of_repeated_pairs():
    m = token_count.RankedMerges(open(BYTE_BPE, encoding="utf-8").read())
    t = tokenizers.Tokenizer.from_file(BYTE_BPE)
    r = random.Random(4)
    words = ["".join(r.choice("aab-!") for _ in range(r.randint(1, 40))) for _ in range(800)] + ["a" * k for k in range(1, 60)] + ["-" * k for k in range(1, 200)]
    words = [w for w in words if len(set(w) & set("ab")) == 0 or not set(w) & set("-!")]  # one pre-token each
    assert m.counts(words).tolist() == [len(e.ids) for e in t.encode_batch(words, add_special_tokens=False)]


def test_long_runs_are_not_held():
    c = bpe.Cache(len, 10, longest=4)
    assert [c[k] for k in ("abcd", "abcde", "abcde")] == [4, 5, 5] and dict(c) == {"abcd": 4}


def test_registered_queries_match_the_library_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    words, pieces = tokenizers.Tokenizer.from_file(WORD_BPE), tokenizers.Tokenizer.from_file(BYTE_BPE)
    for t in (words, pieces):
        t.no_truncation()
        t.no_padding()
    coded = {r.doc_id: r for r in queries.op6_bpe_roundtrip(spark, sf).collect()}
    counted = {r.doc_id: r for r in queries.op9_token_counts(spark, sf).collect()}
    assert set(coded) == set(counted) == set(texts)
    for i, x in texts.items():
        ids = words.encode(x, add_special_tokens=False).ids
        decoded = hashlib.sha256(words.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids), hex_of(ids), decoded)
        n = len(pieces.encode(x, add_special_tokens=False).ids)
        assert (counted[i].n_bytes, counted[i].n_tokens, counted[i].over_limit) == (len(x.encode()), n, n > 1024)
