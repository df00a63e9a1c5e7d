"""The registered queries over the smallest supplied tables."""

import hashlib

import pytest

import harness
import test_embed_dedup
import test_setsketch
import test_substring

from labledger.llm import substring
from labledger.llm.queries import QUERIES, SQL, table
from llm_fixtures import SMALL, by  # noqa: F401

COLUMNS = {1: ["vec_id", "n_links", "component_id", "kept"], 2: ["doc_id", "score", "kept"], 3: ["doc_id", "n_shingles", "component_id", "kept"],
           4: ["doc_id", "n_words", "n_removed", "kept_sha256"], 5: ["doc_id", "probability", "sampled"], 6: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
           7: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], 8: ["page_id", "host", "path", "rule", "verdict"],
           9: ["doc_id", "n_bytes", "n_tokens", "over_limit"], 10: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
           11: ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], 12: ["lang", "source", "part", "item", "value", "rank"],
           13: ["doc_id", "n_lines", "n_dropped", "kept_sha256"]}


@pytest.mark.parametrize("name", list(QUERIES))
def test_one_row_for_each_input_row(spark, name):
    n = int(name[2:].split("_")[0])
    out = QUERIES[name](spark, SMALL)
    assert out.columns[:3] and set(COLUMNS[n]) <= set(out.columns)
    if n == 12:  # rows of sources and terms
        return
    source, key = {1: ("embeddings", "vec_id"), 7: ("pages", "page_id"), 8: ("pages", "page_id")}.get(n, ("documents", "doc_id"))
    ids = sorted(r[0] for r in out.select(key).collect())
    assert ids == sorted(r[0] for r in table(spark, SMALL, source).select(key).collect())


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, name):
    assert harness.compare(spark, harness.duck(SMALL), SMALL, name, QUERIES[name], SQL[name])["ok"] is True


def test_match_brute_force(spark, by, monkeypatch):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = by(QUERIES["op3_minhash_dedup"](spark, SMALL), "doc_id", "n_shingles", "component_id", "kept")
    assert got == test_setsketch.brute(docs, 3, 85)
    want = {i: (*v[:2], hashlib.sha256(v[2].encode()).hexdigest()) for i, v in test_substring.brute(docs, 13).items()}
    assert by(QUERIES["op4_substring_dedup"](spark, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    monkeypatch.setattr(substring.remove_repeated_windows, "__defaults__", ("doc_id", "text", 13, 20_000, 8_000, 1_000, 3_000))  # many chunks, segments and groups
    assert by(QUERIES["op4_substring_dedup"](spark, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    vectors = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, SMALL, "embeddings").collect()]
    got = by(QUERIES["op1_embedding_dedup"](spark, SMALL), "vec_id", "n_links", "component_id", "kept")
    assert got == test_embed_dedup.brute(vectors, 0.93)
