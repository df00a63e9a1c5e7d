import random

import numpy as np
import pyarrow as pa
import pytest

from labledger.llm import quality as Q
from labledger.llm.queries import op2_quality_classifier
from llm_fixtures import SMALL, make  # noqa: F401

SCHEMA = "doc_id bigint, text string, source string, lang string, score string"


def texts(seed, n):
    r = random.Random(seed)
    words = ["tion", "the", "of", "anere", "hand", "ble", "thor", "and", "ingen", "rea"]
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        w = [r.choice(words) + r.choice(words) for _ in range(r.randrange(20, 200))]
        if not good:
            kind = r.randrange(3)
            w = [w[0]] * len(w) if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [x + r.choice(["$$$", "***", "&&&"]) for x in w]
        rows.append((i, " ".join(w) + ".", f"src{min(r.randrange(40), 20)}", r.choice("ab"), "x"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_clean_documents_stay(make):
    rows, labels = texts(1, 1500)
    known = make("doc_id bigint, quality int", labels[:700])
    out = {r.doc_id: r for r in Q.classify_quality(make(SCHEMA, rows), known).collect()}
    truth = dict(labels)
    held = [i for i in range(700, 1500)]
    assert np.mean([out[i].kept == bool(truth[i]) for i in held]) > 0.97
    assert np.mean([out[i].kept for i in held if truth[i]]) > 0.99


def brute_sites(rows):
    """The same posteriors from plain sums."""
    rows = [(h, q, float(p)) for h, q, p in rows]
    mu = np.mean([p for *_, p in rows])

    def groups(key):
        g = {}
        for r in rows:
            g.setdefault(key(r), []).append(r[2])
        return g

    def strength(g, mean):
        use = {k: v for k, v in g.items() if len(v) > 1}
        if not use:
            return Q.LARGEST_CONCENTRATION
        n = sum(len(v) for v in use.values())
        between = (sum(len(v) * (np.mean(v) - mean(k)) ** 2 for k, v in use.items()) - sum(mean(k) * (1 - mean(k)) for k in use)) / n
        if between <= 0:
            return Q.LARGEST_CONCENTRATION
        within = sum(len(v) * mean(k) * (1 - mean(k)) for k, v in use.items()) / n
        return min(Q.LARGEST_CONCENTRATION, max(Q.SMALLEST_CONCENTRATION, within / between - 1))
    hosts = groups(lambda r: r[0])
    k = strength(hosts, lambda h: mu)
    post = {h: (sum(v) + k * mu) / (len(v) + k) for h, v in hosts.items()}
    paths = groups(lambda r: r[:2])
    k = strength(paths, lambda q: post[q[0]])
    return {q: (post[q[0]], (sum(v) + k * post[q[0]]) / (len(v) + k)) for q, v in paths.items()}, mu


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_posteriors_match_brute_force(make, seed):
    r = random.Random(seed)
    rate = {h: r.random() for h in range(6)}
    rows = []
    for _ in range(900):
        h = r.choice([0, 0, 0, 1, 2, 3, 4, None]) if r.random() < 0.98 else r.randrange(6, 60)
        rows.append((None if h is None else f"h{h}", r.choice(["a", "b", None]), min(1.0, max(0.0, rate.get(h, 0.5) + r.uniform(-0.3, 0.3)))))
    sites, overall = Q.site_posteriors(make("host string, path string, p double", rows))
    want, mu = brute_sites(rows)
    got = {(x.host, x.path): (x.host_posterior, x.path_posterior) for x in sites.collect()}
    assert overall == pytest.approx(mu) and set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)


def test_registered_query_leaves_each_document_out_of_its_site(spark):
    """Posteriors, score and decision of every document from plain sums over the others."""
    docs = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = op2_quality_classifier(spark, SMALL).collect()
    assert sorted(x.doc_id for x in out) == sorted(docs)
    p = {x.doc_id: 1 / (1 + np.exp(-x.evidence)) for x in out}
    rows = [(*docs[x.doc_id], p[x.doc_id]) for x in out]
    sites, mu = brute_sites(rows)
    host_n, host_s, path_n, path_s = {}, {}, {}, {}
    for h, q, v in rows:
        host_n[h], host_s[h] = host_n.get(h, 0) + 1, host_s.get(h, 0.0) + v
        path_n[h, q], path_s[h, q] = path_n.get((h, q), 0) + 1, path_s.get((h, q), 0.0) + v
    # Strengths by solving for them in the whole posteriors: (s + k m) / (n + k) = posterior.
    solve = lambda s, n, m, post: (s - n * post) / (post - m)
    h = max(host_n, key=lambda v: abs(host_s[v] / host_n[v] - mu))
    hk = solve(host_s[h], host_n[h], mu, next(a for k, (a, _) in sites.items() if k[0] == h))
    s = max(sites, key=lambda v: abs(path_s[v] / path_n[v] - sites[v][0]))
    pk = solve(path_s[s], path_n[s], *sites[s])
    logit = lambda v: np.log(min(max(v, 1e-6), 1 - 1e-6) / (1 - min(max(v, 1e-6), 1 - 1e-6)))
    for x in out:
        site, own = docs[x.doc_id], p[x.doc_id]
        host = (host_s[site[0]] - own + hk * mu) / (host_n[site[0]] - 1 + hk)
        path = (path_s[site] - own + pk * host) / (path_n[site] - 1 + pk)
        score = 1 / (1 + np.exp(-(x.evidence + logit(path) - logit(mu))))
        assert (x.host_posterior, x.path_posterior, x.score) == pytest.approx((host, path, score), rel=1e-5)
        assert x.kept == (x.score >= 0.5 - 1e-12)


def test_sparse_sites_shrink_towards_their_host(make):
    rows = [("good", "p", 0.95)] * 300 + [("bad", "p", 0.1)] * 300 + [("bad", "new", 0.9)] + [("lone", "p", 0.1)]
    sites, overall = Q.site_posteriors(make("host string, path string, p double", rows))
    got = {(x.host, x.path): x for x in sites.collect()}
    assert got["bad", "new"].path_posterior < overall < got["good", "p"].path_posterior
    assert abs(got["lone", "p"].host_posterior - overall) < abs(0.1 - overall)


def test_features():
    x = dict(zip(Q.FEATURES, Q.text_features(pa.array([None, "", "One one TWO!\nOne one TWO!\n12 | abc.", " \n\t "], pa.large_string()))[2]))
    assert x["log_words"] == pytest.approx(np.log(10)) and x["distinct_share"] == pytest.approx(5 / 9) and x["repeat_share"] == pytest.approx(2 / 9)
    assert x["top_share"] == pytest.approx(4 / 9) and x["bar_share"] == pytest.approx(1 / 9) and x["repeated_line_share"] == pytest.approx(1 / 3)
    assert x["digit_share"] == pytest.approx(2 / 27) and x["upper_share"] == pytest.approx(8 / 27) and x["punctuated_share"] == pytest.approx(1 / 9)
    assert (Q.text_features(pa.array([None, "", " \n"], pa.large_string())) == 0).all()


def test_defined_cases(make, spark):
    rows = [(None, "some text", None, None, None), (1, None, "s", "l", None), (2, "", "s", None, None), (3, "word " * 60_000, "s", "l", None), (3, "word " * 60_000, "s", "l", None)]
    df, none = make(SCHEMA, rows), spark.createDataFrame([], "doc_id bigint, quality int")
    out = Q.classify_quality(df, none).collect()
    assert len(out) == 5 and all(r.kept and r.evidence == 0 and r.score == pytest.approx(0.5) for r in out)
    some = make("doc_id bigint, quality int", [(1, 0), (3, 1), (3, 1), (9, None), (None, 1)])
    out = Q.classify_quality(df, some, labelled_rows=3).collect()
    assert len(out) == 5 and all(r.score is not None and 0 <= r.score <= 1 for r in out)
    assert Q.classify_quality(spark.createDataFrame([], SCHEMA), some).count() == 0
