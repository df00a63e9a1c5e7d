import math
import random
import re
from collections import Counter, defaultdict

import pytest

from labledger.llm import urlfilter as V
from llm_fixtures import make  # noqa: F401

SCHEMA = "page_id bigint, url string, verdict string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path, rules):
    fits = [(rule, v) for rule, v in rules for name, _, p in [rule.partition("/")]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + p)]
    return min(fits, key=lambda r: (-len(r[0]), r[0])) if fits else (None, None)


ODD = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://net/x", "http://xnet/", "http://example.net/en/1", "http://WWW.Example.NET/en/", "http://example.net/EN/",
       "http://example.net/en", "http://b.example.com/de/?q", "http://example.com?/de/", "http://x.org/fr/#a", "a://b://c/d", "http://x.org\n/fr/", "http://É.org/fr/1", "x" * 5000 + "://net/"]


def urls(seed, n):
    r = random.Random(seed)
    host = [f"{r.choice(['www', 'm', 'a1'])}.{r.choice(['thing', 'win', 'cas'])}{k}.example.{t}" for k in range(12) for t in ("net", "org", "com")]
    return ODD + [f"http://{r.choice(host)}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.randrange(1000)}{r.choice(['', '.html', '#x', '?u=1'])}" for _ in range(n)]


def test_hosts_paths_and_rules(make):
    rows = [(i, u, "x") for i, u in enumerate(urls(1, 200))]
    for r in V.filter_urls(make(SCHEMA, rows)).collect():
        host, path = split(rows[r.page_id][1])
        rule, verdict = ruled(host, path, V.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule), rows[r.page_id]
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)


def test_longest_rule_wins_and_ties(spark):
    rules = [("b/x/", "block"), ("a.b/x", "allow"), ("b/", "block"), ("c.b/", "allow")]
    for host, path in [("a.b", "/x/"), ("c.b", "/y"), ("z.c.b", ""), ("b", "/x"), ("ab", "/")]:
        got = spark.range(1).select(V.rule_of(V.F.lit(host), V.F.lit(path), rules).alias("r")).first().r
        assert (tuple(got) if got else (None, None)) == ruled(host, path, rules)


def test_ratios_match_brute_force(make, spark):
    r = random.Random(3)
    counts = [("".join(r.choice("ab\x02") for _ in range(4)), float(r.randrange(3)), float(r.randrange(4))) for _ in range(60)]
    total = defaultdict(lambda: [0.0, 0.0])
    for g, a, b in counts:
        total[g][0] += a
        total[g][1] += b
    wanted = list(total) + ["zzzz", "abab", "bz\x02a"]
    out = {x.gram: x.ratio for x in V.log_ratios(make("gram string, allow double, block double", [(g, *v) for g, v in total.items()]),
                                                 make("gram string", [(g,) for g in set(wanted)]), 3).collect()}

    def p(gram, c):
        est = 1 / V.ALPHABET
        for k in range(4):
            seen = Counter()
            for g, v in total.items():
                seen[g[-k - 1:]] += v[c]
            x = gram[-k - 1:][:k]
            m = sum(v for g, v in seen.items() if g[:k] == x)
            t = sum(1 for g, v in seen.items() if g[:k] == x and v > 0)
            est = (seen[gram[-k - 1:]] + t * est) / (m + t) if m + t else est
        return est
    for g in set(wanted):
        assert out[g] == pytest.approx(math.log(p(g, 0)) - math.log(p(g, 1)), abs=1e-9)


def test_models_separate_the_classes(make):
    r = random.Random(5)
    word = lambda s: "".join(r.choice(s) for _ in range(8))
    good = [f"http://{word('bcdfaeiou')}.good/{word('aeioubcd')}" for _ in range(300)]
    bad = [f"http://{word('xzqjkw')}.bad/{word('xzqjkw9')}" for _ in range(300)]
    free = [f"http://{word('bcdfaeiou')}.other/{word('aeioubcd')}" for _ in range(60)] + [f"http://{word('xzqjkw')}.other/{word('xzqjkw')}" for _ in range(60)]
    rows = [(i, u, None) for i, u in enumerate(good + bad + free)]
    got = {x.page_id: x.verdict for x in V.filter_urls(make(SCHEMA, rows), [("good/", "allow"), ("bad/", "block")]).collect()}
    right = sum(got[600 + i] == ("allow" if i < 60 else "block") for i in range(120))
    assert right >= 114


def test_models_count_every_ruled_url(make):
    r = random.Random(11)
    word = lambda s: "".join(r.choice(s) for _ in range(6))
    urls = [f"http://{word('abcd')}.good/{word('ab')}" for _ in range(20)] + [f"http://{word('wxyz')}.bad/{word('wx')}" for _ in range(20)]
    free = [f"http://{word('abwx')}.other/{word('abcdwxyz')}" for _ in range(10)]
    got = {x.page_id: x for x in V.filter_urls(make(SCHEMA, [(i, u, None) for i, u in enumerate(urls + free)]), [("good/", "allow"), ("bad/", "block")]).collect()}
    grams = lambda u: [p[i:i + 5] for p in ["\x02" * 4 + "".join(split(u)) + "\x03"] for i in range(len(p) - 4)]
    total = defaultdict(lambda: [0.0, 0.0])
    for i, u in enumerate(urls):
        for g in grams(u):
            total[g][i >= 20] += 1
    wanted = {g for u in free for g in grams(u)}
    ratio = {x.gram: x.ratio for x in V.log_ratios(make("gram string, allow double, block double", [(g, *v) for g, v in total.items()]),
                                                   make("gram string", [(g,) for g in wanted]), 4).collect()}
    for i, u in enumerate(free):
        assert got[40 + i].score == pytest.approx(sum(ratio[g] for g in grams(u)) / len(grams(u)), abs=1e-9)
    assert all(x.score is not None for x in got.values())


def test_threshold(make):
    rows = [(0.1, 1.0, 0.0), (0.5, 1.0, 0.0), (-0.3, 0.0, 2.0), (-0.9, 0.0, 1.0), (0.02, 0.0, 1.0)]
    assert V.threshold_of(make("score double, allow double, block double", rows)) == pytest.approx(0.03)
    assert V.threshold_of(make("score double, allow double, block double", rows[:2])) == 0.0


def test_defined_cases(make, spark):
    rows = [(None, "http://a.b/c", None), (1, "http://a.b/c", None), (1, "http://a.b/c", None), (2, "http://q.net/", None)]
    got = sorted(((r.page_id, r.rule, r.verdict) for r in V.filter_urls(make(SCHEMA, rows)).collect()), key=str)
    assert got == sorted([(None, None, "allow"), (1, None, "allow"), (1, None, "allow"), (2, "net/", "block")], key=str)
    assert V.filter_urls(spark.createDataFrame([], SCHEMA)).count() == 0
