"""The pipeline, stage by stage, against brute force on a small corpus."""

import random

import pytest

import test_exact_dedup
import test_setsketch

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row int"


def corpus(seed=3):
    r = random.Random(seed)
    words = ["tion", "the", "of", "anere", "hand", "ble", "thor", "and", "ingen", "rea"]
    make = lambda n: [r.choice(words) + r.choice(words) + r.choice(words) for _ in range(n)]
    texts, good = [], []
    for _ in range(260):
        texts.append(" ".join(make(r.randrange(30, 150))) + ".")
        good.append(1)
    for k in range(90):
        w = make(80)
        texts.append(" ".join([w[0]] * 80 if k % 3 == 0 else [x.upper() + "!!" for x in w] if k % 3 == 1 else [x + "$$$" for x in w]))
        good.append(0)
    for k in range(40):  # exact copies but for white space
        texts.append(texts[k].replace(" ", "  " if k % 2 else "\n"))
        good.append(1)
    for k in range(40, 80):  # near copies: one word in the middle changed
        w = texts[k].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
        good.append(1)
    rows = [(i, t, r.choice("ef"), f"src{min(r.randrange(8), 4)}", len(t), "x", i) for i, t in enumerate(texts)]
    return rows, good


def test_stages(spark, tmp_path):
    import corpus_pipeline as P
    from labledger.llm import mixing
    from labledger.llm.queries import WORD_BPE

    rows, good = corpus()
    labels = [(i, g, 0) for i, g in enumerate(good) if i % 2]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "minhash_dedup", "mixing", "bpe"]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, sets = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for i, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "bpe":
            assert sorted(docs.columns) == sorted(columns)
            sets.append({r.doc_id: r.text for r in docs.collect()})
            assert sets[-1].items() <= sets[-2].items()
    everything, accepted, single, distinct, mixed = sets
    assert sorted(set(everything) - set(accepted)) == [i for i, g in enumerate(good) if not g]
    want = test_exact_dedup.brute(list(accepted.items()))
    assert set(single) == {i for i in accepted if want[i][2]}
    want = test_setsketch.brute(list(single.items()), 5, 80)
    assert set(distinct) == {i for i in single if want[i][2]} and len(distinct) < len(single) < len(accepted)
    held = spark.createDataFrame([(i, rows[i][3], rows[i][2], "prose", len(t.split())) for i, t in distinct.items()],
                                 "doc_id bigint, source string, lang string, topic string, n_tokens bigint")
    drawn = {r.doc_id for r in mixing.mix_sources(held, ["source", "lang", "topic"], keep=P.KEPT_TOKENS).collect() if r.sampled}
    assert set(mixed) == drawn and 0.6 < len(mixed) / len(distinct) < 0.95
    t = tokenizers.Tokenizer.from_file(WORD_BPE)
    last = {r.doc_id: r for r in docs.collect()}
    assert set(last) == set(mixed)
    for i, text in mixed.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert list(last[i].ids) == ids and last[i].n_tokens == len(ids) and last[i].decoded == t.decode(ids, skip_special_tokens=False)


def test_odd_tables(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(None, None, None, None, None, None, 1), (1, None, None, "s", 0, None, 2), (2, "a b c", "e", None, 5, None, 3), (2, "a b c", "e", None, 5, None, 3),
            (3, "word " * 30_000, "e", "s", 150_000, None, 4), (4, "", "e", "s", 0, None, 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
    out = P.run(spark, f"{tmp_path}/a")
    assert {r.doc_id for r in out.collect()} <= {None, 1, 2, 3, 4}
    assert P.run(spark, f"{tmp_path}/b").count() == 0
