"""Work per task and bytes moved follow the rows: partition counts, rows without a key, exports on demand."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from labledger.operators import anomaly as an
from labledger.operators import ingest as ing
from labledger.operators import maintenance as mt
from labledger.operators.numbering import index_in_place, request_ids
from labledger.plans import registry
from labledger.plans.registry import REGISTRY
from labledger.sources import keys as ky
from labledger.sources import store as st
from labledger.sources import tables
from labledger.sources.fixture_files import ExportFiles
from labledger.sources.store import OrderStore
from labledger.streaming import jobs as sj

SMALL = "/root/testdata/sf0.001"


def test_wide_tables_get_partitions_by_rows(spark, monkeypatch):
    set_for = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(1000)
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 10)
    assert tables.partitions_for(spark, 5) == set_for
    assert tables.partitions_for(spark, 1000) == 100
    assert tables.dealt_by_rows(df, 1000, "id").rdd.getNumPartitions() == 100
    assert tables.dealt_by_rows(df, 10, "id") is df


def test_an_export_is_written_when_asked_for(spark):
    files = ExportFiles(spark, SMALL)
    assert set(vars(files)) == {"spark", "sf_dir"}
    path = files.inventory
    assert files.inventory == path and set(vars(files)) == {"spark", "sf_dir", "inventory"}
    assert os.path.isdir(path.removeprefix("file:"))


def test_rows_with_blank_ids_are_not_dealt_to_one_task(spark, orders_df):
    rows = [("S", "*" if i % 4 else None, f"item {i}", "f.csv", i) for i in range(4000)] + [("S", "17.0", "known", "f.csv", 9000), ("S", "18", "new", "f.csv", 9001)]
    inv = spark.createDataFrame(rows, "sheet string, `Req#` string, Item string, file string, line_no bigint")
    stored = orders_df([{"notes": "Original Req#: 17."}, {"notes": "Original Req#: *."}])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ing.origin_req_anti_join(inv, stored)
        assert got.count() == 4001 and got.filter("Item = 'known'").isEmpty()
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    assert most < 1500


def test_dispositions_shuffle_the_lines_once(spark):
    rows = [("7", "tube", "1", "f", i) for i in range(3)] + [(None, "tube", "1", "f", 10 + i) for i in range(2)] + [("7", "ab", "1", "f", 20), ("8", "tube", "1", "f", 30)]
    export = spark.createDataFrame(rows, "`PO #` string, Item string, `Unit Price ($)` string, file string, line_no bigint")
    export = export.withColumn("Grant", F.when(F.col("line_no") == 0, "abc"))
    judged = ing.line_item_dispositions(export, None, "L")
    got = {r["line_no"]: r["disposition"] for r in judged.collect()}
    assert got == {0: "quarantined", 1: "imported", 2: "duplicate", 10: "imported", 11: "imported", 20: "unnamed", 30: "imported"}
    plan = judged._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_orders_to_score_arrive_in_files_by_rows(spark, monkeypatch):
    seen = {}
    real = sj.stream_score_orders

    def watch(spark, source_dir, model, **kw):
        seen["files"], seen["batch"] = len(spark.read.parquet(source_dir).inputFiles()), kw["max_files_per_trigger"]
        return real(spark, source_dir, model, **kw)

    monkeypatch.setattr(sj, "stream_score_orders", watch)
    REGISTRY["stream_score_orders"](spark, SMALL)
    assert seen["files"] == 4 * seen["batch"] == 8


def test_walk_by_steps_gives_the_scores_of_a_plain_walk(spark, orders_df):
    rng = np.random.default_rng(3)
    df = orders_df([{"req_id": f"R{i}", "qty": int(q), "unit_price": round(p, 2), "total": round(q * p, 2)}
                    for i, (q, p) in enumerate(zip(rng.integers(1, 50, 300), rng.uniform(1, 90, 300)))])
    model = an.fit_forest(df, n_trees=7, max_samples=64)
    feat, thr, left, right, pathv = model.arrays()
    denom = float(an.average_path_length([model.psi])[0]) * model.n_trees
    got = {r["req_id"]: r["score"] for r in an.score_samples(df, model).collect()}
    for r in an.standardize(an.finite_features(df), model.scaler).collect():
        total = 0.0
        for t in range(7):
            node = 0
            while feat[t, node] >= 0:
                node = left[t, node] if r[an.FEATURES[feat[t, node]]] <= thr[t, node] else right[t, node]
            total += pathv[t, node]
        assert got[r["req_id"]] == -np.exp2(-total / denom)
    leaf = feat < 0
    assert np.isinf(model.steps()[1][leaf]).all()


def rows_of(df):
    return sorted(map(str, df.collect()))


def lines_and_orders(spark, orders_df):
    """Lines with a hot key, without a PO and unnamed; orders that hold some of their keys several times."""
    rows = [(None if i % 9 == 0 else "7.0" if i % 3 == 0 else str(i), "ab" if i % 11 == 0 else f"item {0 if i % 3 == 0 else i}", "1", "abc" if i % 13 == 0 else "5", "6", "f", i) for i in range(400)]
    export = spark.createDataFrame(rows, "`PO #` string, Item string, `Unit Price ($)` string, Grant string, `RF Project` string, file string, line_no bigint")
    return export, orders_df([{"po_no": None if i % 5 == 0 else str(i // 2 * 2), "item": f"item {i // 2 * 2}", "notes": f"Original Req#: {i}.", "lab": "L"} for i in range(150)])


def test_large_imports_give_the_rows_of_small_ones(spark, orders_df, monkeypatch):
    export, orders = lines_and_orders(spark, orders_df)
    summary = export.select(F.col("PO #").alias("PO Number"), F.col("Item").alias("Supplier"), F.lit("3").alias("Total Amount"), F.lit("x").alias("PO Owner"), "file", "line_no")
    inv = export.select(F.lit("S").alias("sheet"), F.col("PO #").alias("Req#"), "Item", F.lit("2").alias("#"), F.lit("1").alias("Amount"), "file", "line_no")
    store = OrderStore(spark)
    store.write(orders)
    held = ky.OrderKeys(store).refresh()

    def results():
        return [rows_of(f) for f in (
            ing.import_line_items(export, orders, "L", "2001-08-02"), ing.import_line_items(export, orders, "L", "2001-08-02", keys=held.table("line")),
            ing.import_anti_join(export, None, ky.order_keys(orders, "line"), laid_out=False), ing.import_anti_join(export, orders), ing.import_dup_count(export, orders),
            ing.import_po_summary(summary, orders, "L", "2001-08-02"), ing.import_po_summary(summary, orders, "L", "2001-08-02", keys=held.table("po")),
            ing.import_inventory(inv, orders, "L", "2001-08-02"), ing.import_inventory(inv, orders, "L", "2001-08-02", keys=held.table("origin")),
            ing.line_item_dispositions(export, orders, "L"), ing.import_report(summary, orders, "L"))]

    small = results()
    assert small[0] == small[1] and small[2] == small[3] and small[5] == small[6] and all(small)
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 20)
    assert results() == small


def test_large_batches_are_joined_and_numbered_in_partitions_by_rows(spark, orders_df, monkeypatch):
    export, orders = lines_and_orders(spark, orders_df)
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 20)
    fresh = ing.import_anti_join(export, orders)
    plan = fresh._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "hashpartitioning(k_po" in plan and ", 20)" in plan and "LeftSemi" not in plan
    batch = spark.range(100).select("id", F.lit("a").alias("item"))
    got = request_ids(batch, ["id"], orders, "2001-08-02", rows=400)
    assert got.rdd.getNumPartitions() == 20 and [r["req_id"] for r in got.orderBy("id").collect()] == [f"REQ-010802-{i:03d}" for i in range(1, 101)]


def test_adoption_moves_whole_rows_once(spark, orders_df, monkeypatch):
    rows = [{"req_id": None if i % 17 == 0 else " " if i % 19 == 0 else f"R{i % 90}", "item": f"item {i}", "lab": "L"} for i in range(120)]
    rows = [{**r, "req_id": r["req_id"] or ""} for r in rows]
    known = [{"req_id": f"R{i}", "item": "known", "lab": "L"} for i in range(0, 90, 4)]

    def adopted(n):
        monkeypatch.setattr(tables, "ROWS_PER_TASK", n)
        store = OrderStore(spark)
        store.write(orders_df(known))
        rejected = mt.adopt_orders(store, orders_df(rows))
        again = mt.adopt_orders(store, orders_df(rows))
        assert again.count() == len(rows) and store.versions().count() == 2
        return rows_of(store.read(1)), rows_of(rejected)

    ids, kept = [r["req_id"].strip() for r in rows], {r["req_id"] for r in known}
    fresh = [i for i in ids if i and i not in kept and ids.count(i) == 1]
    few, many = adopted(400_000), adopted(10)
    assert few == many and len(few[0]) == len(fresh) and len(few[1]) == len(rows) - len(fresh)
    refused = mt.refused_ids(orders_df(rows).filter("trim(req_id) != ''"), orders_df(known), len(rows))
    assert {r["r"]: r["reason"] for r in refused.collect()} == {i: mt.KNOWN_ID if i in kept else mt.REPEATED_ID for i in ids if i and (i in kept or ids.count(i) > 1)}
    assert "refused_ids" in refused.inputFiles()[0]


def shuffle_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in held.mkString("\n").split("\n") if "/shuffle_" in f}


def left_over(spark, before, most=20_000):
    """Bytes of the shuffle files that came since; those of ended queries may take a moment to go."""
    until = time.time() + 10
    while (left := sum(os.path.getsize(f) for f in shuffle_files(spark) - before if os.path.exists(f))) > most and time.time() < until:
        time.sleep(0.2)
    return left


def kept_copies(spark):
    return {d for d in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if d.startswith("rdd-")}


def test_exports_leave_no_shuffle_files_and_no_sorted_copy(spark):
    st.order_table(spark, SMALL)
    files, copies = shuffle_files(spark), kept_copies(spark)
    export = ExportFiles(spark, SMALL).write()
    assert left_over(spark, files) < 20_000 and kept_copies(spark) == copies  # 6005 lines are some 600,000
    lines = sorted(f for f in os.listdir(export.line_items.removeprefix("file:")) if f.startswith("part-"))
    numbers = [int(r["Line"]) for f in lines for r in spark.read.csv(f"{export.line_items}/{f}", header=True).collect()]
    assert numbers == list(range(1, st.order_table(spark, SMALL).count() + 1))


def test_snapshots_and_numbering_leave_no_shuffle_files(spark, orders_df):
    rows = spark.range(3000).select(F.concat(F.lit("R"), "id").alias("req_id"), F.sha2(F.col("id").cast("string"), 256).alias("item"), F.lit("L").alias("lab"))
    files = shuffle_files(spark)
    OrderStore(spark).write(rows.repartition(5, "req_id"))
    assert left_over(spark, files) < 20_000
    numbered = request_ids(rows.drop("req_id"), ["item"], orders_df([]), "2001-08-02")
    assert left_over(spark, files) < 20_000 and numbered.count() == 3000


def test_rows_are_numbered_in_place_by_ranges_of_keys(spark):
    keys = [None] * 30 + ["hot"] * 300 + [f"k{i * 37 % 500}" for i in range(500)] + ["\u00e9", "\U0001f600", "\uffee", ""]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    for n in (1, 2, 13, 40):
        rows = index_in_place(df, "k", "i", partitions=n).withColumn("p", F.spark_partition_id()).orderBy("i").collect()
        assert [r["i"] for r in rows] == list(range(1, len(keys) + 1))
        assert [r["k"] for r in rows] == sorted(keys, key=lambda k: (k is not None, (k or "").encode()))
        assert [r["p"] for r in rows] == sorted(r["p"] for r in rows) and n // 2 <= len({r["p"] for r in rows}) <= n
    assert index_in_place(df.filter("k = 'none'"), "k", "i").count() == 0


def test_suffixes_go_on_after_those_in_use(spark, orders_df):
    batch = spark.range(3).withColumnRenamed("id", "n")
    taken = lambda *n: orders_df([{"req_id": f"REQ-010802-{i:03d}"} for i in n])
    ids = lambda t: [r["req_id"][-3:] for r in request_ids(batch, ["n"], t, "2001-08-02").orderBy("n").collect()]
    assert ids(taken(1, 2)) == ["003", "004", "005"] and ids(taken(2, 3)) == ["001", "004", "005"] and ids(taken()) == ["001", "002", "003"]
    plan = request_ids(batch, ["n"], taken(1, 2), "2001-08-02")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_large_tables_are_written_densely(spark, monkeypatch, orders_df):
    monkeypatch.setattr(st, "LARGE_ROWS", 100)
    for rows, codec in ((99, "snappy"), (100, "zstd")):
        store = OrderStore(spark, rows=rows)
        store.write(orders_df([{"lab": "L"}]))
        assert all(codec in f for f in store.read().inputFiles())


def test_a_large_table_is_cut_into_files_to_score_without_a_shuffle(spark, monkeypatch):
    seen = {}

    def watch(spark, source_dir, model, **kw):
        seen["files"], seen["batch"] = spark.read.parquet(source_dir), kw["max_files_per_trigger"]
        return source_dir

    monkeypatch.setattr(sj, "stream_score_orders", watch)
    monkeypatch.setattr(registry, "LARGE_ROWS", 1000)
    REGISTRY["stream_score_orders"](spark, SMALL)
    names = seen["files"].inputFiles()
    assert -(-len(names) // seen["batch"]) == 4 and seen["files"].count() == st.order_table(spark, SMALL).count()
    # As they lie: files of the same task follow each other (c000, c001), which a shuffle into one file a task doesn't give.
    assert any("-c001." in n for n in names)


def test_a_report_shuffles_flags_not_texts(spark, orders_df):
    export, orders = lines_and_orders(spark, orders_df)
    judged = ing.line_item_dispositions(export.withColumn("Line Total ($)", F.lit("3")), orders, "L").groupBy("disposition").count()
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    joined = next(x for x in plan[plan.index("Join LeftOuter"):].split("\n") if "k_item" in x and "Project" in x)
    assert " AS _bad" in joined and "_lone" not in joined and "item_clean" not in joined
