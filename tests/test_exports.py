"""Imports of real-looking export files: quoting, header order, optional columns, no row lost."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from labledger.functions import clean as cl
from labledger.operators import forecast as fc
from labledger.operators import ingest as ing
from labledger.operators import maintenance as mt
from labledger.operators import sourcing as src
from labledger.operators import yearly as yr
from labledger.schema import ORDER, empty_orders
from labledger.sources import exports as ex
from labledger.sources.fixture_files import ExportFiles
from labledger.sources.store import OrderStore, export_csv, scan_order_csv
from labledger.streaming import jobs as sj

AS_OF = "2001-08-02"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def lines_of(spark, tmp_path, *texts):
    for i, t in enumerate(texts):
        put(f"{tmp_path}/li/{chr(97 + i)}.csv", t)
    return ex.scan_line_items(spark, f"{tmp_path}/li")


def report(export, existing):
    return {r["disposition"]: r["rows"] for r in ing.import_report(export, existing, "Admin").collect()}


def test_quotes_line_breaks_and_header_order(spark, tmp_path):
    df = lines_of(spark, tmp_path,
                  'PO #, Item ,Vendor,Quantity,Unit Price ($)\n1,"Plate 10"" deep, sterile",Acme,2,3.5\n2,"Two\nlines of text",Acme,1,1\n',
                  'Vendor,Unit Price ($),Item,PO #,Date Ordered,Extra\nBeta,4,Gloves nitrile,3,7/1/2001,x\n')
    rows = {r["PO #"]: r for r in df.collect()}
    assert rows["1"]["Item"] == 'Plate 10" deep, sterile' and rows["2"]["Item"] == "Two\nlines of text"
    assert rows["3"]["Item"] == "Gloves nitrile" and rows["3"]["Vendor"] == "Beta" and rows["3"]["Quantity"] is None
    got = ing.import_line_items(df, empty_orders(spark), "Admin", AS_OF).orderBy("req_id").collect()
    assert [(r["req_id"], r["po_no"]) for r in got] == [("REQ-010802-001", "1"), ("REQ-010802-002", "2"), ("REQ-010802-003", "3")]
    assert got[2]["date_ordered"] == date(2001, 7, 1) and float(got[0]["total"]) == 7.0


def test_only_a_line_total_and_headers_alone(spark, tmp_path):
    df = lines_of(spark, tmp_path, "Item,Line Total ($)\nPipette tips,12.50\nTube rack,0\n")
    assert report(df, empty_orders(spark)) == {"imported": 1, "unpriced": 1}
    row = ing.import_line_items(df, empty_orders(spark), "Admin", AS_OF).first()
    assert float(row["total"]) == 12.5 and row["grant"] is None and row["vendor"] is None
    frame = spark.createDataFrame([("9", "Some item", "V", "1", "2", "2", "1", "2", "", "c", "o", "07/01/2001")], ing.LINE_ITEM_HEADERS)
    assert ing.import_line_items(frame, empty_orders(spark), "Admin", AS_OF).count() == 1


def test_no_line_is_lost(spark, tmp_path):
    head = "PO #,Item,Quantity,Unit Price ($),Grant\n"
    first = [",Same item,1,2,", "#2,Same item,1,2,", ",Same item,1,2,", "7,Huge order,1e20,5,", "8,Bad grant,1,2,abc", "9,ab,1,2,", "5,Stored item,1,1,", "6,No price,1,,"]
    second = ["10,Twice item,1,1,", "10,Twice item,1,9,"]
    df = lines_of(spark, tmp_path, head + "\n".join(first) + "\n", head + "\n".join(second) + "\n")
    existing = spark.createDataFrame([("L1", "Stored item", "5")], "req_id string, item string, po_no string")
    from labledger.schema import conform
    existing = conform(existing)
    got = report(df, existing)
    assert got == {"imported": 4, "quarantined": 2, "unnamed": 1, "duplicate": 2, "unpriced": 1}
    assert sum(got.values()) == df.count()
    rows = ing.import_line_items(df, existing, "Admin", AS_OF).collect()
    assert sorted(((r["po_no"], float(r["total"])) for r in rows), key=str) == sorted([(None, 2.0), (None, 2.0), ("#2", 2.0), ("10", 1.0)], key=str)


def test_po_summary_of_several_files(spark, tmp_path):
    pre = "".join(f"line {i}\n" for i in range(9))
    put(f"{tmp_path}/po/a.csv", pre + "PO Number,Supplier,Total Amount,PO Owner\n1,A,10,x\n2,\"From, a\",20,x\n,No number,5,x\n")
    put(f"{tmp_path}/po/b.csv", pre + "Supplier,PO Number,Total Amount,PO Owner\nFrom b,2,99,y\nC,3,30,y\nNo number,,5,x\n")
    df = ex.scan_po_summary(spark, f"{tmp_path}/po")
    assert df.count() == 6
    rows = ing.import_po_summary(df, empty_orders(spark), "Admin", AS_OF).orderBy("req_id").collect()
    assert [(r["po_no"], r["vendor"], float(r["total"])) for r in rows] == [
        ("1", "A", 10.0), ("2", "From, a", 20.0), (None, "No number", 5.0), ("3", "C", 30.0), (None, "No number", 5.0)]
    assert report(df, empty_orders(spark)) == {"imported": 5, "duplicate": 1}


def test_po_summary_values_may_span_lines(spark, tmp_path):
    pre = "Report,a\n\n" + "".join(f"line {i}\n" for i in range(7))
    put(f"{tmp_path}/po/a.csv", pre + 'PO Number,Supplier,Total Amount,PO Owner\n1,"Two\n\nlines, one",10,"x\ny"\n\n2,"5"" plates",20,x\n')
    put(f"{tmp_path}/po/b.csv", pre.replace("line 0", '"open') + "PO Number,Supplier,Total Amount,PO Owner\n3,C,30,y\n")
    df = ex.scan_po_summary(spark, f"{tmp_path}/po")
    assert sorted((r["PO Number"], r["Supplier"], r["Total Amount"], r["PO Owner"]) for r in df.collect()) == [
        ("1", "Two\n\nlines, one", "10", "x\ny"), ("2", '5" plates', "20", "x"), ("3", "C", "30", "y")]
    rows = ing.import_po_summary(df, empty_orders(spark), "Admin", AS_OF).collect()
    assert sorted((r["po_no"], float(r["total"])) for r in rows) == [("1", 10.0), ("2", 20.0), ("3", 30.0)]


def test_large_po_summaries_are_read_by_many_tasks(spark, tmp_path):
    pre = 'Report,"open\n' + "".join(f"line {i}\n" for i in range(8))
    head = "PO Number,Supplier,Total Amount,PO Owner\n"
    spans = "".join(f'{i},"Two\nlines, {i}",{i},"x ""y"""\n' if i % 3 else f"{i},Plain,{i},z\n" for i in range(1, 2001))
    plain = "".join(f'{i},"Plain, {i}",{i},z\n' for i in range(2001, 3001))
    put(f"{tmp_path}/po/a.csv", pre + head + spans)
    put(f"{tmp_path}/po/b.csv", pre + head + plain)
    put(f"{tmp_path}/po/c.csv", pre.replace("line 7\n", "line 7"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = ex.scan_po_summary(spark, f"{tmp_path}/po")
        rows = sorted(df.collect(), key=lambda r: (r["file"], r["line_no"]))
        assert [(r["PO Number"], r["Total Amount"]) for r in rows] == [(str(i), str(i)) for i in range(1, 3001)]
        assert rows[0]["Supplier"] == "Two\nlines, 1" and rows[0]["PO Owner"] == 'x "y"' and rows[-1]["Supplier"] == "Plain, 3000"
        assert ex._after_preamble(spark, f"{tmp_path}/po").rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_entries_and_tables_go_down_to_the_store(spark, orders_df, tmp_path):
    store = OrderStore(spark, f"{tmp_path}/store")
    store.write(orders_df([{"req_id": "REQ-010802-002", "item": "a", "lab": "L"}]))
    entry = lambda item, qty: {"item": item, "qty": qty, "unit_price": 2, "vendor": "V", "lab": "L"}
    entries = orders_df([entry("b", 1), entry("c", 0), entry("d", 3), entry(None, 1)])
    rejected = mt.store_entries(store, entries, ["item"], AS_OF)
    assert sorted((r["item"] or "", r["reason"]) for r in rejected.collect()) == [("", "Item name is required"), ("c", "Quantity must be greater than 0")]
    assert sorted((r["req_id"], r["item"], float(r["total"] or 0)) for r in store.read().collect()) == [
        ("REQ-010802-001", "b", 2.0), ("REQ-010802-002", "a", 0.0), ("REQ-010802-003", "d", 6.0)]
    versions = store.versions().count()
    assert mt.store_entries(store, entries.filter("qty = 0"), ["item"], AS_OF).count() == 1 and store.versions().count() == versions
    put(f"{tmp_path}/old/x.csv", "REQ#,ITEM,LAB\nREQ-010802-001,again,L\nOLD-1,x,L\nOLD-2,y,L\nOLD-2,z,L\n,none,L\n")
    old = scan_order_csv(spark, f"{tmp_path}/old")
    want = [("again", "Known id"), ("none", "No id"), ("y", "Repeated id"), ("z", "Repeated id")]
    assert sorted((r["item"], r["reason"]) for r in mt.adopt_orders(store, old).collect()) == want
    assert sorted((r["item"], r["reason"]) for r in mt.adopt_orders(store, old).collect()) == sorted([*want, ("x", "Known id")])
    assert sorted(r["item"] for r in store.read().collect()) == ["a", "b", "d", "x"] and store.versions().count() == versions + 1
    assert mt.adopt_orders(store, empty_orders(spark)).count() == 0


def test_inventory_sheets(spark, tmp_path):
    put(f"{tmp_path}/inv/sheet=0012/x.csv", "Req#,Item,#,Amount\n,Blank one,2 EA,3\n12\t,Tabbed id,1,1\n")
    put(f"{tmp_path}/inv/sheet=0034/x.csv", "Item,Req#,Amount,#,Vendor\nBlank two,,4,1,V\nFresh,13,5,1,V\nFresh again,13.0,5,1,V\nab,14,1,1,V\n")
    df = ex.scan_inventory(spark, f"{tmp_path}/inv")
    assert sorted({r["sheet"] for r in df.select("sheet").collect()}) == ["0012", "0034"]
    existing = spark.createDataFrame([("L1", "Original Req#: 12.")], "req_id string, notes string")
    from labledger.schema import conform
    existing = conform(existing)
    rows = ing.import_inventory(df, existing, "Admin", AS_OF).collect()
    assert sorted((r["item"], r["grant"], float(r["total"])) for r in rows) == [("Blank one", "0012", 6.0), ("Blank two", "0034", 4.0), ("Fresh", "0034", 5.0)]
    assert report(df, existing) == {"imported": 3, "duplicate": 2, "unnamed": 1}
    assert ing.import_export(df, existing, "Admin", AS_OF).count() == 3


def test_white_space_and_dates(spark):
    df = spark.createDataFrame([(" \t12 \n", "7/1/2001 0:00"), ("x", "2001-7-1")], "a string, d string")
    rows = df.select(cl.strip("a").alias("a"), cl.coerce_date(cl.normalize_date_text("d")).alias("d")).collect()
    assert rows[0]["a"] == "12" and rows[0]["d"] == rows[1]["d"] == date(2001, 7, 1)


def test_stored_table_with_original_names(spark, tmp_path, orders_df):
    t = orders_df([{"item": 'A "quoted", item', "qty": 2, "unit_price": 1.5, "total": 3, "lab": "L", "date_ordered": "2001-07-01", "notes": "two\nlines"}, {"item": "b"}])
    export_csv(t, f"{tmp_path}/out")
    back = scan_order_csv(spark, f"{tmp_path}/out")
    assert back.schema.simpleString() == ORDER.simpleString() and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, t.collect()), key=str)
    put(f"{tmp_path}/up/x.csv", "ITEM,REQ#,TOTAL,DATE ORDERED\nGlove,R1,abc,7/1/2001\n")
    r = scan_order_csv(spark, f"{tmp_path}/up").first()
    assert (r["item"], r["req_id"], r["total"], r["date_ordered"], r["lab"]) == ("Glove", "R1", None, date(2001, 7, 1), None)


def test_store_survives_a_failed_write(spark, orders_df, tmp_path):
    store = OrderStore(spark, f"{tmp_path}/store")
    store.write(orders_df([{"item": "a", "lab": "L"}]))
    broken = orders_df([{"item": "b", "lab": "L"}]).withColumn("item", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        store.append(broken)
    assert store.read().count() == 1
    store.append(orders_df([{"item": "c", "lab": "L"}]), epoch="e1")
    assert store.append(orders_df([{"item": "c", "lab": "L"}]), epoch="e1") is None
    for i in range(3):
        store.append(orders_df([{"item": f"d{i}", "lab": "L"}]))
    assert store.read().count() == 5 and len(store._live_paths()) == 5
    store.compact()
    assert store.read().count() == 5 and len(store._live_paths()) == 1
    put(f"{tmp_path}/bad/_log/x.parquet", "not parquet")
    with pytest.raises(Exception):
        OrderStore(spark, f"{tmp_path}/bad").read().count()


def test_stream_import_resumes_and_replays(spark, tmp_path):
    store = OrderStore(spark, f"{tmp_path}/store")
    store.write(empty_orders(spark))
    run = lambda: sj.stream_import(spark, f"{tmp_path}/in", store, AS_OF, checkpoint=f"{tmp_path}/ckpt")
    put(f"{tmp_path}/in/a.csv", "PO #,Item,Unit Price ($)\n,No number,1\n1,Item one,2\n")
    run()
    run()
    assert store.read().count() == 2
    put(f"{tmp_path}/in/b.csv", "Item,Unit Price ($),PO #\nItem two,1,2\nItem one,2,1\n")
    run()
    assert sorted(r["item"] for r in store.read().collect()) == ["Item one", "Item two", "No number"]


def test_large_quoted_files_are_read_by_many_tasks(spark, tmp_path):
    import random
    r = random.Random(3)
    value = lambda: r.choice(["plain", "", 'deep 10"" tray', "two\nlines", "a,b", '\n\n""x""\n,', "1,2\n3", "é" * 9, '""', "x\n" * 40])
    rows = "".join(",".join([str(i)] + [f'"{value()}"' if r.random() < 0.5 else r.choice(["u", "", '5" tube', "v w"]) for _ in range(3)]) + "\n" for i in range(3000))
    put(f"{tmp_path}/in/a.csv", "Line,Item,Vendor,Notes\n" + rows)
    put(f"{tmp_path}/in/b.csv", "Line,Item,Vendor,Notes\n" + "".join(f"{i},x,y,z\n" for i in range(9000, 9100)))
    names = ["Line", "Item", "Vendor", "Notes"]
    want = sorted((tuple(x) for x in spark.read.schema(", ".join(f"{n} string" for n in names)).options(header=True, multiLine=True, **ex.QUOTING).csv(f"{tmp_path}/in").collect()), key=str)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        df = ex.read_csv_by_header(spark, f"{tmp_path}/in")
        assert sorted((tuple(x) for x in df.select(*names).collect()), key=str) == want
        places = [(x["line_no"], int(x["Line"])) for x in df.filter("file like '%a.csv'").collect()]
        assert [k for _, k in sorted(places)] == list(range(3000))  # line_no grows along the file
        assert ex._text_lines(spark, f"{tmp_path}/in/a.csv").rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("line,out,into", [("a,b", 0, 1), ('"a",b', 0, 1), ('a,"b', 1, 1), ('b"', 0, 0), ('b",c', 0, 0), ('5" tube,b', 0, 1), ('a,"b ""c"" d"', 0, 1), ('"",x', 0, 1), ('x",y,"z', 1, 1), ('",x', 1, 0)])
def test_quote_effect(spark, line, out, into):
    ends = {ex.KEEPS: (0, 1), ex.LEAVES_OUT: (0, 0), ex.LEAVES_IN: (1, 1), ex.SWAPS: (1, 0)}
    got = spark.createDataFrame([(line,)], "v string").select(ex.quote_effect(F.col("v"))).first()[0]
    assert ends[got] == (out, into)


def test_stream_import_accounts_for_every_line(spark, tmp_path):
    store = OrderStore(spark, f"{tmp_path}/store")
    stored = spark.createDataFrame([("9", "Item nine", "REQ-010802-002"), (None, "No number", "OLD-1")], "po_no string, item string, req_id string")
    store.write(stored)
    ckpt = f"{tmp_path}/ckpt"
    run = lambda: sj.stream_import(spark, f"{tmp_path}/in", store, AS_OF, checkpoint=ckpt)
    head = "PO #,Item,Quantity,Unit Price ($),Grant\n"
    put(f"{tmp_path}/in/a.csv", head + "9.0,Item nine,1,2,\n1,Item one,1,2,5\n1,Item one,1,3,5\n2,ab,1,1,\n3,Item three,1,0,\n4,Item four,1,1,abc\n,No number,1,1,\n,No number,1,1,\n")
    run()
    first = [("a.csv", "duplicate", "Item nine", None), ("a.csv", "duplicate", "Item one", None), ("a.csv", "imported", "Item one", "REQ-010802-001"),
             ("a.csv", "imported", "No number", "REQ-010802-003"), ("a.csv", "imported", "No number", "REQ-010802-004"), ("a.csv", "quarantined", "Item four", None),
             ("a.csv", "unnamed", "ab", None), ("a.csv", "unpriced", None, None)]
    got = sorted(((os.path.basename(r["file"]), r["disposition"], r["item"], r["req_id"]) for r in sj.import_outcomes(spark, ckpt).collect()), key=str)
    assert got == sorted(first, key=str)
    # The stored table is read only while versions of others are new; a line that another writer stores meanwhile is known to the state.
    store.append(spark.createDataFrame([("7", "Item seven", "REQ-010802-005")], "po_no string, item string, req_id string"))
    put(f"{tmp_path}/in/b.csv", head + "7,Item seven,1,1,\n1,Item one,1,2,5\n8,Item eight,1,1,\n")
    run()
    second = [("b.csv", "duplicate", "Item seven", None), ("b.csv", "duplicate", "Item one", None), ("b.csv", "imported", "Item eight", "REQ-010802-006")]
    got = sorted(((os.path.basename(r["file"]), r["disposition"], r["item"], r["req_id"]) for r in sj.import_outcomes(spark, ckpt).collect()), key=str)
    assert got == sorted(first + second, key=str) and len(got) == 11
    assert store.read().count() == 2 + 3 + 1 + 1


def test_replayed_epochs_add_nothing(spark, tmp_path, monkeypatch):
    store = OrderStore(spark, f"{tmp_path}/store")
    ckpt = f"{tmp_path}/ckpt"
    run = lambda: sj.stream_import(spark, f"{tmp_path}/in", store, AS_OF, checkpoint=ckpt)
    put(f"{tmp_path}/in/a.csv", "PO #,Item,Unit Price ($)\n1,Item one,2\n,No number,1\n,xy,1\n")
    append = OrderStore.append

    def lost(self, rows, epoch=None):  # the commit goes through, the stream dies before it learns so
        append(self, rows, epoch)
        raise OSError("lost")

    monkeypatch.setattr(OrderStore, "append", lost)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(OrderStore, "append", append)
    run()
    run()
    assert sorted(r["item"] for r in store.read().collect()) == ["Item one", "No number"]
    assert sorted(r["disposition"] for r in sj.import_outcomes(spark, ckpt).collect()) == ["imported", "imported", "unnamed"]


def test_null_items_and_blank_grants(orders_df):
    rows = [{"item": None, "vendor": "V", "qty": 100, "unit_price": 100, "date_ordered": d, "grant": g, "total": 10}
            for d, g in (("2001-01-01", ""), ("2001-02-01", None), ("2001-03-01", "G"))]
    df = orders_df(rows)
    assert fc.reorder_predictions(df, AS_OF).count() == 0 and src.vendor_ranking(df).count() == 0 and src.bulk_opportunities(df).count() == 0
    assert [r["scope"] for r in fc.demand_forecast(df).collect()] == ["all"]
    assert [r["grant"] for r in yr.yearly_projection(df).collect()] == ["G"]
    margins = {(r["year"], r["grant"], r["level"]): r["spend"] for r in yr.year_grant_margins(df).collect()}
    assert margins == {(2001, "G", 0): 10.0, (2001, None, 0): 20.0, (2001, None, 1): 30.0, (None, "G", 2): 10.0, (None, None, 2): 20.0, (None, None, 3): 30.0}
    wide = yr.year_grant_wide(df, ["G", "H"]).first()
    assert (wide["G"], wide["H"]) == (10.0, 0.0)


def test_order_entry(spark, orders_df):
    from labledger.operators import maintenance as mt
    entries = orders_df([{"item": "Gloves", "qty": 2, "unit_price": 1.255, "vendor": "V"}, {"item": " \t", "qty": 2, "unit_price": 1, "vendor": "V"},
                         {"item": "x", "qty": 0, "unit_price": 1, "vendor": "V"}, {"item": "y", "qty": 1, "unit_price": 1, "vendor": None},
                         {"item": "z", "qty": 1e30, "unit_price": 1, "vendor": "V"}])
    existing = orders_df([{"req_id": "REQ-010802-001"}])
    accepted, rejected = mt.enter_orders(entries, existing, ["item"], AS_OF)
    assert [(r["req_id"], r["item"], float(r["total"])) for r in accepted.collect()] == [("REQ-010802-002", "Gloves", 2.51)]
    assert sorted(r["reason"] for r in rejected.collect()) == ["Item name is required", "Quantity must be greater than 0", "Total is out of range", "Vendor name is required"]


def test_a_stream_has_partitions_for_its_rows_not_the_sessions(spark, tmp_path, orders_df, monkeypatch):
    store = OrderStore(spark)
    store.write(orders_df([{"po_no": "1", "item": "known thing", "lab": "L"}]))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("PO #,Item,Unit Price ($),Grant,RF Project\n1,known thing,2,5,6\n2,new thing,2,5,6\n2,new thing,3,5,6\n")
    monkeypatch.setattr(sj, "stream_partitions", lambda *_: 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sj.stream_import(spark, f"{tmp_path}/in", store, AS_OF, checkpoint=f"{tmp_path}/ckpt")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    states = [d for d in os.listdir(tmp_path / "ckpt/import_ckpt/state/0") if d.isdigit()]
    assert sorted(states) == ["0", "1", "2"] and store.read().count() == 2
    monkeypatch.undo()
    assert sj.stream_partitions(spark, store) == min(int(before), spark.sparkContext.defaultParallelism)


def test_a_small_export_is_not_cut_up_by_the_sessions_partitions(spark, monkeypatch):
    from labledger.sources import tables

    set_for = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [tables.files_for(spark, n) for n in (0, 6005, 250_000, 10**6 * set_for)] == [1, 1, 3, 10**6 * set_for // tables.ROWS_PER_TASK + (10**6 * set_for % tables.ROWS_PER_TASK > 0)]
    path = ExportFiles(spark, "/root/testdata/sf0.001").line_items
    assert len([f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]) == 1


def test_headers_are_found_without_sorting_the_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('b,c\n1,2\n3,4\n')
    (tmp_path / "b.csv").write_text('b,c\n1,"2\n3",4\n')
    (tmp_path / "c.csv").write_text("")
    heads = ex._heads(ex._text_lines(spark, str(tmp_path)))
    assert "SortAggregate" not in heads._jdf.queryExecution().toString()
    assert {r["file"][-5:]: (r["header"], r["spans"]) for r in heads.collect()} == {"a.csv": ("b,c", False), "b.csv": ("b,c", True)}
    lines = ex._text_lines(spark, str(tmp_path)).withColumn("heads", F.col("value") == "b,c")
    summary = ex._summary_heads(lines)
    assert "SortAggregate" not in summary._jdf.queryExecution().toString()
    assert {r["file"][-5:]: (r["header"], r["spans"]) for r in summary.collect()} == {"a.csv": ("b,c", False), "b.csv": ("b,c", True)}
