import gzip
import hashlib

import duckdb
import pytest

from labledger.llm import warc
from labledger.llm.queries import QUERIES, SQL, op7_warc_roundtrip
from llm_fixtures import by, make  # noqa: F401

SCHEMA = "page_id bigint, url string, html string, type string"


def pages():
    big, other = "é" * 500 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "b" * 1000
    return [(1, "http://a.b/x?y#z", big), (2, "http://a.b/", big), (9, None, big), (3, "u", other), (4, "u", other[:-1]), (5, "u", other[:-1]), (6, "u", None), (7, "", ""),
            (8, "http://a.b\r\nX: y/", "\r\n\r\n"), (10, "http://é/ü", "x" * 300_000), (11, "u", "\r\n"), (12, "u", "WARC/1.1\r\n\r\n")]


def expected(rows):
    out = {}
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, k in rows if (k or "").encode() == body]
        top = max(same) if len(body) >= 1000 else i
        out[i] = (len(body), hashlib.sha1(body).hexdigest(), "response" if top == i else "revisit", None if top == i else top)
    return out


def test_round_trip(make, by, spark, tmp_path):
    rows = pages()
    make(SCHEMA, [(*r, "x") for r in rows], parts=4).write.parquet(str(tmp_path / "pages.parquet"))
    got = by(op7_warc_roundtrip(spark, str(tmp_path)), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == expected(rows)


def test_payloads_urls_and_nesting(make, spark):
    rows = pages()
    c = warc.warc_roundtrip(make(SCHEMA, [(*r, None) for r in rows]), with_payload=True, captures_per_file=2)
    got = {int(r.metadata.fields["id"]): r for r in c.collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        r = got[i]
        assert r.capture.uri == (url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None) or url == ""
        assert r.request.type == "request" and r.request.concurrent_to == r.capture.id == r.capture_id == r.metadata.concurrent_to
        if r.capture.type == "response":
            assert bytes(r.capture.payload) == (html or "").encode() and r.capture.digest == r.capture.payload_digest and r.referred is None
        else:
            assert r.capture.payload is None and got[int(r.referred.id)].capture.payload_digest == r.capture.digest
    assert got[1].request.http.startswith("GET /x?y HTTP/1.1")


def test_ties_nulls_and_empty(make, spark, tmp_path):
    big = "q" * 2000
    rows = [(None, "u", big, None), (5, "u", big, None), (5, "v", big, None), (6, "w", "small", None), (6, "w", "small", None)]
    make(SCHEMA, rows).write.parquet(str(tmp_path / "pages.parquet"))
    out = [tuple(r) for r in op7_warc_roundtrip(spark, str(tmp_path)).collect()]
    got = sorted(((r[0], r[3], r[4]) for r in out), key=str)
    assert got == sorted([(None, "revisit", 5), (5, "response", None), (5, "response", None), (6, "response", None), (6, "response", None)], key=str)
    want = duckdb.sql(SQL["op7_warc_roundtrip"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(out, key=str) == sorted(want, key=str)
    make(SCHEMA, [(None, u, big, None) for u in "ab"]).write.parquet(str(tmp_path / "nulls" / "pages.parquet"))
    assert [(r.record_type, r.refers_to) for r in op7_warc_roundtrip(spark, str(tmp_path / "nulls")).collect()] == [("response", None)] * 2
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert op7_warc_roundtrip(spark, str(tmp_path / "none")).count() == 0


def test_repeated_rows_all_come_back(make, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 3)
    big = "q" * 2000
    rows = [(4, "u", big, None)] * 2 + [(5, "u", big, None)] * 8 + [(6, "w", "small", None)] * 7 + [(7, None, None, None)] * 2 + [(8, "w", "one", None)]
    make(SCHEMA, rows, parts=3).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in op7_warc_roundtrip(spark, str(tmp_path)).collect()]
    want = duckdb.sql(SQL["op7_warc_roundtrip"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(want, key=str)


def record(kind, ident, body=b"", **more):
    heads = {"WARC-Type": kind, "WARC-Record-ID": ident, **more, "Content-Length": len(body)}
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in heads.items()) + b"\r\n" + body + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = {"Content-Type": "application/http; msgtype=response"}
    to = {"WARC-Concurrent-To": "<c1>"}
    parts = [record("warcinfo", "<w>", b"software: x\r\n", **{"Content-Type": "application/warc-fields"}), record("request", "<r2>", b"GET / HTTP/1.1\r\n\r\n", **to),
             record("request", "<r1>", b"GET / HTTP/1.1\r\n\r\n", **to), record("metadata", "<m>", b"id: 4\r\n", **to, **{"Content-Type": "application/warc-fields"}),
             record("response", "<c1>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", **http), record("revisit", "<c2>", b"", **{"WARC-Refers-To": "<gone>"}),
             record("resource", "<c3>", b"\x00\xff raw"), record("request", "<r9>", b"", **{"WARC-Concurrent-To": "<nowhere>"})]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:5]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(parts[5:]))
    got = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<c1>", "<c2>", "<c3>"}
    assert got["<c1>"].request.id == "<r1>" and got["<c1>"].metadata.fields == {"id": "4"} and bytes(got["<c1>"].capture.payload) == b"body"
    assert got["<c2>"].request is None and got["<c2>"].referred is None and bytes(got["<c3>"].capture.payload) == b"\x00\xff raw"


@pytest.mark.parametrize("data", [record("response", "<x>", b"abc")[:-6], b"WARC/1.0\r\nContent-Le", b"nonsense\r\nContent-Length: 0\r\n\r\n"])
def test_broken_archives_are_errors(data):
    with pytest.raises(ValueError):
        list(warc.parse(data, True))
