"""WARC archives: writing, reading and transaction assembly (operator 7)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labledger.llm.common import ready, written
from labledger.session import scratch_path

CAPTURES_PER_FILE = 1000
COPIES = 1000         # equal captures dealt out at once
REVISIT_BYTES = 1000  # smallest payload that is worth a revisit record
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORD = ("id string, type string, uri string, date string, concurrent_to string, refers_to string, digest string, "
          "http string, fields map<string,string>, payload binary, payload_bytes bigint, payload_digest string")


def _urn(kind: str, key: Column) -> Column:
    """A record id made from the capture's key."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat(F.lit(kind), key)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without the two line ends that close it; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"\r\n{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in headers]
    return F.concat(F.lit("WARC/1.1"), *[F.coalesce(x, F.lit("")) for x in lines],
                    F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   revisit_bytes: int = REVISIT_BYTES, captures_per_file: int = CAPTURES_PER_FILE, date: str = DATE) -> None:
    """Write each row as a capture of three records (request, response or revisit, metadata) into gzip archives at ``path``.

    Of the rows whose payloads (text in UTF-8, null: empty) are equal and have at least ``revisit_bytes`` bytes, the one
    with the largest id (a null id is smaller than any other) is the response and the others revisit it; several rows of that id
    are all responses, as no page revisits itself, and the revisits name the one with the largest record key. A revisit record
    names the response and the digest and holds no payload. Request and metadata name their capture as concurrent; the metadata hold the id. Line ends in URLs
    are percent-encoded, a null URL or id has no header or field. Rows equal in id, URL and payload get equal record ids.

    Only digests are grouped and shuffled to find the responses (pre-aggregated, so a payload may be any share of the rows);
    Spark's text writer makes the files, so they may lie in any file system it knows.
    """
    ready(df.sparkSession)
    url = F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = (df.select(F.col(id_col).cast("bigint").alias("id"), url.alias("url"), html.alias("html"))
            .withColumns({"digest": F.sha1("html"), "size": F.octet_length("html")})
            .withColumn("key", F.sha1(F.concat_ws("\x00", F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("url", F.lit("\x01")), "digest"))))
    names = rows.filter(F.col("size") >= revisit_bytes).select("key", "id", "digest", "size")
    firsts = (names.groupBy("digest", "size").agg(F.max(F.struct("id", "key")).alias("top"), F.count(F.lit(1)).alias("c"))
              .filter("c > 1").select("digest", "size", F.col("top.id").alias("top_id"), F.col("top.key").alias("top_key")))
    revisits = written(names.join(written(firsts), ["digest", "size"]).filter("not (id <=> top_id)").select("key", "top_key").distinct())
    c = rows.join(revisits, "key", "left")
    host = F.regexp_extract("url", r"^[^:/?#]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    me, again = _urn("capture", F.col("key")), F.col("top_key").isNotNull()
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", F.col("key"))), *common, ("WARC-Concurrent-To", me),
                       ("Content-Type", "application/http; msgtype=request")],
                      F.concat(F.lit("GET "), F.when(F.coalesce(target, F.lit("")) == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END)))
    capture = _record([("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", me), *common,
                       ("WARC-Profile", F.when(again, PROFILE)), ("WARC-Refers-To", F.when(again, _urn("capture", F.col("top_key")))),
                       ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", "application/http; msgtype=response")],
                      F.when(again, http).otherwise(F.concat(http, F.col("html"))))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", F.col("key"))), *common, ("WARC-Concurrent-To", me),
                        ("Content-Type", "application/warc-fields")],
                       F.coalesce(F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("")))
    (c.select(F.explode(F.array(request, capture, metadata)).alias("value")).write
     .option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_per_file).text(path))


class _Stream:
    """Bytes of an archive, inflated as they are asked for; gzip members may follow each other."""

    def __init__(self, data: bytes):
        self.zipped, self.plain, self.inflate, self.at = data[:2] == b"\x1f\x8b", memoryview(data), zlib.decompressobj(31), 0
        self.buffer = bytearray()

    def fill(self, size: int) -> bool:
        while len(self.buffer) < size and self.at < len(self.plain):
            part = self.plain[self.at:self.at + (1 << 18)]
            self.at += len(part)
            while self.zipped and len(part):
                self.buffer += self.inflate.decompress(part)
                part = self.inflate.unused_data
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
            if not self.zipped:
                self.buffer += part
        return len(self.buffer) >= size

    def take(self, size: int) -> bytes:
        if not self.fill(size):
            raise ValueError("the archive ends within a record")
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out

    def headers(self) -> bytes | None:
        """Up to the empty line; None at the end of the archive. Line ends between records are skipped."""
        while True:
            if not self.fill(2):
                if bytes(self.buffer).strip():
                    raise ValueError("the archive ends within a record")
                return None
            if self.buffer[:2] != b"\r\n":
                break
            del self.buffer[:2]
        seen = 0
        while (end := self.buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buffer)
            if not self.fill(seen + 1):
                raise ValueError("the archive ends within a header")
        return self.take(end + 4)[:-4]


def _parsed(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """Rows of RECORD for the records of one archive. Lengths come from the headers, so payloads may hold anything."""
    stream = _Stream(data)
    while (head := stream.headers()) is not None:
        version, h = _parsed(head)
        if not version.startswith("WARC/"):
            raise ValueError("a record doesn't begin with its version")
        block = stream.take(int(h["content-length"]))
        kind, http, payload, fields = h.get("warc-type"), None, None, None
        if h.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
        elif h.get("content-type", "").startswith("application/warc-fields"):
            fields = list(_parsed(b"\r\n" + block)[1].items())
            fields = [(k, v) for k, v in fields if k]
        else:
            payload = block
        full = kind == "response" or kind == "resource"
        digest = h.get("warc-payload-digest", "")
        yield (h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"),
               digest.removeprefix("sha1:") or None, http, fields, payload if full and with_payload else None,
               len(payload) if full else None, hashlib.sha1(payload).hexdigest() if full else None)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives at ``path``: id, type, target, date, links, HTTP head, fields, payload and its digest.

    Files are read whole by Spark's binary reader, one after the other, and inflated piece by piece; a broken archive is an
    error. Without ``with_payload``, payloads are only measured and digested."""
    ready(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.string()] * 8 + [pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for r in parse(content.as_py(), with_payload):
                    rows.append(r)
                    size += len(r[9] or b"") + 500
                    if size > 4 << 20:
                        yield make(rows)
                        rows, size = [], 0
                if rows:
                    yield make(rows)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture record: ``(capture_id, capture, request, metadata, referred)``.

    A request or metadata record belongs to the capture (response, revisit or resource) that its concurrent-to names.
    All records meet their capture in one shuffle by that id; of several of a kind, the one with the smallest record
    id is taken, and records whose capture is missing make no row. n captures of one record id (``write_archives`` gives
    one to rows equal in id, URL and payload) make n equal rows, dealt out in runs of COPIES. ``referred``: id, size and digest of the response that a revisit refers
    to, null if it's missing. One response may be referred to by any share of the captures (an equi-join that adaptive
    execution splits); only its id, size and digest take part.
    """
    body = F.struct(*[c for c in records.columns])
    kind = F.col("type")
    is_capture = kind.isin("response", "revisit", "resource")
    whole = (records.withColumn("to", F.when(is_capture, F.col("id")).otherwise(F.col("concurrent_to"))).filter("to is not null")
             .groupBy(F.col("to").alias("capture_id"))
             .agg(F.min_by(body, F.when(is_capture, F.col("id"))).alias("capture"),
                  F.min_by(body, F.when(kind == "request", F.col("id"))).alias("request"),
                  F.min_by(body, F.when(kind == "metadata", F.col("id"))).alias("metadata"),
                  F.count(F.when(is_capture, F.lit(1))).alias("copies")).filter("capture is not null"))
    whole = written(whole)
    owned = whole.filter("capture.payload_digest is not null").select(F.struct("capture_id", F.col("capture.payload_bytes").alias("payload_bytes"),
                         F.col("capture.payload_digest").alias("payload_digest"), F.col("metadata.fields").getItem("id").alias("id")).alias("referred"))
    runs = (whole.filter("copies > 1").withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
            .repartition("capture_id", "run").withColumn("one", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(COPIES), F.col("copies") - F.col("run"))))))
    every = whole.filter("copies = 1").unionByName(runs.drop("run", "one")).drop("copies")
    return every.join(owned, F.col("capture.refers_to") == F.col("referred.capture_id"), "left")


def warc_roundtrip(df: DataFrame, id_col: str = "page_id", with_payload: bool = False, **options) -> DataFrame:
    """Write ``df`` to archives in the shared folder, read them back and assemble the captures."""
    spark = ready(df.sparkSession)
    path = scratch_path(spark, "warc")
    write_archives(df, path, id_col=id_col, **options)
    return assemble(read_records(spark, path, with_payload))
