"""Divergence of sources by their terms, found by iceberg prefix refinement (operator 12)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from labledger.llm.common import SALTS, ready, written
from labledger.llm.hashing import string_column
from labledger.llm.setsketch import slices

MIN_DOCS, TOP = 10, 10
SCALE = 10 ** 9
SLICE = 8 << 20          # bytes of text handled at once
BLOCK_SOURCES = 64       # sources in one side of a tile
TILE_ROWS = 1 << 17      # counts in a bucket of terms, about
BUCKET_BYTES = 8 << 20   # of text for each bucket of terms, about
SHARES = 32              # buckets that share the terms of one prefix
CELLS = 1 << 20          # numbers that a tile compares at once

#: Bytes of a term: those of letters A-Z and a-z and of characters beyond ASCII.
INSIDE = np.zeros(256, dtype=bool)
INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

COUNTS = "level int, lang string, source string, term binary, docs bigint, n bigint"
CELLS_OF = "lang string, source string, term binary, n bigint, lang_n bigint, first int"
PAIRS = "lang string, source string, item string, value bigint, seen bigint"


def term_column(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a string column, A-Z lower-cased, and the number of terms of each text."""
    column = string_column(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    inside = INSIDE[data]
    edge = np.ones(len(data) + 1, dtype=bool)  # edge[i]: no term goes on from byte i - 1 to byte i
    edge[1:-1] = ~inside[:-1]
    edge[offsets - offsets[0]] = True
    starts = np.flatnonzero(inside & edge[:-1])
    edge[:-1] |= ~inside  # now: no term goes on to byte i
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(inside & edge[1:]) + 1 - starts)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[data[inside]])])
    return terms, np.diff(np.searchsorted(starts, offsets - offsets[0]))


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return keys[order][at], np.diff(np.append(at, len(keys))), np.add.reduceat(weights[order], at) if len(at) else weights[:0]


def longest_stem(size: int) -> int:
    """Bytes of the longest counted prefix of a term of ``size`` bytes: a power of two."""
    return 1 << size.bit_length() - 1


def _home(term: bytes, buckets: int, shares: int) -> int:
    """The bucket of a term: one of the ``shares`` buckets of its longest prefix, so that no prefix has to fit one bucket."""
    return zlib.crc32(term[:longest_stem(len(term))]) % (buckets // shares) * shares + zlib.crc32(term) % shares


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _counts(buckets: int, shares: int):
    """Partial counts of slices of documents: the groups (level 0), term prefixes of w = 1, 2, 4, ... bytes by documents of a
    language (level w), and the terms by group, packed in one row for each bucket (level -1, the bucket in ``n``)."""
    schema = pa.schema([("level", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("n", pa.int64())])

    def rows(count: int, level: int, lang=None, source=None, term=None, docs=None, n=None) -> pa.RecordBatch:
        given = [np.full(count, level), lang, source, term, docs, n]
        return pa.RecordBatch.from_arrays([pa.nulls(count, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(given, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = string_column(batch["text"])
            for a, b in slices(text, SLICE):
                names: dict[tuple[str, str], int] = {}
                codes = np.array([names.setdefault(key, len(names)) for key in zip(*(batch[c].slice(a, b - a).to_pylist() for c in ("lang", "source")))])
                lang, source = (pa.array(x, pa.string()) for x in zip(*names))
                yield rows(len(names), 0, lang, source)
                langs = lang.dictionary_encode()
                lang_of = langs.indices.to_numpy()
                terms, counts = term_column(text.slice(a, b - a))
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                words, width, many = coded.dictionary, len(coded.dictionary), len(names)
                doc_term, times = np.unique(np.repeat(np.arange(b - a), counts) * width + coded.indices.to_numpy(), return_counts=True)
                doc, term = doc_term // width, doc_term % width
                home = np.array([_home(x, buckets, shares) for x in words.to_pylist()])
                key, docs, n = _sums((home[term] * width + term) * many + codes[doc], times)  # by bucket, term and group
                group, term_of = pa.array(key % many), key // many % width
                cut = np.searchsorted(key, np.arange(buckets + 1) * (width * many))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    p = slice(cut[k], cut[k + 1])
                    own, index = np.unique(term_of[p], return_inverse=True)
                    block = pa.table({"lang": lang.take(group[p]).dictionary_encode(), "source": source.take(group[p]).dictionary_encode(),
                                      "term": pa.DictionaryArray.from_arrays(pa.array(index, pa.int32()), words.take(pa.array(own))), "docs": docs[p], "n": n[p]})
                    yield rows(1, -1, term=[_packed(block)], n=[k])
                size, w = pc.binary_length(words).to_numpy(zero_copy_only=False), 1
                while (long := size >= w).any():
                    prefix = pc.binary_slice(words.filter(pa.array(long)), 0, w).dictionary_encode()
                    of, some = np.full(width, -1), len(prefix.dictionary)
                    of[long] = prefix.indices.to_numpy()
                    held = of[term] >= 0
                    pair = np.unique(doc[held] * some + of[term[held]])
                    key, docs = np.unique(lang_of[codes[pair // some]] * some + pair % some, return_counts=True)
                    yield rows(len(key), w, langs.dictionary.take(pa.array(key // some)), None, prefix.dictionary.take(pa.array(key % some)), docs)
                    w *= 2
    return run


def _cells(min_docs: int):
    """A bucket's terms that enough documents hold, counted by group. Terms whose longest prefix was dropped aren't looked at."""
    def run(blocks: pa.Table, stems: pa.Table) -> pa.Table:
        held = [pa.ipc.open_stream(x.as_py()).read_all() for x in blocks["term"]]
        if not held or not stems.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("lang_n", pa.int64()), ("first", pa.int32()))})
        t = pa.concat_tables(held).unify_dictionaries().combine_chunks()
        (lang, langs), (source, sources), (term, terms) = ((x.indices.to_numpy().astype(np.int64), x.dictionary) for x in (t[c].combine_chunks() for c in ("lang", "source", "term")))
        kept = set(zip(stems["lang"].to_pylist(), stems["stem"].to_pylist()))
        name, at = np.unique(lang * len(terms) + term, return_inverse=True)
        name_lang, name_term = name // len(terms), name % len(terms)
        alive = np.array([(x, y[:longest_stem(len(y))]) in kept for x, y in zip(langs.take(pa.array(name_lang)).to_pylist(), terms.take(pa.array(name_term)).to_pylist())])
        docs, total = np.zeros(len(name), dtype=np.int64), np.zeros(len(name), dtype=np.int64)
        np.add.at(docs, at, t["docs"].to_numpy())
        np.add.at(total, at, t["n"].to_numpy())
        alive &= docs >= min_docs
        rows = alive[at]
        key, _, n = _sums(at[rows] * len(sources) + source[rows], t["n"].to_numpy()[rows])
        at = key // len(sources)
        return pa.table({"lang": langs.take(pa.array(name_lang[at])), "source": sources.take(pa.array(key % len(sources))), "term": terms.take(pa.array(name_term[at])),
                         "n": n, "lang_n": total[at], "first": pa.array(np.diff(at, prepend=-1) > 0).cast(pa.int32())})
    return run


def frequent_prefixes(counts: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, level, stem)``: the prefixes that ``min_docs`` documents of the language hold, level by level.

    A prefix is counted only if the one of half its length was kept; the refinement ends when no prefix is left.
    """
    kept, w = [], 1
    while True:
        rows = counts.filter(F.col("level") == w)
        if kept:
            rows = rows.withColumn("stem", F.substring("term", 1, w // 2)).join(kept[-1].select("lang", "stem"), ["lang", "stem"], "left_semi")
        kept.append(written(rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
                            .select("lang", F.lit(w).alias("level"), F.col("term").alias("stem"))))
        if kept[-1].isEmpty():
            return reduce(DataFrame.unionByName, kept)
        w *= 2


def frequent_terms(counts: DataFrame, min_docs: int, buckets: int, shares: int) -> DataFrame:
    """Counts ``(lang, source, term, n, lang_n, first)`` of the terms that ``min_docs`` documents hold; ``first`` is 1 once a term and language."""
    home = F.pmod(F.crc32("stem"), F.lit(buckets // shares)) * shares
    stems = (frequent_prefixes(counts, min_docs).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
             .select("lang", "stem", (home + F.col("share")).cast("bigint").alias("n")))
    return written(counts.filter("level = -1").select("n", "term").groupBy("n").cogroup(stems.groupBy("n")).applyInArrow(_cells(min_docs), CELLS_OF))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly; 1 where there are no terms."""
    return F.expr(f"CASE WHEN {terms} = 0 THEN 1L ELSE 1 + (cast({n} as decimal(20,0)) + 2) * {SCALE} div ({total} + 2 * {terms}) END")


def _tile(t: pa.Table) -> pa.Table:
    """Sums over a bucket's terms of the divergence of each source of one block from each of another (or of the same)."""
    names, at = np.unique(np.array(t["source"].to_pylist(), dtype=object), return_inverse=True)
    p, real = t["p"].to_numpy(), np.array(t["term"].is_valid())
    left = np.zeros(len(names), dtype=bool)
    left[at] = t["mine"].to_numpy() == t["i"].to_numpy()
    same = t["i"][0].as_py() == t["j"][0].as_py()
    rest = np.zeros(len(names), dtype=np.int64)
    rest[at[~real]] = p[~real]  # the share of a term that a source lacks
    terms = t["term"].combine_chunks().filter(pa.array(real)).dictionary_encode()
    row, n = terms.indices.to_numpy(), len(terms.dictionary)
    order = np.argsort(row, kind="stable")
    row, column, value = row[order], at[real][order], p[real][order]
    total = np.zeros((len(names), len(names)), dtype=np.int64)
    step = max(1, CELLS // len(names))
    for lo in range(0, n, step):
        cut = slice(*np.searchsorted(row, (lo, lo + step)))
        m = np.tile(rest, (min(step, n - lo), 1))
        m[row[cut] - lo, column[cut]] = value[cut]
        for k in np.flatnonzero(left):
            d = m - m[:, [k]]
            total[k] += (d * d // (m + m[:, [k]])).sum(axis=0)
    a, b = np.nonzero(np.triu(np.ones_like(total, dtype=bool), 1) if same else left[:, None] & ~left[None, :])
    return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(a), pa.string()), "source": pa.array(names[a], pa.string()), "item": pa.array(names[b], pa.string()),
                     "value": total[a, b], "seen": np.full(len(a), n)})


def pair_divergence(counts: DataFrame, groups: DataFrame, block_sources: int = BLOCK_SOURCES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language, over its kept terms.

    Terms are dealt into buckets and sources into blocks; a bucket and two blocks meet in one tile. Terms that no source of
    a tile has need no row: they are counted and enter with the shares of absent terms.
    """
    sizes = (groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block_sources).alias("blocks"))
             .join(counts.groupBy("lang").agg((F.count(F.lit(1)) / tile_rows).alias("load")), "lang", "left")
             .select("lang", "blocks", F.coalesce(F.ceil("load"), F.lit(1)).alias("buckets")))
    sizes = written(sizes)
    every = (groups.select("lang", "source", F.lit(None).cast("binary").alias("term"), F.col("rest").alias("p")).join(sizes, "lang")
             .withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1))))
    rows = (counts.select("lang", "source", "term", "p").join(sizes, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets"))).unionByName(every)
            .withColumn("mine", F.pmod(F.xxhash64("source"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
            .select("lang", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "source", "term", "p"))
    sums = (rows.groupBy("lang", "bucket", "i", "j").applyInArrow(_tile, PAIRS).groupBy("lang", "source", "item")
            .agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    one, two = groups.select("lang", "source", "terms", F.col("rest").alias("p")), groups.select("lang", F.col("source").alias("item"), F.col("rest").alias("q"))
    whole = written(sums.join(one, ["lang", "source"]).join(two, ["lang", "item"])
                    .select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.expr("(p - q) * (p - q) div (p + q)")).alias("value")))
    return whole.unionByName(whole.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP,
                      block_sources: int = BLOCK_SOURCES, tile_rows: int = TILE_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """How the sources of each language differ in their terms: rows ``(lang, source, part, item, value, rank)``.

    Null text, language and source are read as ''. Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z
    lower-cased. A language keeps the terms that at least ``min_docs`` of its rows hold (a repeated row counts again, a term that repeats in a
    row doesn't). Every (lang, source) that occurs, and each language, gives a kept term the share
    p = 1 + floor(10^9 (count + 2) / (total + 2 V)), where V terms are kept and ``total`` counts their occurrences there. Two shares differ by
    floor((p - q)^2 / (p + q)). All sums are exact.
    - part ``pair``: item is each other source of the language, value the sum over all kept terms (0 without any).
    - part ``term``: item is each kept term that occurs in the group and has a larger share there than in the language;
      only the ``top`` largest values.
    ``rank`` counts from 1 in each group and part, by value descending, then item ascending by bytes. A group without such terms has no
    ``term`` rows, a language of one source no ``pair`` rows; an empty table gives none. Other columns take no part.

    One pass over the texts counts terms and their prefixes of 1, 2, 4, ... bytes per slice of rows, by documents. The prefixes
    are then summed level by level: one is counted only if the prefix of half its length was kept. Last, complete terms are
    summed in buckets, to which slices send them packed; only those whose longest prefix was kept are looked at. A term's
    documents never outnumber its prefix's, so none is lost.
    """
    ready(df.sparkSession)
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shares = min(SHARES, max(1, size // bucket_bytes))
    buckets = max(1, size // bucket_bytes // shares) * shares
    counts = written(rows.mapInArrow(_counts(buckets, shares), COUNTS))
    cells = frequent_terms(counts, min_docs, buckets, shares)
    langs = cells.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("bigint")
    groups = (counts.filter("level = 0").select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("terms", "total", "lang_total")]))
    groups = written(groups.withColumn("rest", share("0", "total", "terms")))
    shares = cells.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"))
    shares = written(shares)
    value = F.expr("(p - q) * (p - q) div (p + q)")
    best = shares.filter("p > q").select("lang", "source", F.decode("term", "UTF-8").alias("item"), value.alias("value"))
    by_value = [F.desc("value"), F.asc("item")]
    first = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(*by_value)
    ranked = Window.partitionBy("lang", "source").orderBy(*by_value)
    terms = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    pairs = pair_divergence(shares, groups, block_sources, tile_rows).withColumn("rank", F.row_number().over(ranked))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
