"""The registered queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labledger.llm import bpe, divergence, embed_dedup, exact_dedup, line_dedup, merkle, mixing, quality, setsketch, substring, token_count, urlfilter, warc

#: The vocabulary files.
WORD_BPE, BYTE_BPE = (str(public_tokenizers.path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.93 within a label."""
    return embed_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; host and path are source and language."""
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over 3-word shingles at 85 %."""
    return setsketch.minhash_components(table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words removed from all documents."""
    cut = substring.remove_repeated_windows(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and the sample of all documents for tempered source, language and topic shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.topic().alias("topic"), mixing.word_count().alias("n_tokens"))
    return mixing.mix_sources(docs, ["source", "lang", "topic"])


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the word-end BPE file."""
    both = bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE, keep=["doc_id"], outputs=("n_tokens", "ids_bytes", "decoded"))
    return both.select("doc_id", "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    c = warc.warc_roundtrip(table(spark, sf_dir, "pages"))
    revisit = F.col("capture.type") == "revisit"
    return c.select(F.col("metadata.fields").getItem("id").cast("bigint").alias("page_id"),
                    F.when(revisit, F.col("referred.payload_bytes")).otherwise(F.col("capture.payload_bytes")).alias("payload_bytes"),
                    F.when(revisit, F.col("capture.digest")).otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
                    F.col("capture.type").alias("record_type"), F.col("referred.id").cast("bigint").alias("refers_to"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' URLs judged by the rules and the character models."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the byte-level BPE file."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal without white space."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle trees over all documents, one per language; every third id is checked against a text without capitals."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), tamper={"text": lower}, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in the terms of all documents."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points that five documents hold, dropped from all documents but one."""
    cut = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_quality_classifier, op3_minhash_dedup, op4_substring_dedup, op5_mixing, op6_bpe_roundtrip,
                                   op7_warc_roundtrip, op8_url_filter, op9_token_counts, op10_exact_dedup, op11_merkle_manifest, op12_source_divergence, op13_line_dedup)}

#: H of a document's fields, ``{text}`` being its text.
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

SQL = {
    "op11_merkle_manifest": rf"""
        WITH RECURSIVE crc AS (
            SELECT doc_id, xor(list_reduce([4294967295::BIGINT] || list_transform(split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda x, _: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc FROM documents),
        leaves AS (
            SELECT doc_id, lang, {_LEAF.format(text="text")} AS leaf,
                   CASE WHEN crc % 3 = 0 THEN {_LEAF.format(text=f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")}
                   ELSE leaf END AS given, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS total
            FROM documents JOIN crc USING (doc_id)),
        nodes AS (
            SELECT lang, 0 AS level, idx, total, leaf AS digest FROM leaves
            UNION ALL
            SELECT lang, level + 1, idx >> 3, (total + 7) >> 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE total > 1 GROUP BY lang, level, total, idx >> 3),
        subroots AS (
            SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS total FROM nodes WHERE total = 1),
        tops AS (
            SELECT 0 AS level, idx, total, subroot AS digest FROM subroots
            UNION ALL
            SELECT level + 1, idx >> 3, (total + 7) >> 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE total > 1 GROUP BY level, total, idx >> 3),
        own AS (SELECT l.*, s.subroot, s.height, s.idx AS place FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang),
        levels AS (SELECT DISTINCT lang, level FROM nodes WHERE total > 1),
        siblings AS (
            SELECT doc_id, o.level AS step, n.idx, n.idx - o.me AS side, n.digest
            FROM (SELECT doc_id, own.lang, level, own.idx >> (3 * level) AS me FROM own JOIN levels ON own.lang IS NOT DISTINCT FROM levels.lang) o
            JOIN nodes n ON n.lang IS NOT DISTINCT FROM o.lang AND n.level = o.level AND n.idx >> 3 = o.me >> 3
            UNION ALL
            SELECT doc_id, own.height + n.level, n.idx, n.idx - (own.place >> (3 * n.level)), n.digest
            FROM own JOIN tops n ON n.total > 1 AND n.idx >> 3 = own.place >> (3 * n.level + 3)),
        steps AS (
            SELECT doc_id, step, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (side < 0), '') AS lefts,
                   coalesce(string_agg(digest, '' ORDER BY idx) FILTER (side > 0), '') AS rights FROM siblings GROUP BY doc_id, step),
        folds AS (
            SELECT doc_id, 0 AS step, given AS digest FROM own
            UNION ALL
            SELECT doc_id, step + 1, sha256(lefts || digest || rights) FROM folds JOIN steps USING (doc_id, step)),
        proofs AS (SELECT doc_id, string_agg(lefts || rights, '' ORDER BY step) AS proof FROM steps GROUP BY doc_id),
        folded AS (SELECT doc_id, arg_max(digest, step) AS folded_root FROM folds GROUP BY doc_id),
        root AS (SELECT digest AS root FROM tops WHERE total = 1)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM own JOIN folded USING (doc_id) LEFT JOIN proofs USING (doc_id) CROSS JOIN root""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
             h AS (SELECT doc_id, points, bare, sha256(bare) AS text_sha256 FROM d),
             k AS (SELECT bare, arg_min(doc_id, (-points, doc_id)) AS keep_id, count(*) AS group_size FROM h GROUP BY bare)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN k USING (bare)""",
    "op12_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d),
        t AS (SELECT doc, lang, source, translate(word, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS term FROM w),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
        cells AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, kept.n AS lang_n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
        sums AS (SELECT lang, source, sum(n) AS total, sum(lang_n) AS lang_total, count(*) AS terms FROM cells GROUP BY lang, source),
        shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * terms) AS p,
                          1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * terms) AS q FROM cells JOIN sums USING (lang, source)),
        far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10""",
    "op13_line_dedup": rf"""
        WITH lines AS (
            SELECT doc_id, unnest(split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM lines),
        common AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        judged AS (SELECT k.*, coalesce(owner <> doc_id, false) AS gone FROM keyed k LEFT JOIN common USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id""",
    "op7_warc_roundtrip": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             q AS (SELECT page_id, body, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
             m AS (SELECT body, max(page_id) AS top FROM q WHERE payload_bytes >= 1000 GROUP BY body)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NULL OR top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to FROM q LEFT JOIN m USING (body)""",
}
