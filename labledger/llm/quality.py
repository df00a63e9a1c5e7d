"""Hierarchical empirical-Bayes quality classifier (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labledger.llm.common import ready, written
from labledger.llm.hashing import split_words, string_column, word_hashes
from labledger.llm.setsketch import slices

FEATURES = ["log_words", "distinct_share", "repeat_share", "top_share", "mean_length", "upper_share", "symbol_share",
            "digit_share", "bar_share", "punctuated_share", "long_share", "line_words", "repeated_line_share"]
PRIOR_WORDS = 8.0       # words of a text that weigh as much as the share of good labels
LABELLED_ROWS = 20_000  # largest number of labelled rows that the classifier is fitted on
SMALLEST_CONCENTRATION, LARGEST_CONCENTRATION = 1.0, 1e4
_UPPER, _DIGIT, _SYMBOL = (np.zeros(256) for _ in range(3))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[ord(c) for c in "!#$%&*+/<=>@\\^_`{}~"]] = 1
_END = np.zeros(256)
_END[[ord(c) for c in ".,;:?"]] = 1


def text_features(column: pa.Array) -> np.ndarray:
    """The features of each whole text (rows) as float64; all zero for texts without words."""
    w = split_words(column)
    n = len(w.counts)
    out = np.zeros((n, len(FEATURES)))
    if not len(w.starts):
        return out
    (h,) = word_hashes(w, lower=True)
    owner = np.repeat(np.arange(n), w.counts)
    words = np.maximum(w.counts, 1).astype(float)
    size = w.ends - w.starts
    per_doc = lambda x, at=owner: np.bincount(at, x, n)
    order = np.lexsort((h, owner))
    a, b = owner[order], h[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(a)))
    top = np.zeros(n)
    np.maximum.at(top, a[first], times)
    again = np.append(False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
    sums = lambda table: np.diff(np.concatenate([[0.0], np.cumsum(table[w.data])])[np.stack([w.starts, w.ends])], axis=0)[0]
    letters = np.maximum(per_doc(size), 1)
    # A line ends where a newline stands before a word; it counts as repeated if the text holds the same words in one twice.
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    new_line = np.append(True, (breaks[w.starts[1:]] > breaks[w.ends[:-1]]) | (owner[1:] != owner[:-1]))
    at = np.flatnonzero(new_line)
    line_owner, line_words = owner[at], np.diff(np.append(at, len(owner)))
    place = np.arange(len(h)) - np.repeat(at, line_words)
    line = np.add.reduceat(h * (2 * place.astype(np.uint64) + np.uint64(1)), at)
    order = np.lexsort((line, line_owner))
    p, q = line_owner[order], line[order]
    repeated = np.append(False, (p[1:] == p[:-1]) & (q[1:] == q[:-1]))
    lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    for k, x in enumerate([
            np.log1p(w.counts), per_doc(new.astype(float), a) / words, per_doc(again) / words, top / words, letters / words,
            per_doc(sums(_UPPER)) / letters, per_doc(sums(_SYMBOL)) / letters, per_doc(sums(_DIGIT)) / letters,
            per_doc((w.data[w.starts] == ord("|")) & (size == 1)) / words, per_doc(_END[w.data[w.ends - 1]]) / words,
            per_doc(size > 24) / words, np.log1p(w.counts / lines), np.bincount(p, repeated, n) / lines]):
        out[:, k] = np.where(w.counts > 0, x, 0.0)
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = string_column(batch["text"])
        for a, b in slices(text):
            x = text_features(text.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in ("id", "host", "path")),
                                              *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["id", "host", "path", *FEATURES])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: coefficients (the constant first), means and scales of the features.
    The second half of the coefficients belongs to the squares of the standardised features."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.column_stack([np.ones(len(z)), z, z ** 2])
    beta = np.zeros(z.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta, mean, scale


def _evidence(beta: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Column:
    out = F.lit(float(beta[0]))
    k = len(FEATURES)
    for i, name in enumerate(FEATURES):
        z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(name) - F.lit(float(mean[i]))) / F.lit(float(scale[i]))))
        out = out + z * F.lit(float(beta[1 + i])) + z * z * F.lit(float(beta[1 + k + i]))
    return out


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def concentration(sites: DataFrame, mean: Column) -> float:
    """Prior strength of a level, in documents, by the method of moments: from how much the groups' shares ``s / n`` vary
    around ``mean`` beyond what their sizes explain. No variation left: the largest strength, so groups shrink fully."""
    v = mean * (1 - mean)
    row = sites.filter("n > 1").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)), F.sum(v),
                                    F.sum("n"), F.sum(F.col("n") * v)).first()
    groups, spread, noise, n, total = row
    if not groups or not n:
        return LARGEST_CONCENTRATION
    between = (spread - noise) / n
    if between <= 0 or not total:
        return LARGEST_CONCENTRATION
    return float(min(LARGEST_CONCENTRATION, max(SMALLEST_CONCENTRATION, (total / n) / between - 1)))


def site_posteriors(df: DataFrame, probability: str = "p") -> tuple[DataFrame, float]:
    """Shrunken means of a probability: rows ``(host, path, host_posterior, path_posterior, ...)`` and the global mean.
    The other columns are the sums and prior strengths that ``without_own`` takes.

    Sums by (host, path) are aggregated once; hosts are summed from them. A host's mean is drawn towards the global
    one and a path's towards its host's, by a prior worth as many documents as ``concentration`` finds at that level. Null
    is a site like others."""
    paths = written(df.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(probability).alias("s")))
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    overall = float(total[1] / total[0]) if total[0] else 0.5
    k = concentration(hosts, F.lit(overall))
    hosts = hosts.withColumn("host_posterior", (F.col("s") + k * overall) / (F.col("n") + k)).select(
        F.col("host").alias("h"), "host_posterior", F.col("n").alias("host_n"), F.col("s").alias("host_s"), F.lit(k).alias("host_k"))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    both = written(both)
    k = concentration(both, F.col("host_posterior"))
    return both.select("host", "path", "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"),
                       "host_n", "host_s", "host_k", F.col("n").alias("path_n"), F.col("s").alias("path_s"), F.lit(k).alias("path_k")), overall


def without_own(p: Column, overall: float) -> tuple[Column, Column]:
    """Host and path posterior as they are without a document whose probability is ``p``, from its site's columns."""
    host = (F.col("host_s") - p + F.col("host_k") * overall) / (F.col("host_n") - 1 + F.col("host_k"))
    return host, (F.col("path_s") - p + F.col("path_k") * host) / (F.col("path_n") - 1 + F.col("path_k"))


def classify_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None,
                     path: Column | None = None, label_col: str = "quality", labelled_rows: int = LABELLED_ROWS,
                     threshold: float = 0.5) -> DataFrame:
    """Quality of every row: ``(id_col, evidence, host_posterior, path_posterior, score, kept)``.

    ``evidence``: log-odds of a ridge logistic regression on features of the whole text, fitted on at most
    ``labelled_rows`` labelled rows, those with the lowest hash of their id (ids with several labels count by their mean), drawn towards the labels' overall log-odds in texts of few words. ``score``
    adds by how much the log-odds of the path's shrunken mean probability differ from the global one, so sparse sites change
    little. Both posteriors leave the document itself out (``without_own``): its evidence counts once, and a site's only
    document gets the prior. ``kept``: score >= threshold.

    ``host`` and ``path`` default to the columns source and lang (``documents`` has no URL). Null, empty and wordless texts have no evidence of their own but the prior; null ids are
    scored like others; repeated rows score alike. Without labels of both kinds the evidence is 0 and all rows are kept.
    Only fixed-size feature rows are shuffled; a site may hold any share of the rows, its sums are formed before the shuffle.
    """
    ready(df.sparkSession)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                     F.col(text_col).cast("string").alias("text"))
    features = written(rows.mapInArrow(_feature_rows, "id bigint, host string, path string, " + ", ".join(f"{f} double" for f in FEATURES)))
    known = (labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null")
             .groupBy("id").agg(F.avg("y").alias("y")).filter("y <> 0.5"))
    labelled = written(features.join(known, "id").select("id", "y", *FEATURES))
    share = min(1.0, 1.2 * labelled_rows / max(1, labelled.count()))  # of the hashes: few more than the limit reach the sort
    sample = (labelled.filter(F.xxhash64("id").cast("double") <= -2.0 ** 63 + share * 2.0 ** 64)
              .orderBy(F.xxhash64("id"), "id", *FEATURES).limit(labelled_rows).toPandas())
    y = (sample["y"].to_numpy() > 0.5).astype(float)
    if 0 < y.sum() < len(y):
        prior = F.lit(float(np.log(y.sum() / (len(y) - y.sum()))))
        words = F.expm1("log_words")
        evidence = prior + (_evidence(*fit_logistic(sample[FEATURES].to_numpy(), y)) - prior) * words / (words + PRIOR_WORDS)
    else:
        evidence = F.lit(0.0)
    scored = written(features.select("id", "host", "path", evidence.alias("evidence")).withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))))
    sites, overall = site_posteriors(scored)
    sites = written(sites.withColumnsRenamed({"host": "h", "path": "q"}))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    host_posterior, path_posterior = without_own(F.col("p"), overall)
    joined = joined.withColumns({"host_posterior": host_posterior, "path_posterior": path_posterior})
    log_odds = F.col("evidence") + _logit(F.col("path_posterior")) - _logit(F.lit(overall))
    return (joined.withColumn("score", 1 / (1 + F.exp(-log_odds)))
            .select(F.col("id").alias(id_col), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold - 1e-12).alias("kept")))
