"""URL filter by rules and character language models (operator 8), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labledger.llm.common import ready, written

ORDER = 4           # characters of context at most
ALPHABET = 96       # equally likely characters below the shortest context
FOLDS = 5           # of the ruled shapes, by hash; the threshold is calibrated on each by models of the others
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, else null. ``host/prefix`` fits the host and its subdomains
    if the path starts with ``/prefix``; of equally long rules the smallest text wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(host: Column, path: Column) -> Column:
    """The characters that the models read: host and path, each run of digits as one 0."""
    return F.regexp_replace(F.concat(host, path), "[0-9]+", "0")


def _grams(shapes: DataFrame, order: int) -> DataFrame:
    """Every position's longest gram: the character and the ``order`` before it (\\x02 before the start, \\x03 ends)."""
    padded = F.concat(F.lit("\x02" * order), "shape", F.lit("\x03"))
    return (shapes.withColumn("padded", padded)
            .withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("shape") + 1)))
            .withColumn("gram", F.substring(F.col("padded"), F.col("at"), F.lit(order + 1))).drop("padded", "at"))


def _suffix(gram: Column, size: int) -> Column:
    return F.right(gram, F.lit(size)) if size else F.lit("")


def log_ratios(counts: DataFrame, wanted: DataFrame, order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, gram, ratio)``: log P(c | context, accepted) - log P(c | context, rejected) of each wanted gram.

    ``counts``: (gram, allow, block), how often each longest gram was seen in either class. Both models back off over all
    shorter contexts with Witten-Bell smoothing: a context with n occurrences and t different successors gives the
    shorter context's estimate the share t / (n + t), down to equal chances. Columns ``by`` of both name separate models."""
    est = wanted.select(*by, "gram", *[F.lit(1.0 / ALPHABET).alias(f"p_{c}") for c in ("allow", "block")])
    for k in range(order + 1):
        seen = (counts.groupBy(*by, _suffix(F.col("gram"), k + 1).alias("g")).agg(F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block")))
        context = (seen.groupBy(*by, F.expr(f"left(g, {k})").alias("x")).agg(
            F.sum("n_allow").alias("m_allow"), F.sum("n_block").alias("m_block"),
            F.sum((F.col("n_allow") > 0).cast("double")).alias("t_allow"), F.sum((F.col("n_block") > 0).cast("double")).alias("t_block")))
        est = (est.withColumn("g", _suffix(F.col("gram"), k + 1)).join(seen, [*by, "g"], "left").drop("g")
               .withColumn("x", F.expr(f"left(right(gram, {k + 1}), {k})")).join(context, [*by, "x"], "left").drop("x"))
        for c in ("allow", "block"):
            n, m, t = (F.coalesce(f"{v}_{c}", F.lit(0.0)) for v in "nmt")
            est = est.withColumn(f"p_{c}", F.when(m + t > 0, (n + t * F.col(f"p_{c}")) / (m + t)).otherwise(F.col(f"p_{c}")))
        est = est.select(*by, "gram", "p_allow", "p_block")
    return est.select(*by, "gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def threshold_of(scored: DataFrame, step: float = 0.01) -> float:
    """The cut between scores, on a grid of ``step``, that best splits ``(score, allow, block)`` rows: largest sum of the share of
    accepted at or above and rejected below; of equals the one nearest 0. 0 without rows of both kinds."""
    bins = scored.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.sum("allow").alias("a"), F.sum("block").alias("b"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over the bins, a few thousand at most
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0.0)), F.sum(c).over(whole))
    gain = share("b") - share("a")
    before = F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin"))
    cut = F.least(F.col("bin"), F.greatest(before, F.lit(0)))  # every cut from the bin before to this one splits alike
    best = (bins.select("bin", gain.alias("gain"), cut.alias("cut")).filter("gain is not null")
            .orderBy(F.desc("gain"), F.abs("cut"), "cut").limit(1).collect())
    return best[0]["cut"] * step if best else 0.0


def filter_urls(df: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """Judge every URL: ``(id_col, host, path, rule, verdict, score)``.

    A fitting rule decides. All other URLs are compared by two character models of variable order, one of the URLs that
    rules allow, one of those they block, counted over all of them: ``score`` is the mean log-likelihood difference per
    character, and ``allow`` means at or above the threshold that best splits the ruled URLs. For the threshold, each of
    FOLDS parts of the ruled shapes is scored by models of the other parts (a class found in one part only keeps its
    counts); that is also the score of a ruled URL.
    Without accepted or without rejected URLs there is nothing to compare, and URLs without a rule are allowed.

    A URL is read as its shape (digits runs are one 0) and equal shapes are counted and scored once; grams are summed
    before the shuffle, and the models stay distributed tables. Null and odd URLs have empty host and path and no
    score but that of the end mark; null ids, repeated rows and empty tables need no care. Rules are a short list; each becomes
    a condition of the scan.
    """
    ready(df.sparkSession)
    rows = (df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
            .select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
            .withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("host"), F.col("path"))))
    shapes = written(rows.groupBy("shape").agg(F.sum((F.col("r.verdict") == "allow").cast("double")).alias("allow"),
                                               F.sum((F.col("r.verdict") == "block").cast("double")).alias("block"),
                                               F.sum(F.col("r").isNull().cast("double")).alias("free"))
                     .select("shape", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("allow", "block", "free")]))
    ruled = F.col("allow") + F.col("block") > 0
    shapes = shapes.withColumn("fold", F.pmod(F.xxhash64("shape"), F.lit(FOLDS)).cast("int"))
    sums = shapes.filter(ruled).groupBy("fold").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect()
    parts = {c: [r["fold"] for r in sums if r[c] > 0] for c in ("allow", "block")}
    by_fold = written(_grams(shapes.filter(ruled), order).groupBy("fold", "gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    # Model FOLDS counts everything, each other one everything outside the fold of its number.
    counts_in = lambda c: F.when((F.col("model") != F.col("fold")) | F.lit(len(parts[c]) == 1), F.col(c)).otherwise(0.0)
    counts = written(by_fold.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
                     .select("model", "gram", *[counts_in(c).alias(c) for c in ("allow", "block")]).filter("allow + block > 0")
                     .groupBy("model", "gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    models = F.array_compact(F.array(F.when(ruled, F.col("fold")), F.when(F.col("free") > 0, F.lit(FOLDS))))
    grams = _grams(shapes.withColumn("model", F.explode(models)), order)
    ratios = written(log_ratios(counts, grams.select("model", "gram").distinct(), order, ("model",)))
    scored = written(grams.join(ratios, ["model", "gram"]).groupBy("shape", "model")
                     .agg(F.avg("ratio").alias("score"), F.first("allow").alias("allow"), F.first("block").alias("block")))
    cut = threshold_of(scored.filter(F.col("model") < FOLDS).select("score", "allow", "block")) if parts["allow"] and parts["block"] else None
    learned = F.lit("allow") if cut is None else F.when(F.col("score") >= cut - 1e-9, "allow").otherwise("block")
    model = F.when(F.col("r").isNull(), F.lit(FOLDS)).otherwise(F.pmod(F.xxhash64("shape"), F.lit(FOLDS)).cast("int"))
    return (rows.withColumn("model", model).join(scored.select("shape", "model", "score"), ["shape", "model"], "left")
            .select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", learned).alias("verdict"), "score"))
