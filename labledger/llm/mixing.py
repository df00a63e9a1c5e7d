"""Mixing sources to target weights by iterative proportional fitting (operator 5), with DataFrame functions only."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labledger.llm.common import ready, written


def word_count(text_col: str = "text") -> Column:
    """Words of a whole text, the weight of a document unless tokens are counted; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def topic(text_col: str = "text") -> Column:
    """A coarse topic from the shape of a text, for tables that name none: table, listing, code, contact or prose."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return (F.when(t.contains(" | "), "table").when(t.contains("@") & t.contains("."), "contact")
            .when(t.contains("{") | t.contains("};"), "code").when(t.contains("\n- ") | t.contains("\n* "), "listing")
            .otherwise("prose"))


def cells(df: DataFrame, dims: list[str], tokens_col: str = "n_tokens") -> DataFrame:
    """Token weight of each combination of the dimensions, ``(dims..., tokens)``; null is a value like others."""
    return (df.groupBy(*dims).agg(F.sum(F.col(tokens_col).cast("double")).alias("tokens"))
            .withColumn("tokens", F.coalesce("tokens", F.lit(0.0))))


def tempered(cell: DataFrame, dim: str, power: float = 0.5) -> DataFrame:
    """Target shares ``(dim, share)`` of one dimension: its token shares to a power below 1, so that large values shrink."""
    raw = cell.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("raw"))
    whole = raw.agg(F.sum("raw")).first()[0] or 1.0
    return raw.select(dim, (F.col("raw") / whole).alias("share"))



def _fit(state: DataFrame, dim: str, target: DataFrame, total: float) -> DataFrame:
    """Scale the weights of each value of a dimension to its target; values without a target lose all weight. ``off`` takes
    up how far, relative to its target, the sum of a value with weight was from it."""
    goal = target.select(F.col(dim).alias("d"), F.col("share").alias("s"))
    sums = state.groupBy(dim).agg(F.sum("weight").alias("have"))
    factor = (sums.join(goal, sums[dim].eqNullSafe(goal["d"]), "left")
              .select(F.col(dim).alias("d"), F.when(F.col("have") > 0, F.coalesce("s", F.lit(0.0)) * total / F.col("have")).otherwise(0.0).alias("factor")))
    return (state.join(factor, state[dim].eqNullSafe(factor["d"]), "left")
            .withColumns({"weight": F.col("weight") * F.col("factor"),
                          "off": F.greatest("off", F.when((F.col("weight") > 0) & (F.col("factor") > 0), F.abs(1 / F.col("factor") - 1)))}).drop("d", "factor"))


def rake(cell: DataFrame, targets: dict[str, DataFrame], rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """Iterative proportional fitting: ``cell`` with ``weight``, whose sums by each dimension follow its target shares, and ``off``.

    Each round scales the weights to every dimension's shares in turn, by an aggregation of the cells and a join, and is
    written. It ends when the sum of every value, however light, is found within ``tolerance`` of its own target before it is
    scaled, or after ``rounds`` with a warning (targets that the empty cells make impossible never settle). ``off``: the largest
    relative distance that the last round found for the cell's values. A value without target rows gets weight 0; shares
    needn't sum to 1. Cells without tokens get weight 0; an empty table gives an empty one.
    """
    total = cell.agg(F.sum("tokens")).first()[0] or 0.0
    goals = {}
    for dim, target in targets.items():
        whole = target.agg(F.sum("share")).first()[0] or 1.0
        goals[dim] = target.select(dim, (F.col("share") / whole).alias("share"))
    state, off = cell.withColumns({"weight": F.col("tokens"), "off": F.lit(0.0)}), 0.0
    for _ in range(rounds if total else 0):
        fitted = state.withColumn("off", F.lit(0.0))
        for dim, target in goals.items():
            fitted = _fit(fitted, dim, target, total)
        state = written(fitted)
        off = state.agg(F.max("off")).first()[0] or 0.0
        if off <= tolerance:
            break
    else:
        if off > tolerance:
            warnings.warn(f"the targets weren't met after {rounds} rounds; sums are up to {off:.2g} of their target off", stacklevel=2)
    return state


def calibrate(raked: DataFrame, keep: float) -> DataFrame:
    """Inclusion probabilities ``probability = min(1, scale * weight / tokens)`` whose expected tokens are ``keep`` of
    all; tokens beyond a cell's supply go to the others in proportion. Less comes out if the cells with weight hold less."""
    raked = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    budget = keep * (raked.agg(F.sum("tokens")).first()[0] or 0.0)
    scale = 0.0
    while True:  # ends: the set of cells at their supply only grows
        full = F.col("ratio") * scale >= 1
        row = raked.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("ratio") * F.col("tokens")))).first()
        if not row[1]:
            break
        new = max(scale, (budget - row[0]) / row[1])
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * scale)).drop("ratio")


def draw(df: DataFrame, calibrated: DataFrame, dims: list[str], id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """Append ``weight_factor`` (target against present token weight), ``probability`` and ``sampled`` to every row.

    The draw hashes id and seed, so it repeats; rows with one id are drawn together. Only the cells are joined; a cell
    may hold any share of the rows. Columns of these names are replaced.
    """
    right = calibrated.select(*[F.col(d).alias(f"_cell_{d}") for d in dims],
                              F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias("weight_factor"), "probability")
    same = reduce(lambda x, y: x & y, [df[d].eqNullSafe(right[f"_cell_{d}"]) for d in dims])
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) * F.lit(2.0 ** -53)
    joined = df.drop("weight_factor", "probability", "sampled").join(right, same, "left").drop(*[f"_cell_{d}" for d in dims])
    return (joined.withColumns({"weight_factor": F.coalesce("weight_factor", F.lit(0.0)), "probability": F.coalesce("probability", F.lit(0.0))})
            .withColumn("sampled", u < F.col("probability")))


def mix_sources(df: DataFrame, dims: list[str], targets: dict[str, DataFrame] | None = None, power: float = 0.5, keep: float = 0.5,
                tokens_col: str = "n_tokens", id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """Rake the token weights of ``df`` to target shares of every dimension and sample its rows accordingly.

    ``targets``: for some or all of ``dims`` a table ``(dim, share)``; the others are tempered by ``power``. ``keep``:
    expected share of the tokens that the sample holds. Returns all rows with ``weight_factor``, ``probability`` and
    ``sampled``. Null dimension values form cells of their own, null token counts weigh nothing.
    """
    ready(df.sparkSession)
    cell = written(cells(df, dims, tokens_col))
    goals = {d: (targets or {}).get(d) for d in dims}
    goals = {d: tempered(cell, d, power) if t is None else t for d, t in goals.items()}
    goals = {d: written(t) for d, t in goals.items()}
    return draw(df, written(calibrate(rake(cell, goals), keep)), dims, id_col, seed)
