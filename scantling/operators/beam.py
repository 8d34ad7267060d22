"""Exhaustive and forward beam search over sign models with coefficients fixed by class.

A level is a DataFrame of combinations in feature order; the next comes from an inequality join,
whose size is bounded before (``most``) by cutting each class's features. Each level is one
scoring job.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import dense, goals, population


def largest_pool(k: int, most: int, available: int) -> int:
    """The most features of which all combinations of ``k`` number at most ``most``."""
    n = k
    while n < available and comb(n + 1, k) <= most:
        n += 1
    return min(n, available)


def limited(selection: DataFrame, k: int, most: int) -> DataFrame:
    """Features cut by significance within each class, evenly, so that the combinations fit."""
    n = selection.count()
    pool = largest_pool(k, most, n)
    if pool >= n:
        return selection
    w = Window.partitionBy("class").orderBy("rank")
    return selection.withColumn("place", F.row_number().over(w)).withColumn("o", F.row_number().over(Window.orderBy("place", "class"))).filter(F.col("o") <= pool).drop("place", "o")


def combinations(selection: DataFrame, k: int) -> DataFrame:
    """``terms``: all combinations of ``k`` features, sorted; class 0 is negative, class 1 positive."""
    one = selection.select(F.col("feature_id").alias("f"), F.when(F.col("class") == 0, -1).otherwise(1).alias("c"))
    out = one.select(F.array(F.struct("f", "c")).alias("terms"))
    for _ in range(k - 1):
        more = out.join(F.broadcast(one), F.element_at("terms", -1)["f"] < F.col("f"))
        out = more.select(F.concat("terms", F.array(F.struct("f", "c"))).alias("terms"))
    return out


def rewritten(models: DataFrame, k: int, language: str = "ternary") -> DataFrame:
    """One-signed models as their language writes them: all-positive ternary is binary, all-negative has no model."""
    pos, neg = F.exists("terms", lambda t: t["c"] > 0), F.exists("terms", lambda t: t["c"] < 0)
    if language == "binary":
        return models.filter(~neg).withColumn("language", F.lit("binary"))
    if k == 1:
        return models.withColumn("language", F.when(pos, "binary").otherwise("ternary"))
    if language == "ratio":
        return models.filter(pos & neg).withColumn("language", F.lit("ratio"))
    return models.filter(pos).withColumn("language", F.when(neg, language).otherwise("binary"))


def named(models: DataFrame, k: int) -> DataFrame:
    """Models numbered by their features' order."""
    m = models.withColumn("term_key", population.term_key())
    return m.withColumn("k", F.lit(k).cast("long")).withColumn("model_id", F.xxhash64("term_key", "language"))


def extended(best: DataFrame, selection: DataFrame) -> DataFrame:
    """Forward step: every best model with every kept feature that it lacks."""
    one = selection.select(F.col("feature_id").alias("f"), F.when(F.col("class") == 0, -1).otherwise(1).alias("c"))
    more = best.crossJoin(F.broadcast(one)).filter(~F.exists("terms", lambda t: t["f"] == F.col("f")))
    return more.select(F.array_sort(F.concat("terms", F.array(F.struct("f", "c")))).alias("terms")).distinct()


def fitted_level(models: DataFrame, matrix: dense.Matrix, data_type: str = "raw", k_penalty: float = 0.0, goal: goals.Goal | None = None, epsilon: float = dense.EPSILON) -> DataFrame:
    """Models of a level with AUC and fit; ratio and linear models are scored apart."""
    models, c = models.persist(), goal or goals.Goal(k_penalty=k_penalty)
    parts = [goals.fitted(models.filter(cond), matrix, c, kind, data_type, epsilon) for kind, cond in (("ternary", "language <> 'ratio'"), ("ratio", "language = 'ratio'"))]
    return parts[0].unionByName(parts[1])


def search(matrix: dense.Matrix, selection: DataFrame, k_start: int = 1, k_stop: int = 4, method: str = "exhaustive", criterion: float = 10.0, most: int = 10_000, language: str = "ternary", data_type: str = "raw", k_penalty: float = 0.0, goal: goals.Goal | None = None, epsilon: float = dense.EPSILON):
    """Levels from ``k_start`` + 1 to ``k_stop``, each fitted and ranked, a list of ``most`` models or a few more; the first isn't returned.

    ``criterion`` up to 1 is the level of the family of best models, above 1 a percentage.
    """
    selection = population.listed(selection)  # read at every level
    start = rewritten(combinations(limited(selection, k_start, most), k_start), k_start, language)
    level = population.listed(population.ranked(fitted_level(named(start, k_start), matrix, data_type, k_penalty, goal, epsilon)))
    for k in range(k_start + 1, k_stop + 1):
        best = population.first_pct(level, criterion) if criterion > 1 else population.family(level, criterion)
        best = population.listed(best)
        kept = population.features_by_frequency(best)
        pool = selection.join(kept, "feature_id", "left_semi")
        if pool.count() < k or best.isEmpty():
            return
        models = combinations(limited(pool, k, most), k) if method == "exhaustive" else extended(best, pool)
        level = population.listed(population.ranked(fitted_level(named(rewritten(models, k, language), k), matrix, data_type, k_penalty, goal, epsilon)))
        if level.isEmpty():
            return
        yield level
