"""Populations of models: order, families, clones, distances, penalties."""

from __future__ import annotations

from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import binomial_interval

TIE = 1e-6


def term_key(terms: str = "terms") -> Column:
    """Identity of a model: its sorted terms, whatever its language or data type."""
    return F.array_join(F.transform(terms, lambda t: F.concat_ws(":", t["f"].cast("string"), t["c"].cast("string"))), ",")


def order(fit: str = "fit", key: str = "term_key") -> list[Column]:
    """+inf first, then finite fits by steps of ``TIE``, -inf, NaN; equal steps by key, descending."""
    f = F.col(fit)
    inf = float("inf")
    category = F.when(F.isnan(f), 3).when(f == inf, 0).when(f == -inf, 2).otherwise(1)
    return [category, F.when(category == 1, F.round(f / TIE)).otherwise(0.0).desc(), F.col(key).desc(), F.col("model_id")]


def listed(df: DataFrame) -> DataFrame:
    """A bounded list (selected features, a search's models) as rows of its own: what is built on it has a short plan."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def ranked(models: DataFrame) -> DataFrame:
    return models.withColumn("rank", F.row_number().over(Window.orderBy(*order())) - 1)


def first_pct(models: DataFrame, pct: float) -> DataFrame:
    models = listed(models)  # read twice
    return ranked(models).filter(F.col("rank") < floor(models.count() * pct / 100))


def keep_best(models: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by rank; all if ``n`` is 0."""
    r = ranked(models)
    return r if n == 0 else r.filter(F.col("rank") < n)


def family(models: DataFrame, alpha: float, method: str = "wald") -> DataFrame:
    """The family of best models: the ranked prefix above the lower bound of the best model's value.

    The bound's sample size is the number of models. If the best fit isn't in [0, 1], its AUC
    gives the bound, while fits are still what is compared.
    """
    models = listed(models)  # read three times
    r = ranked(models)
    best, n = r.filter("rank = 0").select("fit", "auc").first(), models.count()
    if best is None:
        return r
    lower, _ = binomial_interval(best["fit"] if 0 <= best["fit"] <= 1 else best["auc"], n, alpha, method)
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("low", F.min("fit").over(w)).filter(F.col("low") > lower).drop("low")


def remove_clones(models: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The first model of each term key (and of these columns)."""
    w = Window.partitionBy("term_key", *also).orderBy("model_id")
    return models.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def remove_stillborn(models: DataFrame, language: str) -> DataFrame:
    """Signed languages need a positive and a negative term, others a term."""
    if language in ("ternary", "ratio"):
        return models.filter(F.exists("terms", lambda t: t["c"] > 0) & F.exists("terms", lambda t: t["c"] < 0))
    return models.filter(F.size("terms") > 0)


def remove_out_of_bounds(models: DataFrame, k_min: int = 0, k_max: int = 0) -> DataFrame:
    k = F.size("terms")
    return models.filter((k >= k_min if k_min else F.lit(True)) & (k <= k_max if k_max else F.lit(True)))


def compatible_coefficients(models: DataFrame, language: str) -> DataFrame:
    """``model_id, ok``: whether all coefficients are of the language's domain."""
    low, high = {"binary": (1, 1), "ternary": (-1, 1), "ratio": (-1, 1), "pow2": (-64, 64)}[language]

    def fits(t):
        c = t["c"]
        inside = (c >= low) & (c <= high)
        return inside & c.isin(*[s << k for k in range(7) for s in (1, -1)]) if language == "pow2" else inside

    return models.select("model_id", F.forall("terms", fits).alias("ok"))


def with_key(models: DataFrame, key: str) -> DataFrame:
    """The models of a term key."""
    return models.filter(F.col("term_key") == key)


def jaccard_pairs(models: DataFrame) -> DataFrame:
    """Signed Jaccard dissimilarity of every pair of models that share a term (any other pair: 1)."""
    t = models.select("model_id", F.size("terms").alias("k"), F.explode("terms").alias("t"))
    a, b = t.alias("a"), t.alias("b")
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.model_id") < F.col("b.model_id"))
    both = a.join(b, same).groupBy(F.col("a.model_id").alias("a"), F.col("b.model_id").alias("b")).agg(F.count("*").alias("n"), F.first("a.k").alias("ka"), F.first("b.k").alias("kb"))
    return both.select("a", "b", (1 - F.col("n") / (F.col("ka") + F.col("kb") - F.col("n"))).alias("dissimilarity"))


def diverse(models: DataFrame, threshold_pct: float, niche: str | None = None) -> DataFrame:
    """Greedy by fit: a model stays if it is at least so dissimilar from every one that stayed, per niche.

    A threshold of 0 or less keeps nothing.
    """
    columns = models.columns
    if threshold_pct <= 0:
        return models.limit(0)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("model_id").sort_values(["fit", "term_key"], ascending=False, kind="stable")  # clones: the first one
        kept, sets = [], []
        for i, key in enumerate(pdf["term_key"]):
            own = set(key.split(",")) if key else set()
            if all(1 - len(own & s) / len(own | s) >= threshold_pct / 100 if own | s else False for s in sets):
                kept.append(i)
                sets.append(own)
        return pdf.iloc[kept][columns]

    return models.withColumn("_niche", F.col(niche) if niche else F.lit("")).groupBy("_niche").applyInPandas(keep, models.schema)


def penalized(models: DataFrame, k_penalty: float = 0.0, ci_penalty: float = 0.0, bias_penalty: float = 0.0, weight: float = 0.0, penalties: DataFrame | None = None) -> DataFrame:
    """``fit`` less penalties for size, rejection, one-sidedness and annotated features."""
    fit = F.col("fit") - F.col("k") * k_penalty
    if "rejection_rate" in models.columns:
        fit = fit - ci_penalty * F.col("rejection_rate")
    for side in ("sensitivity", "specificity") if bias_penalty else ():
        fit = fit - F.when(F.col(side) < 0.5, (1 - F.col(side)) * bias_penalty).otherwise(0.0)
    if penalties is not None and weight > 0:
        packed = penalties.agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "feature_penalty"))).alias("pen"))
        models = models.crossJoin(F.broadcast(packed))
        size = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.abs(t["c"]))
        paid = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.abs(t["c"]) * F.greatest(F.lit(0.0), F.coalesce(F.col("pen")[t["f"]], F.lit(0.0))))
        fit = fit - F.when(size > 0, weight * paid / F.when(size > 0, size)).otherwise(0.0)
    return models.withColumn("fit", fit).drop("pen")


def features_by_frequency(best: DataFrame, min_freq_pct: float = 1.0, top_models_pct: float = 10.0) -> DataFrame:
    """Features of ranked models that are frequent, or in a top model. ``best``: rank, terms."""
    best = listed(best.select("rank", "terms"))  # read twice
    n = best.count()
    least, top = ceil(n * min_freq_pct / 100), max(1, ceil(n * top_models_pct / 100))
    t = best.select("rank", F.explode("terms").alias("t")).groupBy(F.col("t.f").alias("feature_id")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return t.filter((F.col("n") >= least) | (F.col("first") < top)).select("feature_id")


def features_for_ratio(best: DataFrame, min_freq_pct: float = 1.0, top_models_pct: float = 10.0, nb_best: int = 10) -> DataFrame:
    """``feature_id, sign``: per sign, features that are frequent, in a top model, or among the most frequent."""
    best = listed(best.select("rank", "terms"))
    n = best.count()
    least, top, half = max(1, ceil(n * min_freq_pct / 100)), max(1, ceil(n * top_models_pct / 100)), max(1, nb_best // 2)
    t = best.select("rank", F.explode("terms").alias("t")).groupBy(F.col("t.f").alias("feature_id"), F.signum("t.c").cast("int").alias("sign")).agg(F.count("*").alias("n"), F.min("rank").alias("first")).filter("sign <> 0")
    t = t.withColumn("place", F.row_number().over(Window.partitionBy("sign").orderBy(F.col("n").desc(), "feature_id")))
    return t.filter((F.col("n") >= least) | (F.col("first") < top) | (F.col("place") <= half)).select("feature_id", "sign")


def feature_statistics(models: DataFrame) -> DataFrame:
    """Per feature: prevalence, dominant sign, entropy of the sign, mean and deviation of the size of coefficients."""
    n = models.agg(F.count("*").alias("models"))
    c = F.col("t.c")
    t = models.select(F.explode("terms").alias("t")).groupBy(F.col("t.f").alias("feature_id")).agg(F.count("*").alias("n"), F.count_if(c > 0).alias("pos"), F.count_if(c < 0).alias("neg"), F.avg(F.abs(c)).alias("coefficient"), F.stddev_pop(F.abs(c)).alias("coefficient_std"))
    total = F.col("pos") + F.col("neg")
    p = F.when(total > 0, F.col("pos") / F.when(total > 0, total)).otherwise(0.0)
    q = 1 - p
    entropy = F.when((p > 0) & (q > 0), -(p * F.log2(F.when(p > 0, p).otherwise(1.0)) + q * F.log2(F.when(q > 0, q).otherwise(1.0)))).otherwise(0.0)
    direction = F.when(total == 0, 2).when(p > 0.66, 1).when(F.col("neg") / F.when(total > 0, total).otherwise(1) > 0.66, 0).otherwise(2)
    return t.crossJoin(F.broadcast(n)).select("feature_id", (F.col("n") / F.col("models")).alias("prevalence"), direction.alias("direction"), entropy.alias("sign_entropy"), "coefficient", "coefficient_std")


def averaged(scores: DataFrame, threshold: float) -> DataFrame:
    """Mean score of all models per sample, and its class (above the threshold: 1)."""
    mean = F.avg("score")
    return scores.groupBy("sample_id").agg(F.first("y").alias("y"), mean.alias("score")).withColumn("predicted", F.when(F.col("score") > threshold, 1).otherwise(0))


def genealogy(parents: DataFrame, root: int, depth: int) -> DataFrame:
    """``ancestor, depth`` of a model: recursive over (child, parent)."""
    parents.createOrReplaceTempView("scantling_parents")
    return parents.sparkSession.sql(
        f"WITH RECURSIVE a(ancestor, depth) AS (SELECT CAST({root} AS BIGINT), 0 UNION ALL SELECT p.parent, a.depth + 1 FROM a JOIN scantling_parents p ON p.child = a.ancestor WHERE a.depth < {depth}) SELECT DISTINCT ancestor, depth FROM a"
    )
