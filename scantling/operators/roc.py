"""Ranking quality and thresholds from scores: tie groups per model, ordered in blocks of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from . import ranks

KEY = ("model_id",)
#: Digits within which objectives of thresholds are compared: equal ones that differ by rounding noise are ties.
DIGITS = 12


def tie_groups(scores: DataFrame, key=KEY, weight: str | None = None) -> DataFrame:
    """Positives and negatives (or their weights) at each distinct score; unknown labels take no part."""
    y = F.col("y")
    count = (lambda own: F.sum(F.when(own, F.col(weight)).otherwise(0))) if weight else F.count_if
    return scores.filter(y.isin(0.0, 1.0)).groupBy(*key, "score").agg(count(y == 1).alias("p"), count(y == 0).alias("n"))


def auc(scores: DataFrame, key=KEY) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties one half; 0.5 without either class.

    Pairs are counted within blocks of scores, then between them: no task sorts all of a model's.
    """
    return auc_of(tie_groups(scores, key), key)


def auc_of(tied: DataFrame, key=KEY) -> DataFrame:
    """As ``auc``, of tie groups."""
    g = tied.withColumn("block", ranks.number_block(F.col("score")))
    lower = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = lower(Window.partitionBy(*key, "block").orderBy("score"))
    g = g.withColumn("below", F.coalesce(F.sum("n").over(within), F.lit(0)))
    blocks = g.groupBy(*key, "block").agg(F.sum(F.col("p") * F.col("below") + F.lit(0.5) * F.col("n") * F.col("p")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    blocks = blocks.withColumn("below", F.coalesce(F.sum("n").over(lower(Window.partitionBy(*key).orderBy("block"))), F.lit(0)))
    pairs = F.sum("p") * F.sum("n")
    u = F.sum(F.col("u") + F.col("p") * F.col("below"))
    return blocks.groupBy(*key).agg(F.when(pairs > 0, u / F.when(pairs > 0, pairs)).otherwise(0.5).alias("auc"))


def running(scores: DataFrame, key=KEY, weight: str | None = None) -> DataFrame:
    """Tie groups in the order of scores: counts below (``before_``) and of all, and the next score."""
    return running_of(tie_groups(scores, key, weight), key)


def running_of(tied: DataFrame, key=KEY) -> DataFrame:
    """As ``running``, of tie groups."""
    g = tied.withColumnRenamed("n", "q")
    return ranks.placed(g, list(key), ["score"], ranks.number_block(F.col("score")), ("p", "q"), "score")


def candidates(scores: DataFrame, key=KEY, weight: str | None = None) -> DataFrame:
    """All thresholds a model can have, with their counts.

    The first calls every sample positive (threshold: the lowest score); one more after each tie
    group: the next score, or beyond the last one its score + 1.
    """
    return candidates_of(running(scores, key, weight), key)


def candidates_of(g: DataFrame, key=KEY) -> DataFrame:
    """As ``candidates``, of running tie groups; ``u``: pairs in order that a tie group adds, ties one half."""
    fn, tn, zero = F.col("before_p") + F.col("p"), F.col("before_q") + F.col("q"), F.lit(0).cast("long")
    names = ("threshold", "place", "tp", "fp", "tn", "fn", "u")
    one = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, names)])
    after = one(F.coalesce("next", F.col("score") + 1.0), F.col("place") + 1, F.col("all_p") - fn, F.col("all_q") - tn, tn, fn, F.col("p") * F.col("before_q") + F.lit(0.5) * F.col("p") * F.col("q"))
    start = one(F.col("score"), F.col("place"), F.col("all_p"), F.col("all_q"), zero, zero, F.lit(0.0))
    return g.select(*key, F.inline(F.when(F.col("place") == 0, F.array(start, after)).otherwise(F.array(after))))


def best_threshold(scores: DataFrame, fit: str = "auc", penalties: tuple[float, float] | None = None, key=KEY, weight: str | None = None) -> DataFrame:
    """Per model the lowest threshold of the highest objective: ``threshold, accuracy, sensitivity, specificity, objective`` and counts."""
    return best_of(candidates(scores, key, weight), fit, penalties, key).drop("auc")


def best_of(c: DataFrame, fit: str = "auc", penalties: tuple[float, float] | None = None, key=KEY) -> DataFrame:
    """As ``best_threshold``, of candidates, with ``auc``: both from one pass."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumn("objective", metrics.objective(fit, tp, fp, tn, fn, penalties))
    best = F.max_by(F.struct("threshold", "objective", "tp", "fp", "tn", "fn"), F.struct(F.round("objective", DIGITS), -F.col("place")))
    pairs = (tp + fn) * (tn + fp)
    return c.groupBy(*key).agg(best.alias("best"), F.sum("u").alias("u")).select(*key, "best.*", "u").select(
        *key, "threshold", ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), metrics.sensitivity(tp, fn).alias("sensitivity"),
        metrics.specificity(tn, fp).alias("specificity"), "objective", "tp", "fp", "tn", "fn", F.when(pairs > 0, F.col("u") / F.when(pairs > 0, pairs)).otherwise(0.5).alias("auc"),
    )


def weighted_threshold(scores: DataFrame, fpr_penalty: float, fnr_penalty: float, key=KEY) -> DataFrame:
    """The score value that maximizes weighted specificity and sensitivity (``score >= threshold``); the lowest wins."""
    P, N, fn, tn = (F.col(c) for c in ("all_p", "all_q", "before_p", "before_q"))
    sens, spec = (P - fn) / P, tn / N
    g = running(scores, key).filter((P > 0) & (N > 0)).select(*key, F.col("score").alias("threshold"), sens.alias("sensitivity"), spec.alias("specificity"), ((P - fn + tn) / (P + N)).alias("accuracy"), metrics.balance(sens, spec, (fpr_penalty, fnr_penalty)).alias("objective"))
    values = ("threshold", "sensitivity", "specificity", "accuracy", "objective")
    best = F.max_by(F.struct(*values), F.struct(F.round("objective", DIGITS), -F.col("threshold")))
    return g.groupBy(*key).agg(best.alias("best")).select(*key, "best.*")


def confusion(classes: DataFrame, key=KEY) -> DataFrame:
    """Counts of predicted against true classes; abstentions and unknown labels apart.

    ``classes``: key, y, predicted (0, 1, 2 = abstain).
    """
    y, c = F.col("y"), F.col("predicted")
    return classes.groupBy(*key).agg(
        F.count_if((y == 1) & (c == 1)).alias("tp"), F.count_if((y == 0) & (c == 1)).alias("fp"), F.count_if((y == 0) & (c == 0)).alias("tn"), F.count_if((y == 1) & (c == 0)).alias("fn"),
        F.count_if(c == 2).alias("abstained"), F.count("*").alias("samples"),
    )


def class_metrics(classes: DataFrame, key=KEY) -> DataFrame:
    """Accuracy, sensitivity, specificity, the additional metrics and the rejection rate (of all samples)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    sens, spec = metrics.sensitivity(tp, fn), metrics.specificity(tn, fp)
    return confusion(classes, key).select(
        *key, metrics.ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), sens.alias("sensitivity"), spec.alias("specificity"), metrics.mcc(tp, fp, tn, fn).alias("mcc"),
        metrics.f1_score(tp, fp, fn).alias("f1_score"), metrics.npv(tn, fn).alias("npv"), metrics.ppv(tp, fp).alias("ppv"), metrics.g_mean(sens, spec).alias("g_mean"),
        metrics.ratio(F.col("abstained"), F.col("samples")).alias("rejection_rate"),
    )
