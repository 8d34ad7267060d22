"""Splits, folds, bootstrap and permutation as tables of assignments, drawn by counter hashes."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from ..sources.fixtures import dealt
from . import ranks, roc

#: Draws of a replicate that weigh on a task as one row of a long table does.
LIGHT = 4


def shuffled(samples: DataFrame, seed: int, purpose: str, strata: list[str], *ids: str) -> DataFrame:
    """``place``: rank in a random order within each stratum, from 0; ``n``: the stratum's size."""
    drawn = samples.withColumn("_u", draw(seed, purpose, *ids, "sample_id"))
    return ranks.placed(drawn, strata, ["_u", "sample_id"], ranks.draw_block(F.col("_u"))).drop("_u")


def chunk(place: Column, n: Column, k: int) -> Column:
    """Which of ``k`` chunks a place is in; sizes differ by one at most, the first are larger."""
    q, extra = F.floor(n / k), n % k
    head = extra * (q + 1)
    return F.when(place < head, F.floor(place / (q + 1))).otherwise(extra + F.floor((place - head) / F.greatest(q, F.lit(1)))).cast("int")


def folds(samples: DataFrame, k: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """``sample_id, fold``; stratified by class (unknown labels drop out) and further columns; unstratified if ``by`` is empty."""
    strata = ["y"] if by is None else by
    rows = samples.filter("y < 2") if "y" in strata else samples
    rows = shuffled(rows, seed, "fold", strata) if strata else shuffled(rows.withColumn("_all", F.lit(0)), seed, "fold", ["_all"])
    return rows.select("sample_id", chunk(F.col("place"), F.col("n"), k).alias("fold"))


def holdout(samples: DataFrame, ratio: float, seed: int, by: list[str] | None = None) -> DataFrame:
    """``sample_id, test``: per class (and stratum) the rounded share is test; unknown labels drop out."""
    rows = shuffled(samples.filter("y < 2"), seed, "holdout", ["y", *(by or [])])
    return rows.select("sample_id", (F.col("place") < F.round(F.col("n") * ratio)).alias("test"))


def holdout_unstratified(samples: DataFrame, ratio: float, seed: int) -> DataFrame:
    """``sample_id, test`` whatever the target: those whose draw is below the share, each by itself."""
    return samples.select("sample_id", (draw(seed, "holdout", "sample_id") < F.lit(int(ratio * (1 << 32)))).alias("test"))


def random_subset(samples: DataFrame, size: int, seed: int) -> DataFrame:
    """``sample_id`` of about ``size`` samples with the classes' shares kept; positives are rounded, negatives fill up."""
    known = samples.filter("y < 2")
    rows = shuffled(known, seed, "subset", ["y"]).crossJoin(F.broadcast(known.agg(F.count("*").alias("total"), F.count_if(F.col("y") == 1).alias("positive"))))
    pos = F.round(F.lit(size) * F.col("positive") / F.col("total"))
    return rows.withColumn("take", F.when(F.col("y") == 1, pos).otherwise(size - pos)).filter(F.col("place") < F.col("take")).select("sample_id")


def parts_of(drawn: DataFrame, fraction: float) -> DataFrame:
    """``replicate, sample_id, weight`` of the first draws (``_u``) of each replicate and class, up to the fraction.

    Draws are counted by block (``ranks.draw_block``); whole blocks are in or out, and only the one in
    which the fraction ends is put in order, so the rows aren't moved.
    """
    key = ["replicate", "y"]
    rows = drawn.select(*key, "sample_id", "_u").withColumn("_block", ranks.draw_block(F.col("_u")))
    w = Window.partitionBy(*key)
    totals = rows.groupBy(*key, "_block").agg(F.count("*").alias("_rows"))
    totals = totals.withColumn("_to", F.sum("_rows").over(w.orderBy("_block"))).withColumn("_take", F.ceil(F.sum("_rows").over(w) * fraction))
    ends = totals.filter((F.col("_to") >= F.col("_take")) & (F.col("_to") - F.col("_rows") < F.col("_take"))).select(*key, F.col("_block").alias("_end"), (F.col("_take") - F.col("_to") + F.col("_rows")).alias("_left"))
    rows = rows.join(F.broadcast(ends), key)  # a row for each replicate and class
    last = rows.filter("_block = _end").withColumn("_place", F.row_number().over(w.orderBy("_u", "sample_id"))).filter("_place <= _left")
    return rows.filter("_block < _end").select("replicate", "sample_id").unionByName(last.select("replicate", "sample_id")).withColumn("weight", F.lit(1).cast("long"))


def bootstrap(samples: DataFrame, replicates: int, seed: int, fraction: float = 1.0) -> DataFrame:
    """``replicate, sample_id, weight``, the same for all models.

    Fraction 1: with replacement within each class; less: a random part of each class, without.
    """
    known = samples.filter("y < 2")
    b = known.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    if fraction < 1:
        return parts_of(known.crossJoin(F.broadcast(b)).withColumn("_u", draw(seed, "part", "replicate", "sample_id")), fraction)
    classes = known.select(F.col("y").cast("string").alias("y"), "sample_id")  # Spark normalizes real keys, and would deal them anew
    members = ranks.placed(classes, ["y"], ["sample_id"], ranks.number_block(F.col("sample_id")))
    rows = known.count() * replicates // LIGHT
    picks = members.crossJoin(F.broadcast(b)).select("replicate", "y", (draw(seed, "boot", "replicate", "sample_id") % F.col("n")).alias("place"))
    picks = dealt(picks, rows, "y", "place").groupBy("replicate", "y", "place").agg(F.count("*").alias("weight"))  # summed where they are dealt
    return picks.join(dealt(members, rows, "y", "place").hint("merge"), ["y", "place"]).select("replicate", "sample_id", "weight")


def replicate_thresholds(scores: DataFrame, boot: DataFrame, fit: str = "auc") -> DataFrame:
    """Best threshold of every (model, replicate); weights are summed by tie group."""
    rows = scores.join(boot.hint("merge"), "sample_id")
    return roc.best_threshold(rows, fit, key=("model_id", "replicate"), weight="weight").select("model_id", "replicate", "threshold")


def percentiles(stats: DataFrame, value: str, replicates: int, alpha: float) -> DataFrame:
    """``model_id, lower, upper``: order statistics of the replicates."""
    lo, hi = ceil(alpha / 2 * (replicates - 1)), floor((1 - alpha / 2) * (replicates - 1))
    place = F.row_number().over(Window.partitionBy("model_id").orderBy(value)) - 1
    return stats.withColumn("place", place).groupBy("model_id").agg(F.max(F.when(F.col("place") == lo, F.col(value))).alias("lower"), F.max(F.when(F.col("place") == hi, F.col(value))).alias("upper"))


def subsample_interval(stats: DataFrame, center: DataFrame, replicates: int, alpha: float, m: int, n: int) -> DataFrame:
    """Interval around the full-sample threshold from subsamples of ``m`` of ``n``, rescaled by the square roots."""
    d = stats.join(center.select("model_id", F.col("threshold").alias("center")), "model_id").withColumn("d", F.lit(m**0.5) * (F.col("threshold") - F.col("center")))
    q = percentiles(d, "d", replicates, alpha)
    return q.join(center, "model_id").select("model_id", (F.col("threshold") - F.col("upper") / n**0.5).alias("lower"), (F.col("threshold") - F.col("lower") / n**0.5).alias("upper"))


def fit_on_folds(scores: DataFrame, assignment: DataFrame, overfit_penalty: float) -> DataFrame:
    """Mean over folds of the training AUC less the penalized gap to the validation AUC."""
    rows = scores.join(assignment, "sample_id")
    k = assignment.select("fold").distinct().withColumnRenamed("fold", "held")
    parts = rows.crossJoin(F.broadcast(k)).withColumn("valid", F.col("fold") == F.col("held"))
    a = roc.auc(parts, ("model_id", "held", "valid"))
    per = a.groupBy("model_id", "held").agg(F.max(F.when(~F.col("valid"), F.col("auc"))).alias("t"), F.max(F.when(F.col("valid"), F.col("auc"))).alias("v"))
    return per.groupBy("model_id").agg(F.avg(F.col("t") - F.abs(F.col("t") - F.col("v")) * overfit_penalty).alias("fit"))


def shuffled_feature(x: DataFrame, samples: DataFrame, features: DataFrame, permutations: int | range, seed: int) -> DataFrame:
    """``feature_id, permutation, sample_id, value``: a feature's stored values on random distinct samples; of so many permutations, or of those named."""
    own = permutations if isinstance(permutations, range) else range(permutations)
    p = features.sparkSession.range(own.start, own.stop).select(F.col("id").cast("int").alias("permutation"))
    features = features.select("feature_id").distinct()
    rows = samples.count() * features.count() * len(own) // LIGHT
    places = dealt(samples.select("sample_id"), rows, "sample_id").crossJoin(F.broadcast(features.crossJoin(p)))
    places = places.withColumn("_u", draw(seed, "mda", "feature_id", "permutation", "sample_id"))
    places = ranks.placed(places, ["feature_id", "permutation"], ["_u", "sample_id"], ranks.draw_block(F.col("_u"))).drop("n", "_u")
    values = x.join(F.broadcast(features), "feature_id", "left_semi").join(samples.select("sample_id").hint("merge"), "sample_id", "left_semi").select("feature_id", "sample_id", "value")
    values = ranks.placed(values, ["feature_id"], ["sample_id"], ranks.number_block(F.col("sample_id"))).select("feature_id", "place", "value")
    return places.join(values.hint("merge"), ["feature_id", "place"]).select("feature_id", "permutation", "sample_id", "value")


def rebuilt(folds: DataFrame, samples: DataFrame) -> DataFrame:
    """``fold, sample_id, y`` of folds stored by sample name; a name that no sample has is an error.

    ``folds``: fold, name. ``samples``: sample_id, name, y.
    """
    lost = folds.join(samples, "name", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} samples of the folds are not in the data")
    return folds.join(samples, "name").select("fold", "sample_id", "y")
