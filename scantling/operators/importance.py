"""Permutation importance: the fall of AUC when a feature's values are dealt anew."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources import shared
from . import dense, population, resampling, roc


def mda(models: DataFrame, scores: DataFrame, x: DataFrame, samples: DataFrame, permutations: int, seed: int) -> DataFrame:
    """``model_id, feature_id, importance`` of linear raw-value models.

    Only the changed term is rescored: score - c * old + c * new.
    """
    x, scores = x.persist(), scores.persist()  # read several times
    known = samples.filter("y < 2")
    t = models.select("model_id", F.explode("terms").alias("t")).select("model_id", F.col("t.f").alias("feature_id"), F.col("t.c").alias("c"))
    new = resampling.shuffled_feature(x, known, t.select("feature_id").distinct(), permutations, seed).withColumnRenamed("value", "new")
    p = t.sparkSession.range(permutations).select(F.col("id").cast("int").alias("permutation"))
    rows = scores.filter("y < 2").join(F.broadcast(t), "model_id").crossJoin(F.broadcast(p))
    rows = rows.join(x.withColumnRenamed("value", "old"), ["sample_id", "feature_id"], "left").join(new, ["sample_id", "feature_id", "permutation"], "left")
    rows = rows.withColumn("score", F.col("score") + F.col("c") * (F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
    permuted = roc.auc(rows, ("model_id", "feature_id", "permutation")).groupBy("model_id", "feature_id").agg(F.avg("auc").alias("permuted"))
    return permuted.join(roc.auc(scores), "model_id").select("model_id", "feature_id", (F.col("auc") - F.col("permuted")).alias("importance"))


def over_models(importance: DataFrame, n_models: int, by_prevalence: bool = False) -> DataFrame:
    """Mean and deviation over all models; a model without the feature counts as 0. ``by_prevalence``: as ``over_models_median``."""
    if by_prevalence:
        share = F.col("scope_pct")
        return over_models(importance, n_models).select("feature_id", (F.col("importance") * share).alias("importance"), (F.col("dispersion") * share).alias("dispersion"), "scope_pct")
    s, q = F.sum("importance"), F.sum(F.col("importance") * F.col("importance"))
    mean = s / n_models
    return importance.groupBy("feature_id").agg(mean.alias("importance"), F.sqrt(F.greatest(q / n_models - mean * mean, F.lit(0.0))).alias("dispersion"), (F.count("*") / n_models).alias("scope_pct"))


def over_folds(importance: DataFrame, n_folds: int) -> DataFrame:
    """Mean and deviation over folds (``fold, feature_id, importance``); share of folds in which a feature counted."""
    return importance.groupBy("feature_id").agg(F.avg("importance").alias("importance"), F.stddev_pop("importance").alias("dispersion"), (F.count_if(F.col("importance") > 0) / n_folds).alias("scope_pct"))


def of_collection(importance: DataFrame, significant: DataFrame, n_folds: int, aggregation: str = "mean") -> DataFrame:
    """``feature_id, importance, dispersion, scope_pct`` over folds (``fold, feature_id, importance``).

    ``significant``: fold, feature_id of the features that a fold's screening kept; their share is ``scope_pct``.
    """
    share = significant.groupBy("feature_id").agg((F.count("*") / n_folds).alias("scope_pct"))
    v = F.col("importance")
    if aggregation == "median":
        middle = importance.groupBy("feature_id").agg(F.median(v).alias("m"))
        out = importance.join(middle, "feature_id").groupBy("feature_id").agg(F.first("m").alias("importance"), (F.median(F.abs(v - F.col("m"))) * 1.4826).alias("dispersion"))
    else:
        out = importance.groupBy("feature_id").agg(F.avg(v).alias("importance"), F.stddev_pop(v).alias("dispersion"))
    return out.join(share, "feature_id", "left").select("feature_id", "importance", "dispersion", F.coalesce("scope_pct", F.lit(0.0)).alias("scope_pct"))


def pruned(models: DataFrame, importance: DataFrame, threshold: float, min_k: int = 1) -> DataFrame:
    """Models without the terms whose importance is under the threshold; the best ``min_k`` stay always."""
    w = Window.partitionBy("model_id").orderBy(F.col("importance").desc(), "feature_id")
    keep = importance.withColumn("place", F.row_number().over(w)).filter((F.col("importance") >= threshold) | (F.col("place") <= min_k))
    kept = keep.groupBy("model_id").agg(F.collect_set("feature_id").alias("_keep"))
    return models.join(kept, "model_id").withColumn("terms", F.filter("terms", lambda t: F.array_contains("_keep", t["f"]))).drop("_keep")


def top_share(importance: DataFrame, share: float) -> DataFrame:
    """The most important share of features, one at least."""
    return importance.orderBy(F.col("importance").desc(), "feature_id").limit(max(1, ceil(importance.count() * share)))


def of(importances: DataFrame, feature_id: int | None = None, least: float | None = None) -> DataFrame:
    """The rows of one feature, or of at least some importance."""
    if feature_id is not None:
        importances = importances.filter(F.col("feature_id") == feature_id)
    return importances if least is None else importances.filter(F.col("importance") >= least)


#: Permuted values that tasks share, at most; and that are dealt at a time over blocks, about (a column of values at least).
MOST_PERMUTED, WAVE = 2_000_000, 24_000_000


def permuted_columns(x: DataFrame, matrix: dense.Matrix, features: DataFrame, permutations: int, seed: int) -> dict[int, np.ndarray]:
    """Feature to its values (permutations x known samples of the matrix), dealt as ``resampling.shuffled_feature`` does."""
    known = matrix.samples[matrix.y < 2]
    n = features.select("feature_id").distinct().count()
    if n * permutations * len(known) > MOST_PERMUTED:
        raise ValueError(f"{n} x {permutations} x {len(known)} permuted values; use importance.mda")
    samples = features.sparkSession.createDataFrame(pd.DataFrame({"sample_id": known}))
    rows = resampling.shuffled_feature(x, samples, features, permutations, seed).toPandas()
    out = {}
    for f, own in rows.groupby("feature_id"):
        v = np.zeros((permutations, len(known)))
        v[own["permutation"], np.searchsorted(known, own["sample_id"])] = own["value"]
        out[int(f)] = v
    return out


def of_models(models: DataFrame, matrix: dense.Matrix, x: DataFrame, permutations: int, seed: int, language: str = "ternary", data_type: str = "raw", epsilon: float = dense.EPSILON) -> DataFrame:
    """``model_id, feature_id, importance`` of models of any language and data type (of several, separated by commas, each model's own).

    A permuted column takes the place of the feature's own in the block; the rest of the model is as it was.
    """
    models = population.listed(models)
    features = models.select(F.explode("terms.f").alias("feature_id"))
    if not matrix.one or features.distinct().count() * permutations * matrix.size > MOST_PERMUTED:
        return of_models_in_blocks(models, matrix, x, permutations, seed, language, data_type, epsilon)
    held = models.sparkSession.sparkContext.broadcast((matrix.whole, permuted_columns(x, matrix, features, permutations, seed)))

    read = scoring.kinds(language, data_type)

    def run(batches):
        m, columns = held.value
        m = m.rows(m.y < 2)
        g = {own: m.read(own, epsilon) for _, own in read}
        for pdf in batches:
            out = []
            for model_id, f, c, kind, values_of in zip(pdf["model_id"], pdf["f"], pdf["c"], pdf["language"], pdf["data_type"]):
                at, c = np.searchsorted(m.features, f), np.asarray(c, float)
                part, own = g[values_of][:, at].copy(), np.arange(len(at))
                base = dense.auc(m.scores(own, c, kind, part, values_of, epsilon), m.y)
                for k, feature in enumerate(f):
                    kept, falls = part[:, k].copy(), []
                    for values in m.as_read(columns.get(int(feature), np.zeros((permutations, len(m.y)))), at[k], values_of, epsilon):
                        part[:, k] = values
                        falls.append(base - dense.auc(m.scores(own, c, kind, part, values_of, epsilon), m.y))
                    part[:, k] = kept
                    out.append((model_id, int(feature), float(np.mean(falls))))
            yield pd.DataFrame(out, columns=["model_id", "feature_id", "importance"])

    return dense.with_kind(models, language, data_type).mapInPandas(run, "model_id long, feature_id int, importance double")


def waves(features: list[int], permutations: int, samples: int, most: int) -> list[tuple[list[int], range]]:
    """Features and permutations in steps of about ``most`` values: some features, or one with some of its permutations."""
    n = max(1, min(permutations, most // max(samples, 1)))
    n = -(-permutations // -(-permutations // n))  # about as many in each
    some = max(1, most // max(samples * permutations, 1)) if n == permutations else 1
    return [(features[k : k + some], range(p, min(p + n, permutations))) for k in range(0, len(features), some) for p in range(0, permutations, n)]


def permuted_blocks(x: DataFrame, matrix: dense.Matrix, features: DataFrame, permutations: int | range, seed: int, own: list[int] | None = None) -> tuple[DataFrame, int]:
    """A matrix's blocks once for each ``part`` with ``moved``, features with values there, and beside each (as bytes) its samples, permutations and values; and the number of parts.

    The feature at place k of ``own`` (the matrix's, if not given) is of part k modulo that number: so many that the
    permuted values of a part are no more than a block's cells, and that each task can have one.
    """

    def ids(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                yield pd.DataFrame({"sample_id": np.frombuffer(row.samples, np.int64)[np.frombuffer(row.y) < 2]})

    def pack(key, v: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(key[0])], "part": [int(key[1])], "moved": [int(key[2])], "ids": [v["sample_id"].to_numpy(np.int64).tobytes()], "places": [v["permutation"].to_numpy(np.int32).tobytes()], "new": [v["value"].to_numpy(float).tobytes()]})

    own = [int(f) for f in matrix.features] if own is None else own
    spark, all_, several = features.sparkSession, len(own), len(permutations) if isinstance(permutations, range) else permutations
    parts = max(1, min(all_, max(-(-all_ * several * min(matrix.size, dense.ROWS) // dense.CELLS), -(-spark.sparkContext.defaultParallelism // matrix.count))))
    tasks = matrix.count * parts
    known = matrix.blocks.select("samples", "y").mapInPandas(ids, "sample_id long")
    rows = resampling.shuffled_feature(x, known, features, permutations, seed)
    of = spark.createDataFrame([(f, k % parts) for k, f in enumerate(own)], "feature_id int, part int")
    rows = rows.join(F.broadcast(of), "feature_id").withColumn("block", F.pmod(F.xxhash64("sample_id"), F.lit(matrix.count)))
    rows = rows.repartition(dense.SPREAD * tasks, "block", "part")  # what a task sorts is a few parts of a block
    moved = rows.groupBy("block", "part", "feature_id").applyInPandas(pack, "block long, part int, moved int, ids binary, places binary, new binary")
    moved = moved.groupBy("block", "part").agg(*[F.collect_list(c).alias(c) for c in ("moved", "ids", "places", "new")])
    every = matrix.blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    every = every.repartition(dense.SPREAD * tasks, "block", "part").join(moved.hint("merge"), ["block", "part"], "left")
    return every.select(*matrix.blocks.columns, "part", *[F.coalesce(c, F.array().cast(moved.schema[c].dataType)).alias(c) for c in moved.columns[2:]]), parts


def of_models_in_blocks(models: DataFrame, matrix: dense.Matrix, x: DataFrame, permutations: int, seed: int, language: str, data_type: str, epsilon: float) -> DataFrame:
    """As ``of_models``: permuted columns come to each block by parts of the features, and AUCs from the tie groups of all blocks.

    Columns are permuted in steps (``waves``), whose shuffle files go when their sums of AUCs are known, so the disk in
    use doesn't grow with features and permutations. A row for each term of a model comes to the driver.
    """
    spark = models.sparkSession
    features = sorted(int(r[0]) for r in models.select(F.explode("terms.f")).distinct().collect())
    x = x.persist()  # read by permutations and, before, by the matrix
    sums = []
    with shared.shuffles_dropped(spark):
        for some, perms in waves(features, permutations, matrix.size, WAVE):
            beside, parts = permuted_blocks(x, matrix, spark.createDataFrame([(f,) for f in some], "feature_id int"), perms, seed, some)
            g = dense.tied(models, matrix, permuted_scores({f: k % parts for k, f in enumerate(some)}, perms, epsilon), "model_id long, feature_id int, permutation int", language, data_type, epsilon, beside)
            sums += dense.auc_of(g, ("model_id", "feature_id", "permutation")).groupBy("model_id", "feature_id").agg(F.sum("auc"), F.count("auc")).collect()
        whole = dense.tied(models, matrix, lambda model, b, g, row: [((model[0],), dense.scored(b, g, model, epsilon), b.y)], "model_id long", language, data_type, epsilon)
        whole = population.listed(dense.auc_of(whole))
    sums = spark.createDataFrame(sums, "model_id long, feature_id int, total double, n long")
    after = sums.groupBy("model_id", "feature_id").agg((F.sum("total") / F.sum("n")).alias("permuted"))
    terms = models.select("model_id", F.explode("terms.f").alias("feature_id"))
    auc = lambda c: F.coalesce(c, F.lit(0.5))
    return terms.join(whole, "model_id", "left").join(after, ["model_id", "feature_id"], "left").select("model_id", "feature_id", (auc("auc") - auc("permuted")).alias("importance"))


def permuted_scores(part_of: dict[int, int], perms: range, epsilon: float):
    """What ``dense.tied`` emits: scores of a model with one of its features permuted, of those features that are of a row's part."""

    def emit(model, b, g, row):
        model_id, f, c, kind, values_of = model
        mine = [k for k, feature in enumerate(f) if part_of.get(int(feature)) == row.part]
        if not mine:
            return
        known = b.y < 2
        samples, y = b.samples[known], b.y[known]
        at, c = np.searchsorted(b.features, f), np.asarray(c, float)
        whole, own = np.asfortranarray(g[values_of][:, at][known]), np.arange(len(at))
        held = {int(v): n for n, v in enumerate(row.moved)}
        for k in mine:
            new, part = np.zeros((len(perms), len(samples))), whole.copy(order="F")
            n = held.get(int(f[k]))  # a feature without values in a block is permuted too
            if n is not None:
                new[np.frombuffer(row.places[n], np.int32) - perms.start, np.searchsorted(samples, np.frombuffer(row.ids[n], np.int64))] = np.frombuffer(row.new[n])
            for p, values in zip(perms, b.as_read(new, at[k], values_of, epsilon)):
                part[:, k] = values
                yield (model_id, int(f[k]), p), b.scores(own, c, kind, part, values_of, epsilon), y

    return emit


def quantile_threshold(importance: DataFrame, quantile: float, margin: float = 0.0) -> DataFrame:
    """``model_id, threshold``: each model's own quantile of importance (linear between neighbours), less the margin."""
    return importance.groupBy("model_id").agg((F.percentile("importance", F.lit(quantile)) - margin).alias("threshold"))


def pruned_by_quantile(models: DataFrame, importance: DataFrame, quantile: float, margin: float = 0.0, min_k: int = 1) -> DataFrame:
    """As ``pruned``, with a threshold of each model's own."""
    importance = population.listed(importance)  # a row for each term of a model, read twice
    own = importance.join(quantile_threshold(importance, quantile, margin), "model_id")
    return pruned(models, own.withColumn("importance", F.col("importance") - F.col("threshold")).drop("threshold"), 0.0, min_k)


def over_models_median(importance: DataFrame, n_models: int, by_prevalence: bool = False) -> DataFrame:
    """``feature_id, importance, dispersion, scope_pct``: median and scaled median deviation over all models.

    A model without the feature counts as 0: as one value with the number of such models as its
    frequency. ``by_prevalence`` multiplies both by the share of models with the feature.
    """
    importance = population.listed(importance)  # a row for each term of a model, read five times
    own = importance.select("feature_id", F.col("importance").alias("v"), F.lit(1).cast("long").alias("n"))
    rest = importance.groupBy("feature_id").agg(F.lit(0.0).alias("v"), (F.lit(n_models) - F.count("*")).alias("n"))
    every = own.unionByName(rest.filter("n > 0"))
    middle = every.groupBy("feature_id").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("m"))
    share = importance.groupBy("feature_id").agg((F.count("*") / n_models).alias("scope_pct"))
    spread = every.join(middle, "feature_id").groupBy("feature_id").agg((F.percentile(F.abs(F.col("v") - F.col("m")), F.lit(0.5), F.col("n")) * 1.4826).alias("dispersion"))
    scale = F.col("scope_pct") if by_prevalence else F.lit(1.0)
    return middle.join(spread, "feature_id").join(share, "feature_id").select("feature_id", (F.col("m") * scale).alias("importance"), (F.col("dispersion") * scale).alias("dispersion"), "scope_pct")
