"""Ant colony: pheromone tables, construction by weighted draws without replacement, update."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw
from . import dense, goals, population

TAU = (0.01, 1.0)


def fresh(features: DataFrame, tau: float = TAU[1]) -> DataFrame:
    return features.select("feature_id").distinct().select("feature_id", F.lit(tau).alias("tau_pos"), F.lit(tau).alias("tau_neg"))


def heuristic(selection: DataFrame) -> DataFrame:
    """``feature_id, eta``: 1 / (p + 1e-10) of a significance in [0, 1], else its size."""
    s = F.col("significance")
    return selection.select("feature_id", F.when((s >= 0) & (s <= 1), 1 / (s + 1e-10)).otherwise(F.abs(s)).alias("eta"))


def probabilities(pheromone: DataFrame, eta: DataFrame, alpha: float = 1.0, beta: float = 2.0) -> DataFrame:
    """``feature_id, weight, p, p_pos``: chance of a feature, and of its positive sign."""
    total = F.col("tau_pos") + F.col("tau_neg")
    w = pheromone.join(eta, "feature_id").withColumn("weight", F.pow(total, alpha) * F.pow("eta", beta))
    return w.select("feature_id", "weight", (F.col("weight") / F.sum("weight").over(Window.partitionBy())).alias("p"), (F.col("tau_pos") / total).alias("p_pos"))


def construct(probs: DataFrame, ants: int, k_min: int, k_max: int, seed: int) -> DataFrame:
    """``model_id, terms``: features by smallest -ln(u) / weight, which draws without replacement; sign by its share."""
    m = probs.sparkSession.range(ants).select(F.col("id").alias("model_id")).withColumn("k", F.lit(k_min) + draw(seed, "ant", "model_id") % (k_max - k_min + 1))
    u = (draw(seed, "walk", "model_id", "feature_id") + 1) / F.lit(4294967297.0)
    rows = m.crossJoin(F.broadcast(probs)).withColumn("o", F.row_number().over(Window.partitionBy("model_id").orderBy(F.round(-F.ln(u) / F.col("weight"), 15), "feature_id"))).filter("o <= k")
    sign = F.when(draw(seed, "sign", "model_id", "feature_id") / F.lit(4294967296.0) < F.col("p_pos"), 1).otherwise(-1)
    return rows.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature_id").alias("f"), sign.cast("int").alias("c")))).alias("terms"))


def evaporate(pheromone: DataFrame, rho: float, low: float = TAU[0]) -> DataFrame:
    return pheromone.select("feature_id", *[F.greatest(F.col(c) * (1 - rho), F.lit(low)).alias(c) for c in ("tau_pos", "tau_neg")])


def deposit(pheromone: DataFrame, models: DataFrame, amount: str = "amount", high: float = TAU[1]) -> DataFrame:
    """Adds each model's amount to its terms by sign."""
    t = models.select(F.col(amount).alias("d"), F.explode("terms").alias("t"))
    t = t.groupBy(F.col("t.f").alias("feature_id")).agg(F.sum(F.when(F.col("t.c") > 0, F.col("d")).otherwise(0.0)).alias("dp"), F.sum(F.when(F.col("t.c") < 0, F.col("d")).otherwise(0.0)).alias("dn"))
    j = pheromone.join(t, "feature_id", "left")
    return j.select("feature_id", F.least(F.col("tau_pos") + F.coalesce("dp", F.lit(0.0)), F.lit(high)).alias("tau_pos"), F.least(F.col("tau_neg") + F.coalesce("dn", F.lit(0.0)), F.lit(high)).alias("tau_neg"))


def trimmed(models: DataFrame, matrix: dense.Matrix, k_penalty: float = 0.0, language: str = "ternary", data_type: str = "raw", epsilon: float = dense.EPSILON) -> DataFrame:
    """``model_id, terms``: each model without the terms it is as good without.

    Terms are tried in order; one goes if the AUC without it, less the size penalty, is at least that
    of the whole model at the size before. A model keeps one term.
    """
    if not matrix.one:
        return trimmed_in_rounds(models, matrix, k_penalty, language, data_type, epsilon)
    shared = models.sparkSession.sparkContext.broadcast(matrix.whole)

    def run(batches):
        m = shared.value
        m = m.rows(m.y < 2)
        g = m.read(data_type, epsilon)
        for pdf in batches:
            out = []
            for f, c in zip(pdf["f"], pdf["c"]):
                f, c = np.asarray(f), np.asarray(c, float)
                at, keep = np.searchsorted(m.features, f), np.ones(len(f), bool)
                whole = dense.auc(m.scores(at, c, language, g, data_type, epsilon), m.y)
                for k in range(len(f)):
                    if keep.sum() == 1:
                        break
                    keep[k] = False
                    less = dense.auc(m.scores(at[keep], c[keep], language, g, data_type, epsilon), m.y)
                    keep[k] = round(less - whole + k_penalty, dense.DIGITS) < 0
                out.append([{"f": int(a), "c": int(b)} for a, b, x in zip(f, c, keep) if x])
            yield pd.DataFrame({"model_id": pdf["model_id"], "terms": out})

    return models.select("model_id", F.col("terms.f").alias("f"), F.col("terms.c").alias("c")).mapInPandas(run, "model_id long, terms array<struct<f:int,c:int>>")


def trimmed_in_rounds(models: DataFrame, matrix: dense.Matrix, k_penalty: float, language: str, data_type: str, epsilon: float) -> DataFrame:
    """As ``trimmed``: the k-th term of all models is tried at once, over the matrix's blocks."""
    spark, schema = models.sparkSession, "model_id long, terms array<struct<f:int,c:int>>"
    own = {r["model_id"]: [(t["f"], t["c"]) for t in r["terms"]] for r in models.select("model_id", "terms").collect()}  # a list of models
    keep = {i: [True] * len(t) for i, t in own.items()}

    def aucs(rows: dict) -> dict:
        return {r["model_id"]: r["auc"] for r in dense.fit(spark.createDataFrame(list(rows.items()), schema), matrix, language, data_type, epsilon).collect()} if rows else {}

    whole = aucs({i: t for i, t in own.items() if len(t) > 1})
    for k in range(max(map(len, own.values()), default=0)):
        tried = {i: [x for j, x in enumerate(t) if keep[i][j] and j != k] for i, t in own.items() if k < len(t) and sum(keep[i]) > 1}
        less = aucs(tried)
        for i in tried:
            keep[i][k] = round(less.get(i, 0.5) - whole.get(i, 0.5) + k_penalty, dense.DIGITS) < 0
    return spark.createDataFrame([(i, [x for x, a in zip(t, keep[i]) if a]) for i, t in own.items()], schema)


#: Models of an iteration whose terms are tried.
TRIMMED = 5


def entropy(pheromone: DataFrame) -> DataFrame:
    """Entropy of the features' pheromone over its maximum: 1 without pheromone, 0 with one feature."""
    t = F.col("tau_pos") + F.col("tau_neg")
    rows = pheromone.select(t.alias("t")).withColumn("s", F.sum("t").over(Window.partitionBy())).withColumn("n", F.count("*").over(Window.partitionBy()))
    p = F.col("t") / F.when(F.col("s") > 0, F.col("s"))
    h = F.sum(F.when(p > 0, -p * F.ln(F.when(p > 0, p))).otherwise(0.0))
    out = rows.groupBy().agg(h.alias("h"), F.max("n").alias("n"), F.max("s").alias("s"))
    return out.select(F.when(F.col("s") <= 0, 1.0).when(F.col("n") == 1, 0.0).otherwise(F.col("h") / F.ln(F.when(F.col("n") > 1, F.col("n")))).alias("entropy"))


def top(pheromone: DataFrame, n: int) -> DataFrame:
    return pheromone.withColumn("tau", F.col("tau_pos") + F.col("tau_neg")).orderBy(F.round("tau", 12).desc(), "feature_id").limit(n)


def search(selection: DataFrame, matrix: dense.Matrix, ants: int = 50, iterations: int = 8, k_min: int = 2, k_max: int = 8, rho: float = 0.1, elite_weight: float = 2.0, k_penalty: float = 0.0, language: str = "ternary", seed: int = 4815162342, goal: goals.Goal | None = None, data_type: str = "raw", epsilon: float = dense.EPSILON) -> DataFrame:
    """All distinct models of the last iteration and the best ever, ranked."""
    spark, selection = selection.sparkSession, population.listed(selection)
    eta = heuristic(selection)
    tau, best = fresh(selection), None
    for i in range(iterations):
        models = construct(probabilities(tau, eta), ants, k_min, k_max, seed + i)
        models = models.withColumn("model_id", F.col("model_id") + i * (1 << 32)).withColumn("term_key", population.term_key()).withColumn("k", F.size("terms").cast("long"))
        models = population.remove_clones(population.remove_stillborn(models, language))
        aim = goal or goals.Goal(k_penalty=k_penalty)
        first = population.listed(population.ranked(goals.fitted(models, matrix, aim, language, data_type, epsilon)))  # at most one per ant
        columns = ["model_id", "terms"]
        less = trimmed(first.filter(F.col("rank") < TRIMMED), matrix, aim.k_penalty, language, data_type, epsilon) if aim.fold is None and not aim.regression else first.filter(F.col("rank") < TRIMMED).select(columns)
        models = first.filter(F.col("rank") >= TRIMMED).select(columns).unionByName(less).withColumn("term_key", population.term_key()).withColumn("k", F.size("terms").cast("long"))
        models = population.remove_clones(population.remove_stillborn(models, language))
        out = population.ranked(goals.fitted(population.listed(models), matrix, aim, language, data_type, epsilon))
        rows = out.collect()  # at most one per ant
        if not rows:
            continue
        now = spark.createDataFrame(rows, out.schema)
        lead = min(rows, key=lambda r: r["rank"])
        best = lead if best is None or lead["fit"] > best["fit"] else best
        gifts = spark.createDataFrame([(lead["terms"], lead["fit"] / lead["k"]), (best["terms"], elite_weight * best["fit"] / best["k"])], out.select("terms", F.lit(0.0).alias("amount")).schema)
        updated = deposit(evaporate(tau, rho), gifts)
        tau = spark.createDataFrame(updated.collect(), updated.schema)  # one row per feature
        last = now
    return population.ranked(population.remove_clones(last.drop("rank").unionByName(spark.createDataFrame([best], out.schema).drop("rank")).dropDuplicates(["model_id"])))
