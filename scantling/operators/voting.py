"""Juries: weighted votes of models on samples.

``votes``: model_id, sample_id, y, vote (0, 1, 2 = abstain). ``experts``: model_id, weight and,
with specialists, ``side`` (balanced, positive, negative, ineffective).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jury(models: DataFrame, min_perf: float = 0.5, max_experts: int = 0) -> DataFrame:
    """Ranked experts that reach ``min_perf`` on both sides; an even limit is lowered by one."""
    kept = models.filter((F.col("sensitivity") >= min_perf) & (F.col("specificity") >= min_perf))
    if max_experts:
        n = max_experts - 1 if max_experts % 2 == 0 else max_experts
        kept = kept.withColumn("_o", F.row_number().over(Window.orderBy("rank"))).filter(F.col("_o") <= n).drop("_o")
    return kept


def specialized(models: DataFrame, sens: float = 0.7, spec: float = 0.7) -> DataFrame:
    """``side`` and ``weight``: each side that has experts gets an equal share of the weight; ineffective ones none."""
    a, b = F.col("sensitivity") >= sens, F.col("specificity") >= spec
    side = F.when(a & b, "balanced").when(a, "positive").when(b, "negative").otherwise("ineffective")
    m = models.withColumn("side", side)
    sides = m.filter("side <> 'ineffective'").agg(F.countDistinct("side").alias("_sides"))
    m = m.crossJoin(F.broadcast(sides)).withColumn("_n", F.count("*").over(Window.partitionBy("side")))
    return m.withColumn("weight", F.when(F.col("side") == "ineffective", 0.0).otherwise(1 / F.col("_sides") / F.col("_n"))).drop("_sides", "_n")


def counted(votes: DataFrame, experts: DataFrame) -> DataFrame:
    """Per sample: positive and total weight of votes that count."""
    v = votes.join(F.broadcast(experts), "model_id")
    counts = (F.col("vote") != 2) & (F.col("weight") > 0)
    if "side" in experts.columns:
        counts = counts & ~((F.col("side") == "positive") & (F.col("vote") == 0)) & ~((F.col("side") == "negative") & (F.col("vote") == 1)) & (F.col("side") != "ineffective")
    w = F.when(counts, F.col("weight")).otherwise(0.0)
    return v.groupBy("sample_id").agg(F.first("y").alias("y"), F.sum(F.when(F.col("vote") == 1, w).otherwise(0.0)).alias("pos"), F.sum(w).alias("total"))


def ratio() -> Column:
    return F.col("pos") / F.when(F.col("total") > 0, F.col("total"))


def majority(votes: DataFrame, experts: DataFrame, threshold: float = 0.5, window: float = 0.0) -> DataFrame:
    """``sample_id, y, ratio, predicted``; abstains within ``window`` percent of the threshold, or without votes."""
    c = counted(votes, experts).withColumn("ratio", F.coalesce(ratio(), F.lit(0.5)))
    p = F.when(F.col("total") <= 0, 2).when(F.abs(F.col("ratio") - threshold) < window / 100, 2).when(F.col("ratio") >= threshold, 1).otherwise(0)
    return c.select("sample_id", "y", "ratio", p.alias("predicted"))


def consensus(votes: DataFrame, experts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A class needs the threshold's share of the weight; otherwise, or without votes, abstains."""
    c = counted(votes, experts)
    r, neg = ratio(), (F.col("total") - F.col("pos")) / F.when(F.col("total") > 0, F.col("total"))
    p = F.when(F.col("total") <= 0, 2).when(r >= threshold, 1).when(neg >= threshold, 0).otherwise(2)
    return c.select("sample_id", "y", F.coalesce(r, F.lit(-1.0)).alias("ratio"), p.alias("predicted"))


def threshold_grid(votes: DataFrame, experts: DataFrame, step: float) -> DataFrame:
    """``threshold, youden`` of every majority threshold on a grid; the first maximum is ``best``."""
    c = counted(votes, experts).withColumn("ratio", F.coalesce(ratio(), F.lit(0.5))).filter("y < 2")
    steps = round(1 / step)
    g = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("threshold", F.col("i") / steps)
    one = (F.col("total") > 0) & (F.col("ratio") >= F.col("threshold"))
    m = g.groupBy("i", "threshold").agg(*[F.count_if(e).alias(n) for n, e in (("tp", (F.col("y") == 1) & one), ("p", F.col("y") == 1), ("tn", (F.col("y") == 0) & ~one), ("n", F.col("y") == 0))])
    m = m.select("i", "threshold", (F.col("tp") / F.col("p") + F.col("tn") / F.col("n") - 1.0).alias("youden"))
    return m.withColumn("best", F.row_number().over(Window.orderBy(F.round("youden", 12).desc(), "i")) == 1).drop("i")


def grid_step(samples: int) -> float:
    """Thresholds are tried at finer steps the more samples there are."""
    return 0.1 if samples <= 50 else 0.05 if samples <= 200 else 0.01


def youden_grid(votes: DataFrame, experts: DataFrame, step: float, window: float = 0.0) -> DataFrame:
    """``i, threshold, youden`` of the majority thresholds inside (0, 1), of samples on which the jury doesn't abstain.

    Ratios are counted first, so the grid multiplies distinct ratios, not samples.
    """
    steps = round(1 / step)
    c = counted(votes, experts).filter("y < 2 and total > 0").groupBy(ratio().alias("ratio")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    g = c.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps - 1)))).withColumn("threshold", F.col("i") * F.lit(step))
    g = g.filter(F.abs(F.col("ratio") - F.col("threshold")) >= window / 100)
    one = F.col("ratio") >= F.col("threshold")
    m = g.groupBy("i", "threshold").agg(*[F.sum(F.when(cond, F.col(k)).otherwise(0)).alias(name) for name, cond, k in (("tp", one, "p"), ("fn", ~one, "p"), ("fp", one, "n"), ("tn", ~one, "n"))])
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return m.select("i", "threshold", (share("tp", "fn") + share("tn", "fp") - 1.0).alias("youden"))


def fitted_threshold(votes: DataFrame, experts: DataFrame, samples: int, window: float = 0.0) -> float:
    """The lowest threshold of the highest Youden index above 0; one half if there is none."""
    best = youden_grid(votes, experts, grid_step(samples), window).filter(F.round("youden", 12) > 0).orderBy(F.round("youden", 12).desc(), "i").first()
    return best["threshold"] if best else 0.5


def inconsistency(votes: DataFrame) -> DataFrame:
    """``sample_id, inconsistency``: one less the share of the most frequent vote, abstentions being votes."""
    n = votes.groupBy("sample_id", "vote").agg(F.count("*").alias("n"))
    return n.groupBy("sample_id").agg((1 - F.max("n") / F.sum("n")).alias("inconsistency"))


def categories(predicted: DataFrame, inconsistent: DataFrame) -> DataFrame:
    """Errors, abstentions and correct samples, each by inconsistency."""
    kind = F.when(F.col("predicted") == 2, "abstention").when(F.col("predicted") == F.col("y"), "correct").otherwise("error")
    rows = predicted.filter("y < 2").join(inconsistent, "sample_id").select("sample_id", kind.alias("kind"), "inconsistency")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("inconsistency").desc(), "sample_id")))
