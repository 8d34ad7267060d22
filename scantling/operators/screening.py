"""Feature screening: two-sample tests over sparse columns, false-discovery control, selection.

Zeros aren't stored and aren't made: each feature has one group of tied zeros, whose size is the
class size less the stored values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distributions import student_two_sided, upper_normal


def class_sizes(samples: DataFrame) -> DataFrame:
    y = F.col("y")
    return samples.agg(F.count_if(y == 0).cast("double").alias("n0"), F.count_if(y == 1).cast("double").alias("n1"))


def class_sums(x: DataFrame, samples: DataFrame) -> DataFrame:
    """Per feature and class: stored values, their sum and sum of squares."""
    y, v = F.col("y"), F.col("value")
    own = x.join(samples.filter(y.isin(0.0, 1.0)).hint("merge"), "sample_id")
    pick = lambda k, e: F.sum(F.when(y == k, e).otherwise(0.0))
    return own.groupBy("feature_id").agg(*[pick(k, e).alias(f"{n}{k}") for k in (0, 1) for n, e in (("c", F.lit(1.0)), ("s", v), ("q", v * v))])


def passes(sums: DataFrame, min_prevalence: float, min_mean: float, stored_only: bool = False):
    """A feature fails only if both classes are under a minimum."""
    bottom = lambda k: F.when(F.col(f"c{k}") > 0, F.col(f"c{k}")).otherwise(1.0) if stored_only else F.col(f"n{k}")
    prev = [F.col(f"c{k}") / F.col(f"n{k}") for k in (0, 1)]
    mean = [F.col(f"s{k}") / bottom(k) for k in (0, 1)]
    return ~((prev[0] < min_prevalence) & (prev[1] < min_prevalence)), ~((mean[0] < min_mean) & (mean[1] < min_mean))


def by_mean(alpha: float):
    """Class with the higher mean where p is below alpha, else 2."""
    m0, m1 = F.col("s0") / F.col("n0"), F.col("s1") / F.col("n1")
    return F.when(F.col("p") < alpha, F.when(m0 > m1, 0).otherwise(1)).otherwise(2)


def wilcoxon(x: DataFrame, samples: DataFrame, alpha: float = 0.05, min_prevalence: float = 0.0, min_mean: float = 0.0) -> DataFrame:
    """``feature_id, z, p, class``: rank sum test with mid-ranks, tie and continuity correction."""
    y = F.col("y")
    known = samples.filter(y.isin(0.0, 1.0))
    sizes = class_sizes(samples)
    stored = x.join(known.hint("merge"), "sample_id").groupBy("feature_id", "value").agg(F.count_if(y == 0).cast("double").alias("t0"), F.count_if(y == 1).cast("double").alias("t1"))
    sums = class_sums(x, samples).crossJoin(F.broadcast(sizes))
    zeros = sums.select("feature_id", F.lit(0.0).alias("value"), (F.col("n0") - F.col("c0")).alias("t0"), (F.col("n1") - F.col("c1")).alias("t1"))
    w = Window.partitionBy("feature_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("t0") + F.col("t1")
    groups = stored.unionByName(zeros).groupBy("feature_id", "value").agg(F.sum("t0").alias("t0"), F.sum("t1").alias("t1")).withColumn("before", F.coalesce(F.sum(t).over(w), F.lit(0.0)))
    ranks = groups.groupBy("feature_id").agg(F.sum(F.col("t0") * (F.col("before") + (t + 1) / 2)).alias("r0"), F.sum(t * t * t - t).alias("ties"))
    d = ranks.join(sums, "feature_id")
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    diff = F.col("r0") - n0 * (n0 + 1) / 2 - n0 * n1 / 2
    std = F.sqrt(n0 * n1 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    d = d.withColumn("z", (F.abs(diff) - 0.5) / std * F.when(diff < 0, -1.0).otherwise(1.0))
    prev, mean = passes(d, min_prevalence, min_mean)
    d = d.withColumn("p", F.when(prev & mean & (n0 > 0) & (n1 > 0), 2 * upper_normal(F.abs("z"))).otherwise(2.0))
    return d.select("feature_id", "z", "p", by_mean(alpha).alias("class"))


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_two_sided(a, b) for a, b in zip(t, df)])


def student_t(x: DataFrame, samples: DataFrame, alpha: float = 0.05, min_prevalence: float = 0.0, min_mean: float = 0.0) -> DataFrame:
    """``feature_id, t, p, class``: two-sided test with pooled variance; p is 2 where it isn't made."""
    d = class_sums(x, samples).crossJoin(F.broadcast(class_sizes(samples)))
    n0, n1 = F.col("n0"), F.col("n1")
    m0, m1 = F.col("s0") / n0, F.col("s1") / n1
    square = (F.col("q0") - n0 * m0 * m0) + (F.col("q1") - n1 * m1 * m1)
    pooled = F.sqrt(F.greatest(square, F.lit(0.0)) / (n0 + n1 - 2))
    t = (m0 - m1) / (F.when(pooled > 0, pooled) * F.sqrt(1 / n0 + 1 / n1))
    prev, mean = passes(d, min_prevalence, min_mean)
    d = d.withColumn("t", t).withColumn("p", F.when(prev & mean & F.col("t").isNotNull(), student_p(F.coalesce("t", F.lit(0.0)), n0 + n1 - 2)).otherwise(2.0))
    return d.select("feature_id", "t", "p", by_mean(alpha).alias("class"))


def fisher_bayes(x: DataFrame, samples: DataFrame, min_log_factor: float = 2.0, min_prevalence: float = 0.0, min_mean: float = 0.0) -> DataFrame:
    """``feature_id, value, class``: |log10| of the ratio of the two one-sided exact tests on presence."""
    sizes = class_sizes(samples)
    d = class_sums(x.filter("value >= 0"), samples).crossJoin(F.broadcast(sizes))
    logs = samples.sparkSession.range(1).join(F.broadcast(sizes)).select(F.transform(F.sequence(F.lit(0), (F.col("n0") + F.col("n1")).cast("int")), lambda i: F.ln(F.greatest(i, F.lit(1)).cast("double"))).alias("ln"))
    logs = logs.select(F.posexplode("ln").alias("i", "v")).select("i", F.sum("v").over(Window.orderBy("i")).alias("lf")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lf"))), lambda s: s["lf"]).alias("lf"))
    d = d.crossJoin(F.broadcast(logs))
    lf = lambda c: F.element_at("lf", c.cast("int") + 1)
    a, present, n0, n = F.col("c0"), F.col("c0") + F.col("c1"), F.col("n0"), F.col("n0") + F.col("n1")
    choose = lambda m, k: lf(m) - lf(k) - lf(m - k)
    low, high = F.greatest(F.lit(0.0), n0 - (n - present)), F.least(present, n0)
    prob = lambda k: F.exp(choose(present, k) + choose(n - present, n0 - k) - choose(n, n0))
    tail = lambda lo, hi: F.aggregate(F.transform(F.sequence(lo.cast("int"), hi.cast("int")), lambda k: prob(k.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    tiny = 2.2250738585072014e-308
    factor = F.log10(F.greatest(tail(a, high), F.lit(tiny))) - F.log10(F.greatest(tail(low, a), F.lit(tiny)))
    prev, mean = passes(d, min_prevalence, min_mean, stored_only=True)
    d = d.select("feature_id", factor.alias("f"), prev.alias("prev"), mean.alias("mean"))
    sure = F.abs("f") >= min_log_factor
    value = F.when(~F.col("prev"), 2.0).when(~F.col("mean"), 0.0).when(sure, F.abs("f")).otherwise(0.0)
    return d.select("feature_id", value.alias("value"), F.when(F.col("prev") & F.col("mean") & sure, F.when(F.col("f") < 0, 0).otherwise(1)).otherwise(2).alias("class"))


RELAXED, LEAST = (0.1, 0.2, 0.5), 10


def false_discovery(tests: DataFrame, alpha: float) -> DataFrame:
    """Tests kept by Benjamini and Hochberg; with fewer than ten, at the next relaxed levels; else the first ten.

    ``tests``: feature_id, p. Level 0 keeps none, 1 or more all.
    """
    if alpha <= 0 or alpha >= 1:
        return tests.limit(0) if alpha <= 0 else tests
    levels = [alpha, *[a for a in RELAXED if a > alpha]]
    w = Window.orderBy("p", "feature_id")
    t = tests.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    for k, a in enumerate(levels):
        t = t.withColumn(f"k{k}", F.max(F.when(F.col("p") <= F.col("i") / F.col("n") * a, F.col("i")).otherwise(0)).over(Window.partitionBy()))
    keep = F.least(F.lit(LEAST), F.col("n"))
    for k in reversed(range(len(levels))):
        keep = F.when(F.col(f"k{k}") >= LEAST, F.col(f"k{k}")).otherwise(keep)
    return t.filter(F.col("i") <= keep).select(*tests.columns)


def select_features(tests: DataFrame, alpha: float, per_class: int = 0) -> DataFrame:
    """``feature_id, class, significance, rank``: class 0 first, each class by p; class 2 is dropped."""
    kept = false_discovery(tests, alpha).filter(F.col("class").isin(0, 1))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("p", "feature_id")))
    if per_class:
        kept = kept.filter(F.col("place") <= per_class)
    return kept.select("feature_id", "class", F.col("p").alias("significance"), (F.row_number().over(Window.orderBy("class", "place")) - 1).alias("rank"))


def select_for_regression(x: DataFrame, samples: DataFrame, min_prevalence: float) -> DataFrame:
    """Features positive in enough samples, in feature order; class 0, significance = that share."""
    n = samples.agg(F.count("*").cast("double").alias("n"))
    share = x.join(samples.select("sample_id"), "sample_id").groupBy("feature_id").agg(F.count_if(F.col("value") > 0).alias("c")).crossJoin(F.broadcast(n)).select("feature_id", (F.col("c") / F.col("n")).alias("significance"))
    return share.filter(F.col("significance") >= min_prevalence).select("feature_id", F.lit(0).alias("class"), "significance", (F.row_number().over(Window.orderBy("feature_id")) - 1).alias("rank"))
