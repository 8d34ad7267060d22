"""Fits for continuous targets, and robust summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("model_id",)
BINS = 10


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of a group; 0 without variance."""
    ok = (F.var_pop(a) > 1e-18) & (F.var_pop(b) > 1e-18)
    return F.when(ok, F.covar_pop(a, b) / F.when(ok, F.stddev_pop(a) * F.stddev_pop(b))).otherwise(0.0)


def pearson(scores: DataFrame, key=KEY) -> DataFrame:
    return scores.groupBy(*key).agg(correlation("score", "y").alias("fit"))


def average_rank(column: str, key=KEY) -> Column:
    w = Window.partitionBy(*key)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(w.partitionBy(*key, column)) - 1) / 2


def spearman(scores: DataFrame, key=KEY) -> DataFrame:
    r = scores.select(*key, average_rank("score", key).alias("a"), average_rank("y", key).alias("b"))
    return r.groupBy(*key).agg(correlation("a", "b").alias("fit"))


def neg_rmse(scores: DataFrame, key=KEY) -> DataFrame:
    d = F.col("score") - F.col("y")
    return scores.groupBy(*key).agg((-F.sqrt(F.avg(d * d))).alias("fit"))


def binned(column: str, key=KEY) -> Column:
    w = Window.partitionBy(*key)
    low, span = F.min(column).over(w), F.max(column).over(w) - F.min(column).over(w)
    return F.when(span > 0, F.least(F.lit(BINS - 1), F.floor((F.col(column) - low) / F.when(span > 0, span) * (BINS - 1e-10)).cast("int"))).otherwise(0)


def mutual_information(scores: DataFrame, key=KEY) -> DataFrame:
    """Between score and target, both cut into ten equal widths; natural logarithm."""
    cells = scores.select(*key, binned("score", key).alias("a"), binned("y", key).alias("b")).groupBy(*key, "a", "b").agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy(*key)
    c = cells.select(*key, "n", F.sum("n").over(w.partitionBy(*key, "a")).alias("na"), F.sum("n").over(w.partitionBy(*key, "b")).alias("nb"), F.sum("n").over(w).alias("all"))
    n, na, nb, total = (F.col(x) for x in ("n", "na", "nb", "all"))
    return c.groupBy(*key).agg(F.sum(n / total * F.ln(n * total / (na * nb))).alias("fit"))


FITS = {"spearman": spearman, "pearson": pearson, "neg_rmse": neg_rmse, "mutual_info": mutual_information}


def summaries(values: DataFrame, value: str, key: str) -> DataFrame:
    """Mean, population deviation, median and scaled median absolute deviation of each group."""
    med = values.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.median(value).alias("median"))
    mad = values.join(med.select(key, "median"), key).groupBy(key).agg((F.median(F.abs(F.col(value) - F.col("median"))) * 1.4826).alias("mad"))
    return med.join(mad, key)


def coefficient_deviations(x: DataFrame, scores: DataFrame, ridge: float) -> DataFrame:
    """``feature_id, sigma``: 1 / sqrt(sum over samples of s(z) s(-z) value^2 + ridge), s the logistic function.

    ``scores``: sample_id, z. Samples without a value add nothing.
    """
    z = F.col("z")
    weight = 1 / ((1 + F.exp(-z)) * (1 + F.exp(z)))
    return x.join(scores, "sample_id").groupBy("feature_id").agg((1 / F.sqrt(F.sum(weight * F.col("value") * F.col("value")) + ridge)).alias("sigma"))
