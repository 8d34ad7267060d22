"""Datasets as tables: labels, annotations, subsets, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide_to_long(wide: DataFrame, key: str, name: str = "name", value: str = "value") -> DataFrame:
    """Unpivot; cells that are no number count as absent, zeros aren't stored."""
    cells = [c for c in wide.columns if c != key]
    text = wide.select(key, *[F.col(f"`{c}`").cast("string").alias(c) for c in cells])
    long = text.unpivot([key], cells, name, "cell").select(key, name, F.expr("try_cast(cell as double)").alias(value))
    return long.filter(F.col(value).isNotNull() & (F.col(value) != 0))


def align_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Every sample with its label; 2 (unknown) where there is none."""
    return samples.select("sample_id").join(labels, "sample_id", "left").select("sample_id", F.coalesce("y", F.lit(2.0)).alias("y"))


def annotate(rows: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Rows whose key has an annotation, with it; annotations of unknown keys are dropped."""
    return rows.join(annotations, key, "inner")


def inverse_classes(samples: DataFrame) -> DataFrame:
    y = F.col("y")
    return samples.withColumn("y", F.when(y == 0, 1.0).when(y == 1, 0.0).otherwise(y))


def remove_class(samples: DataFrame, label: float) -> DataFrame:
    return samples.filter(F.col("y") != label)


def name_classes(samples: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``sample_id, y, class``: the configured name of each label; labels beyond the names have none."""
    label = F.element_at(F.array(*map(F.lit, names)), F.col("y").cast("int") + 1)
    return samples.withColumn("class", F.when((F.col("y") >= 0) & (F.col("y") < len(names)), label))


def transformed(x: DataFrame, data_type: str, epsilon: float = 1e-5) -> DataFrame:
    """Values as a chain reads them: raw, presence above ``epsilon``, or log of value over ``epsilon`` (0 for values that have none)."""
    v = F.col("value")
    how = {"raw": v, "prevalence": F.when(v > epsilon, 1.0).otherwise(0.0), "log": F.when(v > 0, F.log(v / epsilon)).otherwise(0.0)}
    if data_type not in how:
        raise ValueError(f"no value-wise reading of {data_type}")
    return x.withColumn("value", how[data_type])


def selected(x: DataFrame, selection: DataFrame) -> DataFrame:
    """The values of selected features (feature_id)."""
    return x.join(selection.select("feature_id"), "feature_id", "left_semi").select(*x.columns)


def with_values(x: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same samples and labels with other values: those of unknown samples are dropped."""
    return x.join(samples.select("sample_id"), "sample_id", "left_semi").select(*x.columns), samples


def subset(x: DataFrame, samples: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples by a list with order and repetition (position, sample_id); new ids are positions."""
    own = chosen.join(samples, "sample_id").select(F.col("position").alias("sample_id"), F.col("sample_id").alias("of"), "y")
    values = x.withColumnRenamed("sample_id", "of").join(own.select("sample_id", "of"), "of").select("sample_id", "feature_id", "value")
    return values, own.select("sample_id", "y")


def add_samples(x: DataFrame, other: DataFrame, shift: int) -> DataFrame:
    """Bag union; the other's sample ids follow."""
    return x.unionByName(other.withColumn("sample_id", F.col("sample_id") + shift))


def compatibility(features_a: DataFrame, features_b: DataFrame) -> DataFrame:
    """Features of either side that the other lacks, and whether there are none."""
    lacks = lambda a, b: a.join(b, "feature_id", "left_anti").agg(F.count("*").alias("n"))
    a, b = lacks(features_a, features_b).select(F.col("n").alias("only_a")), lacks(features_b, features_a).select(F.col("n").alias("only_b"))
    return a.crossJoin(b).withColumn("compatible", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def zscore_stats(x: DataFrame, samples: DataFrame) -> DataFrame:
    """``feature_id, mean, std`` over all samples with their implicit zeros; population std, 1 if the variance isn't positive."""
    n = samples.agg(F.count("*").alias("n"))
    sums = x.join(samples.select("sample_id"), "sample_id", "left_semi").groupBy("feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / F.col("n")
    variance = F.col("q") / F.col("n") - mean * mean
    return sums.crossJoin(F.broadcast(n)).select("feature_id", mean.alias("mean"), F.when(variance > 0, F.sqrt(variance)).otherwise(1.0).alias("std"))


def prevalence(x: DataFrame, samples: DataFrame) -> DataFrame:
    """``feature_id, n, share`` of samples with a stored value."""
    n = samples.agg(F.count("*").alias("all"))
    return x.groupBy("feature_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("feature_id", "n", (F.col("n") / F.col("all")).alias("share"))


def numbered(names: DataFrame, name: str, order: str) -> DataFrame:
    """Ordinal ids by a stated order, from 0."""
    return names.select((F.row_number().over(Window.orderBy(order)) - 1).alias("id"), name)
