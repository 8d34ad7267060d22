"""Delimited text in: matrices of either orientation, labels, annotations."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dataset import align_labels


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    if row is None:
        raise ValueError(f"{path} is empty")
    return row[0]


def delimiter(spark: SparkSession, path: str) -> str:
    """By extension: tab for .tsv, .txt and .tab; for .csv a semicolon if it is more frequent than the comma in the first line."""
    ext = os.path.splitext(path)[1].lower()
    if ext in (".tsv", ".txt", ".tab"):
        return "\t"
    if ext != ".csv":
        raise ValueError(f"no delimiter is known for {ext or 'a file without extension'}")
    line = first_line(spark, path)
    semi, comma = line.count(";"), line.count(",")
    if not semi and not comma:
        raise ValueError(f"{path}: the first line has neither ; nor ,")
    return ";" if semi > comma else ","


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header."""
    return spark.read.csv(path, sep=delimiter(spark, path), header=True, inferSchema=False)


def ordinals(names: list[str], spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), f"{kind}_id int, {kind} string")


def matrix(spark: SparkSession, path: str, features_in_rows: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(x, samples, features): values by ordinal ids in file order; cells that are no number are absent, zeros not stored."""
    wide = read(spark, path)
    key, *cells = wide.columns
    row, col = ("feature", "sample") if features_in_rows else ("sample", "feature")
    rows = wide.select(F.monotonically_increasing_id().alias("_o"), F.col(f"`{key}`").alias(row), *[F.col(f"`{c}`") for c in cells])
    ids = rows.select(row, (F.row_number().over(Window.orderBy("_o")) - 1).cast("int").alias(f"{row}_id"))
    columns = ordinals(cells, spark, col)
    long = rows.drop("_o").unpivot([row], cells, col, "cell").select(row, col, F.expr("try_cast(cell as double)").alias("value")).filter("value is not null and value <> 0")
    x = long.join(ids, row).join(F.broadcast(columns), col).select(F.col("sample_id").cast("long").alias("sample_id"), "feature_id", "value")
    samples, features = (ids, columns) if row == "sample" else (columns, ids)
    if samples.count() < 3 or features.count() < 3:
        raise ValueError("fewer than three samples or features")
    return x, samples.select(F.col("sample_id").cast("long").alias("sample_id"), "sample"), features.select("feature_id", "feature")


def labels(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """``sample_id, y``: the file's label, the last of repeated ones; 2 without; text that is no number is an error."""
    raw = read(spark, path)
    name, value = raw.columns[:2]
    rows = raw.select(F.monotonically_increasing_id().alias("_o"), F.col(f"`{name}`").alias("sample"), F.col(f"`{value}`").cast("double").alias("y"))
    last = rows.groupBy("sample").agg(F.max_by("y", "_o").alias("y"))
    return align_labels(samples, samples.join(last, "sample").select("sample_id", "y"))


def annotations(spark: SparkSession, path: str, of: DataFrame, kind: str) -> DataFrame:
    """Annotations of features or samples: numeric ``prior_weight`` and ``feature_penalty``, all else in ``tags``; unknown names are dropped."""
    raw = read(spark, path)
    key = next((c for c in raw.columns if c in (kind, f"{kind}_name")), None)
    if key is None:
        raise ValueError(f"{path} has no column {kind} or {kind}_name")
    numbers = [c for c in ("prior_weight", "feature_penalty") if kind == "feature" and c in raw.columns]
    tags = [c for c in raw.columns if c != key and c not in numbers]
    packed = F.create_map(*[e for c in tags for e in (F.lit(c), F.col(f"`{c}`"))]) if tags else F.create_map().cast("map<string,string>")
    own = raw.select(F.col(f"`{key}`").alias(kind), *[F.col(c).cast("double").alias(c) for c in numbers], packed.alias("tags"))
    return of.join(own, kind).select(f"{kind}_id", *numbers, "tags")
