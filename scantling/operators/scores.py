"""Scores of all models on all samples.

A sample's values travel as one map, models (few, broadcast) as arrays of terms: so a pair is one
row of a nested-loop join with a broadcast side, implicit zeros come by themselves, and the only
shuffle is the one that gathers a sample's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

#: Models up to this number are broadcast; more are scored in blocks of it.
BLOCK = 20_000


def by_sample(x: DataFrame, samples: DataFrame) -> DataFrame:
    """``samples`` with ``xs``: map of the sample's non-zero values."""
    values = x.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("xs"))
    return samples.join(values, "sample_id", "left").withColumn("xs", F.coalesce("xs", F.create_map().cast("map<int,double>")))


def evaluate(models: DataFrame, x: DataFrame, samples: DataFrame, language: str = "ternary", data_type: str = "raw", epsilon: float = scoring.EPSILON, stats: DataFrame | None = None, betas: tuple | None = None) -> DataFrame:
    """``model_id, sample_id, y, score`` for every model and sample, scored or not (a sample without any term scores as zeros do).

    Several languages or data types, separated by commas: each model is read as its own columns say.
    """
    rows = by_sample(x, samples)
    if stats is not None:
        packed = stats.agg(F.map_from_entries(F.collect_list(F.struct("feature_id", F.struct("mean", "std")))).alias("stats"))
        rows = rows.crossJoin(F.broadcast(packed))
    pairs = rows.crossJoin(F.broadcast(models.select("model_id", "terms", *(["language", "data_type"] if len(scoring.kinds(language, data_type)) > 1 else []))))
    return pairs.select("model_id", "sample_id", "y", scoring.score(language, data_type, epsilon, stats="stats" if stats is not None else None, betas=betas).alias("score"))


def in_blocks(models: DataFrame, size: int = BLOCK) -> list[DataFrame]:
    """Models in parts small enough to broadcast, by hash."""
    n = -(-models.count() // size)
    return [models] if n <= 1 else [models.filter(F.pmod(F.xxhash64("model_id"), F.lit(n)) == k) for k in range(n)]
