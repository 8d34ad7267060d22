"""Scoring a stream of measurements with fixed models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def scored(stream: DataFrame, models: DataFrame, window: str = "1 hour", late: str = "1 hour", language: str = "ternary", data_type: str = "raw", epsilon: float = scoring.EPSILON) -> DataFrame:
    """``window_start, sample_id, model_id, score`` once a window has closed.

    ``stream``: ts, sample_id, feature_id, value. A sample's values within a tumbling window are
    summed per feature; state is bounded by the watermark. ``models`` is static and broadcast.
    """
    # one stateful step: value of each feature as a map, built from sums per feature in the models
    needed = sorted(r[0] for r in models.select(F.explode("terms.f")).distinct().collect())
    sums = [F.sum(F.when(F.col("feature_id") == f, F.col("value"))).alias(f"_{f}") for f in needed]
    own = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "sample_id").agg(*sums)
    xs = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in needed]), F.array(*[F.col(f"_{f}") for f in needed])), lambda k, v: v.isNotNull() & (v != 0))
    return own.withColumn("xs", xs).crossJoin(F.broadcast(models.select("model_id", "terms"))).select(F.col("w.start").alias("window_start"), "sample_id", "model_id", scoring.score(language, data_type, epsilon).alias("score"))


def written(rows: DataFrame, folder: str, seconds: int = 600) -> DataFrame:
    """Runs a stream over what is there now and returns its rows, from files below ``folder``, where its progress is kept too.

    Run again with the same folder, it goes on where it stopped. A stream that fails, or isn't done
    in time (then it is stopped), is an error.
    """
    q = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
    if not q.awaitTermination(seconds):
        q.stop()
        raise TimeoutError(f"the stream isn't done after {seconds} seconds")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
