"""Queries over reports and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import population, reports, roc, voting
from ..sources import fixtures as fx
from ..sources import shared
from ..streaming import scoring as streaming
from . import base, ranking, resampling
from .base import query
from .ranking import fitted
from .scoring import r

_FORMULA = "CASE WHEN count(*) FILTER (c > 0) = 0 THEN '0' ELSE '(' || string_agg('f' || f, ' + ' ORDER BY f) FILTER (c > 0) || ')' END || CASE WHEN count(*) FILTER (c < 0) = 0 THEN '' ELSE ' - (' || string_agg('f' || f, ' + ' ORDER BY f) FILTER (c < 0) || ')' END"
_SHOW = ", ".join(f"printf('%.6f', {c}) AS {c}" for c in reports.METRICS)
query("report_best_model", f"{ranking.P}, fo AS (SELECT model_id, {_FORMULA} AS model FROM terms GROUP BY 1) SELECT 'best_model' AS section, model, CAST(k AS VARCHAR) AS k, {_SHOW} FROM ranked JOIN fo USING (model_id) WHERE rank = 0")(lambda spark, sf: reports.best_model(population.ranked(fitted(spark, sf))))
_AVG = ", ".join(f"printf('%.6f', avg({c})) AS {c}" for c in reports.METRICS)
query("report_fbm", f"{ranking.FAMILY} SELECT 'fbm' AS section, count(*) || ' models' AS model, printf('%.6f', avg(k)) AS k, {_AVG} FROM family")(lambda spark, sf: reports.family_mean(fitted(spark, sf, per_term=ranking.SPREAD)))


def jury_report(spark, sf):
    votes, experts = resampling.votes(spark, sf), resampling.experts(spark, sf)
    p = voting.majority(votes, experts, 0.5, 5.0).withColumn("model_id", F.lit(0))
    auc = roc.auc(p.filter("predicted <> 2").select("model_id", "y", F.round("ratio", 12).alias("score")))
    return reports.jury_row(roc.class_metrics(p), auc, 15)


_M = resampling.JM.replace(", k AS (", f", js AS (SELECT 0 AS model_id, y, round(ratio, 12) AS score FROM mj WHERE predicted <> 2), {base.auc('js', 'ja')}, k AS (")
query("report_jury", f"{_M} SELECT 'jury' AS section, '15 experts' AS model, 'NA' AS k, printf('%.6f', auc) AS auc, printf('%.6f', {resampling._D.format(a='tp + tn', b='tp + fp + tn + fn')}) AS accuracy, printf('%.6f', {resampling._D.format(a='tp', b='tp + fn')}) AS sensitivity, printf('%.6f', {resampling._D.format(a='tn', b='tn + fp')}) AS specificity, 'NA' AS fit FROM k, ja")(jury_report)
query("model_formulas", f"WITH {base.X}, {base.terms(20)} SELECT model_id, {_FORMULA} AS model FROM terms GROUP BY 1")(lambda spark, sf: fx.models(fx.abundance(spark, sf), 20).select("model_id", reports.formula().alias("model")))


_CLOSED = "window_start + 86400 <= (SELECT max(epoch(ts)) FROM events)"


@query(
    "streaming_scores",
    f"""WITH x AS (SELECT range::INT AS feature_id FROM range(5)), {base.terms(3)}, ev AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS window_start, user_id AS sample_id, {base._CODE} AS f, round(value * 100) AS v FROM events),
wn AS (SELECT DISTINCT window_start, sample_id FROM ev WHERE {_CLOSED}), sm AS (SELECT window_start, sample_id, f, sum(v) AS v FROM ev GROUP BY 1, 2, 3)
SELECT wn.window_start, wn.sample_id, t.model_id, round(coalesce(sum(t.c * sm.v), 0), 3)::DOUBLE AS score FROM wn CROSS JOIN terms t LEFT JOIN sm ON sm.window_start = wn.window_start AND sm.sample_id = wn.sample_id AND sm.f = t.f GROUP BY 1, 2, 3""",
)
def streamed(spark, sf):
    """Events as a stream of measurements, scored per user and day (``window_start``: seconds) once a later event closes it; run to the end of what is there."""
    folder = f"{sf}/events.parquet"
    code = F.lit(4)
    for k, name in reversed(list(enumerate(fx.EVENT_CODES))):
        code = F.when(F.col("event_type") == name, k).otherwise(code)
    schema = spark.read.parquet(folder).schema
    # a single file is read as a folder with a name filter
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("sample_id"), code.cast("int").alias("feature_id"), F.round(F.col("value") * 100).alias("value"))
    models = fx.models(spark.range(5).select(F.col("id").cast("int").alias("feature_id")), 3)
    out = streaming.written(streaming.scored(stream, models, "1 day", "0 seconds"), shared.folder(spark, "stream"))
    return r(out.withColumn("window_start", F.col("window_start").cast("long")), "score", digits=3)
