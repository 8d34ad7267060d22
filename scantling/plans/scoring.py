"""Queries over datasets, scores, ranking quality and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, scoring
from ..operators import dataset, fitness, roc, scores
from ..sources import fixtures as fx
from . import base
from .base import query

N = 60  # models of the scoring queries


def r(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def models(spark, sf, n=N, dense=False):
    x = fx.vectors(spark, sf) if dense else fx.abundance(spark, sf)
    return fx.models(x, n)


def scored(spark, sf, language="ternary", data_type="raw", epsilon=1e-5, n=N, dense=False, betas=None, digits=None):
    x, s = (fx.vectors(spark, sf), fx.vector_samples(spark, sf)) if dense else (fx.abundance(spark, sf), fx.abundance_samples(spark, sf))
    stats = dataset.zscore_stats(x, s) if data_type == "zscore" else None
    m = fx.models(x, n)
    if language in ("binary", "pow2"):
        m = m.withColumn("terms", F.transform("terms", lambda t: F.struct(t["f"].alias("f"), recoded(language, t["f"], t["c"]).alias("c"))))
    out = scores.evaluate(m, x, s, language, data_type, epsilon, stats, betas)
    return out if digits is None else r(out, "score", digits=digits)


def recoded(language, f, c):
    """Coefficients of other languages, made from the sign models."""
    return F.lit(1) if language == "binary" else c * F.element_at(F.array(*[F.lit(1 << k) for k in range(7)]), (f % 7 + 1).cast("int"))


def recoded_sql(language):
    c = "1" if language == "binary" else "c * (1 << (f % 7))"
    return f"coded AS (SELECT model_id, f, {c} AS c FROM terms)" if language in ("binary", "pow2") else "coded AS (SELECT * FROM terms)"


# ---------------------------------------------------------------- data

PIVOTED = [11, 12, 13, 21, 22]


@query("wide_to_long", f"WITH {base.X} SELECT sample_id, CAST(feature_id AS VARCHAR) AS name, value FROM x WHERE feature_id IN ({', '.join(map(str, PIVOTED))}) AND value <> 0")
def _(spark, sf):
    wide = fx.abundance(spark, sf).groupBy("sample_id").pivot("feature_id", PIVOTED).agg(F.first("value"))
    return dataset.wide_to_long(wide.na.fill(0.0), "sample_id")


@query("align_labels_default_unknown", f"WITH {base.SAMPLES} SELECT sample_id, CASE WHEN sample_id % 7 = 0 THEN 2.0::DOUBLE ELSE y END AS y FROM samples")
def _(spark, sf):
    s = fx.abundance_samples(spark, sf)
    return dataset.align_labels(s, s.filter("sample_id % 7 <> 0"))


FEATURE_NOTES = "SELECT DISTINCT feature_id, CAST(feature_id % 5 AS DOUBLE) AS prior_weight, CAST(feature_id % 3 AS DOUBLE) / 10 AS feature_penalty FROM x WHERE feature_id % 4 <> 0"


def feature_notes(x):
    f = F.col("feature_id")
    return x.select("feature_id").distinct().filter(f % 4 != 0).select("feature_id", (f % 5).cast("double").alias("prior_weight"), ((f % 3).cast("double") / 10).alias("feature_penalty"))


@query("annotate_features", f"WITH {base.X}, notes AS ({FEATURE_NOTES}) SELECT feature_id, count(*) AS entries, any_value(prior_weight) AS prior_weight, any_value(feature_penalty) AS feature_penalty FROM x JOIN notes USING (feature_id) GROUP BY 1")
def _(spark, sf):
    x = fx.abundance(spark, sf)
    per = x.groupBy("feature_id").agg(F.count("*").alias("entries"))
    return dataset.annotate(per, feature_notes(x), "feature_id")


@query("annotate_samples", f"WITH {base.SAMPLES} SELECT sample_id, y, c_nationkey AS nation, c_mktsegment AS segment FROM samples JOIN customer ON c_custkey = sample_id")
def _(spark, sf):
    notes = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return dataset.annotate(fx.abundance_samples(spark, sf), notes, "sample_id")


@query("inverse_classes", f"WITH {base.SAMPLES} SELECT sample_id, CASE y WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE y END AS y FROM samples")
def _(spark, sf):
    return dataset.inverse_classes(fx.abundance_samples(spark, sf))


@query("remove_class", f"WITH {base.SAMPLES} SELECT * FROM samples WHERE y <> 2")
def _(spark, sf):
    return dataset.remove_class(fx.abundance_samples(spark, sf), 2.0)


@query("subset_with_repeats", f"WITH {base.X}, chosen AS (SELECT range AS position, (range * 7) % 100 + 1 AS of FROM range(150)) SELECT position AS sample_id, feature_id, value FROM chosen JOIN x ON of = x.sample_id")
def _(spark, sf):
    chosen = spark.range(150).select(F.col("id").alias("position"), ((F.col("id") * 7) % 100 + 1).alias("sample_id"))
    return dataset.subset(fx.abundance(spark, sf), fx.abundance_samples(spark, sf), chosen)[0]


@query("add_samples", f"WITH {base.X}, u AS (SELECT * FROM x UNION ALL SELECT sample_id + 1000000, feature_id, value FROM x WHERE feature_id < 30) SELECT feature_id, count(*) AS n, count(DISTINCT sample_id) AS samples, sum(value) AS total FROM u GROUP BY 1")
def _(spark, sf):
    x = fx.abundance(spark, sf)
    both = dataset.add_samples(x, x.filter("feature_id < 30"), 1_000_000)
    return both.groupBy("feature_id").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("samples"), F.sum("value").alias("total"))


@query("dataset_compatibility", f"WITH {base.X}, a AS (SELECT DISTINCT feature_id FROM x WHERE feature_id % 10 <> 1), b AS (SELECT DISTINCT feature_id FROM x WHERE feature_id % 10 <> 2) SELECT (SELECT count(*) FROM a ANTI JOIN b USING (feature_id)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (feature_id)) AS only_b, false AS compatible")
def _(spark, sf):
    f = fx.abundance(spark, sf).select("feature_id").distinct()
    return dataset.compatibility(f.filter("feature_id % 10 <> 1"), f.filter("feature_id % 10 <> 2"))


for _name, _x, _s, _fx, _fs in (("zscore_stats", base.X, base.SAMPLES, fx.abundance, fx.abundance_samples), ("zscore_stats_dense", base.V, base.V_SAMPLES, fx.vectors, fx.vector_samples)):
    query(_name, f"WITH {_x}, {_s}, {base.STATS} SELECT feature_id, {base.rounded('mean, std')} FROM stats")(lambda spark, sf, a=_fx, b=_fs: r(dataset.zscore_stats(a(spark, sf), b(spark, sf)), "mean", "std"))


@query("zscore_stats_train_to_test", f"WITH {base.X}, {base.SAMPLES.replace('FROM customer', 'FROM customer WHERE c_custkey % 3 <> 0')}, {base.STATS} SELECT x.sample_id, feature_id, round((value - mean) / std, 9) AS z FROM x JOIN stats USING (feature_id) WHERE x.sample_id % 3 = 0")
def _(spark, sf):
    x, s = fx.abundance(spark, sf), fx.abundance_samples(spark, sf)
    stats = dataset.zscore_stats(x, s.filter("sample_id % 3 <> 0"))
    test = x.filter("sample_id % 3 = 0").join(F.broadcast(stats), "feature_id")
    return test.select("sample_id", "feature_id", F.round((F.col("value") - F.col("mean")) / F.col("std"), 9).alias("z"))


@query("prevalence", f"WITH {base.X}, {base.SAMPLES} SELECT feature_id, count(*) AS n, round(count(*) / (SELECT count(*)::DOUBLE FROM samples), 12) AS share FROM x GROUP BY 1")
def _(spark, sf):
    return r(dataset.prevalence(fx.abundance(spark, sf), fx.abundance_samples(spark, sf)), "share", digits=12)


@query("generated_vector", "SELECT range AS id, CAST(('0x' || substr(md5(concat_ws('|', '7', 'vector', CAST(range AS VARCHAR))), 1, 8))::BIGINT % 3 - 1 AS INT) AS value FROM range(1000)")
def _(spark, sf):
    from ..functions.hashing import draw

    return spark.range(1000).select("id", (draw(7, "vector", "id") % 3 - 1).cast("int").alias("value"))


# ---------------------------------------------------------------- scores

for _lang in ("binary", "ternary", "pow2", "ratio"):
    for _type in scoring.DATA_TYPES:
        _dense = _type == "zscore"
        _eps = 20.0 if _type == "prevalence" else 1e-5
        _short = {"binary": "bin", "ternary": "ter"}.get(_lang, _lang)
        query(
            f"score_{_short}_{'prev' if _type == 'prevalence' else _type}",
            f"WITH {base.V if _dense else base.X}, {base.V_SAMPLES if _dense else base.SAMPLES}, {base.terms(12)}, {recoded_sql(_lang)}, {base.STATS + ',' if _dense else ''} {base.scores(_lang, _type, _eps, 'coded')} SELECT model_id, sample_id, round(score, 6) AS score FROM sc",
        )(lambda spark, sf, a=_lang, b=_type, e=_eps, d=_dense: r(scored(spark, sf, a, b, e, 12, d).drop("y"), "score", digits=6))

query("score_mcmc_generic", f"WITH {base.X}, {base.SAMPLES}, {base.terms(12)}, {base.scores('mcmc_generic', 'prevalence', 20.0, betas=(0.5, -0.25, 0.1))} SELECT model_id, sample_id, round(score, 9) AS score FROM sc")(lambda spark, sf: r(scored(spark, sf, "mcmc_generic", "prevalence", 20.0, 12, betas=(0.5, -0.25, 0.1)).drop("y"), "score"))

SC = f"WITH {base.X}, {base.SAMPLES}, {base.terms(N)}, {base.scores()}"
SC_V = f"WITH {base.V}, {base.V_SAMPLES}, {base.terms(N)}, {base.scores(digits=9)}"
SC_P = f"WITH {base.X}, {base.SAMPLES}, {base.terms(N)}, {base.scores('ternary', 'prevalence', 20.0)}"

query("class_threshold", f"{SC} SELECT model_id, sample_id, CASE WHEN score >= 10 THEN 1 ELSE 0 END AS predicted FROM sc")(lambda spark, sf: scored(spark, sf).select("model_id", "sample_id", scoring.predicted(F.col("score"), F.lit(10.0)).alias("predicted")))
query("class_ci_reject", f"{SC} SELECT model_id, sample_id, CASE WHEN score > 30 THEN 1 WHEN score < -30 THEN 0 ELSE 2 END AS predicted FROM sc")(lambda spark, sf: scored(spark, sf).select("model_id", "sample_id", scoring.predicted(F.col("score"), F.lit(0.0), F.lit(-30.0), F.lit(30.0)).alias("predicted")))

query("auc_ties", f"{SC_P}, {base.auc()} SELECT model_id, round(auc, 9) AS auc FROM aucs")(lambda spark, sf: r(roc.auc(scored(spark, sf, data_type="prevalence", epsilon=20.0)), "auc"))
query("auc_no_ties", f"{SC_V}, {base.auc()} SELECT model_id, round(auc, 9) AS auc FROM aucs")(lambda spark, sf: r(roc.auc(scored(spark, sf, dense=True, digits=9)), "auc"))

for _fit in metrics.OBJECTIVES:
    _pen = {"sensitivity": (0.5, 1.0), "specificity": (1.0, 0.5)}.get(_fit)
    _short = {"f1_score": "f1", "g_mean": "gmean", "sensitivity": "sens", "specificity": "spec"}.get(_fit, _fit)
    query(f"roc_best_{_short}", f"{SC}, {base.roc(_fit, _pen)} SELECT model_id, threshold, {base.rounded('accuracy, sensitivity, specificity, objective')} FROM best")(
        lambda spark, sf, f=_fit, p=_pen: r(roc.best_threshold(scored(spark, sf), f, p), "accuracy", "sensitivity", "specificity", "objective").drop("tp", "fp", "tn", "fn")
    )

query("roc_best_dense", f"{SC_V}, {base.roc('auc')} SELECT model_id, round(threshold, 8) AS threshold, {base.rounded('accuracy, sensitivity, specificity, objective')} FROM best")(lambda spark, sf: r(r(roc.best_threshold(scored(spark, sf, dense=True, digits=9)), "accuracy", "sensitivity", "specificity", "objective"), "threshold", digits=8).drop("tp", "fp", "tn", "fn"))

query(
    "weighted_objective_threshold",
    f"""{SC}, g AS (SELECT *, coalesce(sum(p) OVER w, 0) AS fn, coalesce(sum(n) OVER w, 0) AS tn, sum(p) OVER (PARTITION BY model_id) AS pp, sum(n) OVER (PARTITION BY model_id) AS nn FROM (
      SELECT model_id, score, (count(*) FILTER (y = 1))::DOUBLE AS p, (count(*) FILTER (y = 0))::DOUBLE AS n FROM sc WHERE y IN (0, 1) GROUP BY 1, 2) WINDOW w AS (PARTITION BY model_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    o AS (SELECT model_id, score AS threshold, (pp - fn) / pp AS sensitivity, tn / nn AS specificity, (pp - fn + tn) / (pp + nn) AS accuracy, (2.0::DOUBLE * (tn / nn) + 1.0::DOUBLE * ((pp - fn) / pp)) / 3.0::DOUBLE AS objective FROM g)
    SELECT model_id, threshold, {base.rounded('accuracy, sensitivity, specificity, objective')} FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY round(objective, 12) DESC, threshold) AS r FROM o) WHERE r = 1""",
)(lambda spark, sf: r(roc.weighted_threshold(scored(spark, sf), 2.0, 1.0), "accuracy", "sensitivity", "specificity", "objective"))

CLASSES = "cl AS (SELECT model_id, sample_id, y, CASE WHEN score > 30 THEN 1 WHEN score < -30 THEN 0 ELSE 2 END AS c FROM sc)"
COUNTS = f"{CLASSES}, k AS (SELECT model_id, (count(*) FILTER (y = 1 AND c = 1)) AS tp, (count(*) FILTER (y = 0 AND c = 1)) AS fp, (count(*) FILTER (y = 0 AND c = 0)) AS tn, (count(*) FILTER (y = 1 AND c = 0)) AS fn, (count(*) FILTER (c = 2)) AS abstained, count(*) AS samples FROM cl GROUP BY 1)"


def classes(spark, sf):
    return scored(spark, sf).withColumn("predicted", scoring.predicted(F.col("score"), F.lit(0.0), F.lit(-30.0), F.lit(30.0)))


query("confusion", f"{SC}, {COUNTS} SELECT * FROM k")(lambda spark, sf: roc.confusion(classes(spark, sf)))

_D = "CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"
_SE, _SP = _D.format(a="tp", b="tp + fn"), _D.format(a="tn", b="tn + fp")
METRICS = f"""d AS (SELECT model_id, tp::DOUBLE AS tp, fp::DOUBLE AS fp, tn::DOUBLE AS tn, fn::DOUBLE AS fn, abstained, samples FROM k),
met AS (SELECT model_id, {_D.format(a='tp + tn', b='tp + fp + tn + fn')} AS accuracy, {_SE} AS sensitivity, {_SP} AS specificity, {base.objective('mcc')} AS mcc,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_score, {base.objective('npv')} AS npv, {base.objective('ppv')} AS ppv, sqrt(({_SE}) * ({_SP})) AS g_mean, abstained::DOUBLE / samples AS rejection_rate FROM d)"""
MET_COLUMNS = "accuracy, sensitivity, specificity, mcc, f1_score, npv, ppv, g_mean, rejection_rate"
query("additional_metrics", f"{SC}, {COUNTS}, {METRICS} SELECT model_id, {base.rounded(MET_COLUMNS)} FROM met")(lambda spark, sf: r(roc.class_metrics(classes(spark, sf)), *MET_COLUMNS.split(", ")))
query("rejection_rate", f"{SC}, {COUNTS} SELECT model_id, round(abstained::DOUBLE / samples, 9) AS rejection_rate FROM k")(lambda spark, sf: r(roc.class_metrics(classes(spark, sf)).select("model_id", "rejection_rate"), "rejection_rate"))
query("convert_language", f"WITH {base.X}, {base.terms(N)} SELECT model_id, f, 1 AS as_binary, CAST(sign(c * (1 << (f % 7))) AS INT) AS as_ternary, c * (1 << (f % 7)) AS as_pow2 FROM terms")(
    lambda spark, sf: models(spark, sf).select("model_id", F.explode("terms").alias("t")).select("model_id", "t.f", recoded("pow2", F.col("t.f"), F.col("t.c")).alias("as_pow2")).select("model_id", "f", scoring.convert("binary", F.col("as_pow2")).alias("as_binary"), scoring.convert("ternary", F.col("as_pow2")).alias("as_ternary"), "as_pow2")
)

NAMES = ("control", "case", "unknown")
query("class_names", f"WITH {base.SAMPLES} SELECT sample_id, y, CASE y WHEN 0 THEN 'control' WHEN 1 THEN 'case' WHEN 2 THEN 'unknown' END AS class FROM samples")(lambda spark, sf: dataset.name_classes(fx.abundance_samples(spark, sf), NAMES))
query("values_log", f"WITH {base.V} SELECT sample_id, feature_id, round(CASE WHEN value > 0 THEN ln(value / 0.001::DOUBLE) ELSE 0 END, 9) AS value FROM x")(lambda spark, sf: r(dataset.transformed(fx.vectors(spark, sf), "log", 0.001), "value"))
query("values_prevalence", f"WITH {base.X} SELECT sample_id, feature_id, CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM x")(lambda spark, sf: dataset.transformed(fx.abundance(spark, sf), "prevalence", 20.0))
query("values_of_selected_features", f"WITH {base.X}, se AS (SELECT feature_id FROM x GROUP BY 1 HAVING count(*) % 2 = 1) SELECT * FROM x SEMI JOIN se USING (feature_id)")(
    lambda spark, sf: (lambda x: dataset.selected(x, x.groupBy("feature_id").agg(F.count("*").alias("n")).filter("n % 2 = 1")))(fx.abundance(spark, sf))
)
query("values_of_known_samples", f"WITH {base.X}, {base.SAMPLES} SELECT * FROM x SEMI JOIN (SELECT sample_id FROM samples WHERE y < 2) USING (sample_id)")(lambda spark, sf: dataset.with_values(fx.abundance(spark, sf), fx.abundance_samples(spark, sf).filter("y < 2"))[0])
query("coefficient_deviations", f"WITH {base.X}, {base.SAMPLES}, {base.terms(1)}, {base.scores()}, z AS (SELECT sample_id, score / 100 AS z FROM sc) SELECT feature_id, round(1 / sqrt(sum(value * value / ((1 + exp(-z)) * (1 + exp(z)))) + 0.5::DOUBLE), 9) AS sigma FROM x JOIN z USING (sample_id) GROUP BY 1")(
    lambda spark, sf: r(fitness.coefficient_deviations(fx.abundance(spark, sf), scored(spark, sf, n=1).select("sample_id", (F.col("score") / 100).alias("z")), 0.5), "sigma")
)
