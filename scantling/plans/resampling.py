"""Queries over splits, folds, bootstrap, permutation importance and juries."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from ..functions import scoring as fs
from ..functions.hashing import draw_sql
from ..operators import dense, importance, population, replicates, resampling, roc, voting
from ..sources import fixtures as fx
from . import base, ranking
from .base import query
from .ranking import fitted
from .scoring import _D, r, scored

SEED = 4815162342
S = f"WITH {base.SAMPLES}"


def places(purpose, strata, source="samples WHERE y < 2", ids=("sample_id",)):
    part = f"PARTITION BY {', '.join(strata)}" if strata else ""
    return f"(SELECT *, row_number() OVER ({part} ORDER BY {draw_sql(SEED, purpose, *ids)}, sample_id) - 1 AS place, count(*) OVER ({part}) AS n FROM {source})"


def chunk_sql(k):
    return f"CASE WHEN place < n % {k} * (n // {k} + 1) THEN place // (n // {k} + 1) ELSE n % {k} + (place - n % {k} * (n // {k} + 1)) // greatest(n // {k}, 1) END::INT"


query("kfold_stratified", f"{S} SELECT sample_id, {chunk_sql(5)} AS fold FROM {places('fold', ['y'])}")(lambda spark, sf: resampling.folds(fx.abundance_samples(spark, sf), 5, SEED))
query("kfold_unstratified", f"{S} SELECT sample_id, {chunk_sql(4)} AS fold FROM {places('fold', [], 'samples')}")(lambda spark, sf: resampling.folds(fx.abundance_samples(spark, sf), 4, SEED, by=[]))


def noted(spark, sf):
    return fx.abundance_samples(spark, sf).join(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("nation")), "sample_id")


query("kfold_by_annotation", f"{S} SELECT sample_id, {chunk_sql(3)} AS fold FROM {places('fold', ['y', 'c_nationkey'], 'samples JOIN customer ON c_custkey = sample_id WHERE y < 2')}")(lambda spark, sf: resampling.folds(noted(spark, sf), 3, SEED, ["y", "nation"]))
query("holdout_split", f"{S} SELECT sample_id, place < round(n * 0.2::DOUBLE) AS test FROM {places('holdout', ['y'])}")(lambda spark, sf: resampling.holdout(fx.abundance_samples(spark, sf), 0.2, SEED))
query("random_subset", f"{S}, p AS {places('subset', ['y'])}, t AS (SELECT *, round(100 * sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER () / count(*) OVER ()::DOUBLE) AS pos FROM p) SELECT sample_id FROM t WHERE place < CASE WHEN y = 1 THEN pos ELSE 100 - pos END")(lambda spark, sf: resampling.random_subset(fx.abundance_samples(spark, sf), 100, SEED))

AUC_BY = base.auc("parts", "ap", "model_id, held, valid")
query(
    "fit_on_folds",
    f"WITH {base.X}, {base.SAMPLES}, {base.terms(12)}, {base.scores()}, fo AS (SELECT sample_id, {chunk_sql(3)} AS fold FROM {places('fold', ['y'])}), parts AS (SELECT model_id, held, fold = held AS valid, y, score FROM sc JOIN fo USING (sample_id), (SELECT unnest([0, 1, 2]) AS held)), {AUC_BY}, pr AS (SELECT model_id, held, max(auc) FILTER (NOT valid) AS t, max(auc) FILTER (valid) AS v FROM ap GROUP BY 1, 2) SELECT model_id, round(avg(t - abs(t - v) * 0.5::DOUBLE), 9) AS fit FROM pr GROUP BY 1",
)(lambda spark, sf: r(resampling.fit_on_folds(scored(spark, sf, n=12), resampling.folds(fx.abundance_samples(spark, sf), 3, SEED), 0.5), "fit"))
def cv_union(spark, sf):
    s, f = scored(spark, sf, n=12), resampling.folds(fx.abundance_samples(spark, sf), 3, SEED)
    rows = s.join(f, "sample_id").crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("held")))).filter("fold <> held")
    from pyspark.sql import Window

    a = r(roc.auc(rows, ("model_id", "held")), "auc")
    return a.withColumn("place", F.row_number().over(Window.partitionBy("held").orderBy(F.col("auc").desc(), "model_id"))).filter("place <= 4").select("held", "model_id", "auc")


base.QUERIES["cv_fbm_union"] = cv_union
base.SQL["cv_fbm_union"] = f"WITH {base.X}, {base.SAMPLES}, {base.terms(12)}, {base.scores()}, fo AS (SELECT sample_id, {chunk_sql(3)} AS fold FROM {places('fold', ['y'])}), parts AS (SELECT model_id, held, y, score FROM sc JOIN fo USING (sample_id), (SELECT unnest([0, 1, 2]) AS held) WHERE fold <> held), {base.auc('parts', 'ap', 'model_id, held')}, rk AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY round(auc, 9) DESC, model_id) AS place FROM ap) SELECT held, model_id, round(auc, 9) AS auc FROM rk WHERE place <= 4"

B, ALPHA = 20, 0.1
#: Replicates of ``bootstrap_ci``: as many as the reference judges a population's thresholds by (it refuses fewer than 100).
CI = 1000


def boot_sql(replicates: int) -> str:
    """``boot(replicate, sample_id)``: with replacement within each class, a row for each pick."""
    return f"bt AS (SELECT range::INT AS replicate FROM range({replicates})), mem AS (SELECT y, sample_id, row_number() OVER (PARTITION BY y ORDER BY sample_id) - 1 AS place, count(*) OVER (PARTITION BY y) AS n FROM samples WHERE y < 2), pk AS (SELECT replicate, y, {draw_sql(SEED, 'boot', 'replicate', 'sample_id')} % n AS place FROM mem, bt), boot AS (SELECT replicate, sample_id FROM pk JOIN mem USING (y, place))"


BOOT = boot_sql(B)
PART = f"bt AS (SELECT range::INT AS replicate FROM range({B})), boot AS (SELECT replicate, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY replicate, y ORDER BY {draw_sql(SEED, 'part', 'replicate', 'sample_id')}, sample_id) - 1 AS place, count(*) OVER (PARTITION BY replicate, y) AS n FROM samples, bt WHERE y < 2) WHERE place < ceil(n * 0.8::DOUBLE))"
LO, HI = ceil(ALPHA / 2 * (B - 1)), int((1 - ALPHA / 2) * (B - 1))
CI_LO, CI_HI = ceil(ALPHA / 2 * (CI - 1)), int((1 - ALPHA / 2) * (CI - 1))


def replicated(boot):
    return f"WITH {base.X}, {base.SAMPLES}, {base.terms(4)}, {base.scores()}, {boot}, rep AS (SELECT model_id, replicate, y, score FROM sc JOIN boot USING (sample_id)), {base.roc('auc', None, 'rep', 'rb', 'model_id, replicate')}"


query("bootstrap_ci", f"{replicated(boot_sql(CI))}, o AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY threshold) - 1 AS place FROM rb) SELECT model_id, max(threshold) FILTER (place = {CI_LO}) AS lower, max(threshold) FILTER (place = {CI_HI}) AS upper FROM o GROUP BY 1")(
    lambda spark, sf: resampling.percentiles(replicates.thresholds(scored(spark, sf, n=4), CI, SEED), "threshold", CI, ALPHA)
)
query("bootstrap_weights", f"WITH {base.SAMPLES}, {BOOT} SELECT replicate, sample_id, count(*) AS weight FROM boot GROUP BY 1, 2")(lambda spark, sf: resampling.bootstrap(fx.abundance_samples(spark, sf), B, SEED))
def geyer(spark, sf):
    samples, s = fx.abundance_samples(spark, sf), scored(spark, sf, n=4)
    boot = resampling.bootstrap(samples, B, SEED, 0.8)
    n, m = samples.filter("y < 2").count(), boot.filter("replicate = 0").count()
    out = resampling.subsample_interval(resampling.replicate_thresholds(s, boot), roc.best_threshold(s).select("model_id", "threshold"), B, ALPHA, m, n)
    return r(out, "lower", "upper", digits=8)


base.QUERIES["subsample_ci_geyer"] = geyer
base.SQL["subsample_ci_geyer"] = f"{replicated(PART)}, {base.roc('auc')}, nn AS (SELECT (SELECT count(*) FROM samples WHERE y < 2)::DOUBLE AS n, (SELECT count(*) FROM boot WHERE replicate = 0)::DOUBLE AS m), d AS (SELECT rb.model_id, sqrt(m) * (rb.threshold - best.threshold) AS d, best.threshold AS c, n FROM rb JOIN best USING (model_id), nn), o AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY d) - 1 AS place FROM d) SELECT model_id, round(any_value(c) - max(d) FILTER (place = {HI}) / sqrt(any_value(n)), 8) AS lower, round(any_value(c) - max(d) FILTER (place = {LO}) / sqrt(any_value(n)), 8) AS upper FROM o GROUP BY 1"

PERMS = 3
MDA = f"""WITH {base.X}, {base.SAMPLES}, {base.terms(4)}, {base.scores()}, {base.auc()}, kn AS (SELECT * FROM samples WHERE y < 2), fp AS (SELECT DISTINCT f, perm FROM terms, (SELECT range::INT AS perm FROM range({PERMS}))),
pl AS (SELECT f, perm, sample_id, row_number() OVER (PARTITION BY f, perm ORDER BY {draw_sql(SEED, 'mda', 'f', 'perm', 'sample_id')}, sample_id) AS place FROM kn, fp),
vl AS (SELECT feature_id AS f, value, row_number() OVER (PARTITION BY feature_id ORDER BY sample_id) AS place FROM x SEMI JOIN kn USING (sample_id)),
nw AS (SELECT f, perm, sample_id, value FROM pl JOIN vl USING (f, place)),
ps AS (SELECT t.model_id, t.f AS feature_id, pp.perm, sc.y, sc.score + t.c * (coalesce(nw.value, 0) - coalesce(x.value, 0)) AS score FROM sc JOIN terms t USING (model_id) CROSS JOIN (SELECT range::INT AS perm FROM range({PERMS})) pp LEFT JOIN x ON x.sample_id = sc.sample_id AND x.feature_id = t.f LEFT JOIN nw ON nw.sample_id = sc.sample_id AND nw.f = t.f AND nw.perm = pp.perm WHERE sc.y < 2),
{base.auc('ps', 'pa', 'model_id, feature_id, perm')}, im AS (SELECT model_id, feature_id, any_value(aucs.auc) - avg(pa.auc) AS importance FROM pa JOIN aucs USING (model_id) GROUP BY 1, 2)"""


def mda(spark, sf):
    x, s = fx.abundance(spark, sf), fx.abundance_samples(spark, sf)
    return importance.of_models(fx.models(x, 4), dense.Matrix(x, s), x, PERMS, SEED)


query("mda_importance", f"{MDA} SELECT model_id, feature_id, round(importance, 9) AS importance FROM im")(lambda spark, sf: r(mda(spark, sf), "importance"))
query("mda_over_models", f"{MDA} SELECT feature_id, round(sum(importance) / 4, 8) AS importance, round(sqrt(greatest(sum(importance * importance) / 4 - pow(sum(importance) / 4, 2), 0)), 8) AS dispersion, round(count(*) / 4.0, 8)::DOUBLE AS scope_pct FROM im GROUP BY 1")(lambda spark, sf: r(importance.over_models(mda(spark, sf), 4), "importance", "dispersion", "scope_pct", digits=8))
query("mda_pruned", f"{MDA}, o AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY round(importance, 9) DESC, feature_id) AS place FROM im) SELECT model_id, feature_id FROM o WHERE round(importance, 9) >= 0.002 OR place <= 2")(lambda spark, sf: importance.pruned(fx.models(fx.abundance(spark, sf), 4), r(mda(spark, sf), "importance"), 0.002, 2).select("model_id", F.explode("terms.f").alias("feature_id")))

# ---------------------------------------------------------------- juries

VOTES = f"{ranking.pop_sql(15)}, ex AS (SELECT model_id, sensitivity, specificity, 1.0::DOUBLE AS weight FROM pop), votes AS (SELECT model_id, sample_id, y, CASE WHEN score > threshold + 20 THEN 1 WHEN score < threshold - 20 THEN 0 ELSE 2 END AS vote FROM sc JOIN best USING (model_id))"
SIDES = "si AS (SELECT *, CASE WHEN sensitivity >= 0.5 AND specificity >= 0.5 THEN 'balanced' WHEN sensitivity >= 0.5 THEN 'positive' WHEN specificity >= 0.5 THEN 'negative' ELSE 'ineffective' END AS side FROM ex), sp AS (SELECT model_id, side, CASE WHEN side = 'ineffective' THEN 0 ELSE 1.0::DOUBLE / (SELECT count(DISTINCT side) FROM si WHERE side <> 'ineffective') / count(*) OVER (PARTITION BY side) END AS weight FROM si)"


def votes(spark, sf):
    s = scored(spark, sf, n=15)
    t = F.col("threshold")
    own = s.join(F.broadcast(roc.best_threshold(s).select("model_id", "threshold")), "model_id")
    return own.select("model_id", "sample_id", "y", fs.predicted(F.col("score"), t, t - 20, t + 20).alias("vote"))


def experts(spark, sf):
    return fitted(spark, sf, 15).select("model_id", "sensitivity", "specificity", F.lit(1.0).alias("weight"))


COUNTED = "cv AS (SELECT sample_id, any_value(y) AS y, sum(CASE WHEN vote = 1 THEN weight ELSE 0 END) AS pos, sum(CASE WHEN vote < 2 THEN weight ELSE 0 END)::DOUBLE AS total FROM votes JOIN ex USING (model_id) GROUP BY 1), rt AS (SELECT *, CASE WHEN total > 0 THEN pos / total END AS q FROM cv)"
SCOUNTED = "cv AS (SELECT sample_id, any_value(y) AS y, sum(CASE WHEN vote = 1 AND side <> 'negative' THEN weight ELSE 0 END) AS pos, sum(CASE WHEN vote = 1 AND side <> 'negative' OR vote = 0 AND side <> 'positive' THEN weight ELSE 0 END)::DOUBLE AS total FROM votes JOIN sp USING (model_id) GROUP BY 1), rt AS (SELECT *, CASE WHEN total > 0 THEN round(pos / total, 9) END AS q FROM cv)"
MAJ = "mj AS (SELECT sample_id, y, coalesce(q, 0.5) AS ratio, CASE WHEN q IS NULL THEN 2 WHEN abs(q - 0.5) < 0.05 THEN 2 WHEN q >= 0.5 THEN 1 ELSE 0 END AS predicted FROM rt)"
query("vote_majority", f"{VOTES}, {COUNTED}, {MAJ} SELECT sample_id, y, round(ratio, 8) AS ratio, predicted FROM mj")(lambda spark, sf: r(voting.majority(votes(spark, sf), experts(spark, sf), 0.5, 5.0), "ratio", digits=8))
query("vote_consensus", f"{VOTES}, {COUNTED} SELECT sample_id, y, round(coalesce(q, -1), 8) AS ratio, CASE WHEN q IS NULL THEN 2 WHEN q >= 0.7 THEN 1 WHEN (total - pos) / total >= 0.7 THEN 0 ELSE 2 END AS predicted FROM rt")(lambda spark, sf: r(voting.consensus(votes(spark, sf), experts(spark, sf), 0.7), "ratio", digits=8))
query("vote_weights", f"{VOTES}, {SIDES} SELECT model_id, side, round(weight, 9) AS weight FROM sp")(lambda spark, sf: r(voting.specialized(experts(spark, sf), 0.5, 0.5).select("model_id", "side", "weight"), "weight"))
query("vote_specialized", f"{VOTES}, {SIDES}, {SCOUNTED} SELECT sample_id, round(coalesce(q, 0.5), 7) AS ratio FROM rt")(lambda spark, sf: r(voting.majority(votes(spark, sf), voting.specialized(experts(spark, sf), 0.5, 0.5).select("model_id", "weight", "side")).select("sample_id", "ratio"), "ratio", digits=7))
query("vote_threshold_grid", f"{VOTES}, {COUNTED}, gd AS (SELECT range / 10.0::DOUBLE AS threshold, range AS i FROM range(11)), gm AS (SELECT i, threshold, (count(*) FILTER (y = 1 AND coalesce(q >= threshold, false)))::DOUBLE / (count(*) FILTER (y = 1)) + (count(*) FILTER (y = 0 AND NOT coalesce(q >= threshold, false)))::DOUBLE / (count(*) FILTER (y = 0)) - 1 AS youden FROM rt, gd WHERE y < 2 GROUP BY 1, 2) SELECT threshold, round(youden, 9) AS youden, row_number() OVER (ORDER BY round(youden, 12) DESC, i) = 1 AS best FROM gm")(lambda spark, sf: r(voting.threshold_grid(votes(spark, sf), experts(spark, sf), 0.1), "youden"))
INC = "nv AS (SELECT sample_id, vote, count(*) AS n FROM votes GROUP BY 1, 2), ic AS (SELECT sample_id, round(1 - max(n)::DOUBLE / sum(n), 9) AS inconsistency FROM nv GROUP BY 1)"
query("vote_inconsistency", f"{VOTES}, {INC} SELECT * FROM ic")(lambda spark, sf: r(voting.inconsistency(votes(spark, sf)), "inconsistency"))
query("vote_categories", f"{VOTES}, {COUNTED}, {MAJ}, {INC}, kd AS (SELECT sample_id, CASE WHEN predicted = 2 THEN 'abstention' WHEN predicted = y THEN 'correct' ELSE 'error' END AS kind, inconsistency FROM mj JOIN ic USING (sample_id) WHERE y < 2) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY inconsistency DESC, sample_id) AS place FROM kd")(
    lambda spark, sf: (lambda v: voting.categories(voting.majority(v, experts(spark, sf), 0.5, 5.0), r(voting.inconsistency(v), "inconsistency")))(votes(spark, sf))
)
query("jury_selection", f"{ranking.P} SELECT model_id, rank FROM ranked WHERE sensitivity >= 0.45 AND specificity >= 0.45 QUALIFY row_number() OVER (ORDER BY rank) <= 5")(lambda spark, sf: voting.jury(population.ranked(fitted(spark, sf)), 0.45, 6).select("model_id", "rank"))
JM = f"{VOTES}, {COUNTED}, {MAJ}, k AS (SELECT 0 AS model_id, (count(*) FILTER (y = 1 AND predicted = 1)) AS tp, (count(*) FILTER (y = 0 AND predicted = 1)) AS fp, (count(*) FILTER (y = 0 AND predicted = 0)) AS tn, (count(*) FILTER (y = 1 AND predicted = 0)) AS fn, (count(*) FILTER (predicted = 2)) AS abstained, count(*) AS samples FROM mj)"
query("jury_metrics", f"{JM} SELECT round({_D.format(a='tp + tn', b='tp + fp + tn + fn')}, 9) AS accuracy, round({_D.format(a='tp', b='tp + fn')}, 9) AS sensitivity, round({_D.format(a='tn', b='tn + fp')}, 9) AS specificity, round(abstained::DOUBLE / samples, 9) AS rejection_rate FROM k")(
    lambda spark, sf: r(roc.class_metrics(voting.majority(votes(spark, sf), experts(spark, sf), 0.5, 5.0).withColumn("model_id", F.lit(0))).select("accuracy", "sensitivity", "specificity", "rejection_rate"), "accuracy", "sensitivity", "specificity", "rejection_rate")
)

query("cv_rebuilt_by_name", f"WITH {base.SAMPLES}, fo AS (SELECT sample_id, {chunk_sql(3)} AS fold FROM {places('fold', ['y'])}) SELECT fold, sample_id, y FROM fo JOIN samples USING (sample_id)")(
    lambda spark, sf: (lambda s: resampling.rebuilt(resampling.folds(s, 3, SEED).select("fold", F.concat(F.lit("s"), "sample_id").alias("name")), s.withColumn("name", F.concat(F.lit("s"), "sample_id"))))(fx.abundance_samples(spark, sf))
)
query("importance_of_feature", f"{MDA} SELECT model_id, feature_id, round(importance, 9) AS importance FROM im WHERE feature_id = (SELECT min(feature_id) FROM im) AND round(importance, 9) >= -1")(lambda spark, sf: (lambda i: importance.of(i, i.agg(F.min("feature_id")).first()[0], -1.0))(r(mda(spark, sf), "importance")))
