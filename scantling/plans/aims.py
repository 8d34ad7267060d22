"""Queries over what runs maximize and leave: bands, inner folds, regression fits, any model's importance, juries, folds."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import functions as F

from ..functions.hashing import draw_sql
from ..operators import ants, beam, dense, goals, importance, resampling, run, voting
from ..sources import fixtures as fx
from ..sources.store import Params
from . import base, ranking, runs
from .base import query
from .resampling import SEED, chunk_sql, places
from .scoring import r, scored
from .search import CF, combos_sql, selection

# ---------------------------------------------------------------- bands

REPLICATES, ALPHA, FRACTION, BAND_SEED, MODELS = 1000, 0.05, 0.8, 42, 4
LO, HI = ceil(ALPHA / 2 * (REPLICATES - 1)), floor((1 - ALPHA / 2) * (REPLICATES - 1))


def parts_sql(replicates: int, seed: int, fraction: float) -> str:
    """``boot(replicate, sample_id)``: parts of each class without replacement."""
    return f"bt AS (SELECT range::INT AS replicate FROM range({replicates})), boot AS (SELECT replicate, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY replicate, y ORDER BY {draw_sql(seed, 'part', 'replicate', 'sample_id')}, sample_id) - 1 AS place, count(*) OVER (PARTITION BY replicate, y) AS n FROM samples, bt WHERE y < 2) WHERE place < ceil(n * {fraction}::DOUBLE))"


def bands_sql(replicates: int, alpha: float, fit: str = "auc") -> str:
    """``band(model_id, lower, upper)`` from ``boot``, ``sc`` and ``best``, rescaled; ``bm``: metrics outside the band."""
    lo, hi = ceil(alpha / 2 * (replicates - 1)), floor((1 - alpha / 2) * (replicates - 1))
    return f"""rep AS (SELECT model_id, replicate, y, score FROM sc JOIN boot USING (sample_id)), {base.roc(fit, None, 'rep', 'rb', 'model_id, replicate')},
nn AS (SELECT (SELECT count(*) FROM samples WHERE y < 2)::DOUBLE AS n, (SELECT count(*) FROM boot WHERE replicate = 0)::DOUBLE AS m),
o AS (SELECT rb.model_id, best.threshold AS c, sqrt(m) * (rb.threshold - best.threshold) AS d, n, row_number() OVER (PARTITION BY rb.model_id ORDER BY rb.threshold) - 1 AS place FROM rb JOIN best USING (model_id), nn),
band AS (SELECT model_id, any_value(c) - max(d) FILTER (place = {hi}) / sqrt(any_value(n)) AS lower, any_value(c) - max(d) FILTER (place = {lo}) / sqrt(any_value(n)) AS upper FROM o GROUP BY 1),
bc AS (SELECT model_id, y, CASE WHEN score > upper THEN 1 WHEN score < lower THEN 0 ELSE 2 END AS c FROM sc JOIN band USING (model_id)),
bk AS (SELECT model_id, (count(*) FILTER (y = 1 AND c = 1))::DOUBLE AS tp, (count(*) FILTER (y = 0 AND c = 1))::DOUBLE AS fp, (count(*) FILTER (y = 0 AND c = 0))::DOUBLE AS tn, (count(*) FILTER (y = 1 AND c = 0))::DOUBLE AS fn, (count(*) FILTER (c = 2))::DOUBLE AS out, count(*) AS n FROM bc GROUP BY 1),
bm AS (SELECT model_id, CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END AS accuracy, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity, out / n AS rejection_rate FROM bk)"""


METRICS = ("accuracy", "sensitivity", "specificity", "rejection_rate")


@query(
    "all_metrics",
    f"WITH {base.X}, {base.SAMPLES}, {base.terms(MODELS)}, {base.scores()}, {base.auc()}, {base.roc()}, {parts_sql(REPLICATES, BAND_SEED, FRACTION)}, {bands_sql(REPLICATES, ALPHA)} SELECT model_id, round(auc, 9) AS auc, threshold, round(lower, 7) AS lower, round(upper, 7) AS upper, {', '.join(f'round(bm.{c}, 9) AS {c}' for c in METRICS)} FROM aucs JOIN best USING (model_id) JOIN band USING (model_id) JOIN bm USING (model_id)",
)
def _(spark, sf):
    """Every model's metrics with the band of a thousand parts of the samples."""
    x, samples = fx.abundance(spark, sf), fx.abundance_samples(spark, sf)
    m = dense.Matrix(x, samples, known=False)
    goal = goals.Goal(bands=goals.bands(m, samples, REPLICATES, ALPHA, BAND_SEED, FRACTION))
    out = goals.judged(fx.models(x, MODELS), m, goal).select("model_id", "auc", "threshold", "lower", "upper", *METRICS)
    return r(r(out, "auc", *METRICS), "lower", "upper", digits=7)


# ---------------------------------------------------------------- inner folds, regression fits

INNER, OVERFIT = 3, 0.5
_FOLDS = f"fo AS (SELECT sample_id, {chunk_sql(INNER)} AS fold FROM {places('fold', ['y'])}), parts AS (SELECT model_id, held, fold = held AS valid, y, score FROM sc JOIN fo USING (sample_id), (SELECT unnest(range({INNER})) AS held))"


@query(
    "beam_inner_folds",
    f"WITH {base.X}, {base.SAMPLES}, {CF}, {combos_sql(2)}, {base.scores()}, {_FOLDS}, {base.auc('parts', 'ap', 'model_id, held, valid')}, pr AS (SELECT model_id, held, max(auc) FILTER (NOT valid) AS t, max(auc) FILTER (valid) AS v FROM ap GROUP BY 1, 2) SELECT model_id AS term_key, round(avg(t - abs(t - v) * {OVERFIT}::DOUBLE) - 2 * 0.001::DOUBLE, 9) AS fit FROM pr GROUP BY 1",
)
def _(spark, sf):
    """A beam level of all pairs, fitted over folds of the training samples."""
    samples = fx.abundance_samples(spark, sf)
    m = dense.Matrix(fx.abundance(spark, sf), samples)
    goal = goals.Goal(k_penalty=0.001, fold=resampling.folds(samples, INNER, SEED), overfit=OVERFIT)
    models = beam.named(beam.rewritten(beam.combinations(selection(spark, sf), 2), 2), 2)
    return r(beam.fitted_level(models, m, goal=goal).select("term_key", "fit"), "fit")


for _fit in ("spearman", "pearson", "neg_rmse", "mutual_info"):
    query(f"dense_{_fit}", base.SQL[f"fit_{_fit}"])(
        lambda spark, sf, fit=_fit: (lambda x, s: r(goals.judged(fx.models(x, 40), dense.Matrix(x, s, known=False), goals.Goal(fit)).select("model_id", F.col("base").alias("fit")), "fit", digits=7 if fit == "neg_rmse" else 8))(fx.activity(spark, sf), fx.activity_samples(spark, sf))
    )

# ---------------------------------------------------------------- a run by another fit, with bands

BOOT, BOOT_ALPHA, BIAS, REJECT, TEST_SHARE = 100, 0.1, 0.2, 0.5, 0.75
BY_MCC = runs.PARAMS | {"general": runs.PARAMS["general"] | {"fit": "mcc", "bias_penalty": BIAS, "ci_penalty": REJECT, "ci_alpha": BOOT_ALPHA, "bootstrap": BOOT, "bootstrap_fraction": FRACTION}, "data": runs.PARAMS["data"] | {"holdout": TEST_SHARE, "max_p": 1.5}}
_SIDE = lambda c: f"CASE WHEN {c} < 0.5 THEN (1 - {c}) * {BIAS}::DOUBLE ELSE 0 END"


@query(
    "run_beam_mcc",
    f"""WITH {base.X}, {runs.EVERYONE}, sp AS (SELECT sample_id, place < round(n * {TEST_SHARE}::DOUBLE) AS test FROM {places('holdout', ['y'], 'everyone WHERE y < 2')}), samples AS (SELECT sample_id, y FROM everyone JOIN sp USING (sample_id) WHERE NOT test), {CF}, {combos_sql(2)}, {base.scores()}, {base.auc()}, {base.roc('mcc')}, {parts_sql(BOOT, SEED, FRACTION)}, {bands_sql(BOOT, BOOT_ALPHA, 'mcc')}
SELECT model_id AS term_key, round(auc, 9) AS auc, threshold, round(lower, 7) AS lower, round(upper, 7) AS upper, {', '.join(f'round(bm.{c}, 9) AS {c}' for c in METRICS)}, round(objective - 2 * {runs.COST}::DOUBLE - {REJECT}::DOUBLE * rejection_rate - {_SIDE('bm.sensitivity')} - {_SIDE('bm.specificity')}, 8) AS fit FROM aucs JOIN best USING (model_id) JOIN band USING (model_id) JOIN bm USING (model_id)""",
)
def _(spark, sf):
    """All models of a beam run by MCC: fit less size, rejection and one-sidedness."""
    out = run.run_on_data(fx.abundance(spark, sf), fx.abundance_samples(spark, sf), Params.of(BY_MCC)).models
    return r(r(r(out.select("term_key", "auc", "threshold", "lower", "upper", *METRICS, "fit"), "auc", *METRICS), "lower", "upper", digits=7), "fit", digits=8)


# ---------------------------------------------------------------- importance of any model

PERMUTED, SOME = 5, 6


def mda_sql(language: str, data_type: str, epsilon: float = 1e-5) -> str:
    """``im(model_id, feature_id, importance)``, each (model, feature, permutation) scored anew as a whole."""
    eps = f"{epsilon!r}::DOUBLE"
    g = {"raw": "coalesce(v, 0)", "prevalence": f"CASE WHEN coalesce(v, 0) > {eps} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "log": f"CASE WHEN v IS NULL THEN 0 ELSE ln(v / {eps}) END", "zscore": "(coalesce(v, 0) - coalesce(mean, 0)) / coalesce(std, 1)"}[data_type]
    weighted = f"abs(c) * ({g})" if data_type == "log" else f"({g})"
    score = f"coalesce(sum(CASE WHEN c > 0 THEN {weighted} END), 0) / (coalesce(sum(CASE WHEN c <= 0 THEN {weighted} END), 0) + {eps})" if language == "ratio" else f"sum(c * ({g}))"
    stats = f", {base.STATS.replace('FROM samples)', 'FROM samples WHERE y < 2)').replace('SEMI JOIN samples USING (sample_id)', 'SEMI JOIN (SELECT * FROM samples WHERE y < 2) k USING (sample_id)')}" if data_type == "zscore" else ""
    join = "LEFT JOIN stats ON stats.feature_id = t.f" if data_type == "zscore" else ""
    return f"""WITH {base.X}, {base.SAMPLES}, {base.terms(SOME)}{stats}, kn AS (SELECT * FROM samples WHERE y < 2), fp AS (SELECT DISTINCT f, perm FROM terms, (SELECT range::INT AS perm FROM range({PERMUTED}))),
pl AS (SELECT f, perm, sample_id, row_number() OVER (PARTITION BY f, perm ORDER BY {draw_sql(SEED, 'mda', 'f', 'perm', 'sample_id')}, sample_id) AS place FROM kn, fp),
vl AS (SELECT feature_id AS f, value, row_number() OVER (PARTITION BY feature_id ORDER BY sample_id) AS place FROM x SEMI JOIN kn USING (sample_id)),
nw AS (SELECT f, perm, sample_id, value FROM pl JOIN vl USING (f, place)),
md AS (SELECT model_id, f AS pf, perm FROM terms, (SELECT range::INT AS perm FROM range({PERMUTED})) UNION ALL SELECT DISTINCT model_id, -1, 0 FROM terms),
vv AS (SELECT md.model_id, md.pf, md.perm, kn.sample_id, kn.y, t.f, t.c, CASE WHEN t.f = md.pf THEN nw.value ELSE x.value END AS v FROM md JOIN terms t USING (model_id) CROSS JOIN kn LEFT JOIN x ON x.feature_id = t.f AND x.sample_id = kn.sample_id LEFT JOIN nw ON nw.f = t.f AND nw.perm = md.perm AND nw.sample_id = kn.sample_id),
ps AS (SELECT model_id, pf, perm, sample_id, any_value(y) AS y, {score} AS score FROM vv t {join} GROUP BY 1, 2, 3, 4), pr AS (SELECT model_id, pf, perm, y, {'round(score, 9)' if data_type in ('log', 'zscore') else 'score'} AS score FROM ps),
{base.auc('pr', 'pa', 'model_id, pf, perm')}, im AS (SELECT a.model_id, a.pf AS feature_id, any_value(b.auc) - avg(a.auc) AS importance FROM pa a JOIN pa b ON b.model_id = a.model_id AND b.pf = -1 WHERE a.pf >= 0 GROUP BY 1, 2)"""


def falls(spark, sf, language, data_type):
    x, samples = fx.abundance(spark, sf), fx.abundance_samples(spark, sf)
    return importance.of_models(fx.models(x, SOME), dense.Matrix(x, samples), x, PERMUTED, SEED, language, data_type)


for _language, _type in (("ternary", "prevalence"), ("ratio", "raw"), ("ratio", "prevalence"), ("ternary", "zscore")):
    query(f"mda_{_language}_{_type}", f"{mda_sql(_language, _type)} SELECT model_id, feature_id, round(importance, 6) AS importance FROM im")(lambda spark, sf, l=_language, t=_type: r(falls(spark, sf, l, t), "importance", digits=6))

IM = mda_sql("ratio", "raw")
query("mda_median", f"{IM}, ev AS (SELECT m.model_id, f.feature_id, importance, coalesce(importance, 0) AS v FROM (SELECT DISTINCT model_id FROM terms) m CROSS JOIN (SELECT DISTINCT feature_id FROM im) f LEFT JOIN im USING (model_id, feature_id)), md1 AS (SELECT feature_id, median(v) AS m, count(importance) / count(*)::DOUBLE AS scope_pct FROM ev GROUP BY 1), dv AS (SELECT feature_id, median(abs(v - m)) * 1.4826::DOUBLE AS dispersion FROM ev JOIN md1 USING (feature_id) GROUP BY 1) SELECT feature_id, round(m * scope_pct, 6) AS importance, round(dispersion * scope_pct, 6) AS dispersion, round(scope_pct, 6) AS scope_pct FROM md1 JOIN dv USING (feature_id)")(
    lambda spark, sf: r(importance.over_models_median(falls(spark, sf, "ratio", "raw"), SOME, True), "importance", "dispersion", "scope_pct", digits=6)
)
query("mda_pruned_by_quantile", f"{IM}, rd AS (SELECT model_id, feature_id, round(importance, 6) AS importance FROM im), th AS (SELECT model_id, quantile_cont(importance, 0.5) - 0.001::DOUBLE AS threshold FROM rd GROUP BY 1), o AS (SELECT rd.*, threshold, row_number() OVER (PARTITION BY model_id ORDER BY importance DESC, feature_id) AS place FROM rd JOIN th USING (model_id)) SELECT model_id, feature_id FROM o WHERE round(importance - threshold, 9) >= 0 OR place <= 2")(
    lambda spark, sf: (lambda i: importance.pruned_by_quantile(fx.models(fx.abundance(spark, sf), SOME), i, 0.5, 0.001, 2).select("model_id", F.explode("terms.f").alias("feature_id")))(r(falls(spark, sf, "ratio", "raw"), "importance", digits=6))
)

# ---------------------------------------------------------------- models without a term

_LESS = f"WITH {base.X}, {base.SAMPLES}, {base.terms(20)}, dr AS (SELECT DISTINCT a.model_id * 1000 + b.f AS model_id, a.f, a.c FROM terms a JOIN terms b ON a.model_id = b.model_id AND a.f <> b.f), {base.scores(source='dr')}, {base.auc()}"
query("leave_one_out", f"{_LESS} SELECT (model_id // 1000)::BIGINT AS model_id, (model_id % 1000)::INT AS feature_id, round(auc, 9) AS auc FROM aucs")(
    lambda spark, sf: (lambda x: r(dense.leave_one_out(fx.models(x, 20), dense.Matrix(x, fx.abundance_samples(spark, sf))), "auc"))(fx.abundance(spark, sf))
)
#: The first term of each model that isn't missed, as the search would drop it.
query("aco_first_removal", f"{_LESS}, wh AS (SELECT model_id AS id, auc AS whole FROM (WITH {base.scores().replace('sc AS', 'sw AS')}, {base.auc('sw', 'aw')} SELECT * FROM aw)), lo AS (SELECT (model_id // 1000)::BIGINT AS id, (model_id % 1000)::INT AS feature_id, auc FROM aucs) SELECT id AS model_id, min(feature_id) FILTER (round(auc - whole + 0.001::DOUBLE, 12) >= 0) AS feature_id FROM lo JOIN wh USING (id) GROUP BY 1")(
    lambda spark, sf: first_removal(spark, sf)
)


def first_removal(spark, sf):
    """The first term that ``ants.trimmed`` drops of each model (null: none)."""
    x = fx.abundance(spark, sf)
    models = fx.models(x, 20)
    less = ants.trimmed(models, dense.Matrix(x, fx.abundance_samples(spark, sf)), 0.001).select("model_id", F.col("terms.f").alias("kept"))
    both = models.join(less, "model_id")
    return both.select("model_id", F.array_min(F.array_except("terms.f", "kept")).alias("feature_id"))


# ---------------------------------------------------------------- juries fitted on training samples

FITTED = runs.PARAMS | {"vote": runs.PARAMS["vote"] | {"threshold": 0.0, "window": 5.0}}
_EX = "ex AS (SELECT model_id, threshold FROM family WHERE sensitivity >= 0.3 AND specificity >= 0.3 QUALIFY row_number() OVER (ORDER BY rank) <= 7)"
#: Votes on training samples; the grid's step follows their number.
_TRAINED = f"""tv AS (SELECT sample_id, any_value(y) AS y, avg(CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS q FROM sc JOIN ex USING (model_id) GROUP BY 1),
st AS (SELECT CASE WHEN count(*) <= 50 THEN 0.1::DOUBLE WHEN count(*) <= 200 THEN 0.05::DOUBLE ELSE 0.01::DOUBLE END AS step FROM samples),
gd AS (SELECT unnest(range(1, round(1 / step)::BIGINT)) AS i, step FROM st), gv AS (SELECT i, i * step AS t, y, q FROM tv, gd WHERE abs(q - i * step) >= 0.05),
yo AS (SELECT i, t, coalesce((count(*) FILTER (y = 1 AND q >= t))::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 0) + coalesce((count(*) FILTER (y = 0 AND q < t))::DOUBLE / nullif(count(*) FILTER (y = 0), 0), 0) - 1 AS youden FROM gv GROUP BY 1, 2),
th AS (SELECT coalesce((SELECT t FROM yo WHERE round(youden, 12) > 0 ORDER BY round(youden, 12) DESC, i LIMIT 1), 0.5::DOUBLE) AS vt)"""


@query("run_jury_fitted", f"{runs.RUN}, {_EX}, {_TRAINED}, hv AS (SELECT sample_id, any_value(y) AS y, avg(c) AS q FROM hc SEMI JOIN ex USING (model_id) GROUP BY 1) SELECT sample_id, y, round(q, 9) AS ratio, CASE WHEN abs(q - vt) < 0.05 THEN 2 WHEN q >= vt THEN 1 ELSE 0 END AS predicted, round(vt, 9) AS vote_threshold FROM hv, th")
def _(spark, sf):
    """Held-out votes of a jury whose threshold was found on the training samples."""
    out = run.run_on_data(fx.abundance(spark, sf), fx.abundance_samples(spark, sf), Params.of(FITTED))
    return r(out.jury.withColumn("vote_threshold", F.lit(out.experts.select("vote_threshold").first()[0])), "ratio", "vote_threshold")


@query("vote_youden_grid", f"{ranking.pop_sql(15)}, tv AS (SELECT sample_id, any_value(y) AS y, avg(CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS q FROM sc JOIN best USING (model_id) GROUP BY 1), gd AS (SELECT unnest(range(1, 20)) AS i), gv AS (SELECT i, i * 0.05::DOUBLE AS t, y, q FROM tv, gd WHERE y < 2 AND abs(q - i * 0.05::DOUBLE) >= 0.03), yo AS (SELECT i::INT AS i, t AS threshold, coalesce((count(*) FILTER (y = 1 AND q >= t))::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 0) + coalesce((count(*) FILTER (y = 0 AND q < t))::DOUBLE / nullif(count(*) FILTER (y = 0), 0), 0) - 1 AS youden FROM gv GROUP BY 1, 2) SELECT i, round(threshold, 9) AS threshold, round(youden, 9) AS youden FROM yo")
def _(spark, sf):
    from ..functions import scoring as fs
    from ..operators import roc

    s = scored(spark, sf, n=15)
    votes = s.join(F.broadcast(roc.best_threshold(s).select("model_id", "threshold")), "model_id").select("model_id", "sample_id", "y", fs.predicted(F.col("score"), F.col("threshold")).alias("vote"))
    return r(voting.youden_grid(votes, votes.select("model_id").distinct().withColumn("weight", F.lit(1.0)), 0.05, 3.0), "threshold", "youden")


# ---------------------------------------------------------------- cross-validated runs

OUTER = 5
CV = runs.PARAMS | {"folds": {"outer": OUTER, "alpha": runs.LEVEL, "method": "wald"}, "importance": {"permutations": 2}}


def fold_sql(k: int) -> str:
    split = f"sp AS (SELECT sample_id, {chunk_sql(OUTER)} AS fold FROM {places('fold', ['y'], 'everyone WHERE y < 2')})"
    return f"SELECT * FROM ({runs.run_sql(split, f'fold <> {k}', f'fold = {k}')} SELECT {k} AS fold, model_id AS term_key, rank, round(family.auc, 9) AS auc, threshold, round(ha.auc, 9) AS valid_auc, round({runs._SE}, 9) AS valid_sensitivity, round({runs._SP}, 9) AS valid_specificity FROM family JOIN ha USING (model_id) JOIN hm USING (model_id))"


@query("run_cv", " UNION ALL ".join(fold_sql(k) for k in range(OUTER)))
def _(spark, sf):
    """The families of five folds, each judged on the fold that it hasn't seen."""
    out = run.run_cv(fx.abundance(spark, sf), fx.abundance_samples(spark, sf), Params.of(CV)).family
    return r(out.select("fold", "term_key", "rank", "auc", "threshold", "valid_auc", "valid_sensitivity", "valid_specificity"), "auc", "valid_auc", "valid_sensitivity", "valid_specificity")
