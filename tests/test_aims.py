"""What runs maximize: bands, folds, fits and importances against plain loops; whole runs of every algorithm."""

import math

import numpy as np
import pytest

from scantling.functions.metrics import OBJECTIVES
from scantling.operators import ants, dense, fitness, goals, importance, population, resampling, run
from scantling.sources import store


def toy(spark, n=60, features=6, seed=3, unknown=0):
    """Samples of which the first features tell the class, some without a label."""
    rng = np.random.default_rng(seed)
    y = (np.arange(n) % 2).astype(float)
    v = np.round(rng.gamma(2.0, 2.0, (n, features)) * (rng.random((n, features)) < 0.7), 3)
    v[:, 0] += 2 * y
    v[:, 1] += 2 * (1 - y)
    if unknown:
        y[:unknown] = 2.0
    x = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(n) for j in range(features) if v[i, j]], "sample_id long, feature_id int, value double")
    return x, spark.createDataFrame([(i, float(y[i])) for i in range(n)], "sample_id long, y double")


def by_repeats(s, y, weights, by):
    """The best threshold of each replicate, its samples repeated by their weights."""
    out = []
    for w in weights:
        k = np.repeat(np.arange(len(s)), w)
        out.append(dense.best_threshold(s[k], y[k], by)["threshold"])
    return np.array(out)


@pytest.mark.parametrize("by", [o for o in OBJECTIVES])
@pytest.mark.parametrize("seed", range(6))
def test_replicates_equal_repeated_samples(by, seed):
    rng = np.random.default_rng(seed)
    n = 40
    s, y = rng.integers(-4, 5, n).astype(float) / (1 + seed % 3), (rng.random(n) < 0.4).astype(float)
    y[:2] = 0, 1
    weights = rng.integers(0, 3, (50, n))
    weights[:, :2] = 1  # both classes in every replicate
    assert (goals.replicate_thresholds(s, y, weights, by) == by_repeats(s, y, weights, by)).all()


def test_bands_equal_the_relational_ones(spark):
    x, samples = toy(spark, unknown=7)
    m = dense.Matrix(x, samples, known=False)
    models = spark.createDataFrame([(1, [(0, 1), (1, -1)]), (2, [(2, 1)]), (3, [(3, -1), (4, 1)])], "model_id long, terms array<struct<f:int,c:int>>")
    boot = resampling.bootstrap(samples, 100, 5)
    out = {r.model_id: r for r in goals.judged(models, m, goals.Goal(bands=goals.bands(m, samples, 100, 0.1, 5))).collect()}
    from scantling.operators import scores

    rows = scores.evaluate(models, x, samples)
    want = {r.model_id: r for r in resampling.percentiles(resampling.replicate_thresholds(rows, boot), "threshold", 100, 0.1).collect()}
    for k, r in out.items():
        assert abs(r.lower - want[k].lower) < 1e-9 and abs(r.upper - want[k].upper) < 1e-9
        s = np.array([a.score for a in rows.filter(f"model_id = {k}").collect()])
        assert abs(r.rejection_rate - ((s <= r.upper) & (s >= r.lower)).mean()) < 1e-9


@pytest.mark.parametrize("fit", goals.REGRESSIONS)
def test_regression_fits_equal_the_relational_ones(spark, fit):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 9, 80) / 2.0, rng.integers(0, 30, 80) / 3.0
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(s, y)], "model_id int, score double, y double")
    assert abs(fitness.FITS[fit](rows).first()["fit"] - goals.REGRESSIONS[fit](s, y)) < 1e-9
    assert goals.REGRESSIONS["pearson"](np.ones(5), np.arange(5.0)) == 0.0 == goals.REGRESSIONS["mutual_info"](np.ones(5), np.ones(5))


def test_folds_as_masks():
    rng = np.random.default_rng(4)
    s, y, fold = rng.normal(size=30), (rng.random(30) < 0.5).astype(float), rng.integers(-1, 3, 30)
    want = []
    for k in range(3):
        t, v = (dense.auc(s[own], y[own]) for own in ((fold != k) & (fold >= 0), fold == k))
        want.append(t - abs(t - v) * 0.25)
    assert abs(goals.over_folds(s, y, goals.Goal(overfit=0.25), fold) - np.mean(want)) < 1e-12


@pytest.mark.parametrize("language,data_type", [("ternary", "raw"), ("ratio", "log"), ("ratio", "zscore"), ("ternary", "log"), ("ratio", "prevalence")])
def test_importance_of_any_model_by_brute_force(spark, language, data_type):
    x, samples = toy(spark)
    m = dense.Matrix(x, samples)
    models = spark.createDataFrame([(1, [(0, 1), (1, -1), (3, 1)]), (2, [(2, 1), (4, -1)])], "model_id long, terms array<struct<f:int,c:int>>")
    got = {(r.model_id, r.feature_id): r.importance for r in importance.of_models(models, m, x, 4, 9, language, data_type).collect()}
    new = {}
    for r in resampling.shuffled_feature(x, samples, x.select("feature_id").distinct(), 4, 9).collect():
        new.setdefault((r.feature_id, r.permutation), {})[r.sample_id] = r.value
    for row in models.collect():
        f, c = np.array([t.f for t in row.terms]), np.array([t.c for t in row.terms], float)
        base = dense.auc(m.scores(f, c, language, m.read(data_type), data_type), m.y)
        for k in f:
            falls = []
            for p in range(4):
                other = m.rows(np.ones(len(m.y), bool))
                other.values = m.values.copy()
                other.values[:, k] = [new[k, p].get(i, 0.0) for i in m.samples]
                other.stored = other.values != 0
                falls.append(base - dense.auc(other.scores(f, c, language, other.read(data_type), data_type), m.y))
            assert abs(got[row.model_id, k] - np.mean(falls)) < 1e-9
    assert len(got) == 5


def test_median_over_models_counts_models_without_the_feature(spark):
    rows = spark.createDataFrame([(1, 7, 0.4), (2, 7, 0.2), (3, 7, 0.9), (1, 8, 0.5)], "model_id long, feature_id int, importance double")
    got = {r.feature_id: r for r in importance.over_models_median(rows, 5).collect()}
    v = np.array([0.4, 0.2, 0.9, 0, 0])
    assert abs(got[7].importance - np.median(v)) < 1e-12 and abs(got[7].dispersion - 1.4826 * np.median(abs(v - np.median(v)))) < 1e-12
    assert got[8].importance == 0 and abs(got[8].scope_pct - 0.2) < 1e-12


SMALL = {
    "beam": {"k_stop": 2, "criterion": 100.0}, "ga": {"size": 20, "epochs": 2, "k_max": 4}, "aco": {"ants": 10, "iterations": 2, "k_max": 4, "k_min": 2},
    "sa": {"chains": 2, "steps": 60, "k": 2, "k_max": 4}, "ils": {"chains": 2, "steps": 60, "k": 2, "k_max": 4}, "lasso": {"alphas": 5}, "mcmc": {"steps": 40, "burn": 20, "most": 5},
}


def params(algo="beam", **parts):
    own = {"general": {"algo": algo, "seed": 7}, "data": {"max_p": 1.5, "min_prevalence": 0.0}, algo: SMALL[algo], "vote": {"min_perf": 0.0}}
    for k, v in parts.items():
        own[k] = own.get(k, {}) | v
    return store.Params.of(own)


@pytest.mark.parametrize("algo", SMALL)
def test_every_algorithm_through_a_whole_run(spark, algo):
    out = run.run_on_data(*toy(spark), params(algo))
    best = out.models.orderBy("rank").first()
    assert best.auc > 0.6 and out.family.count() >= 1 and out.tested.count() == out.family.count()
    assert {r.predicted for r in out.jury.collect()} <= {0, 1, 2} and out.jury.count() == 12


def test_a_run_by_another_fit_with_bands_and_inner_folds(spark):
    x, samples = toy(spark, unknown=4)
    p = params(general={"fit": "mcc", "bootstrap": 100, "ci_penalty": 0.5, "k_penalty": 0.01, "bias_penalty": 0.1}, folds={"inner": 3, "overfit_penalty": 0.5})
    rows = run.run_on_data(x, samples, p).models.collect()
    assert rows and all(r.lower <= r.upper and 0 <= r.rejection_rate <= 1 for r in rows)
    plain = {r.term_key: r.fit for r in run.run_on_data(x, samples, params()).models.collect()}
    assert any(abs(r.fit - plain[r.term_key]) > 1e-3 for r in rows if r.term_key in plain)


def test_a_continuous_target(spark):
    x, samples = toy(spark)
    y = {r.sample_id: r.value for r in x.filter("feature_id = 0").collect()}
    target = spark.createDataFrame([(r.sample_id, y.get(r.sample_id, 0.0) * 3 + 1) for r in samples.collect()], "sample_id long, y double")
    out = run.run_on_data(x, target, params("ga", general={"fit": "spearman"}, ga={"k_max": 3, "size": 40, "epochs": 4}))
    best = out.models.orderBy("rank").first()
    assert best.fit > 0.7 and best.threshold is None and out.jury.count() == 0
    assert out.tested.columns == ["model_id", "term_key", "fit"] and out.tested.count() == out.family.count()


def test_refused_parameters():
    for bad in ({"general": {"fit": "r2"}}, {"general": {"algo": "sa", "fit": "mcc"}}, {"general": {"fit": "spearman", "language": "binary"}}, {"folds": {"inner": 1}}, {"general": {"algo": "ils"}, "folds": {"inner": 3}}, {"general": {"k_penalty": -1.0}}, {"importance": {"aggregation": "mode"}}):
        with pytest.raises(ValueError):
            store.Params.of(bad)


def test_jury_is_pruned_fitted_stored_and_loaded(spark, tmp_path):
    x, samples = toy(spark, n=80)
    p = params(general={"k_penalty": 0.001}, vote={"threshold": 0.0, "window": 2.0, "prune": True, "prune_below": 0.01, "prune_min_k": 1, "prune_permutations": 5, "min_perf": 0.0, "alpha": 0.5})
    out = run.run_on_data(x, samples, p)
    assert out.experts.select("vote_threshold").distinct().count() == 1
    assert out.experts.agg({"k": "min"}).first()[0] >= 1 and out.experts.filter("k <> size(terms)").count() == 0
    out.save(str(tmp_path / "run"))
    tables, loaded = store.load(spark, str(tmp_path / "run"))
    held = out.jury.select("sample_id")
    again = run.voted(tables["experts"], x, samples.join(held, "sample_id", "left_semi"), loaded)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.jury.collect()))


@pytest.mark.parametrize("on_valid", [False, True])
def test_cross_validated_run_equals_its_folds(spark, on_valid):
    x, samples = toy(spark, n=60)
    p = params(folds={"outer": 3, "alpha": 0.3, "fit_on_valid": on_valid}, importance={"permutations": 2, "aggregation": "median" if on_valid else "mean"})
    out = run.run_cv(x, samples, p)
    rows = out.family.collect()
    folds = {r.sample_id: r.fold for r in resampling.folds(samples, 3, 7).collect()}
    assert {r.fold for r in rows} == {0, 1, 2} and all(r.valid_auc > 0.3 for r in rows)
    m = dense.Matrix(x, samples)
    for r in rows:
        s = m.values[:, [t.f for t in r.terms]] @ np.array([t.c for t in r.terms], float)
        own = np.array([folds[i] for i in m.samples]) == r.fold
        assert abs(r.valid_auc - dense.auc(s[own], m.y[own])) < 1e-9
        assert abs(r.auc - dense.auc(s[own], m.y[own]) if on_valid else r.auc - dense.auc(s[~own], m.y[~own])) < 1e-9
    features = {r.feature_id: r for r in out.features.collect()}
    per = {}
    for r in out.importance.collect():
        per.setdefault(r.feature_id, []).append(r.importance)
    assert features.keys() == per.keys() and all(math.isclose(features[f].importance, np.median(v) if on_valid else np.mean(v), abs_tol=1e-12) and features[f].scope_pct == 1.0 for f, v in per.items())


@pytest.mark.parametrize("language,k_penalty", [("ternary", 0.0), ("ternary", 0.02), ("ratio", 0.005)])
def test_trimmed_models_by_hand(spark, language, k_penalty):
    x, samples = toy(spark, unknown=5)
    m = dense.Matrix(x, samples, known=False)
    rows = [(1, [(0, 1), (1, -1), (3, 1), (5, 1)]), (2, [(2, 1), (4, -1), (5, -1)]), (3, [(0, 1)]), (4, [(1, 1), (2, -1)])]
    got = {r.model_id: [(t.f, t.c) for t in r.terms] for r in ants.trimmed(spark.createDataFrame(rows, "model_id long, terms array<struct<f:int,c:int>>"), m, k_penalty, language).collect()}
    known = m.rows(m.y < 2)
    of = lambda terms: dense.auc(known.scores(np.array([t[0] for t in terms]), np.array([t[1] for t in terms], float), language, known.values), known.y)
    for i, terms in rows:
        whole, left = of(terms), list(terms)
        for t in terms:
            rest = [a for a in left if a != t]
            if rest and round(of(rest) - whole + k_penalty, 12) >= 0:
                left = rest
        assert got[i] == left


def test_listed_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, [(2, -1)], None)], "a long, terms array<struct<f:int,c:int>>, d double")
    assert population.listed(df).schema == df.schema and population.listed(df).collect() == df.collect()
