"""Operators against fixed values, direct definitions and each other."""

import math
import random

import numpy as np
import pytest
from hypothesis import example, given
from hypothesis import strategies as st

from scantling.functions import distributions, hashing, scoring
from scantling.operators import dense, fitness, genetic, linear, population, resampling, roc, scores, screening, voting
from scantling.sources import store, text

#: A six-sample, two-feature data set and its tests' probabilities.
X = [(0, 0, 0.9), (3, 0, 0.12), (4, 0, 0.01), (0, 1, 0.01), (1, 1, 0.91), (3, 1, 0.75), (5, 1, 0.9)]
Y = [0.0, 1.0, 0.0, 1.0, 1.0, 1.0]
P_STUDENT = {0: 0.20893746598423224, 1: 0.12215172301873412}
P_WILCOXON = {0: 0.8057327908484386, 1: 0.3475580367718807}


@pytest.fixture(scope="module")
def tiny(spark):
    x = spark.createDataFrame(X, "sample_id long, feature_id int, value double")
    return x, spark.createDataFrame(list(enumerate(Y)), "sample_id long, y double")


def test_fixed_probabilities(tiny):
    t = {r.feature_id: r for r in screening.student_t(*tiny, alpha=1.5).collect()}
    w = {r.feature_id: r for r in screening.wilcoxon(*tiny, alpha=1.5).collect()}
    for f in (0, 1):
        assert abs(t[f].p - P_STUDENT[f]) < 1e-9 and abs(w[f].p - P_WILCOXON[f]) < 1e-9
        assert t[f]["class"] == w[f]["class"] == f
    assert screening.student_t(*tiny, alpha=1e-5).filter("feature_id = 1").first()["class"] == 2
    for kind in ({"min_mean": 0.95}, {"min_prevalence": 0.95}):
        r = screening.student_t(*tiny, alpha=1.5, **kind).filter("feature_id = 1").first()
        assert (r["class"], r.p) == (2, 2.0)


def auc_by_pairs(s, y):
    pos, neg = [a for a, b in zip(s, y) if b == 1], [a for a, b in zip(s, y) if b == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.5


@given(st.lists(st.tuples(st.integers(-5, 5), st.sampled_from([0.0, 1.0])), min_size=1, max_size=30))
def test_auc_by_its_definition_and_symmetries(rows):
    s, y = np.array([float(a) for a, _ in rows]), np.array([b for _, b in rows])
    a = dense.auc(s, y)
    assert abs(a - auc_by_pairs(s, y)) < 1e-12 and 0 <= a <= 1
    assert abs(dense.auc(np.exp(s), y) - a) < 1e-12
    if 0 < y.sum() < len(y):
        assert abs(dense.auc(-s, y) - (1 - a)) < 1e-12


def threshold_by_scan(s, y):
    """Every candidate in order, the first strict maximum stays."""
    values = sorted(set(s))
    best = (-math.inf, None)
    for t in [*values, values[-1] + 1.0]:
        sens = np.mean([a >= t for a, b in zip(s, y) if b == 1])
        spec = np.mean([a < t for a, b in zip(s, y) if b == 0])
        if sens + spec - 1 > best[0] + 1e-9:
            best = (sens + spec - 1, t)
    return best


@example([(0, 0.0)] * 3 + [(0, 1.0)] * 3 + [(1, 0.0), (1, 1.0), (1, 1.0), (-1, 0.0)])  # 1 + 0.2 and 0.4 + 0.8
@given(st.lists(st.tuples(st.integers(-4, 4), st.sampled_from([0.0, 1.0])), min_size=2, max_size=25).filter(lambda r: 0 < sum(b for _, b in r) < len(r)))
def test_best_threshold_by_a_scan(rows):
    s, y = np.array([float(a) for a, _ in rows]), np.array([b for _, b in rows])
    got = dense.best_threshold(s, y)
    want = threshold_by_scan(s, y)
    assert got["threshold"] == want[1] and abs(got["objective"] - want[0]) < 1e-12


def random_data(spark, seed=1, n=40, f=6):
    rng = random.Random(seed)
    x = [(i, j, float(rng.randint(1, 4))) for i in range(n) for j in range(f) if rng.random() < 0.6]
    y = [(i, float(rng.choice([0, 0, 1, 1, 2]))) for i in range(n)]
    m = [(k, [(j, rng.choice([-1, 1])) for j in sorted(rng.sample(range(f), rng.randint(1, 4)))]) for k in range(12)]
    return spark.createDataFrame(x, "sample_id long, feature_id int, value double"), spark.createDataFrame(y, "sample_id long, y double"), spark.createDataFrame(m, "model_id long, terms array<struct<f:int,c:int>>")


@pytest.mark.parametrize("language", ["ternary", "ratio"])
@pytest.mark.parametrize("data_type", ["raw", "prevalence", "log", "zscore"])
def test_both_scoring_paths_agree(spark, language, data_type):
    from scantling.operators import dataset

    x, samples, models = random_data(spark)
    known = samples.filter("y < 2")
    stats = dataset.zscore_stats(x, known) if data_type == "zscore" else None
    s = scores.evaluate(models, x, known, language, data_type, 1e-5, stats)
    a = {r.model_id: r.auc for r in roc.auc(s.selectExpr("model_id", "y", "round(score, 9) as score")).collect()}
    m = dense.Matrix(x, samples)
    for row in models.collect():
        v = m.scores(np.searchsorted(m.features, [t.f for t in row.terms]), np.array([t.c for t in row.terms], float), language, m.read(data_type), data_type)
        assert abs(dense.auc(v.round(9), m.y) - a[row.model_id]) < 1e-12


def test_samples_without_any_term_still_score(spark):
    x, samples, models = random_data(spark)
    got = scores.evaluate(models, x.filter("sample_id <> 7"), samples)
    assert got.count() == 12 * 40 and {r.score for r in got.filter("sample_id = 7").collect()} == {0.0}


def test_unknown_labels_count_for_rejection_only(spark):
    rows = spark.createDataFrame([(0, 1.0, 1), (0, 0.0, 2), (0, 2.0, 2), (0, 2.0, 1)], "model_id int, y double, predicted int")
    r = roc.class_metrics(rows).first()
    assert r.rejection_rate == 0.5 and r.accuracy == 1.0 and r.specificity == 0.0


def test_intervals():
    wald = distributions.binomial_interval(0.8, 50, 0.05)
    exact = distributions.binomial_interval(0.8, 50, 0.05, "clopper_pearson")
    assert exact[0] < wald[0] and abs(exact[0] - 0.66282) < 1e-4
    for m in ("wald", "wald_continuity", "wilson", "agresti_coull", "clopper_pearson"):
        lo, hi = distributions.binomial_interval(0.3, 40, 0.1, m)
        assert 0 <= lo < 0.3 < hi <= 1
    assert abs(distributions.beta_cdf(0.3, 2, 5) - 0.579825) < 1e-6


@given(st.lists(st.tuples(st.integers(0, 8), st.sampled_from([-1, 1])), max_size=6), st.lists(st.tuples(st.integers(0, 8), st.sampled_from([-1, 1])), max_size=6))
def test_jaccard_is_symmetric_and_bounded(a, b):
    a, b = set(a), set(b)
    d = lambda p, q: 1 - len(p & q) / len(p | q) if p | q else 0.0
    assert d(a, b) == d(b, a) and 0 <= d(a, b) <= 1


def test_population_order_and_family(spark):
    rows = [(0, 0.9, 0.9, "a"), (1, float("nan"), 0.1, "b"), (2, float("inf"), 0.1, "c"), (3, 0.9 + 1e-9, 0.9, "d"), (4, float("-inf"), 0.1, "e"), (5, 0.2, 0.2, "f")]
    m = spark.createDataFrame(rows, "model_id long, fit double, auc double, term_key string")
    assert [r.model_id for r in population.ranked(m).orderBy("rank").collect()] == [2, 3, 0, 5, 4, 1]
    fit = m.filter("model_id in (0, 3, 5)")
    assert {r.model_id for r in population.family(fit, 0.05).collect()} == {0, 3}
    assert population.diverse(m.withColumn("terms", m.term_key), 0.0).count() == 0
    clones = spark.createDataFrame([(k, 0.5, "1:1,2:1" if k % 3 else "7:-1") for k in range(12, 0, -1)], "model_id long, fit double, term_key string")
    assert sorted(r.model_id for r in population.diverse(clones, 50.0).collect()) == [1, 3]


def test_folds_are_even_and_do_not_depend_on_partitions(spark):
    samples = spark.createDataFrame([(i, float(i % 3)) for i in range(100)], "sample_id long, y double")
    a = {r.sample_id: r.fold for r in resampling.folds(samples, 4, 7).collect()}
    b = {r.sample_id: r.fold for r in resampling.folds(samples.repartition(5), 4, 7).collect()}
    assert a == b and all(i % 3 != 2 for i in a)
    for label in (0, 1):
        n = [sum(1 for i, f in a.items() if f == k and i % 3 == label) for k in range(4)]
        assert max(n) - min(n) <= 1
    w = resampling.bootstrap(samples, 3, 7).groupBy("replicate").sum("weight").collect()
    assert {r[1] for r in w} == {67}


def test_draws_are_uniform(spark):
    u = [r[0] for r in spark.range(4000).select(hashing.uniform(1, "u", "id")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02


def test_votes(spark):
    votes = spark.createDataFrame([(0, 0, 1.0, 1), (1, 0, 1.0, 0), (2, 0, 1.0, 2), (0, 1, 0.0, 2), (1, 1, 0.0, 2), (2, 1, 0.0, 2), (0, 2, 1.0, 1), (1, 2, 1.0, 1), (2, 2, 1.0, 1)], "model_id int, sample_id int, y double, vote int")
    experts = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "model_id int, weight double")
    assert {r.sample_id: (r.ratio, r.predicted) for r in voting.majority(votes, experts, 0.5, 5).collect()} == {0: (0.5, 2), 1: (0.5, 2), 2: (1.0, 1)}
    assert {r.sample_id: (r.ratio, r.predicted) for r in voting.consensus(votes, experts, 0.8).collect()} == {0: (0.5, 2), 1: (-1.0, 2), 2: (1.0, 1)}


def test_elastic_net_meets_its_conditions(spark):
    x, samples, _ = random_data(spark, 3, 60, 5)
    samples = samples.filter("y < 2")
    alpha, w = linear.path(x, samples, alphas=4, high=0.2, low=0.02)[-1]
    m = dense.Matrix(x, samples)
    g = (m.values - m.mean) / m.std
    v = np.array([w.get(int(f), 0.0) for f in m.features])
    grad = g.T @ (m.y - m.y.mean() - g @ v) / len(m.y)
    for k, c in enumerate(v):
        assert abs(grad[k] - alpha * np.sign(c)) < 1e-3 if c else abs(grad[k]) <= alpha + 1e-3


def test_genetic_steps_keep_children_within_their_parents(spark):
    _, _, models = random_data(spark)
    m = models.withColumn("rank", models.model_id)
    pairs = genetic.couples(m, 20, 5)
    terms = {r.model_id: {(t.f, t.c) for t in r.terms} for r in models.collect()}
    own = {r.child: (r.a, r.b) for r in pairs.collect()}
    assert all(a != b for a, b in own.values())
    for r in genetic.cross_over(m, pairs, 5).collect():
        a, b = own[r.child]
        assert (r.f, r.c) in terms[a] | terms[b]


def test_fits_of_a_constant_score_are_zero(spark):
    s = spark.createDataFrame([(0, float(i), 1.0) for i in range(5)], "model_id int, y double, score double")
    for f in ("pearson", "spearman", "mutual_info"):
        assert fitness.FITS[f](s).first().fit == 0.0


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name;s1;s2;s3\nf1;1.5;0;x\nf2;0;2;3\nf3;1;1;1\n")
    (tmp_path / "y.tsv").write_text("sample\tclass\ns1\t1\ns1\t0\ns3\t1\nother\t1\n")
    (tmp_path / "a.tsv").write_text("feature\tprior_weight\tkind\nf1\t2\tred\nf9\t1\tblue\n")
    x, samples, features = text.matrix(spark, str(tmp_path / "x.csv"))
    assert sorted(tuple(r) for r in x.collect()) == [(0, 0, 1.5), (0, 2, 1.0), (1, 1, 2.0), (1, 2, 1.0), (2, 1, 3.0), (2, 2, 1.0)]
    assert {r.sample_id: r.y for r in text.labels(spark, str(tmp_path / "y.tsv"), samples).collect()} == {0: 0.0, 1: 2.0, 2: 1.0}
    r = text.annotations(spark, str(tmp_path / "a.tsv"), features, "feature").collect()
    assert [(a.feature_id, a.prior_weight, a.tags) for a in r] == [(0, 2.0, {"kind": "red"})]
    y, s2, f2 = text.matrix(spark, str(tmp_path / "x.csv"), features_in_rows=False)
    assert s2.count() == 3 and f2.count() == 3
    (tmp_path / "z.csv").write_text("nothing\n")
    with pytest.raises(ValueError):
        text.delimiter(spark, str(tmp_path / "z.csv"))


def test_store(spark, tmp_path):
    p = store.Params.of({"general": {"algo": "beam"}, "beam": {"k_stop": 5}})
    assert store.Params.of_text(p.to_text()) == p and store.Params.of_text("# none\n") == store.Params()
    store.save(str(tmp_path / "e"), {"models": spark.range(3)}, p)
    tables, q = store.load(spark, str(tmp_path / "e"))
    assert q == p and tables["models"].count() == 3
    for bad in ({"general": {"x": 1}}, {"y": {}}, {"general": {"algo": "none"}}, {"general": {"bootstrap": 5}}):
        with pytest.raises(ValueError):
            store.Params.of(bad)


def test_languages_reject_what_they_lack():
    with pytest.raises(ValueError):
        scoring.score("ternary", "zscore")


def test_golden_section_and_truncated_normal():
    from scantling.functions.distributions import golden_section, truncated_normal

    assert abs(golden_section(lambda v: (v - 3.25) ** 2) - 3.25) < 1e-5
    draws = [(k + 0.5) / 2000 for k in range(2000)]
    for mean, deviation in ((0.5, 1.0), (-2.0, 0.7), (3.0, 0.5)):
        up, down = ([truncated_normal(mean, deviation, u, side) for u in draws] for side in (True, False))
        assert min(up) >= 0 >= max(down) and up == sorted(up)
    assert abs(np.mean([truncated_normal(0.0, 1.0, u) for u in draws]) - math.sqrt(2 / math.pi)) < 1e-2


def test_folds_with_unknown_names_are_an_error(spark):
    from scantling.operators import resampling

    samples = spark.createDataFrame([(1, "a", 0.0)], "sample_id long, name string, y double")
    with pytest.raises(ValueError, match="1 samples"):
        resampling.rebuilt(spark.createDataFrame([(0, "a"), (1, "b")], "fold int, name string"), samples).count()
