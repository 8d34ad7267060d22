"""What keeps tasks and the driver small however large the tables are."""

import os

import pytest

from scantling.operators import ants, chains, dense, goals, importance, resampling
from scantling.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
def test_abundance_is_dealt_by_its_rows_and_broadcasts_nothing(spark, monkeypatch):
    want = {tuple(r) for r in fx.abundance(spark, SF).collect()}
    monkeypatch.setattr(fx, "PER_TASK", 300)
    x = fx.abundance(spark, SF)
    assert x.rdd.getNumPartitions() == spark.read.parquet(f"{SF}/lineitem.parquet").count() // 300
    assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in x.collect()} == want


def toy(spark, n=60, f=5):
    import numpy as np

    rng = np.random.default_rng(3)
    x = [(i, k, float(v)) for i in range(n) for k, v in enumerate(rng.integers(0, 6, f)) if v]
    return spark.createDataFrame(x, "sample_id long, feature_id int, value double"), spark.createDataFrame([(i, float(rng.integers(0, 3) if i > 3 else i % 2)) for i in range(n)], "sample_id long, y double")


def test_blocks_give_what_a_shared_matrix_gives(spark, monkeypatch):
    x, samples = toy(spark)
    models = spark.createDataFrame([(1, [(0, 1), (1, -1)], 2), (2, [(2, 1), (3, -1), (4, 1)], 3)], "model_id long, terms array<struct<f:int,c:int>>, k long")
    goal = lambda m: goals.Goal("mcc", bands=goals.bands(m, samples, 100, 0.1, 5, 0.8), fold=resampling.folds(samples, 3, 5), overfit=0.5)

    def found():
        m, known = dense.Matrix(x, samples, known=False), dense.Matrix(x, samples)
        out = [goals.judged(models, m, goal(m)), dense.fit(models, known), dense.leave_one_out(models, known), ants.trimmed(models, known, 0.01), importance.of_models(models, known, x, 3, 7, "ratio"), chains.search(spark, known, "ils", chains=2, steps=30, k=2, k_max=4)]
        return m, [sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()), key=lambda r: r[:2]) for df in out]

    one, want = found()
    monkeypatch.setattr(dense, "ONE", 0)
    monkeypatch.setattr(dense, "ROWS", 7)
    several, got = found()
    assert one.one and not several.one and several.blocks.count() > 4
    assert got == want


def test_more_cells_than_a_task_may_share_are_searched(spark, monkeypatch):
    x, samples = toy(spark)
    monkeypatch.setattr(dense, "MOST_CELLS", 10)
    monkeypatch.setattr(dense, "ONE", 0)
    m = dense.Matrix(x, samples)
    assert dense.fit(spark.createDataFrame([(1, [(0, 1)])], "model_id long, terms array<struct<f:int,c:int>>"), m).count() == 1
    with pytest.raises(ValueError):
        m.whole


@needs_data
def test_abundance_is_stored_once_for_all_that_read_it(spark):
    fx.abundance(spark, SF).count()
    again = fx.abundance(spark, SF)
    assert again.storageLevel.useMemory
    assert "InMemoryTableScan" in again.groupBy("feature_id").count()._jdf.queryExecution().executedPlan().toString()


def test_ranges_never_fall_along_scores_and_whole_scores_are_counted():
    import numpy as np

    rng = np.random.default_rng(5)
    s = np.sort(np.r_[rng.normal(size=300) * 10.0 ** rng.integers(-8, 8, 300), 0.0, -1.0, 1.0, 2.0, 4.0, np.inf, -np.inf])
    for per in (1, 8):
        assert (np.diff(dense.ranges_of(s, per)) >= 0).all()
    y = rng.integers(0, 2, 200).astype(float)
    whole = rng.integers(-30, 30, 200).astype(float)
    at, p, n = dense.groups(whole, y)
    assert at.tolist() == sorted(set(whole)) and p.tolist() == [((whole == v) & (y == 1)).sum() for v in at] and n.tolist() == [((whole == v) & (y == 0)).sum() for v in at]
    assert [v.tolist() for v in dense.groups(whole + 0.5, y)] == [(at + 0.5).tolist(), p.tolist(), n.tolist()]


def test_tie_groups_of_blocks_travel_packed(spark, monkeypatch):
    x, samples = toy(spark)
    monkeypatch.setattr(dense, "ONE", 0)
    monkeypatch.setattr(dense, "ROWS", 7)
    models = spark.createDataFrame([(1, [(0, 1), (1, -1)])], "model_id long, terms array<struct<f:int,c:int>>")
    m = dense.Matrix(x, samples)
    rows = dense.tied(models, m, lambda model, b, g, row: [((model[0],), dense.scored(b, g, model, 1e-5), b.y)], "model_id long", "ternary", "raw", 1e-5).collect()
    assert sum(r["p"] + r["n"] for r in rows) == m.size
    assert len({(r["range"], r["first"]) for r in rows}) < m.size and all(len(r["scores"]) == 2 * len(r["ps"]) for r in rows)


def test_draws_and_permuted_values_are_dealt_by_their_number_and_never_broadcast(spark, monkeypatch):
    x, samples = toy(spark)
    monkeypatch.setattr(fx, "PER_TASK", 10)
    boot = resampling.bootstrap(samples, 10, 3)
    assert boot.rdd.getNumPartitions() > 8
    moved = resampling.shuffled_feature(x, samples.filter("y < 2"), x.select("feature_id").distinct(), 3, 3)
    for df, join in ((boot, "weight"), (moved, "value")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert join in plan and "SortMergeJoin" in plan
    assert boot.groupBy("replicate").sum("weight").select("sum(weight)").distinct().count() == 1


def test_ends_of_parts_tell_the_samples_that_are_in_without_a_row_for_each(spark, monkeypatch):
    x, samples = toy(spark)
    monkeypatch.setattr(dense, "ONE", 0)
    monkeypatch.setattr(dense, "ROWS", 7)
    m = dense.Matrix(x, samples, known=False)
    want = {}
    for r in resampling.bootstrap(samples, 20, 5, 0.6).collect():
        want.setdefault(r["replicate"], set()).add(r["sample_id"])
    b = goals.bands(m, samples, 20, 0.1, 5, 0.6)
    assert b.table is None and b.weights is None
    y = {r["sample_id"]: int(r["y"]) for r in samples.filter("y < 2").collect()}
    ids = sorted(y)
    monkeypatch.setattr(goals, "MANY", 0)
    for u, at in (b.last, goals.last_in_parts(m, 20, 5, 0.6), goals.last_in_parts(m, 20, 5, 0.6, 0.0)):  # all draws, those near, none near
        for r in range(20):
            drawn = dict(zip(ids, goals.hashing.draws(5, "part", r, [str(i).encode() for i in ids])))
            assert {i for i in ids if (drawn[i], i) <= (u[r, y[i]], at[r, y[i]])} == want[r]


def test_replicates_with_replacement_weigh_blocks_as_a_shared_matrix(spark, monkeypatch):
    x, samples = toy(spark)
    models = spark.createDataFrame([(1, [(0, 1), (1, -1)]), (2, [(2, 1)])], "model_id long, terms array<struct<f:int,c:int>>")
    found = lambda m: sorted([round(v, 9) for v in r] for r in goals.judged(models, m, goals.Goal(bands=goals.bands(m, samples, 100, 0.1, 5))).collect())
    want = found(dense.Matrix(x, samples))
    monkeypatch.setattr(dense, "ONE", 0)
    monkeypatch.setattr(dense, "ROWS", 7)
    assert found(dense.Matrix(x, samples)) == want


def test_permuted_columns_come_to_a_block_by_parts_of_the_features(spark, monkeypatch):
    x, samples = toy(spark)
    monkeypatch.setattr(dense, "ONE", 0)
    monkeypatch.setattr(dense, "CELLS", 100)
    m = dense.Matrix(x, samples)
    rows, parts = importance.permuted_blocks(x, m, x.select("feature_id").distinct(), 4, 3)
    rows = rows.collect()
    assert parts == 5 and len(rows) == parts * m.count and all(len(r["moved"]) <= 1 for r in rows)


def test_samples_of_folds_are_never_broadcast(spark):
    from scantling.operators import run

    _, samples = toy(spark)
    plan = run.part(samples, resampling.folds(samples, 3, 5).filter("fold <> 1"))._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [line for line in plan if "Join" in line]
    assert "SortMergeJoin" in joins[0]


@needs_data
def test_fitted_populations_and_importances_make_no_row_for_each_model_and_sample(spark, monkeypatch):
    from scantling.operators import scores
    from scantling.plans import ranking
    from scantling.plans import resampling as plans

    def refused(*args, **kwargs):
        raise AssertionError("a row for each model and sample")

    monkeypatch.setattr(scores, "evaluate", refused)
    assert ranking.fitted(spark, SF, 5).count() == 5
    assert plans.mda(spark, SF).count() > 4


def test_columns_are_permuted_in_steps_that_leave_no_shuffle_files(spark, monkeypatch):
    from scantling.sources import shared

    assert importance.waves([3, 4, 5], 4, 10, 80) == [([3, 4], range(4)), ([5], range(4))]
    assert importance.waves([3, 4], 5, 10, 30) == [([3], range(3)), ([3], range(3, 5)), ([4], range(3)), ([4], range(3, 5))]
    assert importance.waves([3], 2, 10, 1) == [([3], range(1)), ([3], range(1, 2))]
    x, samples = toy(spark)
    models = spark.createDataFrame([(1, [(0, 1), (1, -1)]), (2, [(2, 1), (3, -1), (4, 1)])], "model_id long, terms array<struct<f:int,c:int>>")
    found = lambda m: sorted((r.model_id, r.feature_id, round(r.importance, 9)) for r in importance.of_models(models, m, x, 3, 7, "ratio").collect())
    want = found(dense.Matrix(x, samples))
    monkeypatch.setattr(dense, "ONE", 0)
    monkeypatch.setattr(dense, "ROWS", 30)
    monkeypatch.setattr(importance, "WAVE", 360)
    settings = []
    deal = resampling.shuffled_feature
    monkeypatch.setattr(resampling, "shuffled_feature", lambda *a: settings.append((spark.conf.get(shared.CLEANUP), len(a[3]))) or deal(*a))
    assert found(dense.Matrix(x, samples)) == want
    assert len(settings) > 1 and set(settings) == {("true", 3)}
    assert spark.conf.get(shared.CLEANUP) == "false"


def test_medians_over_models_run_importances_once(spark):
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            n.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([(m, f, 0.1 * m * f) for m in range(3) for f in range(4)], "model_id long, feature_id int, importance double")
    assert importance.over_models_median(rows.mapInPandas(run, rows.schema), 4).count() == 4
    assert n.value == 12


def test_folds_of_large_tables_take_turns_and_leave_no_blocks(spark, monkeypatch):
    import threading

    from scantling.operators import run
    from scantling.sources.store import Params

    x, samples = toy(spark)
    p = Params.of({"general": {"algo": "beam", "seed": 7}, "data": {"max_p": 1.0, "min_prevalence": 0.0}, "beam": {"k_stop": 2, "criterion": 100.0}, "folds": {"outer": 2, "alpha": 0.5}, "importance": {"permutations": 1}})
    found = lambda: sorted((r.fold, r.term_key, round(r.valid_auc, 9)) for r in run.run_cv(x, samples, p).family.collect())
    want, made, now, most = found(), [], [0], [0]
    lock, search, init = threading.Lock(), run.found, dense.Matrix.__init__

    def searched(*a):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            return search(*a)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(run, "found", searched)
    monkeypatch.setattr(dense.Matrix, "__init__", lambda self, *a, **b: made.append(self) or init(self, *a, **b))
    monkeypatch.setattr(dense, "ONE", 0)
    assert found() == want and most[0] == 1
    assert len(made) == 4 and not any(m.blocks.is_cached for m in made)
