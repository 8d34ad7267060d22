"""A run's report against plain loops, its file, and the command line."""

import numpy as np
import pytest

from scantling import __main__ as command
from scantling.operators import dense, population, reports, run
from scantling.sources import rows, store
from tests.test_aims import params, toy


def counted(y, c):
    tp, fp, tn, fn = (float(((y == a) & (c == b)).sum()) for a, b in ((1, 1), (0, 1), (0, 0), (1, 0)))
    div = lambda a, b: a / b if b else 0.0
    se, sp, pr = div(tp, tp + fn), div(tn, tn + fp), div(tp, tp + fp)
    return {
        "accuracy": div(tp + tn, tp + fp + tn + fn), "sensitivity": se, "specificity": sp, "f1": div(2 * pr * se, pr + se), "ppv": pr, "npv": div(tn, tn + fn), "g_mean": (se * sp) ** 0.5,
        "mcc": div(tp * tn - fp * fn, ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5), "rejection_rate": float((c == 2).mean()),
    }


def by_hand(model, x, samples):
    """Metrics of a ternary model on raw values, with its own threshold or band."""
    v = {(r.sample_id, r.feature_id): r.value for r in x.collect()}
    own = sorted(map(tuple, samples.select("sample_id", "y").collect()))
    y = np.array([b for _, b in own])
    s = np.array([sum(t.c * v.get((i, t.f), 0.0) for t in model.terms) for i, _ in own])
    c = (s >= model.threshold).astype(int) if model.lower is None else np.where(s > model.upper, 1, np.where(s < model.lower, 0, 2))
    known = y < 2
    return {"auc": dense.auc(s[known], y[known])} | counted(y, c)


@pytest.mark.parametrize("more", [{}, {"bootstrap": 100, "fit": "mcc", "bias_penalty": 0.1}])
def test_sections_by_hand(spark, more):
    x, samples = toy(spark, n=80, unknown=3)
    out = run.run_on_data(x, samples, params(general=more, vote={"max_experts": 5, "alpha": 0.5, "min_perf": 0.0}))
    got = {r.section: r for r in reports.sections(out).collect()}
    best = out.models.filter("rank = 0").first()
    for side, pair in (("train", out.train), ("test", out.held)):
        for name, value in by_hand(best, *pair).items():
            assert abs(got["best_model"][f"{side}_{name}"] - value) < 1e-9, (side, name)
    family = population.family(out.models.drop("rank"), 0.05).collect()
    assert got["best_model"].n_models == 1 and ("fbm" in got) == bool(family)
    if family:
        each = [by_hand(m, *out.held) for m in family]
        assert got["fbm"].n_models == len(family) and abs(got["fbm"].train_fit - np.mean([m.fit for m in family])) < 1e-9
        for name in reports.SIDE:
            assert abs(got["fbm"][f"test_{name}"] - np.mean([e[name] for e in each])) < 1e-9, name
    votes = out.jury.collect()
    y, c, q = (np.array([r[k] for r in votes], float) for k in ("y", "predicted", "ratio"))
    for name, value in counted(y, c).items():
        assert abs(got["jury"][f"test_{name}"] - value) < 1e-9, name
    assert got["jury"].train_fit is None and got["jury"].n_models == out.experts.count()
    kept = (c != 2) & (y < 2)
    assert abs(got["jury"].test_auc - dense.auc(q[kept], y[kept])) < 1e-9


def test_without_test_samples_and_without_models(spark):
    x, samples = toy(spark)
    out = run.run_on_data(x, samples, params(data={"holdout": 0.0}, vote={"alpha": 0.5, "min_perf": 0.0}))
    got = {r.section: r for r in reports.report(out).collect()}
    assert got["best_model"].test_auc == got["jury"].test_auc == "NA" and got["best_model"].n_test_samples == "0" and got["best_model"].train_auc != "NA"
    none = run.run_on_data(x, samples, params(data={"min_prevalence": 1.0, "max_p": 1e-9}))
    assert none.models.count() == 0 and reports.report(none).count() == 0


def test_a_continuous_target_has_no_class_metrics(spark):
    x, samples = toy(spark)
    y = {r.sample_id: r.value for r in x.filter("feature_id = 0").collect()}
    target = spark.createDataFrame([(r.sample_id, y.get(r.sample_id, 0.0) * 3 + 1) for r in samples.collect()], "sample_id long, y double")
    out = run.run_on_data(x, target, params("ga", general={"fit": "spearman"}, ga={"k_max": 3, "size": 20, "epochs": 2}))
    got = {r.section: r for r in reports.report(out).collect()}
    assert "jury" not in got and got["best_model"].train_mcc == got["best_model"].test_auc == "NA" and got["best_model"].train_fit != "NA" and got["best_model"].vote_enabled == "false"


def test_rows_are_appended_to_the_same_header_only(spark, tmp_path):
    x, samples = toy(spark)
    out = run.run_on_data(x, samples, params(vote={"alpha": 0.5, "min_perf": 0.0}))
    folder = str(tmp_path / "report")
    first = reports.report(out, 1.5, 'a "name", with both', "2020-01-01", features=6)
    assert tuple(first.columns) == reports.COLUMNS and len(reports.COLUMNS) == 79
    n = first.count()
    rows.append(first, folder)
    rows.append(first, folder)
    back = rows.read(spark, folder, reports.COLUMNS).collect()
    assert sorted(map(tuple, back)) == sorted(list(map(tuple, first.collect())) * 2) and len(back) == 2 * n >= 4
    best = next(r for r in back if r.section == "best_model")
    assert best.experiment_id == 'a "name", with both' and best.execution_time == "1.500000" and best.n_features_total == "6" and best.model_k in ("1", "2") and best.beam_k_stop == "2" and best.ga_min_epochs == "NA" and best.is_cv == "false"
    with pytest.raises(ValueError):
        rows.append(first.drop("seed"), folder)
    with pytest.raises(ValueError):
        rows.append(first.select(*reversed(first.columns)), folder)
    assert rows.read(spark, folder, reports.COLUMNS).count() == 2 * n


def test_command_line(spark, tmp_path):
    x, samples = toy(spark, n=40)
    v = {(r.sample_id, r.feature_id): r.value for r in x.collect()}
    (tmp_path / "x.tsv").write_text("feature\t" + "\t".join(f"s{i}" for i in range(40)) + "\n" + "".join(f"f{j}\t" + "\t".join(str(v.get((i, j), 0)) for i in range(40)) + "\n" for j in range(6)))
    (tmp_path / "y.tsv").write_text("sample\tclass\n" + "".join(f"s{r.sample_id}\t{int(r.y)}\n" for r in samples.collect()))
    (tmp_path / "p.yaml").write_text(params(vote={"alpha": 0.5, "min_perf": 0.0}).to_text())
    at = lambda name: str(tmp_path / name)
    base = ["--x", at("x.tsv"), "--y", at("y.tsv")]
    command.main([*base, "--out", at("run"), "--params", at("p.yaml"), "--report", at("report")], spark)
    tables, p = store.load(spark, at("run"))
    assert p.general.algo == "beam" and tables["family"].count() > 0 and tables["features"].count() == 6
    got = {r.section: r for r in rows.read(spark, at("report"), reports.COLUMNS).collect()}
    assert got["best_model"].n_features_total == "6" and got["jury"].n_test_samples == "8" and got["best_model"].experiment_id == at("run")
    command.main([*base, "--out", at("new"), "--load", at("run")], spark)
    again, _ = store.load(spark, at("new"))
    assert again["tested"].count() == tables["family"].count()
