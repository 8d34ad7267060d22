"""Report rows as text columns: six decimals, ``NA`` for what is missing; a run's whole report."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import REGRESSIONS, Params
from . import population, roc, run

METRICS = ("auc", "accuracy", "sensitivity", "specificity", "fit")

#: The report's columns.
COLUMNS = (
    "section", "experiment_id", "timestamp", "version", "algorithm", "language", "data_type", "fit_function",
    "n_features_total", "n_features_selected", "n_train_samples", "n_test_samples", "is_cv", "cv_folds", "seed",
    "k_penalty", "bias_penalty", "threshold_ci_penalty", "threshold_ci_alpha", "user_penalties_weight", "model_k",
    "train_auc", "train_fit", "train_accuracy", "train_sensitivity", "train_specificity", "train_f1", "train_mcc", "train_ppv", "train_npv", "train_g_mean", "train_rejection_rate",
    "test_auc", "test_accuracy", "test_sensitivity", "test_specificity", "test_f1", "test_mcc", "test_ppv", "test_npv", "test_g_mean", "test_rejection_rate",
    "n_models", "execution_time", "holdout_ratio", "fr_penalty", "feature_selection_method", "max_features_per_class", "min_prevalence_pct", "max_adj_pvalue",
    "ga_pop_size", "ga_max_epochs", "ga_min_epochs", "ga_k_min", "ga_k_max", "ga_elite_pct", "ga_random_pct", "ga_mut_children_pct", "ga_mut_features_pct", "ga_mut_non_null_chance_pct",
    "beam_method", "beam_k_start", "beam_k_stop", "beam_best_models_criterion", "beam_max_nb_of_models", "mcmc_n_iter", "mcmc_n_burn", "mcmc_lambda", "mcmc_nmin",
    "cv_enabled", "cv_inner_folds", "cv_outer_folds", "cv_fbm_ci_method", "cv_best_models_ci_alpha", "vote_enabled", "vote_method", "vote_threshold", "vote_min_perf", "vote_min_diversity",
)
#: The level of the reported family.
ALPHA = 0.05
#: Metrics of one side (training or test) by the names that ``roc`` gives them.
SIDE = {"auc": "auc", "accuracy": "accuracy", "sensitivity": "sensitivity", "specificity": "specificity", "f1": "f1_score", "mcc": "mcc", "ppv": "ppv", "npv": "npv", "g_mean": "g_mean", "rejection_rate": "rejection_rate"}
#: Those of them that a search doesn't leave with its models.
FURTHER = ("f1", "mcc", "ppv", "npv", "g_mean")
MEASURED = tuple(c for c in COLUMNS if c == "model_k" or c.startswith(("train_", "test_")))


def shown(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c), F.format_string("%.6f", c)).otherwise("NA")


def best_model(ranked: DataFrame) -> DataFrame:
    """The first model: its formula and metrics."""
    return ranked.filter("rank = 0").select(F.lit("best_model").alias("section"), formula().alias("model"), F.col("k").cast("string").alias("k"), *[shown(F.col(c).cast("double")).alias(c) for c in METRICS])


def family_mean(models: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Means over the family of best models."""
    own = population.family(models, alpha)
    return own.agg(F.count("*").alias("n"), F.avg("k").alias("k"), *[F.avg(c).alias(c) for c in METRICS]).select(F.lit("fbm").alias("section"), F.concat(F.col("n").cast("string"), F.lit(" models")).alias("model"), shown(F.col("k")).alias("k"), *[shown(F.col(c)).alias(c) for c in METRICS])


def jury_row(metrics: DataFrame, auc: DataFrame, experts: int) -> DataFrame:
    """Metrics of a jury's accepted samples; a jury has no fit."""
    m = metrics.crossJoin(auc.select("auc"))
    return m.select(F.lit("jury").alias("section"), F.lit(f"{experts} experts").alias("model"), F.lit("NA").alias("k"), *[(F.lit("NA") if c == "fit" else shown(F.col(c))).alias(c) for c in METRICS])


def formula(terms: str = "terms") -> Column:
    """A model as text: positive features less negative ones."""
    side = lambda keep: F.array_join(F.transform(F.filter(terms, keep), lambda t: F.concat(F.when(F.abs(t["c"]) > 1, F.concat(F.abs(t["c"]).cast("string"), F.lit("*"))).otherwise(""), F.lit("f"), t["f"].cast("string"))), " + ")
    pos, neg = side(lambda t: t["c"] > 0), side(lambda t: t["c"] < 0)
    return F.concat(F.when(pos == "", "0").otherwise(F.concat(F.lit("("), pos, F.lit(")"))), F.when(neg == "", "").otherwise(F.concat(F.lit(" - ("), neg, F.lit(")"))))


def models_metrics(out: run.Outcome, alpha: float = ALPHA) -> DataFrame:
    """``MEASURED`` of the best model and of every model of the family, with ``rank`` and ``in_family``.

    What the search fitted is taken as it is; all else is counted from scores on both sides. Without
    test samples, or of a continuous target, class metrics there are null.
    """
    p = out.params
    own = population.family(out.models.drop("rank"), alpha).select("model_id", F.lit(True).alias("in_family"))
    kept = out.models.join(own, "model_id", "left").filter("rank = 0 or in_family")
    kept = population.listed(kept.withColumn("in_family", F.coalesce("in_family", F.lit(False))))
    fitted = [F.col(c).alias(f"train_{c}") for c in METRICS]
    table = kept.select("model_id", "rank", "in_family", F.col("k").cast("double").alias("model_k"), *fitted, F.coalesce("rejection_rate", F.lit(0.0)).alias("train_rejection_rate"))
    for side, pair, names in (("train", out.train, FURTHER), ("test", out.held, tuple(SIDE))):
        if p.general.fit in REGRESSIONS:
            table = table.select("*", *[F.lit(None).cast("double").alias(f"{side}_{c}") for c in names])
        else:
            judged = run.on_new_data(kept, *pair, p, out.stats)
            table = table.join(judged.select("model_id", *[F.col(SIDE[c]).alias(f"{side}_{c}") for c in names]), "model_id", "left")
    return table.select("model_id", "rank", "in_family", *MEASURED)


def jury_metrics(votes: DataFrame, side: str) -> DataFrame:
    """One row, or none without votes: metrics of the samples on which a jury (sample_id, y, ratio, predicted) doesn't abstain."""
    v = votes.withColumn("model_id", F.lit(0))
    auc = roc.auc(v.filter("predicted <> 2").withColumnRenamed("ratio", "score"))
    m = roc.class_metrics(v).join(auc, "model_id", "left").withColumn("auc", F.coalesce("auc", F.lit(0.5)))
    return m.select("model_id", *[F.col(SIDE[c]).alias(f"{side}_{c}") for c in SIDE])


def sections(out: run.Outcome, alpha: float = ALPHA) -> DataFrame:
    """``section, n_models`` and ``MEASURED`` as numbers: the best model, means of the family, the jury.

    A section without a model has no row; a jury has no fit; what can't be measured is null.
    """
    m = population.listed(models_metrics(out, alpha))
    best = m.filter("rank = 0").select(F.lit("best_model").alias("section"), F.lit(1).cast("long").alias("n_models"), *MEASURED)
    family = m.filter("in_family").agg(F.count("*").alias("n_models"), *[F.avg(c).alias(c) for c in MEASURED]).filter("n_models > 0")
    rows = best.unionByName(family.withColumn("section", F.lit("fbm")))
    experts = out.experts.agg(F.count("*").alias("n_models"), F.avg("k").alias("model_k")).filter("n_models > 0").select(F.lit(0).alias("model_id"), F.lit("jury").alias("section"), "n_models", "model_k", F.lit(None).cast("double").alias("train_fit"))
    if out.params.general.fit in REGRESSIONS:
        return rows
    for side, votes in (("train", run.voted(out.experts, *out.train, out.params, out.stats)), ("test", out.jury)):
        experts = experts.join(jury_metrics(votes, side), "model_id", "left")
    return rows.unionByName(experts.drop("model_id"))


def settings(p: Params) -> dict[str, object]:
    """The report's columns that a run's parameters give; those without a counterpart are missing."""
    g, d, a, b, c, f, v = p.general, p.data, p.ga, p.beam, p.mcmc, p.folds, p.vote
    return {
        "algorithm": g.algo, "language": g.language, "data_type": g.data_type, "fit_function": g.fit, "seed": g.seed, "k_penalty": g.k_penalty, "bias_penalty": g.bias_penalty,
        "threshold_ci_penalty": g.ci_penalty, "threshold_ci_alpha": g.ci_alpha, "holdout_ratio": d.holdout, "fr_penalty": g.other_side_penalty, "feature_selection_method": d.test,
        "max_features_per_class": d.per_class, "min_prevalence_pct": 100 * d.min_prevalence, "max_adj_pvalue": d.max_p, "ga_pop_size": a.size, "ga_max_epochs": a.epochs, "ga_k_min": a.k_min, "ga_k_max": a.k_max,
        "ga_elite_pct": a.elite_pct, "ga_random_pct": a.random_pct, "beam_method": b.method, "beam_k_start": b.k_start, "beam_k_stop": b.k_stop, "beam_best_models_criterion": b.criterion,
        "beam_max_nb_of_models": b.most, "mcmc_n_iter": c.steps, "mcmc_n_burn": c.burn, "mcmc_lambda": c.penalty, "cv_inner_folds": f.inner, "cv_outer_folds": f.outer,
        "cv_fbm_ci_method": f.method, "cv_best_models_ci_alpha": f.alpha, "vote_enabled": g.fit not in REGRESSIONS, "vote_method": v.method, "vote_threshold": v.threshold,
        "vote_min_perf": v.min_perf, "vote_min_diversity": v.diversity_pct,
    }


def text(value: object) -> str:
    """As ``shown``, of a driver-side value."""
    if isinstance(value, bool):
        return str(value).lower()
    return "NA" if value in (None, "") else f"{value:.6f}" if isinstance(value, float) else str(value)


def report(out: run.Outcome, seconds: float = 0.0, experiment: str = "", timestamp: str = "", version: str = "", features: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """A run's report: ``COLUMNS`` as text, a row for each section.

    ``features``: how many there are, with those that are zero everywhere; else those with values count.
    """
    (x, samples), (_, held) = out.train, out.held
    fixed = settings(out.params) | {
        "experiment_id": experiment, "timestamp": timestamp, "version": version, "execution_time": float(seconds), "is_cv": False, "cv_folds": 0, "cv_enabled": False,
        "n_features_total": x.select("feature_id").distinct().count() if features is None else features, "n_features_selected": out.selection.count(), "n_train_samples": samples.count(), "n_test_samples": held.count(),
    }
    measured = {c: shown(F.col(c)) for c in MEASURED} | {"section": F.col("section"), "n_models": F.col("n_models").cast("string")}
    whole = F.col("model_k").cast("long").cast("string")  # one model has whole terms, means are shown as such
    measured["model_k"] = F.when(F.col("section") == "best_model", whole).otherwise(measured["model_k"])
    return sections(out, alpha).select(*[measured.get(c, F.lit(text(fixed.get(c)))).alias(c) for c in COLUMNS])


def parameters(params: Params, spark) -> DataFrame:
    return spark.createDataFrame([(s, k, str(v)) for s, part in asdict(params).items() for k, v in part.items()], "section string, name string, value string")
