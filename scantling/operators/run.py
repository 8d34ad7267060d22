"""Whole runs: split, screen, search, rank, judge on held-out samples, vote; cross-validated runs; new data.

Everything before and after the search is relational. The searches themselves read a matrix in
blocks (``dense``) and return bounded lists of models.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as fs
from ..sources import shared, store
from . import ants, beam, chains, dataset, dense, fitness, genetic, goals, importance, linear, mixed, population, resampling, roc, scores, screening, voting

#: Columns of a run's models, and their types.
TYPES = {
    "model_id": "long", "term_key": "string", "terms": "array<struct<f:int,c:int>>", "k": "long", "auc": "double", "fit": "double", "threshold": "double", "accuracy": "double", "sensitivity": "double",
    "specificity": "double", "lower": "double", "upper": "double", "rejection_rate": "double", "language": "string", "data_type": "string",
}
COLUMNS = tuple(TYPES)


@dataclass
class Outcome:
    """What a run leaves: tables, and the parameters that made them; ``train`` and ``held``: the (x, samples) it had."""

    params: store.Params
    selection: DataFrame
    models: DataFrame
    family: DataFrame
    tested: DataFrame
    experts: DataFrame
    jury: DataFrame
    stats: DataFrame | None
    train: tuple[DataFrame, DataFrame] | None = None
    held: tuple[DataFrame, DataFrame] | None = None

    def save(self, folder: str, more: dict[str, DataFrame] | None = None) -> None:
        tables = {"selection": self.selection, "models": self.models, "family": self.family, "tested": self.tested, "experts": self.experts, "jury": self.jury}
        store.save(folder, tables | ({"stats": self.stats} if self.stats is not None else {}) | (more or {}), self.params)


def part(samples: DataFrame, chosen: DataFrame) -> DataFrame:
    return samples.join(chosen.select("sample_id").hint("merge"), "sample_id", "left_semi").select("sample_id", "y")


def selection(x: DataFrame, samples: DataFrame, p: store.Params) -> DataFrame:
    """Features that the configured test keeps, with class and rank."""
    d = p.data
    if p.general.fit in store.REGRESSIONS:
        return screening.select_for_regression(x, samples, d.min_prevalence)
    limits = {"min_prevalence": d.min_prevalence, "min_mean": d.min_mean}
    if d.test == "bayesian_fisher":
        tests = screening.fisher_bayes(x, samples, **limits)
        kept = screening.select_features(tests.select("feature_id", (-F.col("value")).alias("p"), "class"), 1.0, d.per_class)
        return kept.withColumn("significance", F.abs("significance"))
    test = screening.wilcoxon if d.test == "wilcoxon" else screening.student_t
    return screening.select_features(test(x, samples, d.max_p, **limits), d.max_p, d.per_class)


def goal(matrix: dense.Matrix, samples: DataFrame, p: store.Params) -> goals.Goal:
    """What the run's search maximizes: the fit with its penalties, bands and inner folds."""
    g, f = p.general, p.folds
    bands = goals.bands(matrix, samples, g.bootstrap, g.ci_alpha, g.seed, g.bootstrap_fraction) if g.bootstrap and g.fit in store.CLASSES else None
    fold = None
    if f.inner:
        fold = resampling.folds(samples, f.inner, g.seed, [] if g.fit in store.REGRESSIONS else None)
    return goals.Goal(g.fit, g.k_penalty, g.bias_penalty, g.ci_penalty, g.other_side_penalty, bands, fold, f.overfit_penalty)


def found(x: DataFrame, samples: DataFrame, chosen: DataFrame, p: store.Params) -> DataFrame:
    """The algorithm's models, ranked by the run's goal, with thresholds and metrics on ``samples``; none without features."""
    spark, g = x.sparkSession, p.general
    own = getattr(p, g.algo)
    if chosen.isEmpty():
        return spark.createDataFrame([], ", ".join(f"{k} {t}" for k, t in TYPES.items()) + ", rank int")
    x = dataset.selected(x, chosen)
    matrix = dense.Matrix(x, samples, known=g.fit in store.CLASSES and not g.bootstrap)
    aim = goal(matrix, samples, p)
    options = asdict(own)
    if g.algo == "beam":
        levels = list(beam.search(matrix, chosen, **options, language=g.language, data_type=g.data_type, goal=aim, epsilon=g.epsilon))
        if not levels:
            matrix.release()
            return found(x, samples, chosen.limit(0), p)
        models = reduce(DataFrame.unionByName, levels)
    elif g.algo == "ga":
        if len(fs.kinds(g.language, g.data_type)) > 1 or g.data_type != "raw":
            models = mixed.search(chosen, matrix, g.language, g.data_type, **options, epsilon=g.epsilon, seed=g.seed, goal=aim)
        else:
            del options["niche_pct"]
            models = genetic.search(chosen, matrix, g.language, **options, seed=g.seed, goal=aim)
    elif g.algo == "aco":
        models = ants.search(chosen, matrix, **options, language=g.language, seed=g.seed, goal=aim, data_type=g.data_type, epsilon=g.epsilon)
    elif g.algo in ("sa", "ils"):
        models = chains.search(spark, dense.Matrix(x, samples), g.algo, **options, k_penalty=g.k_penalty, seed=g.seed).withColumnRenamed("chain_id", "model_id")
    elif g.algo == "lasso":
        models = linear.search(x, samples.filter("y < 2"), dense.Matrix(x, samples), **options, k_penalty=g.k_penalty)
    else:
        trace = chains.trace(spark, dense.Matrix(x, samples), **options, seed=g.seed)
        models = chains.consensus_model(chains.summary(trace)).withColumn("k", F.size("terms").cast("long"))
    models = models.withColumn("term_key", population.term_key())
    for name in mixed.NICHE:
        if name not in models.columns:
            models = models.withColumn(name, F.lit(getattr(g, name)))
    if "lower" not in models.columns:
        models = population.listed(models.select("model_id", "term_key", "terms", "k", *mixed.NICHE))
        models = goals.fitted(models, matrix, aim, g.language, g.data_type, g.epsilon)
    out = population.listed(population.ranked(population.remove_clones(models.select(*COLUMNS), mixed.NICHE)))
    matrix.release()
    return out


def evaluated(models: DataFrame, x: DataFrame, samples: DataFrame, p: store.Params, stats: DataFrame | None = None) -> DataFrame:
    """``model_id, sample_id, y, score, predicted`` of models with thresholds, in blocks small enough to broadcast."""
    g = p.general
    parts = [scores.evaluate(block, x, samples, g.language, g.data_type, g.epsilon, stats) for block in scores.in_blocks(models)]
    all_ = reduce(DataFrame.unionByName, parts).join(models.select("model_id", "threshold", "lower", "upper"), "model_id")
    s, t, lo, hi = (F.col(c) for c in ("score", "threshold", "lower", "upper"))
    return all_.select("model_id", "sample_id", "y", "score", F.when(lo.isNotNull(), fs.predicted(s, t, lo, hi)).otherwise(fs.predicted(s, t)).alias("predicted"))


def on_new_data(models: DataFrame, x: DataFrame, samples: DataFrame, p: store.Params, stats: DataFrame | None = None) -> DataFrame:
    """``model_id, term_key`` and AUC and class metrics of fitted models on other samples.

    Thresholds (and means and deviations: ``stats``) are those of the training data. A feature
    without values reads as zeros. Of a continuous target, the fit.
    """
    rows = evaluated(models, x, samples, p, stats)
    if p.general.fit in store.REGRESSIONS:
        return models.select("model_id", "term_key").join(fitness.FITS[p.general.fit](rows), "model_id")
    out = roc.auc(rows).join(roc.class_metrics(rows), "model_id")
    return models.select("model_id", "term_key").join(out, "model_id")


def experts(models: DataFrame, p: store.Params) -> DataFrame:
    """The jury: good enough on both sides, different enough, the first of the rank, with their weights."""
    v = p.vote
    if v.diversity_pct > 0:
        models = population.ranked(population.diverse(models.drop("rank"), v.diversity_pct))
    kept = voting.jury(models, v.min_perf, v.max_experts)
    if v.specialized:
        return voting.specialized(kept, v.sensitivity, v.specificity)
    return kept.withColumn("weight", F.lit(1.0))


def pruned(models: DataFrame, x: DataFrame, samples: DataFrame, p: store.Params) -> DataFrame:
    """Models without the terms that the training samples don't need, fitted and ranked anew; those pruned to the same are one."""
    g, v = p.general, p.vote
    matrix = dense.Matrix(x.join(F.broadcast(models.select(F.explode("terms.f").alias("feature_id")).distinct()), "feature_id"), samples, known=not g.bootstrap)
    fall = importance.of_models(models, matrix, x, v.prune_permutations, g.seed, g.language, g.data_type, g.epsilon)
    kept = importance.pruned(models.select("model_id", "terms"), fall, v.prune_below, v.prune_min_k).join(F.broadcast(models.select("model_id", *mixed.NICHE)), "model_id").withColumn("term_key", population.term_key()).withColumn("k", F.size("terms").cast("long")).persist()
    out = goals.fitted(kept, matrix, goal(matrix, samples, p), g.language, g.data_type, g.epsilon)
    return population.ranked(population.remove_clones(out.select(*COLUMNS), mixed.NICHE))


def ballots(jury: DataFrame, x: DataFrame, samples: DataFrame, p: store.Params, stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    votes = evaluated(jury, x, samples, p, stats).select("model_id", "sample_id", "y", F.col("predicted").alias("vote"))
    return votes, jury.select("model_id", "weight", *(["side"] if "side" in jury.columns else []))


def fitted_jury(family: DataFrame, x: DataFrame, samples: DataFrame, p: store.Params, stats: DataFrame | None = None) -> DataFrame:
    """Experts with weights and ``vote_threshold``: the given one, or, if that is 0, the best of a grid on the training samples."""
    v = p.vote
    jury = population.listed(experts(pruned(family, x, samples, p) if v.prune else family, p))
    threshold = v.threshold
    if threshold == 0 and v.method == "majority":
        votes, own = ballots(jury, x, samples, p, stats)
        threshold = voting.fitted_threshold(votes, own, samples.count(), v.window)
    return jury.withColumn("vote_threshold", F.lit(float(threshold)))


def voted(jury: DataFrame, x: DataFrame, samples: DataFrame, p: store.Params, stats: DataFrame | None = None) -> DataFrame:
    """``sample_id, y, ratio, predicted`` of a fitted jury, whose threshold is its own."""
    v = p.vote
    votes, own = ballots(jury, x, samples, p, stats)
    first = jury.select("vote_threshold").first()
    threshold = first[0] if first else v.threshold
    return voting.consensus(votes, own, threshold) if v.method == "consensus" else voting.majority(votes, own, threshold, v.window)


def run_on_data(x: DataFrame, samples: DataFrame, p: store.Params, test: tuple[DataFrame, DataFrame] | None = None) -> Outcome:
    """One run: ``test`` is (x, samples) held out; without it, the holdout share of the samples is.

    A continuous target is divided without strata, and no jury votes on it.
    """
    x = x.persist()  # read by the screening, the search and the judgement
    continuous = p.general.fit in store.REGRESSIONS
    if test is None:
        split = resampling.holdout_unstratified(samples, p.data.holdout, p.general.seed) if continuous else resampling.holdout(samples, p.data.holdout, p.general.seed)
        train, test = part(samples, split.filter("not test")), (x, part(samples, split.filter("test")))
    else:
        train = samples
    own = x.join(train.select("sample_id").hint("merge"), "sample_id", "left_semi").select(*x.columns)
    stats = dataset.zscore_stats(own, train) if "zscore" in p.general.data_type else None
    chosen = population.listed(selection(own, train, p))
    models = found(own, train, chosen, p)
    family = population.listed(population.family(models, p.vote.alpha))
    jury = family.limit(0).withColumn("weight", F.lit(1.0)).withColumn("vote_threshold", F.lit(p.vote.threshold)) if continuous else fitted_jury(family, own, train, p, stats)
    votes = x.sparkSession.createDataFrame([], "sample_id long, y double, ratio double, predicted int") if continuous else voted(jury, *test, p, stats)
    return Outcome(p, chosen, models, family, on_new_data(family, *test, p, stats), jury, votes, stats, (own, train), test)


@dataclass
class CrossValidated:
    """``family``: every fold's family with its validation metrics; ``importance``: of features in every fold; ``features``: over folds."""

    family: DataFrame
    importance: DataFrame
    features: DataFrame


def run_cv(x: DataFrame, samples: DataFrame, p: store.Params, assignment: DataFrame | None = None, at_once: int = 5) -> CrossValidated:
    """A search per fold on the other folds; each fold's family is judged on the fold it hasn't seen.

    The folds' searches are jobs of one session, up to ``at_once`` at a time, over one stored x; what
    they leave is written once. Over more cells than tasks share, which fill the executors anyway, they
    take turns, and what one has on disk goes before the next. ``assignment``: sample_id, fold from 0 (by default drawn within
    classes, without them for a continuous target). Importance is that of the training samples, or
    of the validation samples if ``folds.fit_on_valid``, which also fits and ranks the models anew on
    them before the family is taken.
    """
    f, g, spark = p.folds, p.general, x.sparkSession
    continuous = g.fit in store.REGRESSIONS
    folds = (resampling.folds(samples, f.outer, g.seed, [] if continuous else None) if assignment is None else assignment).persist()
    x, samples = x.persist(), samples.persist()
    x.count()
    large = samples.count() * x.select("feature_id").distinct().count() > dense.ONE
    dropped = shared.shuffles_dropped if large else nullcontext

    def one(k: int) -> tuple[list, list, set]:
        train, valid = (part(samples, folds.filter(cond)) for cond in (F.col("fold") != k, F.col("fold") == k))
        own = x.join(train.select("sample_id").hint("merge"), "sample_id", "left_semi").select(*x.columns)  # samples are never broadcast
        stats = dataset.zscore_stats(own, train) if "zscore" in g.data_type else None
        with dropped(spark):
            chosen = population.listed(selection(own, train, p))
        models = found(own, train, chosen, p)
        if f.fit_on_valid:
            models = refitted(models, x, valid, p)
        if large:
            shared.collected(spark)
        family = population.listed(population.family(models, f.alpha, f.method).select(*COLUMNS, "rank"))
        n = family.count()
        keep = [F.col(c).alias(f"valid_{c}") for c in (("fit",) if continuous else ("auc", "accuracy", "sensitivity", "specificity"))]
        with dropped(spark):
            judged = on_new_data(family, x, valid, p, stats)
            rows = family.join(judged.select("model_id", *keep), "model_id").withColumn("fold", F.lit(k)).collect()  # a family, a bounded list
        falls = []
        if not continuous and n:
            matrix = dense.Matrix(x.join(F.broadcast(family.select(F.explode("terms.f").alias("feature_id")).distinct()), "feature_id"), valid if f.fit_on_valid else train)
            fall = importance.of_models(family, matrix, x, p.importance.permutations, g.seed, g.language, g.data_type, g.epsilon)
            per = importance.over_models_median(fall, n, p.importance.scaled) if p.importance.aggregation == "median" else importance.over_models(fall, n, p.importance.scaled)
            falls = [(k, *r) for r in per.select("feature_id", "importance", "dispersion", "scope_pct").collect()]  # a row for each feature
            matrix.release()
        significant = {(k, r["feature_id"]) for r in chosen.select("feature_id").collect()}
        if large:
            shared.collected(spark)
        return rows, falls, significant

    with ThreadPoolExecutor(max_workers=1 if large else at_once) as pool:
        parts = list(pool.map(one, range(f.outer)))
    valid = ", ".join(f"valid_{c} double" for c in (("fit",) if continuous else ("auc", "accuracy", "sensitivity", "specificity")))
    ddl = ", ".join(f"{c} {t}" for c, t in TYPES.items()) + f", rank int, {valid}, fold int"
    family = spark.createDataFrame([r for rows, _, _ in parts for r in rows], ddl)
    falls = spark.createDataFrame([r for _, rows, _ in parts for r in rows], "fold int, feature_id int, importance double, dispersion double, scope_pct double")
    significant = spark.createDataFrame(sorted(set().union(*(s for _, _, s in parts))), "fold int, feature_id int")
    return CrossValidated(family, falls, importance.of_collection(falls, significant, f.outer, p.importance.aggregation))


def refitted(models: DataFrame, x: DataFrame, samples: DataFrame, p: store.Params) -> DataFrame:
    """Models fitted and ranked on other samples, by the same goal without inner folds."""
    g = p.general
    matrix = dense.Matrix(x.join(F.broadcast(models.select(F.explode("terms.f").alias("feature_id")).distinct()), "feature_id"), samples, known=g.fit in store.CLASSES and not g.bootstrap)
    aim = goal(matrix, samples, replace(p, folds=replace(p.folds, inner=0)))
    out = population.listed(population.ranked(goals.fitted(models.select("model_id", "term_key", "terms", "k", *mixed.NICHE), matrix, aim, g.language, g.data_type, g.epsilon).select(*COLUMNS)))
    matrix.release()
    return out
