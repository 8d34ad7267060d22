"""Experiments at rest: a folder of Parquet tables and a JSON manifest; parameters as YAML-like text."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession


#: Fits by class, fits of a continuous target, and the searches that take any of them.
CLASSES = ("auc", "mcc", "f1_score", "npv", "ppv", "g_mean", "sensitivity", "specificity")
REGRESSIONS = ("spearman", "pearson", "neg_rmse", "mutual_info")
SEARCHES = ("beam", "ga", "aco")
#: Languages and data types of models; several, separated by commas, in a genetic run.
LANGUAGES = ("binary", "ternary", "ratio", "pow2")
DATA_TYPES = ("raw", "prevalence", "log", "zscore")


@dataclass
class General:
    seed: int = 4815162342
    algo: str = "ga"
    language: str = "ternary"
    data_type: str = "raw"
    epsilon: float = 1e-5
    fit: str = "auc"
    k_penalty: float = 0.0
    bias_penalty: float = 0.0
    ci_penalty: float = 0.5
    ci_alpha: float = 0.05
    bootstrap: int = 0
    bootstrap_fraction: float = 1.0
    other_side_penalty: float = 1.0


@dataclass
class Data:
    holdout: float = 0.2
    test: str = "wilcoxon"
    min_prevalence: float = 0.1
    max_p: float = 0.5
    min_mean: float = 0.0
    per_class: int = 0


@dataclass
class Beam:
    k_start: int = 1
    k_stop: int = 4
    method: str = "exhaustive"
    criterion: float = 10.0
    most: int = 10_000


@dataclass
class Genetic:
    size: int = 5000
    epochs: int = 200
    k_min: int = 1
    k_max: int = 200
    elite_pct: float = 2.0
    random_pct: float = 2.0
    max_age: int = 10
    diversity_pct: float = 0.0
    niche_pct: float = 0.0


@dataclass
class Ants:
    ants: int = 100
    iterations: int = 200
    k_min: int = 1
    k_max: int = 200
    rho: float = 0.1
    elite_weight: float = 2.0


@dataclass
class Annealing:
    chains: int = 8
    steps: int = 10_000
    k: int = 5
    k_max: int = 200
    hot: float = 1.0
    cold: float = 1e-3
    rate: float = 0.995


@dataclass
class LocalSearch:
    chains: int = 8
    steps: int = 3000
    k: int = 5
    k_max: int = 200
    kicks: int = 3


@dataclass
class Lasso:
    alphas: int = 100
    high: float = 1.0
    low: float = 0.001
    l1_ratio: float = 1.0


@dataclass
class Gibbs:
    chains: int = 1
    steps: int = 1000
    burn: int = 500
    penalty: float = 0.001
    p0: float = 0.1
    most: int = 50


@dataclass
class Folds:
    outer: int = 5
    inner: int = 0
    overfit_penalty: float = 0.0
    fit_on_valid: bool = False
    alpha: float = 0.05
    method: str = "wilson"


@dataclass
class Vote:
    alpha: float = 0.05
    min_perf: float = 0.5
    max_experts: int = 0
    diversity_pct: float = 0.0
    method: str = "majority"
    threshold: float = 0.5
    window: float = 0.0
    specialized: bool = False
    sensitivity: float = 0.7
    specificity: float = 0.7
    prune: bool = False
    prune_below: float = 0.0
    prune_min_k: int = 10
    prune_permutations: int = 1000


@dataclass
class Importance:
    permutations: int = 100
    aggregation: str = "mean"
    scaled: bool = False


@dataclass
class Params:
    """All parameters; unknown keys are errors, ranges are checked."""

    general: General = field(default_factory=General)
    data: Data = field(default_factory=Data)
    beam: Beam = field(default_factory=Beam)
    ga: Genetic = field(default_factory=Genetic)
    aco: Ants = field(default_factory=Ants)
    sa: Annealing = field(default_factory=Annealing)
    ils: LocalSearch = field(default_factory=LocalSearch)
    lasso: Lasso = field(default_factory=Lasso)
    mcmc: Gibbs = field(default_factory=Gibbs)
    folds: Folds = field(default_factory=Folds)
    vote: Vote = field(default_factory=Vote)
    importance: Importance = field(default_factory=Importance)

    @classmethod
    def of(cls, values: dict) -> Params:
        parts = {}
        for f in fields(cls):
            kind, given = f.default_factory, values.get(f.name, {})
            if unknown := given.keys() - {x.name for x in fields(kind)}:
                raise ValueError(f"unknown keys in {f.name}: {sorted(unknown)}")
            parts[f.name] = kind(**given)
        if unknown := values.keys() - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        return cls(**parts).checked()

    def checked(self) -> Params:
        g, d, v = self.general, self.data, self.vote
        languages, data_types = ([s.strip() for s in text.split(",")] for text in (g.language, g.data_type))
        for ok, what in (
            (g.algo in ("ga", "beam", "aco", "sa", "ils", "lasso", "mcmc"), "algo"),
            (0 < g.ci_alpha < 1, "ci_alpha"),
            (g.bootstrap == 0 or g.bootstrap >= 100, "bootstrap: none, or 100 and more"),
            (0 < g.bootstrap_fraction <= 1, "bootstrap_fraction"),
            (g.fit in CLASSES + REGRESSIONS, "fit"),
            (g.fit == "auc" or g.algo in SEARCHES, "fit: chains and paths know auc only"),
            (g.fit not in REGRESSIONS or "binary" not in languages, "fit: a continuous target has no class that binary models could be of"),
            (self.folds.inner == 0 or (self.folds.inner >= 2 and g.algo in SEARCHES), "folds: inner; chains and paths have none"),
            (min(g.k_penalty, g.bias_penalty, g.ci_penalty, g.other_side_penalty, self.folds.overfit_penalty) >= 0, "penalties"),
            (self.importance.aggregation in ("mean", "median"), "importance: aggregation"),
            (v.prune_permutations >= 1 and v.prune_min_k >= 1, "vote: prune_permutations, prune_min_k"),
            (0 <= d.holdout < 1, "holdout"),
            (d.test in ("wilcoxon", "studentt", "bayesian_fisher"), "test"),
            (0 <= d.min_prevalence <= 1, "min_prevalence"),
            (set(languages) <= set(LANGUAGES) and len(set(languages)) == len(languages), "language"),
            (set(data_types) <= set(DATA_TYPES) and len(set(data_types)) == len(data_types), "data_type"),
            (g.algo == "ga" or len(languages) == len(data_types) == 1, "language, data_type: only genetic runs take several"),
            (g.algo in SEARCHES or g.data_type == "raw", "data_type: chains and paths read raw values"),
            (g.algo in SEARCHES or g.language == "ternary", "language: chains and paths are ternary"),
            (0 <= self.ga.niche_pct <= 100, "ga: niche_pct"),
            (1 <= self.beam.k_start <= self.beam.k_stop, "beam: k_start, k_stop"),
            (all(s.k_min <= s.k_max for s in (self.ga, self.aco)), "k_min, k_max"),
            (self.mcmc.burn < self.mcmc.steps, "mcmc: burn, steps"),
            (self.lasso.low <= self.lasso.high, "lasso: low, high"),
            (self.folds.outer >= 2, "folds: outer"),
            (v.method in ("majority", "consensus"), "vote: method"),
            (0 <= v.threshold <= 1 and 0 <= v.min_perf <= 1, "vote: threshold, min_perf"),
            (self.importance.permutations >= 1, "importance: permutations"),
        ):
            if not ok:
                raise ValueError(f"out of range: {what}")
        return self

    @classmethod
    def of_text(cls, text: str) -> Params:
        """From two levels of ``section:`` and indented ``key: value`` lines; ``#`` starts a comment."""
        values, own = {}, None
        for line in text.splitlines():
            line = line.split("#", 1)[0].rstrip()
            if not line:
                continue
            name, _, value = line.strip().partition(":")
            if line[0] != " ":
                own = values.setdefault(name, {})
            elif own is None:
                raise ValueError(f"{name} is in no section")
            else:
                try:
                    own[name] = json.loads(value)
                except ValueError:
                    own[name] = value.strip().strip("'")
        return cls.of(values)

    def to_text(self) -> str:
        return "".join(f"{s}:\n" + "".join(f"  {k}: {json.dumps(v)}\n" for k, v in part.items()) for s, part in asdict(self).items())

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)


def save(folder: str, tables: dict[str, DataFrame], params: Params | None = None) -> None:
    """Each table as Parquet; names and parameters in ``manifest``, itself a one-row text table, so any store will do."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(folder, name))
    text = json.dumps({"tables": sorted(tables), "params": asdict(params or Params())})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "manifest"))


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], Params]:
    manifest = json.loads(spark.read.text(os.path.join(folder, "manifest")).first()[0])
    return {n: spark.read.parquet(os.path.join(folder, n)) for n in manifest["tables"]}, Params.of(manifest["params"])
