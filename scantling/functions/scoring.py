"""Score of a model on a sample as one column expression over its terms.

``terms`` is array<struct<f, c>>, ``xs`` map<feature, value> of the sample's non-zero values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("binary", "ternary", "pow2", "ratio", "mcmc_generic")
DATA_TYPES = ("raw", "prevalence", "log", "zscore")
EPSILON = 1e-5


def transformed(value: Column, data_type: str, epsilon: Column, mean: Column | None = None, std: Column | None = None) -> Column:
    """A value (null: absent) as the data type reads it; an absent value counts by the type's own rule."""
    zero = F.coalesce(value, F.lit(0.0))
    if data_type == "raw":
        return zero
    if data_type == "prevalence":
        return F.when(zero > epsilon, 1.0).otherwise(0.0)
    if data_type == "log":  # an absent value adds nothing; there is no floor
        return F.when(value.isNull(), 0.0).otherwise(F.when(value > 0, F.ln(value / epsilon)).otherwise(F.lit(float("nan"))))
    if data_type == "zscore":
        return (zero - F.coalesce(mean, F.lit(0.0))) / F.coalesce(std, F.lit(1.0))
    raise ValueError(data_type)


def kinds(language: str, data_type: str) -> list[tuple[str, str]]:
    """Every language with every data type of two comma-separated lists; if there are several, models name their own in columns ``language`` and ``data_type``."""
    return [(a.strip(), b.strip()) for b in data_type.split(",") for a in language.split(",")]


def score(language: str, data_type: str, epsilon: Column | float = EPSILON, terms: str = "terms", xs: str = "xs", stats: str | None = None, betas: tuple | None = None) -> Column:
    """``stats``: column map<feature, struct<mean, std>>, needed by z-scores; ``betas``: (a, b, c)."""
    if len(several := kinds(language, data_type)) > 1:
        out = F
        for ratio, own in sorted({(a == "ratio", b) for a, b in several}):
            mine = ((F.col("language") == "ratio") == F.lit(ratio)) & (F.col("data_type") == own)
            out = out.when(mine, score("ratio" if ratio else "ternary", own, epsilon, terms, xs, stats))
        return out
    eps = F.lit(epsilon) if isinstance(epsilon, float) else epsilon
    if data_type == "zscore" and stats is None:
        raise ValueError("z-scores need means and standard deviations")

    def g(t: Column) -> Column:
        s = F.col(stats)[t["f"]] if stats else None
        return transformed(F.col(xs)[t["f"]], data_type, eps, s["mean"] if stats else None, s["std"] if stats else None)

    def total(keep, value) -> Column:
        return F.aggregate(F.transform(F.filter(F.col(terms), keep), value), F.lit(0.0), lambda a, b: a + b)

    if language == "ratio":
        weight = (lambda t: F.abs(t["c"]) * g(t)) if data_type == "log" else g
        return total(lambda t: t["c"] > 0, weight) / (total(lambda t: t["c"] <= 0, weight) + eps)
    if language == "mcmc_generic":
        a, b, c = betas
        z = F.lit(float(a)) * total(lambda t: t["c"] == 1, g) + F.lit(float(b)) * total(lambda t: t["c"] == -1, g) + F.lit(float(c))
        return 1 / (1 + F.exp(-z))
    return total(lambda t: F.lit(True), lambda t: t["c"] * g(t))


def convert(language: str, coefficient: Column) -> Column:
    """A coefficient as another language may write it."""
    if language == "binary":
        return F.lit(1)
    return F.signum(coefficient).cast("int") if language in ("ternary", "ratio") else coefficient


def predicted(score: Column, threshold: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    """Class at a threshold; with a confidence band, 2 (abstain) inside it."""
    if lower is None:
        return F.when(score >= threshold, 1).otherwise(0)
    return F.when(score > upper, 1).when(score < lower, 0).otherwise(2)
