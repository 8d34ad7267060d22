"""Distribution functions: the normal one as a column expression, others in Python for few values."""

from __future__ import annotations

from math import exp, lgamma, log
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: West's form of Hart's rational approximation of the normal distribution.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def upper_normal(z: Column) -> Column:
    """P(Z > z) for z >= 0."""
    top, bottom = F.lit(HART_TOP[0]), F.lit(HART_BOTTOM[0])
    for c in HART_TOP[1:]:
        top = top * z + c
    for c in HART_BOTTOM[1:]:
        bottom = bottom * z + c
    e = F.exp(-z * z / 2)
    far = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))
    return F.when(z > 37, 0.0).when(z < 7.07106781186547, e * top / bottom).otherwise(e / far / 2.506628274631)


def upper_normal_sql(z: str) -> str:
    """The same in SQL."""
    top, bottom = f"{HART_TOP[0]!r}::DOUBLE", f"{HART_BOTTOM[0]!r}::DOUBLE"
    for c in HART_TOP[1:]:
        top = f"({top} * {z} + {c!r}::DOUBLE)"
    for c in HART_BOTTOM[1:]:
        bottom = f"({bottom} * {z} + {c!r}::DOUBLE)"
    return f"(CASE WHEN {z} > 37 THEN 0.0::DOUBLE WHEN {z} < 7.07106781186547::DOUBLE THEN exp(-{z} * {z} / 2) * {top} / {bottom} ELSE exp(-{z} * {z} / 2) / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65::DOUBLE))))) / 2.506628274631::DOUBLE END)"


def z_value(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function, by the continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * f


def student_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def binomial_interval(p: float, n: int, alpha: float, method: str = "wald") -> tuple[float, float]:
    """Lower and upper bound of a share ``p`` seen in ``n``."""
    z = z_value(alpha)
    if method in ("wald", "wald_continuity"):
        w = z * (p * (1 - p) / n) ** 0.5 + (0.5 / n if method == "wald_continuity" else 0)
        return max(0.0, p - w), min(1.0, p + w)
    if method in ("wilson", "agresti_coull"):
        m = n + z * z
        center = (p * n + z * z / 2) / m
        w = z * (center * (1 - center) / m) ** 0.5 if method == "agresti_coull" else z / m * (p * (1 - p) * n + z * z / 4) ** 0.5
        return max(0.0, center - w), min(1.0, center + w)
    if method == "clopper_pearson":
        x = round(p * n)
        return (0.0 if x == 0 else beta_quantile(alpha / 2, x, n - x + 1)), (1.0 if x == n else beta_quantile(1 - alpha / 2, x + 1, n - x))
    raise ValueError(method)


def truncated_normal(mean: float, deviation: float, u: float, positive: bool = True) -> float:
    """A normal value above 0 (or below it) from a uniform draw ``u`` in (0, 1), by the inverse distribution."""
    unit = NormalDist()
    below = unit.cdf(-mean / deviation)
    share = below + u * (1 - below) if positive else u * below
    value = mean + deviation * unit.inv_cdf(min(max(share, 1e-300), 1 - 1e-16))
    return max(value, 0.0) if positive else min(value, 0.0)


def golden_section(f, low: float = -1e4, high: float = 1e4, tolerance: float = 1e-6, steps: int = 50) -> float:
    """Where a unimodal function is smallest: the interval shrinks by the golden ratio."""
    ratio = (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if high - low <= tolerance:
            break
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2
