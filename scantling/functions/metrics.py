"""Metrics from counts, as column expressions; a ratio without a denominator is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def sensitivity(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def specificity(tn: Column, fp: Column) -> Column:
    return ratio(tn, tn + fp)


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(bottom == 0, 0.0).otherwise((tp * tn - fp * fn) / F.when(bottom == 0, 1.0).otherwise(bottom))


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    both = precision + recall
    return F.when(both > 0, 2.0 * (precision * recall) / F.when(both > 0, both).otherwise(1.0)).otherwise(0.0)


def npv(tn: Column, fn: Column) -> Column:
    return ratio(tn, tn + fn)


def ppv(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def g_mean(sens: Column, spec: Column) -> Column:
    return F.sqrt(sens * spec)


def youden(sens: Column, spec: Column) -> Column:
    return sens + spec - 1.0


def balance(sens: Column, spec: Column, penalties: tuple[float, float]) -> Column:
    p0, p1 = penalties
    return (F.lit(p0) * spec + F.lit(p1) * sens) / F.lit(p0 + p1)


OBJECTIVES = ("auc", "mcc", "f1_score", "npv", "ppv", "g_mean", "sensitivity", "specificity")


def objective(fit: str, tp: Column, fp: Column, tn: Column, fn: Column, penalties: tuple[float, float] | None = None) -> Column:
    """What a threshold is chosen by."""
    sens, spec = sensitivity(tp, fn), specificity(tn, fp)
    if fit in ("sensitivity", "specificity"):
        return balance(sens, spec, penalties) if penalties else youden(sens, spec)
    return {"auc": lambda: youden(sens, spec), "mcc": lambda: mcc(tp, fp, tn, fn), "f1_score": lambda: f1_score(tp, fp, fn), "npv": lambda: npv(tn, fn), "ppv": lambda: ppv(tp, fp), "g_mean": lambda: g_mean(sens, spec)}[fit]()
