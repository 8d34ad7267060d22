"""Places and running sums in two levels against plain sorting."""

import math

import numpy as np
import pytest

from scantling.operators import ranks, resampling, roc
from scantling.functions.hashing import draw
from pyspark.sql import functions as F


def test_blocks_follow_numbers(spark):
    rng = np.random.default_rng(1)
    values = np.r_[rng.normal(size=400), 10.0 ** rng.uniform(-320, 308, 200), -(10.0 ** rng.uniform(-320, 308, 200)), np.arange(-20, 1030), 1 + np.arange(50) * 2.0**-52, 0.0, -0.0, 5e-324, -5e-324, math.inf, -math.inf, 1.7976931348623157e308]
    df = spark.createDataFrame([(float(v),) for v in values] + [(math.nan,)], "v double")
    got = [(r.v, r.b) for r in df.select("v", ranks.number_block(F.col("v")).alias("b")).orderBy("v").collect()]
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and math.isnan(got[-1][0])
    assert {b for v, b in got if v == 0} == {0} and all((b > 0) == (v > 0) for v, b in got[:-1])
    assert len({b for v, b in got if 512 <= v < 1024}) == ranks.OCTAVE


@pytest.mark.parametrize("keys", [["g"], ["g", "h"], []])
def test_places_sums_and_next_values(spark, keys):
    rng = np.random.default_rng(2)
    rows = [(None if rng.random() < 0.2 else int(rng.integers(3)), int(rng.integers(2)), k, float(v), int(rng.integers(5))) for k, v in enumerate(rng.permutation(np.r_[rng.normal(size=150) * 1e3, np.arange(-50, 50), 0.0]))]
    df = spark.createDataFrame(rows, "g int, h int, id int, v double, p long")
    got = {r.id: r for r in ranks.placed(df, keys, ["v", "id"], ranks.number_block(F.col("v")), ("p",), "v").collect()}
    assert len(got) == len(rows)
    at = {"g": 0, "h": 1}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[3], r[2])):
        groups.setdefault(tuple(r[at[k]] for k in keys), []).append(r)
    for members in groups.values():
        for place, r in enumerate(members):
            o = got[r[2]]
            assert (o.place, o.n, o.before_p, o.all_p) == (place, len(members), sum(m[4] for m in members[:place]), sum(m[4] for m in members))
            assert o.next == (members[place + 1][3] if place + 1 < len(members) else None)
    assert ranks.placed(df.limit(0), keys, ["v"], ranks.number_block(F.col("v")), ("p",), "v").count() == 0


def test_draws_in_blocks(spark):
    df = spark.range(3000).select(F.col("id").alias("sample_id"), (F.col("id") % 2).cast("double").alias("y"))
    got = resampling.shuffled(df, 5, "fold", ["y"]).collect()
    u = {r.sample_id: r.u for r in df.select("sample_id", draw(5, "fold", "sample_id").alias("u")).collect()}
    for y in (0.0, 1.0):
        mine = sorted((u[r.sample_id], r.sample_id) for r in got if r.y == y)
        place = {i: k for k, (_, i) in enumerate(mine)}
        assert all(r.place == place[r.sample_id] and r.n == 1500 for r in got if r.y == y)


def test_thresholds_and_areas_by_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(m, float(s), float(y)) for m in range(4) for s, y in zip(np.round(rng.normal(size=120) * 10.0**m, 1), rng.integers(0, 3, 120))] + [(9, 1.0, 1.0), (9, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "model_id int, score double, y double")
    auc = {r.model_id: r.auc for r in roc.auc(df).collect()}
    best = {r.model_id: r for r in roc.best_threshold(df, "mcc").collect()}
    assert auc[9] == 0.5 and best[9].threshold == 1.0
    for m in range(4):
        pos, neg = ([s for k, s, y in rows if k == m and y == c] for c in (1.0, 0.0))
        assert abs(auc[m] - sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)) < 1e-12
        scores = sorted(set(pos + neg))
        tries = []
        for k, t in enumerate([scores[0], *scores[1:], scores[-1] + 1]):
            tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
            fn, tn = len(pos) - tp, len(neg) - fp
            bottom = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
            tries.append((round((tp * tn - fp * fn) / bottom if bottom else 0.0, 12), -k, t, tp, fp, tn, fn))
        want = max(tries)
        assert (best[m].threshold, best[m].tp, best[m].fp, best[m].tn, best[m].fn) == want[2:]


def test_replicates_by_weight_equal_repeated_rows(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(m, i, float(rng.integers(9)), float(i % 2)) for m in range(2) for i in range(30)], "model_id int, sample_id long, score double, y double")
    boot = resampling.bootstrap(df.filter("model_id = 0").select("sample_id", "y"), 6, 3)
    got = {(r.model_id, r.replicate): r.threshold for r in resampling.replicate_thresholds(df, boot).collect()}
    again = df.join(boot, "sample_id").withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
    assert got == {(r.model_id, r.replicate): r.threshold for r in roc.best_threshold(again, key=("model_id", "replicate")).collect()} and len(got) == 12


def test_thresholds_of_many_replicates_equal_those_of_their_table(spark, monkeypatch):
    from scantling.operators import replicates

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(m, i * 7, float(rng.integers(9)), float(i % 3)) for m in range(2) for i in range(60)], "model_id long, sample_id long, score double, y double")
    want = {(r.model_id, r.replicate): r.threshold for r in resampling.replicate_thresholds(df, resampling.bootstrap(df.filter("model_id = 0").select("sample_id", "y"), 12, 3)).collect()}
    monkeypatch.setattr(replicates, "PLACES", 15)
    monkeypatch.setattr(replicates, "WAVE", 320)
    got = {(r.model_id, r.replicate): r.threshold for r in replicates.thresholds(df, 12, 3).collect()}
    assert got == want and len(got) == 24


def test_bands_of_thresholds_have_a_thousand_replicates():
    from scantling.plans import base
    from scantling.plans import resampling as plans

    assert plans.CI == 1000 and "range(1000)" in base.SQL["bootstrap_ci"] and "range(20)" in base.SQL["bootstrap_weights"]
