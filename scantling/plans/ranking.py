"""Queries over populations, regression fits and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import upper_normal_sql, z_value
from ..operators import dense, fitness, population, roc, scores, screening
from ..sources import fixtures as fx
from . import base
from .base import query
from .scoring import feature_notes, r, scored

N = 80
KEY_SQL = "array_to_string(list(f || ':' || c ORDER BY f), ',')"
KEYS = f"keys AS (SELECT model_id, count(*) AS k, {KEY_SQL} AS term_key FROM terms GROUP BY 1)"


def pop_sql(n=N, per_term=0.001):
    return f"WITH {base.X}, {base.SAMPLES}, {base.terms(n)}, {base.scores()}, {base.auc()}, {base.roc('auc')}, {KEYS}, pop AS (SELECT keys.model_id, k, term_key, round(auc, 9) AS auc, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity, round(accuracy, 9) AS accuracy, threshold, round(auc - k * {per_term}::DOUBLE, 9) AS fit FROM keys JOIN aucs USING (model_id) JOIN best USING (model_id))"


def fitted(spark, sf, n=N, per_term=0.001):
    """Sign models with raw scores: size, key, AUC, threshold metrics, and AUC less size as fit."""
    x = fx.abundance(spark, sf)
    m = population.listed(fx.models(x, n)).withColumn("k", F.size("terms").cast("long")).withColumn("term_key", population.term_key())
    fits = r(dense.fit(m, dense.Matrix(x, fx.abundance_samples(spark, sf))), "auc", "accuracy", "sensitivity", "specificity")
    own = m.join(fits.select("model_id", "auc", "threshold", "accuracy", "sensitivity", "specificity"), "model_id")
    return own.withColumn("fit", F.round(F.col("auc") - F.col("k") * F.lit(per_term), 9))


RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY round(fit / 1e-6::DOUBLE) DESC, term_key DESC, model_id) - 1 AS rank FROM pop)"
P = f"{pop_sql()}, {RANKED}"
#: What a term costs where families shall differ from the whole population.
SPREAD = 0.05
SP = f"{pop_sql(per_term=SPREAD)}, {RANKED}"
query("population_sort", f"{P} SELECT model_id, fit, rank FROM ranked")(lambda spark, sf: population.ranked(fitted(spark, sf)).select("model_id", "fit", "rank"))
query("first_pct", f"{P} SELECT model_id, rank FROM ranked WHERE rank < floor((SELECT count(*) FROM pop) * 15 / 100)")(lambda spark, sf: population.first_pct(fitted(spark, sf), 15).select("model_id", "rank"))
query("keep_n_best", f"{P} SELECT model_id, rank FROM ranked WHERE rank < 7")(lambda spark, sf: population.keep_best(fitted(spark, sf), 7).select("model_id", "rank"))

_Z = f"{z_value(0.05)!r}::DOUBLE"
_LOWER = {
    "wald": f"p - {_Z} * sqrt(p * (1 - p) / n)",
    "continuity": f"p - (0.5::DOUBLE / n + {_Z} * sqrt(p * (1 - p) / n))",
    "wilson": f"(p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)",
    "agresti": f"(p * n + {_Z} * {_Z} / 2) / (n + {_Z} * {_Z}) - {_Z} * sqrt((p * n + {_Z} * {_Z} / 2) / (n + {_Z} * {_Z}) * (1 - (p * n + {_Z} * {_Z} / 2) / (n + {_Z} * {_Z})) / (n + {_Z} * {_Z}))",
}
for _name, _method in (("wald", "wald"), ("continuity", "wald_continuity"), ("wilson", "wilson"), ("agresti", "agresti_coull")):
    query(f"fbm_{_name}", f"{SP}, b AS (SELECT greatest(0, {_LOWER[_name]}) AS bound FROM (SELECT fit AS p, (SELECT count(*) FROM pop)::DOUBLE AS n FROM ranked WHERE rank = 0)) SELECT model_id, rank FROM (SELECT *, min(fit) OVER (ORDER BY rank) AS low FROM ranked) WHERE low > (SELECT bound FROM b)")(
        lambda spark, sf, m=_method: population.family(fitted(spark, sf, per_term=SPREAD), 0.05, m).select("model_id", "rank")
    )
query("fbm_clopper_pearson")(lambda spark, sf: population.family(fitted(spark, sf, per_term=SPREAD), 0.05, "clopper_pearson").select("model_id", "rank"))

#: The Wald family as a table.
FAMILY = f"{SP}, b AS (SELECT greatest(0, {_LOWER['wald']}) AS bound FROM (SELECT fit AS p, (SELECT count(*) FROM pop)::DOUBLE AS n FROM ranked WHERE rank = 0)), family AS (SELECT * FROM (SELECT *, min(fit) OVER (ORDER BY rank) AS low FROM ranked) WHERE low > (SELECT bound FROM b))"

M = f"WITH {base.X}, {base.terms(N)}, {KEYS}"


def keyed(spark, sf, n=N):
    return fx.models(fx.abundance(spark, sf), n).withColumn("term_key", population.term_key())


#: Every fourth model keeps its positive terms only.
ONE_SIDED = "sided AS (SELECT * FROM terms WHERE model_id % 4 > 0 OR c > 0)"


def one_sided(spark, sf):
    return keyed(spark, sf).withColumn("terms", F.when(F.col("model_id") % 4 == 0, F.filter("terms", lambda t: t["c"] > 0)).otherwise(F.col("terms"))).filter("size(terms) > 0")


query("remove_clones", f"{M} SELECT model_id, term_key FROM (SELECT *, row_number() OVER (PARTITION BY term_key ORDER BY model_id) AS n FROM keys) WHERE n = 1")(lambda spark, sf: population.remove_clones(keyed(spark, sf)).select("model_id", "term_key"))
query("remove_stillborn", f"{M}, {ONE_SIDED} SELECT model_id FROM sided GROUP BY 1 HAVING max(c) > 0 AND min(c) < 0")(lambda spark, sf: population.remove_stillborn(one_sided(spark, sf), "ternary").select("model_id"))
query("remove_out_of_bounds", f"{M}, {ONE_SIDED} SELECT model_id FROM sided GROUP BY 1 HAVING count(*) BETWEEN 3 AND 6")(lambda spark, sf: population.remove_out_of_bounds(one_sided(spark, sf), 3, 6).select("model_id"))
query("compatible_coefficients", f"{M}, {ONE_SIDED} SELECT model_id, min(c) >= 1 AS ok FROM sided GROUP BY 1")(lambda spark, sf: population.compatible_coefficients(one_sided(spark, sf), "binary"))
query("model_by_key", f"{M} SELECT model_id, term_key FROM keys WHERE term_key = (SELECT term_key FROM keys WHERE model_id = 7)")(lambda spark, sf: (lambda m: population.with_key(m, m.filter("model_id = 7").first()["term_key"]).select("model_id", "term_key"))(keyed(spark, sf)))
query("union_and_term_key", f"{M} SELECT term_key, count(*) AS n FROM (SELECT * FROM keys UNION ALL SELECT * FROM keys WHERE model_id % 2 = 0) GROUP BY 1")(lambda spark, sf: (lambda m: m.unionByName(m.filter("model_id % 2 = 0")).groupBy("term_key").agg(F.count("*").alias("n")))(keyed(spark, sf)))
PAIRS = "prs AS (SELECT a.model_id AS a, b.model_id AS b, count(*) AS n FROM terms a JOIN terms b ON a.f = b.f AND a.c = b.c AND a.model_id < b.model_id GROUP BY 1, 2)"
query("jaccard_pairs", f"{M}, {PAIRS} SELECT a, b, round(1 - n::DOUBLE / (ka.k + kb.k - n), 9) AS dissimilarity FROM prs JOIN keys ka ON ka.model_id = a JOIN keys kb ON kb.model_id = b")(lambda spark, sf: r(population.jaccard_pairs(keyed(spark, sf)), "dissimilarity"))
#: Models in order, one after the other: each stays unless one of those that stayed is too near.
_GREEDY = f"""{P.replace('WITH', 'WITH RECURSIVE', 1)}, o AS (SELECT model_id, fit, row_number() OVER (ORDER BY fit DESC, term_key DESC, model_id) AS i FROM ranked), sz AS (SELECT model_id, count(*)::DOUBLE AS size FROM terms GROUP BY 1),
cm AS (SELECT a.model_id AS a, b.model_id AS b, count(*)::DOUBLE AS n FROM terms a JOIN terms b ON a.f = b.f AND a.c = b.c AND a.model_id <> b.model_id GROUP BY 1, 2),
nb AS (SELECT ob.i, list(oa.i) AS near FROM cm JOIN o oa ON oa.model_id = a JOIN o ob ON ob.model_id = b JOIN sz sa ON sa.model_id = a JOIN sz sb ON sb.model_id = b WHERE oa.i < ob.i AND 1 - n / (sa.size + sb.size - n) < 0.7::DOUBLE GROUP BY 1),
step AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT step.i + 1, CASE WHEN len(list_intersect(kept, coalesce(near, []::BIGINT[]))) = 0 THEN list_append(kept, step.i + 1) ELSE kept END FROM step LEFT JOIN nb ON nb.i = step.i + 1 WHERE step.i < (SELECT count(*) FROM o))
SELECT model_id, fit FROM o WHERE i IN (SELECT unnest(kept) FROM step WHERE i = (SELECT count(*) FROM o))"""
query("jaccard_greedy", _GREEDY)(lambda spark, sf: population.diverse(fitted(spark, sf), 70.0).select("model_id", "fit"))
query("feature_statistics", f"{M}, s AS (SELECT f, count(*)::DOUBLE AS n, (count(*) FILTER (c > 0))::DOUBLE AS pos, (count(*) FILTER (c < 0))::DOUBLE AS neg, avg(abs(c)) AS coefficient, stddev_pop(abs(c)) AS coefficient_std FROM terms GROUP BY 1) SELECT f AS feature_id, round(n / {N}, 9) AS prevalence, CASE WHEN pos / n > 0.66 THEN 1 WHEN neg / n > 0.66 THEN 0 ELSE 2 END AS direction, round(CASE WHEN pos = 0 OR neg = 0 THEN 0 ELSE -(pos / n * log2(pos / n) + neg / n * log2(neg / n)) END, 9) AS sign_entropy, round(coefficient, 9) AS coefficient, round(coefficient_std, 9) AS coefficient_std FROM s")(
    lambda spark, sf: r(population.feature_statistics(keyed(spark, sf)), "prevalence", "sign_entropy", "coefficient", "coefficient_std")
)
query("bayesian_average", f"{pop_sql(20)} SELECT sample_id, round(avg(score), 9) AS score, CASE WHEN avg(score) > 5 THEN 1 ELSE 0 END AS predicted FROM sc GROUP BY 1")(lambda spark, sf: r(population.averaged(scored(spark, sf, n=20), 5.0).drop("y"), "score"))
query(
    "penalized_fit",
    f"{pop_sql()}, notes AS (SELECT DISTINCT feature_id, CAST(feature_id % 3 AS DOUBLE) / 10 AS pen FROM x WHERE feature_id % 4 <> 0), w AS (SELECT model_id, sum(abs(c) * greatest(0, coalesce(pen, 0))) / sum(abs(c)) AS paid FROM terms LEFT JOIN notes ON feature_id = f GROUP BY 1) SELECT model_id, round(fit - k * 0.01::DOUBLE - CASE WHEN sensitivity < 0.5 THEN (1 - sensitivity) * 0.3::DOUBLE ELSE 0 END - CASE WHEN specificity < 0.5 THEN (1 - specificity) * 0.3::DOUBLE ELSE 0 END - 0.2::DOUBLE * paid, 8) AS fit FROM pop JOIN w USING (model_id)",
)(lambda spark, sf: r(population.penalized(fitted(spark, sf), k_penalty=0.01, bias_penalty=0.3, weight=0.2, penalties=feature_notes(fx.abundance(spark, sf))).select("model_id", "fit"), "fit", digits=8))
query("beam_features_frequency", f"{P}, fb AS (SELECT f, count(*) AS n, min(rank) AS first FROM ranked JOIN terms USING (model_id) WHERE rank < 12 GROUP BY 1) SELECT f AS feature_id FROM fb WHERE n >= ceil(12 * 40 / 100.0) OR first < 2")(lambda spark, sf: population.features_by_frequency(population.keep_best(fitted(spark, sf), 12), 40, 10))
query("beam_features_fbm", f"{P} SELECT DISTINCT f AS feature_id FROM ranked JOIN terms USING (model_id) WHERE rank < 3")(lambda spark, sf: population.keep_best(fitted(spark, sf), 3).select(F.explode("terms.f").alias("feature_id")).distinct())
query("beam_features_ratio", f"{P}, fb AS (SELECT f, sign(c)::INT AS sign, count(*) AS n, min(rank) AS first FROM ranked JOIN terms USING (model_id) WHERE rank < 12 GROUP BY 1, 2) SELECT f AS feature_id, sign FROM (SELECT *, row_number() OVER (PARTITION BY sign ORDER BY n DESC, f) AS place FROM fb) WHERE n >= ceil(12 * 40 / 100.0) OR first < 2 OR place <= 3")(lambda spark, sf: population.features_for_ratio(population.keep_best(fitted(spark, sf), 12), 40, 10, 6))

PARENTS = "parents AS (SELECT range AS child, (range * 7 + j * 3) // 11 AS parent FROM range(1, 200), (SELECT unnest([1, 2]) AS j))"
query("genealogy", f"WITH RECURSIVE {PARENTS}, a(ancestor, depth) AS (SELECT 150::BIGINT, 0 UNION ALL SELECT p.parent, a.depth + 1 FROM a JOIN parents p ON p.child = a.ancestor WHERE a.depth < 4) SELECT DISTINCT ancestor, depth FROM a")(
    lambda spark, sf: population.genealogy(spark.range(1, 200).select(F.col("id").alias("child"), F.explode(F.array(F.lit(1), F.lit(2))).alias("j")).select("child", F.floor((F.col("child") * 7 + F.col("j") * 3) / 11).alias("parent")), 150, 4)
)

# ---------------------------------------------------------------- regression

ACT = f"WITH {base.A}, {base.A_SAMPLES}, {base.terms(40)}, {base.scores(digits=6)}"


def activity(spark, sf):
    x = fx.activity(spark, sf)
    return r(scores.evaluate(fx.models(x, 40), x, fx.activity_samples(spark, sf)), "score", digits=6)


def corr_sql(a, b):
    return f"CASE WHEN var_pop({a}) > 1e-18 AND var_pop({b}) > 1e-18 THEN corr({a}, {b}) ELSE 0 END"


RANKS = "rk AS (SELECT model_id, rank() OVER (PARTITION BY model_id ORDER BY score) + (count(*) OVER (PARTITION BY model_id, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY model_id ORDER BY y) + (count(*) OVER (PARTITION BY model_id, y) - 1) / 2.0::DOUBLE AS b FROM sc)"
_B = "CASE WHEN max({c}) OVER w > min({c}) OVER w THEN least(9, floor(({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) * (10 - 1e-10::DOUBLE))::INT) ELSE 0 END"
FIT_SQL = {
    "pearson": f"SELECT model_id, round({corr_sql('score', 'y')}, 8) AS fit FROM sc GROUP BY 1",
    "spearman": f", {RANKS} SELECT model_id, round({corr_sql('a', 'b')}, 8) AS fit FROM rk GROUP BY 1",
    "neg_rmse": "SELECT model_id, round(-sqrt(avg((score - y) * (score - y))), 7) AS fit FROM sc GROUP BY 1",
    "mutual_info": f", bn AS (SELECT model_id, {_B.format(c='score')} AS a, {_B.format(c='y')} AS b FROM sc WINDOW w AS (PARTITION BY model_id)), ce AS (SELECT model_id, a, b, count(*)::DOUBLE AS n FROM bn GROUP BY 1, 2, 3), me AS (SELECT *, sum(n) OVER (PARTITION BY model_id, a) AS na, sum(n) OVER (PARTITION BY model_id, b) AS nb, sum(n) OVER (PARTITION BY model_id) AS t FROM ce) SELECT model_id, round(sum(n / t * ln(n * t / (na * nb))), 8) AS fit FROM me GROUP BY 1",
}
for _name, _f in fitness.FITS.items():
    query(f"fit_{_name}", f"{ACT} {FIT_SQL[_name]}")(lambda spark, sf, f=_f, d=7 if _name == "neg_rmse" else 8: r(f(activity(spark, sf)), "fit", digits=d))
query("robust_summaries", f"WITH {base.X}, m AS (SELECT feature_id, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median FROM x GROUP BY 1), d AS (SELECT feature_id, median(abs(value - median)) * 1.4826 AS mad FROM x JOIN m USING (feature_id) GROUP BY 1) SELECT feature_id, {base.rounded('mean, std, median, mad')} FROM m JOIN d USING (feature_id)")(lambda spark, sf: r(fitness.summaries(fx.abundance(spark, sf), "value", "feature_id"), "mean", "std", "median", "mad"))

# ---------------------------------------------------------------- screening


def sums_sql(where="true"):
    part = ", ".join(f"sum(CASE WHEN y = {k} THEN {e} ELSE 0 END)::DOUBLE AS {n}{k}" for k in (0, 1) for n, e in (("c", "1"), ("s", "value"), ("q", "value * value")))
    return f"sizes AS (SELECT (count(*) FILTER (y = 0))::DOUBLE AS n0, (count(*) FILTER (y = 1))::DOUBLE AS n1 FROM samples), sums AS (SELECT feature_id, {part} FROM x JOIN samples USING (sample_id) WHERE y IN (0, 1) AND {where} GROUP BY 1)"


WILCOXON = f"""{sums_sql()}, gr AS (SELECT feature_id, value, sum(t0) AS t0, sum(t1) AS t1 FROM (
  SELECT feature_id, value, (count(*) FILTER (y = 0))::DOUBLE AS t0, (count(*) FILTER (y = 1))::DOUBLE AS t1 FROM x JOIN samples USING (sample_id) WHERE y IN (0, 1) GROUP BY 1, 2
  UNION ALL SELECT feature_id, 0, n0 - c0, n1 - c1 FROM sums, sizes) GROUP BY 1, 2),
gb AS (SELECT *, coalesce(sum(t0 + t1) OVER (PARTITION BY feature_id ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM gr),
rs AS (SELECT feature_id, sum(t0 * (before + (t0 + t1 + 1) / 2)) AS r0, sum(pow(t0 + t1, 3) - (t0 + t1)) AS ties FROM gb GROUP BY 1),
zz AS (SELECT *, r0 - n0 * (n0 + 1) / 2 - n0 * n1 / 2 AS diff, sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS sd FROM rs JOIN sums USING (feature_id), sizes),
zp AS (SELECT *, (abs(diff) - 0.5::DOUBLE) / sd * (CASE WHEN diff < 0 THEN -1 ELSE 1 END) AS z FROM zz),
wx AS (SELECT *, CASE WHEN s0 < 0 AND s1 < 0 THEN 2 ELSE 2 * {upper_normal_sql('abs(z)')} END AS p FROM zp),
tests AS (SELECT feature_id, z, p, CASE WHEN p < 0.05 THEN CASE WHEN s0 / n0 > s1 / n1 THEN 0 ELSE 1 END ELSE 2 END AS class FROM wx)"""
for _name, _x, _s, _fx, _fs in (("wilcoxon", base.X, base.SAMPLES, fx.abundance, fx.abundance_samples), ("wilcoxon_dense", base.V, base.V_SAMPLES, fx.vectors, fx.vector_samples)):
    query(_name, f"WITH {_x}, {_s}, {WILCOXON} SELECT feature_id, round(z, 8) AS z, round(p, 8) AS p, class FROM tests")(lambda spark, sf, a=_fx, b=_fs: r(screening.wilcoxon(a(spark, sf), b(spark, sf)), "z", "p", digits=8))

query("student_t", f"WITH {base.X}, {base.SAMPLES}, {sums_sql()} SELECT feature_id, round((s0 / n0 - s1 / n1) / (sqrt(((q0 - s0 * s0 / n0) + (q1 - s1 * s1 / n1)) / (n0 + n1 - 2)) * sqrt(1 / n0 + 1 / n1)), 8) AS t FROM sums, sizes")(lambda spark, sf: r(screening.student_t(fx.abundance(spark, sf), fx.abundance_samples(spark, sf)).select("feature_id", "t"), "t", digits=8))
query("student_t_p")(lambda spark, sf: screening.student_t(fx.vectors(spark, sf), fx.vector_samples(spark, sf)))

_ch = "(lf[({m})::INT + 1] - lf[({k})::INT + 1] - lf[({m} - ({k}))::INT + 1])"


def tail_sql(lo, hi):
    prob = f"exp({_ch.format(m='c0 + c1', k='i')} + {_ch.format(m='n0 + n1 - (c0 + c1)', k='n0 - i')} - {_ch.format(m='n0 + n1', k='n0')})"
    return f"list_sum(list_transform(range(({lo})::INT, ({hi})::INT + 1), lambda i: {prob}))"


query(
    "fisher_bf",
    f"WITH {base.X}, {base.SAMPLES}, {sums_sql('value >= 0')}, lgs AS (SELECT list(v ORDER BY i) AS lf FROM (SELECT i, sum(ln(greatest(i, 1)::DOUBLE)) OVER (ORDER BY i) AS v FROM (SELECT unnest(range(0, (n0 + n1)::INT + 1)) AS i FROM sizes))), tl AS (SELECT *, greatest({tail_sql('c0', 'least(c0 + c1, n0)')}, 2.2250738585072014e-308) AS up, greatest({tail_sql('greatest(0, n0 - (n0 + n1 - (c0 + c1)))', 'c0')}, 2.2250738585072014e-308) AS down FROM sums, sizes, lgs), fb AS (SELECT *, log10(up) - log10(down) AS f FROM tl) SELECT feature_id, round(CASE WHEN abs(f) >= 0.3 THEN abs(f) ELSE 0 END, 6) AS value, CASE WHEN abs(f) >= 0.3 THEN CASE WHEN f < 0 THEN 0 ELSE 1 END ELSE 2 END AS class FROM fb",
)(lambda spark, sf: r(screening.fisher_bayes(fx.abundance(spark, sf), fx.abundance_samples(spark, sf), 0.3), "value", digits=6))


def fdr_sql(alpha, tests="tests"):
    levels = [alpha, *[a for a in screening.RELAXED if a > alpha]]
    ks = ", ".join(f"max(CASE WHEN p <= i / n::DOUBLE * {a}::DOUBLE THEN i ELSE 0 END) OVER () AS k{j}" for j, a in enumerate(levels))
    pick = " ".join(f"WHEN k{j} >= 10 THEN k{j}" for j in range(len(levels)))
    return f"ti AS (SELECT *, row_number() OVER (ORDER BY p, feature_id) AS i, count(*) OVER () AS n FROM {tests}), tk AS (SELECT *, {ks} FROM ti), fd AS (SELECT * FROM tk WHERE i <= CASE {pick} ELSE least(10, n) END)"


#: Labels that the first components carry: whether their sum is positive.
CARRIED = "samples AS (SELECT vec_id AS sample_id, CASE WHEN list_sum(list_transform(embedding[1:30], lambda v: CAST(v AS DOUBLE))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM embeddings)"


def wide_tests(spark, sf):
    total = F.aggregate(F.slice("embedding", 1, 30), F.lit(0.0), lambda a, v: a + v.cast("double"))
    carried = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(total > 0, 1.0).otherwise(0.0).alias("y"))
    return screening.wilcoxon(fx.vectors(spark, sf), carried)


V_TESTS = f"WITH {base.V}, {CARRIED}, {WILCOXON}"
query("fdr_adaptive", f"{V_TESTS}, {fdr_sql(0.05)} SELECT feature_id, round(p, 8) AS p FROM fd")(lambda spark, sf: r(screening.false_discovery(wide_tests(spark, sf), 0.05).select("feature_id", "p"), "p", digits=8))
query("select_features", f"{V_TESTS}, {fdr_sql(0.05)}, se AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY p, feature_id) AS place FROM fd WHERE class < 2) SELECT feature_id, class, round(p, 8) AS significance, row_number() OVER (ORDER BY class, place) - 1 AS rank FROM se WHERE place <= 5")(lambda spark, sf: r(screening.select_features(wide_tests(spark, sf), 0.05, 5), "significance", digits=8))
query("select_features_regression", f"WITH {base.A}, {base.A_SAMPLES}, sh AS (SELECT feature_id, (count(*) FILTER (value > 0))::DOUBLE / (SELECT count(*) FROM samples) AS s FROM x JOIN samples USING (sample_id) GROUP BY 1) SELECT feature_id, 0 AS class, round(s, 9) AS significance, row_number() OVER (ORDER BY feature_id) - 1 AS rank FROM sh WHERE s >= 0.9")(lambda spark, sf: r(screening.select_for_regression(fx.activity(spark, sf), fx.activity_samples(spark, sf), 0.9), "significance"))
