"""Queries over the searches: beam levels, genetic and ant steps, Gram matrix, chains, and full runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_sql, uniform_sql
from ..operators import ants, beam, chains, dense, genetic, linear, population, roc, scores, screening
from ..sources import fixtures as fx
from . import base, ranking
from .base import query
from .ranking import fitted, keyed, sums_sql
from .scoring import r, scored

SEED = 11

# ---------------------------------------------------------------- beam

CF = f"{sums_sql()}, cf AS (SELECT feature_id AS f, CASE WHEN s0 / n0 > s1 / n1 THEN -1 ELSE 1 END AS c FROM sums, sizes)"


def combos_sql(k):
    names = [f"t{i}" for i in range(k)]
    key = " || ',' || ".join(f"{n}.f || ':' || {n}.c" for n in names)
    joins = "cf t0 " + " ".join(f"JOIN cf t{i} ON t{i - 1}.f < t{i}.f" for i in range(1, k))
    neg = " AND ".join(f"{n}.c < 0" for n in names)
    pos = " AND ".join(f"{n}.c > 0" for n in names)
    cols = ", ".join(f"{n}.f AS f{i}, {n}.c AS c{i}" for i, n in enumerate(names))
    drop = f"WHERE NOT ({neg})" if k > 1 else ""
    union = " UNION ALL ".join(f"SELECT model_id, f{i} AS f, c{i} AS c FROM cb" for i in range(k))
    return f"cb AS (SELECT {key} AS model_id, CASE WHEN {pos} THEN 'binary' ELSE 'ternary' END AS language, {cols} FROM {joins} {drop}), terms AS ({union})"


def selection(spark, sf):
    """All features with the class of the higher mean."""
    t = screening.wilcoxon(fx.abundance(spark, sf), fx.abundance_samples(spark, sf), 1.5)
    return population.listed(t.select("feature_id", "class", F.col("p").alias("significance"), F.row_number().over(Window.orderBy("p", "feature_id")).alias("rank")))  # a row for each feature


def matrix(spark, sf):
    return dense.Matrix(fx.abundance(spark, sf), fx.abundance_samples(spark, sf))


def level(spark, sf, k):
    models = beam.named(beam.rewritten(beam.combinations(selection(spark, sf), k), k), k)
    return r(beam.fitted_level(models, matrix(spark, sf)).select("term_key", "language", "auc"), "auc")


for _k in (1, 2, 3):
    query(f"beam_k{_k}" + ("_exhaustive" if _k > 1 else ""), f"WITH {base.X}, {base.SAMPLES}, {CF}, {combos_sql(_k)}, {base.scores()}, {base.auc()} SELECT cb.model_id AS term_key, language, round(auc, 9) AS auc FROM aucs JOIN cb USING (model_id)")(lambda spark, sf, k=_k: level(spark, sf, k))

FORWARD = f"WITH {base.X}, {base.SAMPLES}, {CF}, b AS (SELECT * FROM cf ORDER BY f LIMIT 5), fw AS (SELECT DISTINCT least(b.f, cf.f) AS f0, greatest(b.f, cf.f) AS f1 FROM b, cf WHERE b.f <> cf.f), cb AS (SELECT f0 || ':' || a.c || ',' || f1 || ':' || d.c AS model_id, f0, a.c AS c0, f1, d.c AS c1 FROM fw JOIN cf a ON a.f = f0 JOIN cf d ON d.f = f1 WHERE a.c > 0 OR d.c > 0), terms AS (SELECT model_id, f0 AS f, c0 AS c FROM cb UNION ALL SELECT model_id, f1, c1 FROM cb), {base.scores()}, {base.auc()} SELECT model_id AS term_key, round(auc, 9) AS auc FROM aucs"


def forward(spark, sf):
    sel = selection(spark, sf)
    best = beam.combinations(sel, 1).orderBy(F.col("terms")[0]["f"]).limit(5)
    models = beam.named(beam.rewritten(beam.extended(best, sel), 2), 2)
    return r(beam.fitted_level(models, matrix(spark, sf)).select("term_key", "auc"), "auc")


query("beam_k2_forward", FORWARD)(forward)


def beam_full(spark, sf):
    out = None
    for lev in beam.search(matrix(spark, sf), selection(spark, sf), 1, 3, criterion=60.0, most=2000):
        part = lev.select("k", "rank", "term_key", "language", "auc", "fit").filter("rank < 20")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "k long, rank int, term_key string, language string, auc double, fit double")


query("beam_full")(beam_full)
query("gemm_vs_sql", "SELECT 0::BIGINT AS differing")(
    lambda spark, sf: r(roc.auc(scored(spark, sf)), "auc").join(r(dense.fit(fx.models(fx.abundance(spark, sf), 60), matrix(spark, sf)), "auc").select("model_id", F.col("auc").alias("other")), "model_id", "full_outer").agg(F.count_if(~F.col("auc").eqNullSafe(F.col("other"))).alias("differing"))
)
_DF = "SELECT model_id, round(auc, 9) AS auc, threshold, round(accuracy, 9) AS accuracy, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity FROM aucs JOIN best USING (model_id)"
query("dense_fit", f"WITH {base.X}, {base.SAMPLES}, {base.terms(77)}, {base.scores()}, {base.auc()}, {base.roc('auc')} {_DF}")(lambda spark, sf: r(dense.fit(fx.models(fx.abundance(spark, sf), 77), matrix(spark, sf)).drop("objective"), "auc", "accuracy", "sensitivity", "specificity"))

# ---------------------------------------------------------------- genetic steps

PA = f"{ranking.P}, pu AS (SELECT model_id, rank, {draw_sql(SEED, 'parent', 'model_id')} AS u, rank < floor(count(*) OVER () * 10 / 100) AS e, count(*) OVER () AS n FROM ranked), po AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY u, model_id) AS o FROM pu), parents AS (SELECT model_id, rank FROM po WHERE e OR o <= floor(n * 10 / 100))"
query("ga_select_parents", f"{PA} SELECT * FROM parents")(lambda spark, sf: genetic.select_parents(population.ranked(fitted(spark, sf)), 10, 10, SEED))

COUPLES = f"pr AS (SELECT model_id, row_number() OVER (ORDER BY model_id) - 1 AS place, count(*) OVER () AS n FROM keys), kd AS (SELECT range AS child, {draw_sql(SEED, 'a', 'range')} % (SELECT count(*) FROM keys) AS pa, {draw_sql(SEED, 'b', 'range')} AS ub FROM range(50)), cp AS (SELECT child, a.model_id AS a, b.model_id AS b FROM kd JOIN pr a ON a.place = pa JOIN pr b ON b.place = (pa + 1 + ub % greatest(a.n - 1, 1)) % a.n)"
CROSS = f"cx AS (SELECT coalesce(l.child, q.child) AS child, coalesce(l.f, q.f) AS f, l.c AS ca, q.c AS cb FROM (SELECT child, f, c FROM cp JOIN terms ON model_id = a) l FULL JOIN (SELECT child, f, c FROM cp JOIN terms ON model_id = b) q ON l.child = q.child AND l.f = q.f), cr AS (SELECT child, f, CASE WHEN {draw_sql(SEED, 'cross', 'child', 'f')} % 2 = 0 THEN ca ELSE cb END AS c FROM cx)"
GA = f"{ranking.M}, {COUPLES}, {CROSS}"


def crossed(spark, sf):
    m = keyed(spark, sf).withColumn("rank", F.col("model_id"))
    return genetic.cross_over(m, genetic.couples(m, 50, SEED), SEED)


query("ga_crossover", f"{GA} SELECT * FROM cr WHERE c IS NOT NULL")(crossed)


def mutated_sql(language):
    d = draw_sql(SEED, "new", "child", "f")
    new = {
        "binary": f"CASE WHEN {d} % 2 = 0 THEN 1 END",
        "ternary": f"CASE WHEN {d} % 3 = 0 THEN 1 WHEN {d} % 3 = 1 THEN -1 END",
        "pow2": f"CASE WHEN c IS NULL THEN CASE WHEN {d} % 4 = 0 THEN CASE WHEN {d} % 8 < 4 THEN 4 ELSE -4 END END ELSE CASE WHEN {d} % 3 = 0 THEN sign(c) * least(abs(c) * 2, 64) WHEN {d} % 3 = 1 THEN sign(c) * greatest(abs(c) // 2, 1) END END",
    }[language]
    return f"tc AS (SELECT child, f FROM (SELECT DISTINCT child FROM cr WHERE c IS NOT NULL), (SELECT DISTINCT feature_id AS f FROM x) WHERE {uniform_sql(SEED, 'mutant', 'child')} < 0.8 AND {uniform_sql(SEED, 'touch', 'child', 'f')} < 0.2), mu AS (SELECT child, f, CAST(CASE WHEN hit THEN {new} ELSE c END AS INT) AS c FROM (SELECT coalesce(l.child, q.child) AS child, coalesce(l.f, q.f) AS f, l.c, q.f IS NOT NULL AS hit FROM (SELECT * FROM cr WHERE c IS NOT NULL) l FULL JOIN tc q ON l.child = q.child AND l.f = q.f))"


for _lang, _short in (("binary", "bin"), ("ternary", "ter"), ("pow2", "pow2")):
    query(f"ga_mutate_{_short}", f"{GA}, {mutated_sql(_lang)} SELECT * FROM mu WHERE c IS NOT NULL")(lambda spark, sf, g=_lang: genetic.mutate(crossed(spark, sf), fx.abundance(spark, sf), g, SEED))

EPOCH = f"WITH {base.X}, {base.SAMPLES}, {base.terms(80)}, {ranking.KEYS}, {COUPLES}, {CROSS}, {mutated_sql('ternary')}, kids AS (SELECT child AS model_id, f, c FROM mu WHERE c IS NOT NULL), {base.scores(source='kids')}, {base.auc()} SELECT model_id, round(auc, 9) AS auc FROM aucs"


def epoch(spark, sf):
    kids = genetic.gathered(genetic.mutate(crossed(spark, sf), fx.abundance(spark, sf), "ternary", SEED), 0)
    return r(roc.auc(scores.evaluate(kids, fx.abundance(spark, sf), fx.abundance_samples(spark, sf))), "auc")


query("ga_epoch", EPOCH)(epoch)
query("generate_population", f"WITH {base.X}, ge AS (SELECT model_id, f, {draw_sql(SEED, 'sign', 'model_id', 'f')} AS s, row_number() OVER (PARTITION BY model_id ORDER BY -ln(({draw_sql(SEED, 'pick', 'model_id', 'f')} + 1) / 4294967297.0::DOUBLE), f) AS o, 2 + {draw_sql(SEED, 'size', 'model_id')} % 5 AS k FROM (SELECT range AS model_id FROM range(40)), (SELECT DISTINCT feature_id AS f FROM x)) SELECT model_id, f, CASE WHEN s % 2 = 0 THEN 1 ELSE -1 END AS c FROM ge WHERE o <= k")(
    lambda spark, sf: genetic.generate(fx.abundance(spark, sf), 40, 2, 6, SEED).select("model_id", F.explode("terms").alias("t")).select("model_id", "t.f", "t.c")
)
query("ga_full")(lambda spark, sf: genetic.search(fx.abundance(spark, sf).select("feature_id").distinct(), matrix(spark, sf), size=60, epochs=3, k_max=8).select("rank", "term_key", "k", "auc", "fit"))

# ---------------------------------------------------------------- ants

TAU = f"WITH {base.X}, fe AS (SELECT DISTINCT feature_id FROM x), tau AS (SELECT feature_id, 0.1::DOUBLE + (feature_id % 7) / 10.0::DOUBLE AS tau_pos, 0.1::DOUBLE + (feature_id % 5) / 10.0::DOUBLE AS tau_neg, (feature_id % 4 + 1)::DOUBLE AS eta FROM fe), pb AS (SELECT *, pow(tau_pos + tau_neg, 1) * pow(eta, 2) AS weight FROM tau)"


def pheromone(spark, sf):
    f = F.col("feature_id")
    return fx.abundance(spark, sf).select("feature_id").distinct().select("feature_id", (0.1 + (f % 7) / 10.0).alias("tau_pos"), (0.1 + (f % 5) / 10.0).alias("tau_neg"))


def probs(spark, sf):
    t = pheromone(spark, sf)
    return ants.probabilities(t, t.select("feature_id", (F.col("feature_id") % 4 + 1).cast("double").alias("eta")))


query("aco_probabilities", f"{TAU} SELECT feature_id, round(weight, 9) AS weight, round(weight / sum(weight) OVER (), 9) AS p, round(tau_pos / (tau_pos + tau_neg), 9) AS p_pos FROM pb")(lambda spark, sf: r(probs(spark, sf), "weight", "p", "p_pos"))
query(
    "aco_construct",
    f"{TAU}, an AS (SELECT range AS m, 2 + {draw_sql(SEED, 'ant', 'range')} % 4 AS k FROM range(30)), wk AS (SELECT m, feature_id, tau_pos / (tau_pos + tau_neg) AS pp, k, row_number() OVER (PARTITION BY m ORDER BY round(-ln(({draw_sql(SEED, 'walk', 'm', 'feature_id')} + 1) / 4294967297.0::DOUBLE) / weight, 15), feature_id) AS o FROM an, pb) SELECT m AS model_id, feature_id AS f, CASE WHEN {uniform_sql(SEED, 'sign', 'm', 'feature_id')} < pp THEN 1 ELSE -1 END AS c FROM wk WHERE o <= k",
)(lambda spark, sf: ants.construct(probs(spark, sf), 30, 2, 5, SEED).select("model_id", F.explode("terms").alias("t")).select("model_id", "t.f", "t.c"))
query(
    "aco_evaporate_deposit",
    f"{TAU}, {base.terms(5)}, gift AS (SELECT f, sum(CASE WHEN c > 0 THEN 0.05::DOUBLE * (model_id + 1) ELSE 0 END) AS dp, sum(CASE WHEN c < 0 THEN 0.05::DOUBLE * (model_id + 1) ELSE 0 END) AS dn FROM terms GROUP BY 1) SELECT feature_id, round(least(greatest(tau_pos * 0.9::DOUBLE, 0.01) + coalesce(dp, 0), 1.0), 9) AS tau_pos, round(least(greatest(tau_neg * 0.9::DOUBLE, 0.01) + coalesce(dn, 0), 1.0), 9) AS tau_neg FROM tau LEFT JOIN gift ON f = feature_id",
)(lambda spark, sf: r(ants.deposit(ants.evaporate(pheromone(spark, sf), 0.1), fx.models(fx.abundance(spark, sf), 5).withColumn("amount", F.lit(0.05) * (F.col("model_id") + 1))), "tau_pos", "tau_neg"))
query("aco_entropy", f"{TAU}, pt AS (SELECT (tau_pos + tau_neg) / sum(tau_pos + tau_neg) OVER () AS p FROM tau) SELECT round(sum(-p * ln(p)) / ln(count(*)), 9) AS entropy FROM pt")(lambda spark, sf: r(ants.entropy(pheromone(spark, sf)), "entropy"))
query("aco_top", f"{TAU} SELECT feature_id, round(tau_pos + tau_neg, 9) AS tau FROM tau ORDER BY round(tau_pos + tau_neg, 12) DESC, feature_id LIMIT 5")(lambda spark, sf: r(ants.top(pheromone(spark, sf).withColumns({c: F.round(c, 12) for c in ("tau_pos", "tau_neg")}), 5).select("feature_id", "tau"), "tau"))
query("aco_full")(lambda spark, sf: ants.search(selection(spark, sf), matrix(spark, sf), ants=30, iterations=3).select("rank", "term_key", "k", "auc", "fit"))

# ---------------------------------------------------------------- linear and chains

query("lasso_gram", f"WITH {base.V}, {base.V_SAMPLES} SELECT a.feature_id AS i, b.feature_id AS j, round(sum(a.value * b.value), 6) AS s FROM x a JOIN x b USING (sample_id) WHERE a.feature_id <= b.feature_id GROUP BY 1, 2")(lambda spark, sf: r(linear.gram(fx.vectors(spark, sf), fx.vector_samples(spark, sf)), "s", digits=6))
query("lasso_targets", f"WITH {base.V}, {base.V_SAMPLES} SELECT feature_id AS i, round(sum(value), 6) AS sx, round(sum(value * y), 6) AS sxy FROM x JOIN samples USING (sample_id) GROUP BY 1")(lambda spark, sf: r(linear.targets(fx.vectors(spark, sf), fx.vector_samples(spark, sf)), "sx", "sxy", digits=6))


def lasso(spark, sf):
    x, s = fx.vectors(spark, sf), fx.vector_samples(spark, sf).filter("y < 2")
    return linear.search(x, s, dense.Matrix(x, s), alphas=10).select("model_id", "k", "auc", "fit")


query("lasso_path")(lasso)
query("sa_best")(lambda spark, sf: chains.search(spark, matrix(spark, sf), "sa", chains=4, steps=150).select("chain_id", "fit", "auc", "k"))
query("ils_best")(lambda spark, sf: chains.search(spark, matrix(spark, sf), "ils", chains=4, steps=120).select("chain_id", "fit", "auc", "k"))
query("mcmc_posterior")(lambda spark, sf: chains.summary(chains.trace(spark, matrix(spark, sf), chains=2, steps=60, burn=30, most=20)))
SIM = "tr AS (SELECT c.range AS chain_id, s.range AS step, f.range::INT AS feature_id, (hash_of % 3 - 1)::INT AS state FROM range(3) c, range(40) s, range(10) f, LATERAL (SELECT " + draw_sql(SEED, "trace", "c.range", "s.range", "f.range") + " AS hash_of))"
query("mcmc_summary", f"WITH {SIM}, sm AS (SELECT feature_id, count(*) AS n, avg((state = 1)::INT) AS pp, avg((state = -1)::INT) AS pn FROM tr GROUP BY 1) SELECT feature_id, round(pp, 9) AS p_pos, round(pn, 9) AS p_neg, round(pp + pn, 9) AS p_active, round(sqrt((pp + pn) * (1 - pp - pn) / n), 9) AS deviation FROM sm")(
    lambda spark, sf: r(chains.summary(simulated(spark)), "p_pos", "p_neg", "p_active", "deviation")
)


def simulated(spark):
    from ..functions.hashing import draw

    t = spark.range(3).select(F.col("id").alias("chain_id")).crossJoin(spark.range(40).select(F.col("id").alias("step"))).crossJoin(spark.range(10).select(F.col("id").cast("int").alias("feature_id")))
    return t.withColumn("state", (draw(SEED, "trace", "chain_id", "step", "feature_id") % 3 - 1).cast("int"))
