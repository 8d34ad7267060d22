"""Queries over populations of several languages and data types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import draw_sql, uniform_sql
from ..operators import genetic, goals, mixed, population, roc, scores
from ..sources import fixtures as fx
from . import base, ranking
from .base import query
from .scoring import r
from .search import COUPLES, CROSS, SEED, matrix, mutated_sql

LANGUAGES, DATA_TYPES = ("binary", "ternary", "ratio", "pow2"), ("raw", "prevalence")
GIVEN = ",".join(LANGUAGES), ",".join(DATA_TYPES)
N, SIZE, ELITE, QUOTA, CHANCE, PER_TERM = 80, 40, 10, 40, 20, 0.001

_KIND = f"{list(LANGUAGES)}[model_id % 4 + 1] AS language, {list(DATA_TYPES)}[(model_id // 4 % 2 + 1)::INT] AS data_type"
TERMS = f"{base.terms(N).replace('terms AS', 'plain AS', 1)}, terms AS (SELECT model_id, f, CASE WHEN model_id % 4 = 0 THEN 1 WHEN model_id % 4 = 3 THEN c * 4 ELSE c END AS c FROM plain)"
START = f"WITH {base.X}, {base.SAMPLES}, {TERMS}, {ranking.KEYS}, niche AS (SELECT model_id, k, term_key, {_KIND} FROM keys)"


def population_sql() -> str:
    """``sc`` of all models, each as its own kind reads values, and ``ranked``."""
    parts, names = [], []
    for ratio in (False, True):
        for own in DATA_TYPES:
            name = f"{'ratio' if ratio else 'linear'}_{own}"
            parts.append(f"t_{name} AS (SELECT model_id, f, c FROM terms JOIN niche USING (model_id) WHERE (language = 'ratio') = {ratio} AND data_type = '{own}')")
            parts.append(base.scores("ratio" if ratio else "ternary", own, source=f"t_{name}").replace("sc AS", f"sc_{name} AS", 1))
            names.append(f"SELECT * FROM sc_{name}")
    pop = f"ranked AS (SELECT *, row_number() OVER (ORDER BY round(fit / 1e-6::DOUBLE) DESC, term_key DESC, model_id) - 1 AS rank FROM (SELECT niche.*, auc, auc - {PER_TERM}::DOUBLE * k AS fit FROM niche JOIN aucs USING (model_id)))"
    return f"{START}, {', '.join(parts)}, sc AS ({' UNION ALL '.join(names)}), {base.auc()}, {pop}"


def models(spark, sf):
    """The fixture's models, dealt to the niches by id, their coefficients as the language writes them."""
    m = fx.models(fx.abundance(spark, sf), N)
    at = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    i = F.col("model_id")
    m = m.withColumn("language", at(LANGUAGES, i % 4)).withColumn("data_type", at(DATA_TYPES, F.floor(i / 4) % 2))
    written = lambda t: F.when(F.col("language") == "binary", 1).when(F.col("language") == "pow2", t["c"] * 4).otherwise(t["c"]).cast("int")
    m = m.withColumn("terms", F.transform("terms", lambda t: F.struct(t["f"].alias("f"), written(t).alias("c"))))
    return m.withColumn("term_key", population.term_key()).withColumn("k", F.size("terms").cast("long"))


def ranked(spark, sf):
    return population.ranked(goals.fitted(models(spark, sf), matrix(spark, sf), goals.Goal(k_penalty=PER_TERM), *GIVEN))


@query("mixed_scores", f"{population_sql()} SELECT model_id, language, data_type, round(auc, 9) AS auc FROM ranked")
def _(spark, sf):
    """AUC of models of eight kinds in one pass, by the relational path."""
    m = models(spark, sf)
    rows = scores.evaluate(m, fx.abundance(spark, sf), fx.abundance_samples(spark, sf), *GIVEN)
    return r(m.select("model_id", *mixed.NICHE).join(roc.auc(rows), "model_id").select("model_id", *mixed.NICHE, "auc"), "auc")


@query("mixed_population", f"{population_sql()} SELECT model_id, rank, round(auc, 9) AS auc, round(fit, 9) AS fit FROM ranked")
def _(spark, sf):
    """The same in blocks, ranked."""
    return r(ranked(spark, sf).select("model_id", "rank", "auc", "fit"), "auc", "fit")


query(
    "mixed_survivors",
    f"{population_sql()}, pl AS (SELECT *, row_number() OVER (PARTITION BY language, data_type ORDER BY rank) AS place, floor({SIZE} * {QUOTA} / 100 / (SELECT count(DISTINCT (language, data_type)) FROM ranked)) AS quota FROM ranked) SELECT model_id, rank FROM pl QUALIFY row_number() OVER (ORDER BY place > quota, rank) <= {SIZE}",
)(lambda spark, sf: mixed.survivors(ranked(spark, sf), SIZE, QUOTA).select("model_id", "rank"))

query(
    "mixed_parents",
    f"""{population_sql()}, pu AS (SELECT *, count(*) OVER () AS n, {draw_sql(SEED, 'parent', 'model_id')} AS u FROM ranked), el AS (SELECT *, rank < floor(n * {ELITE} / 100) AS e FROM pu),
re AS (SELECT *, (SELECT count(DISTINCT (language, data_type)) FROM el WHERE NOT e) AS kinds, row_number() OVER (PARTITION BY language, data_type ORDER BY rank) AS place, row_number() OVER (PARTITION BY language, data_type ORDER BY u, model_id) AS o FROM el WHERE NOT e)
SELECT model_id, rank FROM el WHERE e UNION ALL SELECT model_id, rank FROM re WHERE place <= floor(n * {QUOTA} / 100 / kinds) OR o <= floor(n * {CHANCE} / 100 / kinds)""",
)(lambda spark, sf: mixed.select_parents(ranked(spark, sf), ELITE, QUOTA, CHANCE, SEED))

CHILDREN = f"{START}, {COUPLES}, {CROSS}, kids AS (SELECT child, language, data_type FROM (SELECT child, CASE WHEN {draw_sql(SEED, 'main', 'child')} % 2 = 0 THEN a ELSE b END AS model_id FROM cp) JOIN niche USING (model_id)), mc AS (SELECT child, f, CAST(CASE language WHEN 'binary' THEN 1 WHEN 'pow2' THEN c ELSE sign(c) END AS INT) AS c FROM cr JOIN kids USING (child) WHERE c IS NOT NULL)"


def families(spark, sf):
    m = models(spark, sf).withColumn("rank", F.col("model_id"))
    return m, mixed.born(m, genetic.couples(m, 50, SEED), SEED)


def crossed(spark, sf):
    m, kids = families(spark, sf)
    return mixed.cross_over(m, kids, SEED), kids


query("mixed_crossover", f"{CHILDREN} SELECT child, language, data_type, f, c FROM mc JOIN kids USING (child)")(lambda spark, sf: (lambda terms, kids: terms.join(kids.select("child", *mixed.NICHE), "child").select("child", *mixed.NICHE, "f", "c"))(*crossed(spark, sf)))


def renewed_sql() -> str:
    """The rule of each language for a coefficient, as its own query states it."""
    rule = {g: mutated_sql(g).split("CASE WHEN hit THEN ", 1)[1].split(" ELSE c END AS INT)", 1)[0] for g in ("binary", "ternary", "pow2")}
    return "CASE language " + " ".join(f"WHEN '{g}' THEN {rule.get(g, rule['ternary'])}" for g in LANGUAGES) + " END"


query(
    "mixed_mutation",
    f"{CHILDREN}, tc AS (SELECT child, f, language FROM kids, (SELECT DISTINCT feature_id AS f FROM x) WHERE {uniform_sql(SEED, 'mutant', 'child')} < 0.8 AND {uniform_sql(SEED, 'touch', 'child', 'f')} < 0.2), al AS (SELECT child, f, c, language FROM mc FULL JOIN tc USING (child, f)) SELECT * FROM (SELECT child, f, CAST(CASE WHEN language IS NOT NULL THEN {renewed_sql()} ELSE c END AS INT) AS c FROM al) WHERE c IS NOT NULL",
)(lambda spark, sf: (lambda terms, kids: mixed.mutate(terms, kids, fx.abundance(spark, sf), SEED))(*crossed(spark, sf)))


@query("ga_mixed")
def _(spark, sf):
    """A search over three languages and two data types; every niche keeps a quota of survivors."""
    out = mixed.search(fx.abundance(spark, sf).select("feature_id").distinct(), matrix(spark, sf), "binary,ternary,ratio", "raw,prevalence", size=120, epochs=3, k_max=8, niche_pct=50)
    return out.select(*mixed.NICHE, "rank", "term_key", "k", "auc", "fit")
