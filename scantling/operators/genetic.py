"""Genetic search: selection, crossing and mutation as relational steps on hash draws.

All draws depend on (seed, step, child, feature), so a generation is the same however it is
partitioned. One generation is one scoring job; the population stays bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw, uniform
from . import dense, goals, population

POW2 = (1, 2, 4, 8, 16, 32, 64)


def select_parents(ranked: DataFrame, elite_pct: float, random_pct: float, seed: int, niche: list[str] | None = None, niche_pct: float = 0.0) -> DataFrame:
    """The first ranks, the first of every niche, and a random part of the others. ``ranked``: model_id, rank."""
    n = F.count("*").over(Window.partitionBy())
    elite = F.floor(n * elite_pct / 100)
    rows = ranked.withColumn("_e", F.col("rank") < elite)
    if niche and niche_pct:
        w = Window.partitionBy(*niche).orderBy("rank")
        rows = rows.withColumn("_e", F.col("_e") | (F.row_number().over(w) <= F.floor(F.count("*").over(Window.partitionBy()) * niche_pct / 100)))
    rest = Window.partitionBy("_e").orderBy("_u", "model_id")
    rows = rows.withColumn("_u", draw(seed, "parent", "model_id")).withColumn("_o", F.row_number().over(rest)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return rows.filter(F.col("_e") | (F.col("_o") <= F.floor(F.col("_n") * random_pct / 100))).select("model_id", "rank")


def couples(parents: DataFrame, children: int, seed: int) -> DataFrame:
    """``child, a, b``: two different parents by position."""
    p = parents.withColumn("place", F.row_number().over(Window.orderBy("rank")) - 1)
    n = p.count()
    kids = parents.sparkSession.range(children).select(F.col("id").alias("child"))
    kids = kids.withColumn("pa", draw(seed, "a", "child") % n).withColumn("pb", (F.col("pa") + 1 + draw(seed, "b", "child") % F.greatest(F.lit(n - 1), F.lit(1))) % n)
    a, b = (F.broadcast(p.select(F.col("place").alias(f"p{s}"), F.col("model_id").alias(s))) for s in "ab")
    return kids.join(a, "pa").join(b, "pb").select("child", "a", "b")


def cross_over(models: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """``child, f, c``: each feature of either parent is taken as a random one of them has it, absent or not."""
    t = models.select("model_id", F.explode("terms").alias("t")).select("model_id", F.col("t.f").alias("f"), F.col("t.c").alias("c"))
    own = lambda s: pairs.join(t.withColumnRenamed("model_id", s), s).select("child", "f", F.col("c").alias(f"c{s}"))
    both = own("a").join(own("b"), ["child", "f"], "full_outer")
    c = F.when(draw(seed, "cross", "child", "f") % 2 == 0, F.col("ca")).otherwise(F.col("cb"))
    return both.select("child", "f", c.alias("c")).filter("c is not null")


def renewed(language: str, d: Column) -> Column:
    """What a chosen coefficient ``c`` (null: absent) becomes by draw."""
    if language == "binary":
        return F.when(d % 2 == 0, 1)
    if language == "pow2":
        size = F.abs("c")
        grown, halved = F.least(size * 2, F.lit(64)), F.greatest((size / 2).cast("int"), F.lit(1))
        return F.when(F.col("c").isNull(), F.when(d % 4 == 0, F.when(d % 8 < 4, 4).otherwise(-4))).otherwise(F.when(d % 3 == 0, F.signum("c") * grown).when(d % 3 == 1, F.signum("c") * halved))
    return F.when(d % 3 == 0, 1).when(d % 3 == 1, -1)


def mutate(children: DataFrame, features: DataFrame, language: str, seed: int, child_pct: float = 80, feature_pct: float = 20, n_children: DataFrame | None = None) -> DataFrame:
    """``child, f, c``: in chosen children, chosen features lose their term and may get a new one.

    Binary: present with probability one half; ternary: 1, -1 or absent alike; powers of two:
    a present coefficient is doubled or halved within its range, or goes; an absent one may start.
    """
    kids = (n_children if n_children is not None else children.select("child").distinct()).filter(uniform(seed, "mutant", "child") < child_pct / 100)
    touched = kids.crossJoin(F.broadcast(features.select(F.col("feature_id").alias("f")).distinct())).filter(uniform(seed, "touch", "child", "f") < feature_pct / 100).withColumn("hit", F.lit(True))
    rows = children.join(touched, ["child", "f"], "full_outer")
    return rows.select("child", "f", F.when(F.col("hit"), renewed(language, draw(seed, "new", "child", "f"))).otherwise(F.col("c")).cast("int").alias("c")).filter("c is not null")


def gathered(terms: DataFrame, epoch: int) -> DataFrame:
    """Children as models; their ids continue by generation."""
    m = terms.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("f", "c"))).alias("terms"))
    return m.select((F.col("child") + F.lit(epoch) * F.lit(1 << 32)).alias("model_id"), "terms")


def generate(features: DataFrame, n: int, k_min: int, k_max: int, seed: int, signed: bool = True, weights: DataFrame | None = None) -> DataFrame:
    """Random models: size uniform in bounds, features by smallest ``-ln(u) / weight``, random signs."""
    f = features.select("feature_id").distinct() if weights is None else features.select("feature_id").distinct().join(weights, "feature_id").filter("weight > 0")
    weight = F.lit(1.0) if weights is None else F.col("weight")
    m = features.sparkSession.range(n).select(F.col("id").alias("model_id")).withColumn("k", F.lit(k_min) + draw(seed, "size", "model_id") % (k_max - k_min + 1))
    u = (draw(seed, "pick", "model_id", "feature_id") + 1) / F.lit(4294967297.0)
    rows = m.crossJoin(F.broadcast(f)).withColumn("o", F.row_number().over(Window.partitionBy("model_id").orderBy(-F.ln(u) / weight, "feature_id"))).filter("o <= k")
    c = F.when(draw(seed, "sign", "model_id", "feature_id") % 2 == 0, 1).otherwise(-1) if signed else F.lit(1)
    return rows.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature_id").alias("f"), c.cast("int").alias("c")))).alias("terms"))


def search(features: DataFrame, matrix: dense.Matrix, language: str = "ternary", size: int = 100, epochs: int = 10, k_min: int = 1, k_max: int = 10, elite_pct: float = 5, random_pct: float = 5, k_penalty: float = 0.0, max_age: int = 5, diversity_pct: float = 0.0, seed: int = 4815162342, goal: goals.Goal | None = None) -> DataFrame:
    """The last population, ranked. Stops after ``epochs``, or when the best model is ``max_age`` epochs old."""
    spark, features = features.sparkSession, population.listed(features.select("feature_id").distinct())  # read at every epoch

    def evaluated(models: DataFrame) -> DataFrame:
        models = models.withColumn("term_key", population.term_key()).withColumn("k", F.size("terms").cast("long"))
        models = population.remove_clones(population.remove_out_of_bounds(population.remove_stillborn(models, language), 0, k_max))
        out = goals.fitted(models, matrix, goal or goals.Goal(k_penalty=k_penalty), language)
        out = population.ranked(out).filter(F.col("rank") < size).drop("rank")
        return population.ranked(spark.createDataFrame(out.collect(), out.schema))  # bounded by the population's size

    pop = evaluated(generate(features, size, max(k_min, 2 if language in ("ternary", "ratio") else 1), k_max, seed, language != "binary"))
    best, age = None, 0
    for epoch in range(1, epochs + 1):
        base = population.diverse(pop, diversity_pct).transform(lambda d: population.ranked(d.drop("rank"))) if diversity_pct and epoch % 5 == 0 else pop
        parents = select_parents(base, elite_pct, random_pct, seed + epoch)
        if parents.count() < 2:
            parents = base.select("model_id", "rank").filter("rank < 2")
        children = cross_over(base, couples(parents, size, seed + epoch), seed + epoch)
        children = gathered(mutate(children, features, language, seed + epoch), epoch)
        kept = base.join(parents.select("model_id"), "model_id", "left_semi").select("model_id", "terms")
        pop = evaluated(kept.unionByName(children))
        top = pop.filter("rank = 0").first()
        if top is None:
            break
        age = age + 1 if best is not None and top["fit"] <= best else 0
        best = top["fit"] if best is None else max(best, top["fit"])
        if age >= max_age:
            break
    return pop
