"""Sample-by-feature tables derived from the driver's tables.

``x(sample_id, feature_id, value)`` holds no zero rows: a missing entry is an implicit zero.
``samples(sample_id, y)`` has a label for every sample: 0, 1 or 2 (unknown); or a real value.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the longest table that a task of a join or sum holds; so a task's memory doesn't grow with the tables.
PER_TASK = 200_000


def dealt(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """By key, to as many tasks as ``rows`` need: a number of our own, which Spark doesn't coalesce to fewer."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // PER_TASK), *key)


def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity of each brand that a customer ordered: sparse, integer-valued; a customer's rows are in one partition.

    Compact files hide how many rows they hold, so how to join is named: Spark would broadcast millions
    of orders or parts through the driver. Each task hashes its part of them and sorts nothing. The
    rows stay in the executors' storage: a query reads them up to five times, and Spark finds them by their plan.
    """
    lines, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    n = lines.count()  # of the files' footers
    lines = dealt(lines.select("l_orderkey", "l_partkey", "l_quantity"), n, "l_orderkey")
    orders = dealt(orders.select("o_orderkey", "o_custkey"), n, "o_orderkey")
    ordered = dealt(lines.join(orders.hint("shuffle_hash"), lines.l_orderkey == orders.o_orderkey).select("o_custkey", "l_partkey", "l_quantity"), n, "l_partkey")
    parts = dealt(parts.select("p_partkey", F.substring("p_brand", 7, 10).cast("int").alias("feature_id")), n, "p_partkey")
    joined = dealt(ordered.join(parts.hint("shuffle_hash"), ordered.l_partkey == parts.p_partkey).select(F.col("o_custkey").alias("sample_id"), "feature_id", "l_quantity"), n, "sample_id")
    return joined.groupBy("sample_id", "feature_id").agg(F.sum("l_quantity").cast("double").alias("value")).persist(StorageLevel.MEMORY_AND_DISK)


def abundance_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, labelled by market segment; household is unknown."""
    segment = F.col("c_mktsegment")
    y = F.when(segment.isin("BUILDING", "MACHINERY"), 1.0).when(segment == "HOUSEHOLD", 2.0).otherwise(0.0)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), y.alias("y"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components: dense, signed, continuous."""
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_id", "v")).select("sample_id", "feature_id", F.col("v").cast("double").alias("value")).filter("value <> 0")


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(label < 4, 1.0).when(label < 9, 0.0).otherwise(2.0).alias("y"))


EVENT_CODES = ("view", "click", "purchase", "signup")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed event values of a user per kind of event, in whole cents."""
    code = F.lit(4)
    for k, name in reversed(list(enumerate(EVENT_CODES))):
        code = F.when(F.col("event_type") == name, k).otherwise(code)
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id"), code.cast("int").alias("feature_id")).agg((cents / 100).alias("value")).filter("value <> 0")


def activity_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their number of purchases: a continuous target."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id")).agg(F.count_if(F.col("event_type") == "purchase").cast("double").alias("y"))


def models(features: DataFrame, n: int) -> DataFrame:
    """``n`` arithmetic sign models over ``features`` (feature_id): ``model_id, terms`` sorted by feature."""
    m, f = F.col("model_id"), F.col("feature_id")
    sign = F.when((m * 31 + f * 17) % 7 < 3, 1).otherwise(-1)
    own = features.sparkSession.range(n).select(F.col("id").alias("model_id")).crossJoin(F.broadcast(features.select("feature_id").distinct()))
    own = own.filter((m * 13 + f * 29) % 11 < 3)
    return own.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct(f.alias("f"), sign.cast("int").alias("c")))).alias("terms"))
