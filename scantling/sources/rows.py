"""Report rows at rest: a folder of CSV files that all have the same header."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Quotes in a value are doubled.
FORMAT = {"header": "true", "escape": '"'}


def headed(spark: SparkSession, folder: str, header: str) -> bool:
    """Whether every file of the folder has this header line; a folder that isn't there has."""
    try:
        lines = spark.read.text(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return True
    return lines.groupBy(F.input_file_name()).agg(F.count_if(F.col("value") == header).alias("n")).filter("n <> 1").isEmpty()


def append(rows: DataFrame, folder: str) -> None:
    """Adds rows as one more file, which appears whole or not at all; another header there is an error, and nothing is written."""
    if not headed(rows.sparkSession, folder, ",".join(rows.columns)):
        raise ValueError(f"{folder} has rows with other columns")
    rows.coalesce(1).write.mode("append").options(**FORMAT).csv(folder)


def read(spark: SparkSession, folder: str, columns: tuple[str, ...]) -> DataFrame:
    return spark.read.options(**FORMAT, enforceSchema="false").schema(", ".join(f"`{c}` string" for c in columns)).csv(folder)
