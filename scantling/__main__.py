"""Command line: a run over delimited tables, or stored models on new ones.

``python -m scantling --x X --y Y --out FOLDER [--params FILE] [--x-test X --y-test Y] [--report FOLDER]``
``python -m scantling --load FOLDER --x X --y Y --out FOLDER``
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from .operators import reports, run
from .sources import rows, store, text


def data(spark: SparkSession, x: str, y: str, features: DataFrame | None = None, in_rows: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(x, samples, features) of two files; given ``features``, ids are those of the names there."""
    values, samples, own = text.matrix(spark, x, in_rows)
    if features is not None:
        names = own.withColumnRenamed("feature_id", "here").join(features, "feature").select("here", "feature_id")
        values = values.withColumnRenamed("feature_id", "here").join(names, "here").select("sample_id", "feature_id", "value")
    return values, text.labels(spark, y, samples), own if features is None else features


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = argparse.ArgumentParser(prog="scantling")
    for name in ("--x", "--y", "--out"):
        a.add_argument(name, required=True)
    for name in ("--params", "--load", "--x-test", "--y-test", "--report"):
        a.add_argument(name)
    a.add_argument("--features-in-columns", action="store_true")
    o = a.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("scantling").getOrCreate()
    in_rows, start = not o.features_in_columns, time.time()
    if o.load:
        tables, p = store.load(spark, o.load)
        x, samples, _ = data(spark, o.x, o.y, tables["features"], in_rows)
        store.save(o.out, {"tested": run.on_new_data(tables["family"], x, samples, p, tables.get("stats"))}, p)
        return
    lines = [r[0] for r in spark.read.text(o.params).collect()] if o.params else []  # a parameter file
    p = store.Params.of_text("\n".join(lines))
    x, samples, features = data(spark, o.x, o.y, None, in_rows)
    test = data(spark, o.x_test, o.y_test, features, in_rows)[:2] if o.x_test else None
    out = run.run_on_data(x, samples, p, test)
    out.save(o.out, {"features": features})
    if o.report:
        stamp = time.strftime("%Y-%m-%d_%H-%M-%S", time.localtime(start))
        rows.append(reports.report(out, time.time() - start, o.out, stamp, features=features.count()), o.report)


if __name__ == "__main__":
    main()
