"""Folders that driver and executors both see, and shuffle files that go early."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def folder(spark: SparkSession, purpose: str) -> str:
    """A path not used before, below ``spark.checkpoint.dir``; below a local folder only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{named or tempfile.mkdtemp(prefix='scantling-')}/{purpose}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _within = threading.Lock(), {"n": 0, "old": None}


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a plan that is made and run here go when it has run; Spark would keep them until the driver collects garbage.

    For several threads of a session too: the setting stays until the last of them is through.
    """
    with _lock:
        if not _within["n"]:
            _within["old"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _within["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _within["n"] -= 1
            if not _within["n"]:
                spark.conf.unset(CLEANUP) if _within["old"] is None else spark.conf.set(CLEANUP, _within["old"])


def collected(spark: SparkSession) -> None:
    """Garbage of both driver processes: with the tables that no one holds go their shuffle files and checkpoints."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
