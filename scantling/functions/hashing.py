"""Counter-based draws: a number depends on seed, purpose and ids alone, not on partitions or order."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, purpose: str, *ids: Column | str) -> Column:
    """Uniform whole number in [0, 2**32)."""
    parts = [F.lit(str(seed)), F.lit(purpose), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def uniform(seed: int, purpose: str, *ids: Column | str) -> Column:
    """Uniform real number in [0, 1)."""
    return draw(seed, purpose, *ids) / F.lit(4294967296.0)


def draw_sql(seed: int, purpose: str, *ids: str) -> str:
    parts = ", ".join([f"'{seed}'", f"'{purpose}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT)"


def uniform_sql(seed: int, purpose: str, *ids: str) -> str:
    return f"({draw_sql(seed, purpose, *ids)} / 4294967296.0::DOUBLE)"


def draws(seed: int, purpose: str, first: int, ids: list[bytes]) -> np.ndarray:
    """As ``draw`` of (first, id) for every id, given as text."""
    start, out = hashlib.md5(f"{seed}|{purpose}|{first}|".encode(), usedforsecurity=False), []
    for i in ids:
        h = start.copy()
        h.update(i)
        out.append(h.digest()[:4])
    return np.frombuffer(b"".join(out), ">u4").astype(np.int64)
