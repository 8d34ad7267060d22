"""Small tables for the operators' tests."""

from __future__ import annotations

import random

#: Other columns, named as the operators name theirs inside.
CLASHING = "node long, key string, component long, salt int, n long, a long, b long, kept boolean, doc long, hash string, length long, _kept long, rank int"


def documents(spark, rows, extra=True):
    """``rows``: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        full = [(*r, *([None] * 13)) for r in full]
        ddl += ", " + CLASHING
    return spark.createDataFrame(full, ddl)


def prose(rng: random.Random, n: int, start: int = 0) -> list[str]:
    return ["".join(rng.choice(("an", "the", "or", "is", "en", "ti", "ou", "re", "ha")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def odd_rows(seed: int = 1):
    """Null ids and texts, blank, short and long texts, ties, repeated rows, unusual characters."""
    rng = random.Random(seed)
    long_text = " ".join(prose(rng, 30_000))
    usual = " ".join(prose(rng, 120))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, usual), (7, usual), (8, usual), (8, usual), (None, usual), (None, None), (9, long_text), (10, "x" * 50_000), (11, "é ü \x1c ßİ " * 30), (12, "a b c a b c a b c")]
