"""Fill-in-the-middle against a plain loop, with odd rows, other units and exact round trips."""

import hashlib
import re

import pytest
from helpers import documents, odd_rows
from pyspark.sql import functions as F

from scantling.llm import fill_in_middle as fim

MARKS = [(20, "a <P> b"), (21, "x<S>"), (22, "<M>"), (23, "<<S<P < M> <" * 40), (24, "\n\r\n" * 70), (25, "𝄞é" * 500), (26, "ab" * 32), (27, "a" * 64), (28, "a" * 65)]


def by_hand(doc_id, text, unit="(?s).", share=90, spm=20):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = [m.group() for m in re.finditer(f"{unit}|(?s:.)" if unit != "(?s)." else unit, text)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return doc_id, text, n, "plain", None, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, text, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, text, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("unit", [fim.UNIT, r"[a-z0-9]+", r"[a-z]{1,3}", r"a|ab"])
@pytest.mark.parametrize("shares", [(90, 20), (100, 0), (100, 100)])
def test_by_hand(spark, unit, shares):
    rows = odd_rows() + MARKS + [(k, f"text {k} of some words " * (k % 9)) for k in range(100, 160)]
    out = fim.transform(documents(spark, rows), unit=unit, share=shares[0], suffix_first=shares[1])
    got = [tuple(r) for r in out.collect()]
    assert in_order(got) == in_order(by_hand(i, t, unit, *shares) for i, t in rows)
    assert len({r[3] for r in got}) == (3 if 0 < shares[1] < 100 else 2)


def test_round_trip(spark):
    rows = odd_rows() + MARKS + [(k, "<M <P> <S>"[: k % 11] + "< M>" * (k % 7)) for k in range(200, 260)]
    out = fim.transform(documents(spark, rows), share=100)
    assert out.withColumn("again", fim.restored()).filter("again <> text").count() == 0
    assert out.filter("form <> 'plain'").filter(~(F.concat("prefix", "middle", "suffix") == F.col("text"))).count() == 0


def test_many_equal_rows_and_an_empty_table(spark):
    docs = documents(spark, [(7, "the same words again " * 20)] * 3000 + [(8, "other words")])
    out = fim.transform(docs, share=100)
    assert out.count() == 3001 and out.distinct().count() == 2
    assert fim.transform(docs.limit(0)).count() == 0
