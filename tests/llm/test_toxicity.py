"""The factorization machine: held-out accuracy, what interactions add, its formula, odd rows."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, odd_rows, prose

from scantling.llm import toxicity


def table(rng, n, rule):
    """Texts of prose into which an insult and a group are put or not, with their labels."""
    docs, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = prose(rng, rng.randint(20, 60))
        for word, use in (("Snarl!", insult), ("(Quonks)", group)):
            if use:
                words.insert(rng.randrange(len(words)), word)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(rule(insult, group))))
    return docs, labels


@pytest.mark.parametrize("rule", [lambda a, b: a, lambda a, b: a and b], ids=["one word", "both words"])
def test_held_out_accuracy(spark, rule):
    docs, labels = table(random.Random(3), 1500, rule)
    out = toxicity.toxicity(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97


def test_a_pair_means_more_than_its_words(spark):
    docs, labels = table(random.Random(5), 1500, lambda a, b: a and b)
    m = toxicity.fit(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert m.interaction("snarl", "quonks") > 0.2 and m.interaction("snarl", "snarl") == m.interaction("snarl", "unknown") == 0
    alone, other, both = m.scores(pa.array(["snarl", "quonks", "snarl quonks"]))
    assert both > 0.5 > max(alone, other)


def test_margins_by_the_formula():
    rng = np.random.default_rng(1)
    m = toxicity.Machine(np.arange(0, 64, 2), rng.normal(size=32), rng.normal(size=(32, 3)), 0.3, bits=6)
    texts = ["a b c d e f g", "", "a a A a.", "x", "one two three four five six seven eight nine ten"]
    values, first = toxicity.terms(pa.array(texts), 6)
    for text, lo, hi, z in zip(texts, first[:-1], first[1:], m.margins(values, first)):
        own = [int(m.place[v]) for v in values[lo:hi] if m.place[v] >= 0]
        assert len(set(values[lo:hi])) == hi - lo
        want = m.bias + sum(m.weights[i] for i in own) + sum(m.factors[i] @ m.factors[j] for a, i in enumerate(own) for j in own[:a])
        assert abs(z - want) < 1e-9
    assert first[2] - first[1] == 0 and first[3] - first[2] == 1


def test_terms_are_lower_case_and_without_punctuation_at_their_ends():
    values, first = toxicity.terms(pa.array(["Idiot! '(idiot)' --idiot--", "idiot", "... !!!"]))
    assert list(np.diff(first)) == [1, 1, 0] and values[0] == values[1]


def test_fitting_lowers_the_loss_of_pairs():
    """Labels that only products explain (both or neither): no sum of weights does."""
    rng = np.random.default_rng(0)
    a, b = rng.random(2000) < 0.5, rng.random(2000) < 0.5
    y = (a == b).astype(float)
    rows = [[k for k, use in enumerate((x, z)) if use] for x, z in zip(a, b)]
    first = np.r_[0, np.cumsum([len(r) for r in rows])]
    values = np.array([v for r in rows for v in r])
    w, v, bias = toxicity.fitted(values, first, y, np.ones(2000), 2, epochs=60)
    own = np.repeat(np.arange(2000), np.diff(first))
    z = bias + toxicity.added(own, 2000, w[values], v[values])[0]
    assert ((z > 0) == (y == 1)).mean() > 0.99


def test_frequencies_by_brute_force(spark):
    docs, labels = table(random.Random(9), 300, lambda a, b: a)
    rows = toxicity.labelled(documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bits=10)
    want = {}
    for r in rows.collect():
        for t in r.terms:
            n = want.setdefault(t, [0, 0, 0, 0])
            for k, add in enumerate((1, r.y, r.apart, r.y and r.apart)):
                n[k] += int(add)
    got = {r.bucket: [r.n, r.n1, r.m, r.m1] for r in toxicity.frequencies(rows.repartition(3), bits=10).collect()}
    assert got == want and len(got) > 50


def test_odd_rows_and_labels(spark):
    docs = documents(spark, odd_rows())
    labels = spark.createDataFrame([(6, None, 1), (7, 1, 0), (7, 1, 1), (8, 0, None), (None, 1, 1), (4, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in odd_rows())
    assert all(r.held_out for r in out if r.doc_id is None)
    blank = {r.score for r in out if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1 and len({r.score for r in out if r.doc_id == 8}) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("mark,score", [(1, 1.0), (0, 0.0), (None, 0.0)])
def test_labels_of_one_kind_or_none(spark, mark, score):
    rows = [(i, 1, mark) for i in range(20)] if mark is not None else []
    out = toxicity.toxicity(documents(spark, odd_rows()), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert all(abs(r.score - score) < 1e-6 for r in out)
