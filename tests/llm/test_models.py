import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import zstandard
from helpers import documents, odd_rows, prose
from pyarrow import fs
from pyspark.sql import functions as F

from scantling.llm import language_model as lm
from scantling.llm import warc

W = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of_prose(n=120):
    rng = random.Random(1)
    return [(i + 100, " ".join(prose(rng, rng.randint(5, 80)))) for i in range(n)] + odd_rows()


@pytest.mark.parametrize("most", [lm.TABLE_WORDS, 40])
def test_base_score_and_counts_equal_naive(spark, most):
    rows = rows_of_prose()
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 5 == 1
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tok = [(i, [*W.findall(lower(t)), None]) for i, t in rows]
    c = Counter(w for i, ws in tok if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, held(i), math.fsum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tok)
    got = lm.score(documents(spark, rows), rounds=1, vocabulary=32, most=most).collect()
    assert {len(ws) for _, ws in tok} >= {30_001}  # the long text
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.held_out, r.base_score) for r in got)
    assert [x[:-1] for x in have] == [x[:-1] for x in want]
    assert all(math.isclose(x[-1], y[-1], rel_tol=1e-9) for x, y in zip(have, want))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_model_beats_its_unigram_base_on_held_out_documents(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):  # an order that unigrams can't see
        a = rng.randrange(3)
        rows.append((i, " ".join(("red green blue", "one two three", "sun moon star")[a] for _ in range(12))))
    got = [r for r in lm.score(documents(spark, rows), rounds=3).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_scores_do_not_depend_on_partitions(spark):
    rows = rows_of_prose(400)
    by = []
    for n in (4, 12):
        docs = documents(spark, rows).repartition(n)
        by.append(sorted((str(r.doc_id), round(r.base_score, 6), round(r.score, 2)) for r in lm.score(docs, shard_tokens=3000).collect()))
    assert [x[:2] for x in by[0]] == [x[:2] for x in by[1]]
    assert all(abs(x[2] - y[2]) <= 1e-5 * abs(x[2]) + 0.02 for x, y in zip(*by))


def test_a_held_out_filter_in_spark_is_that_in_python(spark):
    ids = [None, *range(200), -5]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("h", F.expr(lm.HELD_OUT)).collect()
    assert [(r.doc_id, r.h) for r in got] == [(i, lm.held_out(i)) for i in ids]


def test_vocabulary_grows_with_the_corpus():
    sizes = [lm.vocabulary_size(10**k) for k in range(5, 14)]
    assert sizes == sorted(sizes) and sizes[-1] > 200_000 and sizes[0] == lm.LEAST_VOCABULARY


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40 + lm.SHAPES, 9).astype(np.int32) for _ in range(3)]

    def loss(flat):
        return -float(lm.score_docs(lm.Model(40, 6, 16, flat.astype(np.float32)), docs, 2).sum())

    m = lm.Model(40, 6, 16)
    m.flat[:] = rng.normal(0, 0.3, len(m.flat))
    t = lm.Trainer(m, window=100, n_lanes=2)
    _, (ids, emb), n = t.gradient(*next(lm.windows(docs, 2, 100, m)))
    assert n == sum(map(len, docs))
    t.grad.p["emb"][ids] = emb
    before = m.flat.copy()
    for i in rng.choice(len(m.flat), 120, replace=False):
        e = np.zeros(len(before))
        e[i] = 1e-2
        d = (loss(before + e) - loss(before - e)) / 2e-2
        assert abs(d - t.grad.flat[i]) < 0.02 + 0.03 * abs(d), i


def test_large_weights_overflow_nothing():
    m = lm.Model(40, 6, 16)
    m.flat[:] = np.random.default_rng(1).normal(0, 60, len(m.flat))
    docs = [np.arange(44, dtype=np.int32)]
    assert np.isfinite(lm.score_docs(m, docs)).all()


def test_probabilities_of_all_next_tokens_sum_to_one():
    m = lm.Model(40, 6, 16)
    m.flat[:] = np.random.default_rng(1).normal(0, 0.5, len(m.flat))
    m.p["word"][2, -1, 8:] = -1e4
    h = np.random.default_rng(2).normal(0, 1, (1, 6)).astype(np.float32)
    every = np.arange(40 + lm.SHAPES)
    lp, _ = m.output(np.repeat(h, len(every), 0), every)
    assert abs(np.exp(lp).sum() - 1) < 1e-4


def test_score_is_the_same_in_any_lanes():
    m = lm.Model(40, 6, 16)
    m.flat[:] = np.random.default_rng(1).normal(0, 0.5, len(m.flat))
    docs = [np.random.default_rng(i).integers(0, 44, 3 + 40 * i).astype(np.int32) for i in range(6)]
    assert np.allclose(lm.score_docs(m, docs, 1, 7), lm.score_docs(m, docs, 4, 64), atol=1e-3)


def test_language_model_empty(spark):
    assert lm.score(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- archives

PAGES = [(5, "http://a/", "x" * 200), (3, "http://b/ü\r\n", "x" * 200), (9, None, "x" * 200), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "é" * 50), (8, "u", "é" * 50), (11, "u", "y" * 100), (10, "u", "y" * 100), (12, "u", "z" * 99), (13, "u", "z" * 99), (None, "u", "x" * 200), (3, "again", "x" * 200), (20, "u", "<html>" * 100_000)]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 0, 1) for r in rows], "page_id long, url string, html string, digest int, first int")


@pytest.mark.parametrize("most", [warc.MOST, 0])
def test_archives_round_trip(spark, tmp_path, most):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(table(spark).repartition(3), folder, most=most, archive_bytes=500)
    got = warc.read_archives(manifest, folder).collect()
    first = {}
    for i, _, html in PAGES:
        b = (html or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    want = Counter()
    for i, _, html in PAGES:
        b = (html or "").encode()
        revisit = b in first and i != first[b]
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert manifest.count() >= (3 if most else 1)


def test_archives_empty(spark, tmp_path):
    manifest = warc.write_archives(table(spark, []), str(tmp_path / "none"))
    assert manifest.count() == 0 and warc.read_archives(manifest, str(tmp_path / "none")).count() == 0


def archive(tmp_path, records):
    a = warc.Archive(fs.LocalFileSystem(), str(tmp_path / "a.warc.zst"))
    for r in records:
        a.add(r)
    a.close()
    return tmp_path / "a.warc.zst"


def good(i=1, payload=b"hello"):
    return warc.record(i, "http://x/", payload, hashlib.sha256(payload).hexdigest(), None)


def test_faults_are_found(tmp_path):
    read = lambda p: list(warc.read_archive(fs.LocalFileSystem(), str(p)))
    path = archive(tmp_path, [good(i) for i in range(20)])
    assert [warc.page_of(r["headers"]["warc-record-id"]) for r in read(path)] == list(range(20))
    data = path.read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    path.write_bytes(data[:-3])
    with pytest.raises(warc.WarcError, match="cut short"):
        read(path)
    bad = {"Content-Length": good().replace(b"Content-Length: ", b"Content-Length: 1", 1), "version": b"WARK" + good()[4:], "missing": good().replace(b"WARC-Date", b"X-Date"), "digest": good().replace(b"hello", b"hallo")}
    for what, r in bad.items():
        with pytest.raises(warc.WarcError, match=what):
            read(archive(tmp_path, [good(), r]))


def test_plain_dictionary_and_no_dictionary(tmp_path):
    d = b"some common content " * 20
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    p = tmp_path / "b.warc.zst"
    p.write_bytes(warc.struct.pack("<II", warc.MAGIC, len(d)) + d + c.compress(good(4)))
    assert len(list(warc.read_archive(fs.LocalFileSystem(), str(p)))) == 1
    p.write_bytes(zstandard.ZstdCompressor().compress(good(4)) * 2)
    assert len(list(warc.read_archive(fs.LocalFileSystem(), str(p)))) == 2
