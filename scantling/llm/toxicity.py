"""Toxicity of texts by a factorization machine over hashed terms.

A *term* is a word, lower-cased in A-Z, without punctuation at its ends, hashed to one of
``2 ** BITS`` buckets; a text's features are the buckets that occur in it. The score is the logistic
function of ``b + sum w_i + sum_{i<j} <v_i, v_j>``: the products of factors are what a pair of terms
(an insult and a group, say) means beyond what each means alone.

Fitting: document frequencies by label are counted over all labelled training texts, each task
adding up arrays of all buckets. Buckets whose frequency differs between the labels (``SURE``
standard errors, in ``LEAST`` texts or more) are features; weights and factors are fitted by
minibatches (logistic loss, AdaGrad) on at most about ``ROWS`` labelled texts of each label, drawn
by hash and weighted to restore the labels' shares. A quarter of the training texts
(``crc32 % 5 = 1``) first stays apart: where a machine fitted on the others divides it best (F1), is
moved to the score 0.5; then the machine is fitted on all of them.

Edge cases: null, empty and blank texts have no terms and get the score of none; a null id counts
as the empty string; labels without id or mark are ignored; of several labels of an id the majority
holds (ties: 1), repeated rows are texts of their own. If all labels are 1, all scores are (about)
1; if all are 0, or there are none, 0. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Grid, documents, hash_of, in_small_batches, over_batches, stored

BITS, SURE, LEAST = 18, 3.0, 3
#: Labelled texts of each label that weights are fitted on, about.
ROWS = 20_000
FACTORS, EPOCHS, BATCH, RATE, RIDGE = 8, 12, 128, 0.05, 1e-4
FOLDS, HELD, APART, SEED = 5, 0, 1, 29
#: The margin of what all labels agree on.
SURELY = 30.0

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Punctuation taken off each end of a word, at most.
STRIPPED = 16


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


# ---------------------------------------------------------------- features


def terms(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of every text, one text after the other, and where each text's begin (and the end)."""
    g = Grid(col)
    starts, ends = g.starts.copy(), g.ends.copy()
    for _ in range(STRIPPED):
        more = starts < ends
        more[more] = PUNCTUATION[g.buf[starts[more]]]
        starts[more] += 1
        if not more.any():
            break
    for _ in range(STRIPPED):
        more = starts < ends
        more[more] = PUNCTUATION[g.buf[ends[more] - 1]]
        ends[more] -= 1
        if not more.any():
            break
    real = starts < ends
    own = np.repeat(np.arange(len(g)), np.diff(g.first))[real]
    bucket = g.hashes(True, starts[real], ends[real]) >> np.uint64(64 - bits)
    both = np.unique(own.astype(np.uint64) << np.uint64(bits) | bucket)
    first = np.searchsorted(both, np.arange(len(g) + 1, dtype=np.uint64) << np.uint64(bits))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int32), first


FEATURES = pa.schema([("doc_id", pa.int64()), ("terms", pa.list_(pa.int32()))])


def featured(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, terms`` of every row."""

    def make():
        def f(batch):
            values, first = terms(batch.column(1), bits)
            return {"doc_id": batch.column(0), "terms": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))}

        return f

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(over_batches(make, FEATURES, 512, "text"), "doc_id long, terms array<int>")


def lists(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row's begin (and the end), from 0."""
    offsets = np.asarray(col.offsets).astype(np.int64)
    return np.asarray(col.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def labelled(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, terms, y, apart`` of the training texts."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    known = known.filter(fold() != HELD).hint("merge")  # a side that grows with the corpus isn't broadcast, however few its rows
    return featured(docs, bits).join(known, "doc_id").withColumn("apart", fold() == APART)


def frequencies(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``bucket, n, n1, m, m1``: texts with a term, those labelled 1; the same of the texts that stay apart."""

    def run(batches):
        total = np.zeros((4, 1 << bits), np.int64)
        for batch in batches:
            values, first = lists(batch.column(0))
            own = np.repeat(np.arange(batch.num_rows), np.diff(first))
            y, apart = (np.asarray(batch.column(k)).astype(bool)[own] for k in (1, 2))
            for k, pick in enumerate((slice(None), y, apart, y & apart)):
                total[k] += np.bincount(values[pick], minlength=1 << bits)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in total)], ["bucket", "n", "n1", "m", "m1"])

    own = rows.select("terms", "y", F.col("apart").cast("int").alias("apart")).mapInArrow(run, "bucket int, n long, n1 long, m long, m1 long")
    return own.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "m", "m1")])


def deviation(n: Column, n1: Column, rows: int, ones: int) -> Column:
    """Standard errors between a bucket's count of label 1 and what its frequency lets expect; 0 for rare ones."""
    if not 0 < ones < rows:
        return F.lit(0.0)
    share = ones / rows
    variance = n * (share * (1 - share)) * (1 - n / rows)
    return F.when((n >= LEAST) & (variance > 0), (n1 - n * share) / F.sqrt(F.greatest(variance, F.lit(1e-9)))).otherwise(0.0)


# ---------------------------------------------------------------- the machine


@dataclass
class Machine:
    """Weights and factors of the buckets that are features; ``bias``; bits of a bucket."""

    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float
    bits: int = BITS

    def __post_init__(self):
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.place[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)

    def margins(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of texts whose buckets are given as by ``terms``."""
        at = self.place[values]
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))[at >= 0]
        at = at[at >= 0]
        return self.bias + added(own, len(first) - 1, self.weights[at], self.factors[at])[0]

    def scores(self, col: pa.Array) -> np.ndarray:
        return logistic(self.margins(*terms(col, self.bits)))

    def interaction(self, a: str, b: str) -> float:
        """What two words together add to a margin beyond what each adds alone; 0 if one isn't a feature."""
        i, j = (int(self.place[h >> np.uint64(64 - self.bits)]) for h in hash_of([a.encode(), b.encode()]))
        return float(self.factors[i] @ self.factors[j]) if i >= 0 and j >= 0 and i != j else 0.0


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def added(own: np.ndarray, n: int, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins without bias, and sums of factors, of ``n`` texts; ``own``: the text of each term, ascending."""
    z, s = np.zeros(n), np.zeros((n, v.shape[1]))
    if len(own):
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        at = own[start]
        s[at] = np.add.reduceat(v, start)
        z[at] = np.add.reduceat(w, start) + 0.5 * ((s[at] ** 2).sum(1) - np.add.reduceat((v * v).sum(1), start))
    return z, s


def fitted(values: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, n_terms: int, factors: int = FACTORS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and bias on rows of term numbers below ``n_terms``."""
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, factors))
    share = float((weight * y).sum() / weight.sum())
    b = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(n_terms, 1e-2), np.full((n_terms, factors), 1e-2), 1e-2
    size, weight = np.diff(first), weight / weight.mean()
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            i = order[k : k + BATCH]
            own = np.repeat(np.arange(len(i)), size[i])
            at = np.arange(len(own)) - np.repeat(np.cumsum(size[i]) - size[i], size[i]) + np.repeat(first[i], size[i])
            u, x = np.unique(values[at], return_inverse=True)
            vx = v[u][x]
            z, s = added(own, len(i), w[u][x], vx)
            error = (logistic(b + z) - y[i]) * weight[i] / len(i)
            dw = np.bincount(x, error[own], len(u)) + RIDGE * w[u]
            pull = error[own, None] * (s[own] - vx)
            dv = np.stack([np.bincount(x, pull[:, j], len(u)) for j in range(factors)], 1) + RIDGE * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= RATE * dv / np.sqrt(gv[u])
            gb += error.sum() ** 2
            b -= RATE * error.sum() / gb**0.5
    return w, v, b


def divide(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The margin at which F1 is highest, in the middle between its neighbours; 0 without both labels."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    ones = (weight * y).sum()
    if not 0 < ones < weight.sum():
        return 0.0
    cut = np.flatnonzero(np.r_[z[1:] != z[:-1], True])
    hit, all_ = np.cumsum(weight * y)[cut], np.cumsum(weight)[cut]
    k = int(np.argmax(2 * hit / (all_ + ones)))
    return float((z[cut[k]] + z[cut[k] + 1]) / 2) if cut[k] + 1 < len(z) else float(z[cut[k]])


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, rows: int = ROWS, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """A machine from the labelled training texts; ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    train = stored(labelled(docs, labels, bits))
    count = {(r["y"], r["apart"]): r["n"] for r in train.groupBy("y", "apart").agg(F.count("*").alias("n")).collect()}
    by = [sum(n for (y, _), n in count.items() if y == k) for k in (0, 1)]
    if not min(by):
        return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, factors)), SURELY if by[1] else -SURELY, bits)
    held = [count.get((k, True), 0) for k in (0, 1)]
    n, n1, m, m1 = (F.col(c) for c in ("n", "n1", "m", "m1"))
    kept = frequencies(train, bits).select("bucket", (F.abs(deviation(n, n1, sum(by), by[1])) >= SURE).alias("whole"), (F.abs(deviation(n - m, n1 - m1, sum(by) - sum(held), by[1] - held[1])) >= SURE).alias("part"))
    kept = kept.filter("whole or part").orderBy("bucket").collect()  # at most 2 ** bits small rows
    buckets = np.array([r["bucket"] for r in kept], np.int64)
    whole, part = (np.array([r[c] for r in kept], bool) for c in ("whole", "part"))
    share = [min(1.0, rows / x) for x in by]
    chance = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 32)) / float(1 << 32)
    sample = train.withColumn("u", chance).filter(F.col("u") < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    sent = docs.sparkSession.sparkContext.broadcast(buckets)
    compact = pa.schema([("u", pa.float64()), ("doc_id", pa.int64()), ("y", pa.int32()), ("apart", pa.bool_()), ("terms", pa.list_(pa.int32()))])

    def make():
        place = Machine(sent.value, np.empty(0), np.empty((0, 1)), 0.0, bits).place

        def f(batch):
            values, first = lists(batch.column(4))
            at = place[values]
            ends = np.r_[0, np.cumsum(at >= 0)][first]
            return {"terms": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[at >= 0]))} | {k: batch.column(i) for i, k in enumerate(("u", "doc_id", "y", "apart"))}

        return f

    def learn(batches):
        t = pa.Table.from_batches(list(batches), compact)
        t = t.sort_by([("u", "ascending"), ("doc_id", "ascending"), ("y", "ascending")]) if t.num_rows else t
        values, first = lists(t.column("terms").combine_chunks())
        y, apart = (t.column(c).to_numpy().astype(float if c == "y" else bool) for c in ("y", "apart"))
        weight = np.where(y == 1, 1 / share[1], 1 / share[0])

        def of(rows_: np.ndarray, use: np.ndarray):
            """The rows of a mask, with the features of a mask."""
            ok = use[values] & np.repeat(rows_, np.diff(first))
            ends = np.r_[0, np.cumsum(ok)][first]
            return values[ok], np.r_[0, np.cumsum(np.diff(ends)[rows_])], y[rows_], weight[rows_]

        move = 0.0
        rest, own = of(~apart, part), of(apart, part)
        if 0 < rest[2].sum() < len(rest[2]) and len(own[2]):
            w, v, b = fitted(*rest, len(part), factors, epochs)
            text = np.repeat(np.arange(len(own[2])), np.diff(own[1]))
            move = divide(b + added(text, len(own[2]), w[own[0]], v[own[0]])[0], own[2], own[3])
        everything = of(np.ones(len(y), bool), whole)
        w, v, b = fitted(*everything, len(whole), factors, epochs)
        if b < 0:
            move = max(move, b / 2)  # a text without terms stays on its side
        at = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[b - move, w[at]]), pa.array([[0.0] * factors, *v[at].tolist()], pa.list_(pa.float64()))], ["place", "w", "v"])

    one = sample.select("u", "doc_id", "y", "apart", "terms").mapInArrow(over_batches(make, compact, 4096), "u double, doc_id long, y int, apart boolean, terms array<int>").repartition(1)
    got = one.mapInArrow(learn, "place int, w double, v array<double>").orderBy("place").collect()  # a row for each feature
    sent.unpersist()
    at = np.array([r["place"] for r in got[1:]], np.int64)
    return Machine(buckets[at], np.array([r["w"] for r in got[1:]]), np.array([r["v"] for r in got[1:]]).reshape(-1, factors), got[0]["w"], bits)


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = shared.value
        return lambda batch: {"doc_id": batch.column(0), "score": m.scores(batch.column(1))}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(over_batches(make, SCORED, 512, "text"), "doc_id long, score double")


@in_small_batches
def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, by a machine fitted on the labelled rows of other folds."""
    out = scored(docs, fit(docs, labels, **options))
    return out.select("doc_id", (fold() == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
