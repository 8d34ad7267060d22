"""Document log-likelihood by a gated recurrent language model in numpy.

Counts. Training tokens are counted by word key (a 61-bit hash and the word's shape), in the tasks
first. The most frequent words go to the tasks as a table of at most ``TABLE_WORDS`` entries
(counted before); words whose count it can't tell are joined to the counts by key.

Model. Input is the previous token: a word of the vocabulary, or one of ``SHAPES`` classes of the
other words (by length and script). The vocabulary grows with the corpus: ``GROWTH`` times the cube
root of the training tokens (2,200 words for ten million tokens, 22,000 for ten billion). A gated
recurrent unit carries the state along the whole document; its recurrence is by unit (the gate sees
the token and the unit's own state), so a step costs no matrix product. The output softmax is
factored: first a class, then the word within it. Words form classes of about the vocabulary's
square root by rank; each shape is a class, in which a word's probability is its smoothed share of
the training counts. The output starts at the corpus's own frequencies, so the untrained model is
the unigram model.

Training. Every training document belongs to one round and one shard, by hash; a shard has about
``SHARD_TOKENS`` tokens, whatever the size of the corpus. In a round each shard continues the shared
model on its documents, in the order of their keys, over windows of ``WINDOW`` tokens with the state
carried across windows and gradients cut at their borders (truncated backpropagation through time).
Then the shards' changes are averaged, as integers, so neither partitions nor their order matter,
and more shards mean a better mean of equally long training, not shorter training. Scoring carries
the state across windows too, through complete documents.

Texts are tokenized twice (counts, ids); training and scoring read the stored ids.

Edge cases: null and blank texts are the end token alone; a null id is in training (its text form
is empty); repeated rows are scored each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from heapq import heapreplace
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Grid, cut, documents, over_batches, stored

TABLE_WORDS, LEAST_VOCABULARY, GROWTH = 3_000_000, 1024, 10
SHAPES, HIDDEN = 8, 24
SHARD_TOKENS, UPDATES, WINDOW, TRAIN_LANES, SCORE_LANES, ROUNDS, RATE = 2_000_000, 240, 32, 256, 512, 3, 0.3
#: Texts that a task scores at a time: rows, and bytes of ids.
CHUNK_ROWS, CHUNK_BYTES = 4096, 2 << 20
#: Parameters of a block in transport, and the units in which changes are summed.
BLOCK, UNIT = 1 << 14, 2.0**-24
LN10 = float(np.log(10))
SHAPE_BITS = np.uint64(7)
END = np.uint64(xxhash.xxh3_64_intdigest(b"\0end of text")) & ~SHAPE_BITS


def held_out(doc_id) -> bool:
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


#: The same of the column ``doc_id``, in Spark.
HELD_OUT = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 = 1"


def shapes(grid: Grid) -> np.ndarray:
    """A word's class by length and script, from its bytes alone."""
    size = grid.ends - grid.starts
    high = np.concatenate(([0], np.cumsum(grid.buf >= 128)))
    return (np.searchsorted([5, 8, 12], size, "right") + 4 * (high[grid.ends] > high[grid.starts])).astype(np.uint64)


def word_keys(grid: Grid) -> np.ndarray:
    """Per word: its hash, with the shape in the lowest three bits."""
    return (grid.hashes() & ~SHAPE_BITS) | shapes(grid)


def vocabulary_size(tokens: int) -> int:
    return max(LEAST_VOCABULARY, round(GROWTH * tokens ** (1 / 3)))


# ---------------------------------------------------------------- counts

COUNTED = pa.schema([("hash", pa.int64()), ("n", pa.int64())])


def counter(most: int = 1_500_000, rows: int = 1024):
    """Per task: counts of the tokens of a column of texts, merged until ``most`` entries."""

    def run(batches):
        kept: list[pa.Table] = []
        docs = 0

        def merged() -> pa.Table:
            t = pa.concat_tables(kept).group_by("hash", use_threads=False).aggregate([("n", "sum")])
            return pa.table([t.column("hash"), t.column("n_sum")], schema=COUNTED)

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                col = batch.column(0).slice(at, rows)
                docs += len(col)
                got = pa.array(word_keys(Grid(col)).view(np.int64)).value_counts()
                kept.append(pa.table([got.field(0), got.field(1)], schema=COUNTED))
                if len(kept) > 16:
                    kept[:] = [merged()]
                    if len(kept[0]) > most:
                        yield from kept[0].combine_chunks().to_batches()
                        kept.clear()
        if docs:
            kept.append(pa.table([pa.array([END.astype(np.int64)]), pa.array([docs], pa.int64())], schema=COUNTED))
            yield from merged().combine_chunks().to_batches()

    return run


class Table:
    """Counts of the most frequent words, and what the model must know of all others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, least: int, tokens: int, words: int, vocabulary: int):
        order = np.argsort(hashes)
        self.hash, self.count, self.least, self.tokens, self.words = hashes[order], counts[order], least, tokens, words
        top = np.lexsort((self.hash, -self.count))[:vocabulary]
        self.size = len(top)
        self.rank = np.full(len(order), -1, np.int32)
        self.rank[top] = np.arange(self.size)
        self.freq, self.shape = self.count[top].astype(float), (self.hash[top] & SHAPE_BITS).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of every hash in the table, -1 if it isn't there."""
        if not len(self.hash) or not len(h):
            return np.full(len(h), -1)
        coded = pa.array(h).dictionary_encode()  # words repeat: each is looked up once
        u = coded.dictionary.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.hash, u), len(self.hash) - 1)
        return np.where(self.hash[at] == u, at, -1)[coded.indices.to_numpy(zero_copy_only=False)]

    def ids(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The model's token ids of words, given their places in the table."""
        rank = self.rank[at] if len(self.rank) else at
        return np.where((at >= 0) & (rank >= 0), rank, self.size + (h & SHAPE_BITS).astype(np.int32)).astype(np.int32)


def count_tokens(docs: DataFrame, vocabulary: int | None = None, most: int = TABLE_WORDS) -> tuple[DataFrame, Table, np.ndarray]:
    """(hash and count of all training words, the table, per shape: tokens and words outside the vocabulary)."""
    counts = cut(docs.filter(f"not ({HELD_OUT})").select("text").mapInArrow(counter(), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    # how many words have each count, up to a bound; gives the least count that fits the table
    sizes = {r["n"]: r["words"] for r in counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("words")).collect()}
    least, held = 100_000, 0
    for n in sorted(sizes, reverse=True):
        if held + sizes[n] > most:
            break
        held, least = held + sizes[n], n
    else:
        least = 1  # all words are there
    by_shape = counts.groupBy(F.col("hash").bitwiseAND(F.lit(7).cast("long")).alias("shape")).agg(F.sum("n").alias("n"), F.count("*").alias("w")).collect()
    tokens, words = sum(r["n"] for r in by_shape), sum(r["w"] for r in by_shape)
    top = counts.filter((F.col("n") >= least) | (F.col("hash") == int(END.astype(np.int64)))).toArrow()
    hashes, n = (top.column(c).to_numpy() for c in ("hash", "n"))
    table = Table(hashes.view(np.uint64), n, least, tokens, words, vocabulary or vocabulary_size(tokens))
    rest = np.zeros((SHAPES, 2))
    for r in by_shape:
        rest[r["shape"]] = r["n"], r["w"]
    np.subtract.at(rest[:, 0], table.shape, table.freq)
    np.subtract.at(rest[:, 1], table.shape, 1)
    return counts, table, rest


# ---------------------------------------------------------------- the model


def exponentials(x: np.ndarray, own: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each row's ``own`` column, sums of the rows) after x became exponentials in place.

    ``plain``: no value of x is too large for that; else each row is shifted by its maximum.
    """
    rows = np.arange(len(x))
    if not plain:
        x -= x.max(axis=1, keepdims=True)
    mine = x[rows, own]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    return mine - np.log(total), total


def bounded(w: np.ndarray, limit: float = 60.0) -> np.ndarray:
    """Whether all products of states (-1 to 1, and a last 1 for the bias) with each matrix stay in range."""
    reach, bias = np.abs(w[..., :-1, :]).sum(axis=-2), w[..., -1, :]
    return ((bias + reach).max(axis=-1) < limit) & ((bias - reach).max(axis=-1) > -limit)


class Model:
    """Gated recurrent unit with class-factored softmax; parameters are one flat vector (biases: the last rows)."""

    def __init__(self, vocabulary: int, hidden: int = HIDDEN, per_class: int | None = None, flat: np.ndarray | None = None):
        self.v, self.h, self.k = vocabulary, hidden, per_class or max(1, ceil(vocabulary**0.5))
        self.word_classes = -(-vocabulary // self.k)
        self.classes = self.word_classes + SHAPES
        shapes_ = {"emb": (vocabulary + SHAPES + 1, 2 * hidden), "rec": (hidden,), "cls": (hidden + 1, self.classes), "word": (self.word_classes, hidden + 1, self.k)}
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes_.values()), np.float32) if flat is None else flat
        self.p, self.spans, at = {}, {}, 0
        for name, s in shapes_.items():
            n = int(np.prod(s))
            self.p[name], self.spans[name] = self.flat[at : at + n].reshape(s), slice(at, at + n)
            at += n

    @classmethod
    def fresh(cls, freq: np.ndarray, rest: np.ndarray, seed: int = 5) -> Model:
        """Small random weights; output biases at the logarithms of the training frequencies."""
        m, rng = cls(len(freq)), np.random.default_rng(seed)
        m.p["emb"][:, : m.h] = rng.normal(0, 0.5, m.p["emb"][:, : m.h].shape) + np.linspace(-1.5, 1.5, m.h)  # units of short and of long memory
        m.p["emb"][:, m.h :] = rng.normal(0, 0.5, m.p["emb"][:, m.h :].shape)
        padded = np.zeros(m.word_classes * m.k)
        padded[: len(freq)] = freq
        by = padded.reshape(m.word_classes, m.k)
        of_class = np.r_[by.sum(axis=1), rest[:, 0]] + 0.5
        m.p["cls"][-1] = np.log(of_class / of_class.sum())
        m.p["word"][:, -1] = np.where(by > 0, np.log(np.maximum(by, 0.5) / np.maximum(by.sum(axis=1, keepdims=True), 0.5)), -1e4)
        return m

    def run(self, gate: np.ndarray, cand: np.ndarray, h: np.ndarray, first: np.ndarray, trail: list | None = None) -> np.ndarray:
        """States after every step, from the gates' inputs and the candidates of all steps; ``first`` 0 empties a lane."""
        states, rec = np.empty_like(cand), self.p["rec"]
        for t in range(len(cand)):
            if not first[t].all():
                h = h * first[t][:, None]
            z = rec * h
            z += gate[t]
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            new = np.subtract(cand[t], h, out=states[t])
            new *= z
            new += h
            if trail is not None:
                trail.append((h, z))
            h = new
        return states

    def output(self, h: np.ndarray, token: np.ndarray, grad: Model | None = None, block: int = 2048):
        """Natural log probability of each token id after state h; with ``grad``: also d/dh, and adds to it."""
        n = self.h
        h1 = np.ones((len(h), n + 1), np.float32)
        h1[:, :n] = h
        k = np.where(token < self.v, token // self.k, self.word_classes + token - self.v)
        lp, dh = np.empty(len(k), np.float32), None if grad is None else np.empty((len(k), n), np.float32)

        def part(x_of, w, own, plain, g):
            x = x_of @ w
            got, total = exponentials(x, own, plain)
            if g is None:
                return got, None
            x[np.arange(len(own)), own] -= total  # times 1 / total: the derivative
            share = (1 / total)[:, None]
            g += (x_of * share).T @ x
            back = x @ w[:n].T
            back *= share
            return got, back

        plain, g = bool(bounded(self.p["cls"])), None if grad is None else grad.p["cls"]
        for at in range(0, len(k), block):  # blocks that stay in the processor's cache
            to = at + block
            lp[at:to], back = part(h1[at:to], self.p["cls"], k[at:to], plain, g)
            if grad is not None:
                dh[at:to] = back
        words = np.flatnonzero(token < self.v)
        if not len(words):
            return lp, dh
        order = words[np.argsort(k[words], kind="stable")]
        x_of, own, plain = h1[order], token[order] % self.k, bounded(self.p["word"])
        cuts = np.flatnonzero(np.diff(k[order])) + 1
        got, back = np.empty(len(order), np.float32), np.empty((len(order), n), np.float32)
        for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(order)].tolist()):
            c = int(k[order[lo]])
            got[lo:hi], b = part(x_of[lo:hi], self.p["word"][c], own[lo:hi], plain[c], None if grad is None else grad.p["word"][c])
            if b is not None:
                back[lo:hi] = b
        lp[order] += got
        if grad is not None:
            dh[order] += back
        return lp, dh


def lanes(sizes: list[int], n: int) -> list[list[int]]:
    """Documents dealt to ``n`` lanes of about equal length: per lane the documents' numbers."""
    deal, load = [[] for _ in range(n)], [(0, k) for k in range(n)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, k = load[0]
        deal[k].append(i)
        heapreplace(load, (size + sizes[i], k))
    return [x for x in deal if x]


def grids(docs: list[np.ndarray], n: int, start: int):
    """Lanes as matrices: token, previous token, document number (-1: none) and whether a document starts (0)."""
    sizes = [len(x) for x in docs]
    deal = lanes(sizes, max(1, min(n, 3 * sum(sizes) // max(sizes))))  # the matrix has at most about three cells a token
    steps = max(sum(sizes[i] for i in x) for x in deal)
    token, prev, owner = np.zeros((steps, len(deal)), np.int32), np.full((steps, len(deal)), start, np.int32), np.full((steps, len(deal)), -1, np.int32)
    first = np.ones((steps, len(deal)), np.float32)
    for k, own in enumerate(deal):
        at = 0
        for i in own:
            m = sizes[i]
            token[at : at + m, k], owner[at : at + m, k] = docs[i], i
            prev[at + 1 : at + m, k] = docs[i][:-1]
            first[at, k] = 0
            at += m
    return token, prev, owner, first


def windows(docs: list[np.ndarray], n_lanes: int, size: int, model: Model):
    """(token, previous, owner, first, states before) window by window; ``send`` the states after it."""
    token, prev, owner, first = grids(docs, n_lanes, model.v + SHAPES)
    h = np.zeros((token.shape[1], model.h), np.float32)
    for at in range(0, len(token), size):
        to = min(at + size, len(token))
        live = owner[at] >= 0  # a lane's documents follow without gaps
        if not live.all():
            keep = np.flatnonzero(live)
            token, prev, owner, first, h = token[:, keep], prev[:, keep], owner[:, keep], first[:, keep], h[keep]
        h = yield token[at:to], prev[at:to], owner[at:to], first[at:to], h


def score_docs(model: Model, docs: list[np.ndarray], n_lanes: int = SCORE_LANES, window: int = 64) -> np.ndarray:
    """Natural log probability of every document's token ids, each by one pass with carried state."""
    total = np.zeros(len(docs))
    gates, cands = model.p["emb"][:, : model.h], np.tanh(model.p["emb"][:, model.h :])
    pieces = windows(docs, n_lanes, window, model)
    piece = next(pieces, None)
    while piece is not None:
        token, prev, owner, first, h = piece
        states = model.run(gates[prev], cands[prev], h, first)
        real = owner.ravel() >= 0
        lp, _ = model.output(states.reshape(-1, model.h)[real], token.ravel()[real])
        total += np.bincount(owner.ravel()[real], lp, minlength=len(docs))
        try:
            piece = pieces.send(states[-1])
        except StopIteration:
            piece = None
    return total


class Trainer:
    """Truncated backpropagation over windows with carried state; Adagrad."""

    def __init__(self, model: Model, rate: float = RATE, window: int = WINDOW, n_lanes: int = TRAIN_LANES, updates: int = UPDATES):
        self.m, self.rate, self.window, self.n_lanes, self.updates = model, rate, window, n_lanes, updates
        self.square = Model(model.v, model.h, model.k, np.full(len(model.flat), 1e-3, np.float32))
        self.grad = Model(model.v, model.h, model.k)

    def learn(self, docs: list[np.ndarray]) -> None:
        """One pass, in about ``updates`` steps or more: small sets get fewer lanes."""
        n = max(4, min(self.n_lanes, sum(map(len, docs)) // (self.window * self.updates)))
        pieces = windows(docs, n, self.window, self.m)
        piece = next(pieces, None)
        while piece is not None:
            after, ids, k = self.gradient(*piece)
            self.update(ids, k)
            try:
                piece = pieces.send(after)
            except StopIteration:
                piece = None

    def gradient(self, token, prev, owner, first, h):
        """A window's gradient in ``grad`` (embeddings apart): states after it, embedding rows met and their gradients, tokens."""
        m, g, n = self.m, self.grad, self.m.h
        g.flat[m.spans["rec"].start :] = 0
        x, trail = m.p["emb"][prev], []
        cand = np.tanh(x[..., n:])
        states = m.run(x[..., :n], cand, h, first, trail)
        real = np.flatnonzero(owner.ravel() >= 0)
        _, part = m.output(states.reshape(-1, n)[real], token.ravel()[real], g)
        dh = np.zeros((owner.size, n), np.float32)
        dh[real] = part
        dh = dh.reshape(cand.shape)
        carry, rec = np.zeros(dh.shape[1:], np.float32), m.p["rec"]
        for t in range(len(cand) - 1, -1, -1):
            before, z = trail[t]
            d = dh[t]
            d += carry
            pre = np.subtract(cand[t], before, out=x[t, :, :n])
            pre *= d
            pre *= z
            stay = 1 - z
            pre *= stay
            stay *= d
            g.p["rec"] += np.einsum("ij,ij->j", pre, before)
            carry = pre * rec
            carry += stay
            if not first[t].all():
                carry *= first[t][:, None]
            d *= z
        cand *= cand
        np.subtract(1, cand, out=cand)
        np.multiply(dh, cand, out=x[..., n:])
        order = np.argsort(prev.ravel(), kind="stable")
        ids, begin = np.unique(prev.ravel()[order], return_index=True)
        return states[-1], (ids, np.add.reduceat(x.reshape(-1, 2 * n)[order], begin, axis=0)), len(real)

    def update(self, rows: tuple[np.ndarray, np.ndarray], tokens: int) -> None:
        ids, emb = rows
        rest = slice(self.m.spans["rec"].start, None)
        dense, scale = self.grad.flat[rest], 1 / (max(1, tokens) ** 0.5 * 8)
        norm = scale * float(dense @ dense + np.vdot(emb, emb)) ** 0.5
        scale *= min(1.0, 5 / norm) if norm > 0 else 1.0
        for p, square, g in ((self.m.p["emb"], self.square.p["emb"], emb), (self.m.flat, self.square.flat, dense)):
            at = ids if p.ndim == 2 else rest
            g = g * np.float32(scale)
            new = square[at] + g * g
            square[at] = new
            np.sqrt(new, out=new)
            g /= new
            g *= self.rate
            p[at] -= g


# ---------------------------------------------------------------- over tables


def with_end(ids: np.ndarray, end: int) -> np.ndarray:
    return np.append(ids, np.int32(end))


def doc_key(doc_id, text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(f"{doc_id} ".encode() + text)).astype(np.int64))


def packed(ids: np.ndarray, size: int) -> bytes:
    return ids.astype("<u2" if size + SHAPES < 1 << 16 else "<u4").tobytes()


def unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if size + SHAPES < 1 << 16 else "<u4").astype(np.int32)


READ = pa.schema(
    [("doc", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("outside", pa.float64())]
    + [("ids", pa.binary()), ("open", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
READ_DDL = "doc long, doc_id long, held_out boolean, n_tokens long, known long, base double, outside double, ids binary, open array<long>, times array<long>"


def reader(shared, rest: np.ndarray):
    """Per text: ids, the part of both scores that the table settles, and the words (with counts) that it doesn't."""

    def make():
        t = shared.value
        logs = np.log10(np.append(t.count, 0) + 0.5)  # the last place: count 0
        bottom = np.log10(rest[:, 0] + 0.5 * (rest[:, 1] + 1))  # of a shape's smoothed shares
        base_bottom = float(np.log10(t.tokens + 0.5 * (t.words + 1)))
        end_at = int(t.find(np.array([END]))[0])
        end = int(t.ids(np.array([END]), np.array([end_at]))[0])
        end_out = 0.0 if end < t.size else logs[end_at] - bottom[end - t.size]

        def f(batch):
            grid = Grid(batch.column(1))
            h = word_keys(grid)
            at = t.find(h)
            ids, value, miss = t.ids(h, at), logs[at], at < 0
            out = {k: [] for k in READ.names}
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                a, b = grid.first[i], grid.first[i + 1]
                held, own, v, lost = held_out(doc_id), ids[a:b], value[a:b], miss[a:b]
                known = len(own)
                words, n = (), ()
                if t.least > 1 and lost.any():
                    v = v.copy()
                    if held or t.least > 2:  # the counts must tell
                        v[lost] = 0
                        words, n = np.unique(h[a:b][lost].view(np.int64), return_counts=True)
                        known -= int(lost.sum())
                    else:  # a training word outside the table is the only one of its kind
                        v[lost] = logs_of_one
                elif t.least <= 1:
                    known -= int(lost.sum())
                other = own >= t.size
                outside = v[other].sum() - bottom[own[other] - t.size].sum() + end_out
                row = (doc_key(doc_id, grid.text(i)), doc_id, held, len(own) + 1, known + (end_at >= 0), float(v.sum() + logs[end_at] - (len(own) + 1) * base_bottom), float(outside), packed(with_end(own, end), t.size), words, n)
                for x, value_ in zip(out.values(), row):
                    x.append(value_)
            return out

        return f

    logs_of_one = float(np.log10(1.5))
    return make


SUMS = pa.schema([("block", pa.int32()), ("shards", pa.int64()), ("change", pa.binary())])
SUMS_DDL = "block int, shards long, change binary"


def summed(table: pa.Table) -> pa.Table:
    """The changes of one block of parameters from all tasks, added."""
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("change"))
    return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([sum(table.column("shards").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema=SUMS)


def train(read: DataFrame, table: Table, rest: np.ndarray, train_tokens: int, rounds: int = ROUNDS, rate: float = RATE, shard_tokens: int = SHARD_TOKENS) -> np.ndarray:
    """The parameters after all rounds over the training documents of ``read`` (doc, held_out, ids)."""
    spark = read.sparkSession
    model = Model.fresh(table.freq, rest)
    if not table.size:
        return model.flat
    shards = max(1, round(train_tokens / rounds / shard_tokens))
    tasks, size = min(shards, max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))), table.size
    slot = F.pmod(F.xxhash64("doc"), F.lit(rounds * shards))
    own = read.filter("not held_out").select(slot.alias("slot"), "doc", "ids")
    for k in range(rounds):
        weights = spark.sparkContext.broadcast(model.flat.copy())

        def run(batches, k=k, weights=weights):
            total, n, held, slot = np.zeros(len(weights.value), np.int64), 0, [], None

            def learned():
                trainer = Trainer(Model(size, flat=weights.value.copy()), rate / (1 + k))
                trainer.learn(held)
                return np.rint((trainer.m.flat - weights.value) / UNIT).astype(np.int64)

            for batch in batches:
                for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if s != slot and held:
                        total, n, held = total + learned(), n + 1, []
                    slot = s
                    held.append(unpacked(raw, size))
            if held:
                total, n = total + learned(), n + 1
            if n:
                at = range(0, len(total), BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([x // BLOCK for x in at], pa.int32()), pa.array([n] * len(at), pa.int64()), pa.array([total[x : x + BLOCK].tobytes() for x in at], pa.binary())], schema=SUMS)

        dealt = own.filter(F.col("slot") % rounds == k).repartitionById(tasks, F.pmod(F.floor(F.col("slot") / rounds), F.lit(tasks)).cast("int"))
        sums = dealt.sortWithinPartitions("slot", "doc").select("slot", "ids").mapInArrow(run, SUMS_DDL).groupBy("block").applyInArrow(summed, SUMS_DDL).collect()
        for r in sums:
            at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            model.flat[at] += (np.frombuffer(r["change"], np.int64) / r["shards"] * UNIT).astype(np.float32)
        weights.unpersist()
    return model.flat


SCORED = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("neural", pa.float64())])


def score(docs: DataFrame, rounds: int = ROUNDS, vocabulary: int | None = None, most: int = TABLE_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts, table, rest = count_tokens(docs, vocabulary, most)
    shared = spark.sparkContext.broadcast(table)
    read = stored(docs.mapInArrow(over_batches(reader(shared, rest), READ, 2048, "text"), READ_DDL))
    weights, size = spark.sparkContext.broadcast(train(read, table, rest, table.tokens, rounds, shard_tokens=shard_tokens)), table.size

    def scorer():
        model = Model(size, flat=weights.value.copy())

        def f(batch):
            texts = [unpacked(x, size) for x in batch.column("ids").to_pylist()]
            neural = score_docs(model, texts) / LN10 if size else np.zeros(len(texts))
            return {k: batch.column(k) for k in SCORED.names[:-1]} | {"neural": neural + batch.column("outside").to_numpy()}

        return f

    scored = read.select(*SCORED.names[:-1], "outside", "ids").mapInArrow(over_batches(scorer, SCORED, CHUNK_ROWS, "ids", CHUNK_BYTES), "doc long, doc_id long, held_out boolean, n_tokens long, known long, base double, neural double")
    more, logs = F.lit(0).cast("long"), F.lit(0.0)
    if table.least > 1:
        unsure = read.filter("size(open) > 0").select("doc", "open", "times").dropDuplicates(["doc"])
        unsure = unsure.select("doc", F.explode(F.arrays_zip("open", "times")).alias("w")).select("doc", F.col("w.open").alias("hash"), F.col("w.times").alias("times"))
        c = F.coalesce("n", F.lit(0))
        unsure = unsure.join(counts, "hash", "left").groupBy("doc").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("logs"))
        scored = scored.join(unsure, "doc", "left")
        more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(table.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("neural") + logs).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
