"""Substring deduplication: MinHash banding of paragraphs that text itself delimits.

Copied passages are pasted into lines, so line breaks don't delimit them. A *paragraph* here is a
run of ``LENGTH`` words that starts at a cut point, and cut points depend on the words alone: the
smallest hash among any ``SPREAD`` successive starts (minimizers). A passage of
``LENGTH + SPREAD - 1`` = 49 words or more therefore has a paragraph, the same wherever it is
pasted; the mean distance of cut points is 15.5 words.

A paragraph's set is its distinct 5-word shingles, however few. Where text repeats within itself,
successive paragraphs of equal content that overlap are one, from the first word to the last. Bands
of MinHash rows give keys; ``tune_bands`` takes as many as a pair with one word replaced in the
middle (Jaccard 11/21) needs to meet with the wanted probability. Within a task a content that
occurred already is not banded again (so a passage that half of all documents share reaches each key
once per task); then rows of a key meet, contents are linked with the key's first and the preceding
content, and every link between unequal contents is verified: exact Jaccard similarity of the
shingle sets, or edit similarity of the words (distance over length), must reach ``threshold``.
Contents of a key that are in different components after that are all compared: as rows of pairs
where a key has at most ``CROWD`` contents, else in pairs of blocks of about ``BLOCK``, of which only
links that join components are returned. So no link within a key is lost. Components of contents
that occur in two documents or more are passages; the copy in the smallest (document, place) is
kept, all others are removals.

Runs of removed paragraphs are then extended over the words around them that the kept copy has too
(single replaced words between ``SURE`` equal ones included), up to the next run. Cut points of a
passage are at most ``SPREAD`` apart, so that many words of context on each side suffice. As a
similar paragraph may differ in a fifth of its words, a run may reach up to four words over the end
of a passage.

Result: one row per document and run of repeated paragraphs, in words: ``doc_id, start_word,
end_word, paragraphs, kept_doc_id, removed``. Documents without repeats have no row.

Edge cases: null, blank and short texts have no paragraphs; null ids take no part; repeated rows
of one document are one document, no repeat; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Grid, components, cut, documents, in_small_batches, mix, over_batches, shuffles_dropped, stored, unused, window_hashes
from .near_dedup import common_counts, hash_family

LENGTH, SPREAD, SHINGLE, THRESHOLD, ROWS = 20, 30, 5, 0.8, 2
#: Jaccard similarity of a paragraph and its copy with a middle word replaced, and how often such a pair may share no band.
EDITED, MISS = 11 / 21, 0.28
SEEN, BROADCAST_BYTES, SURE = 1_000_000, 48 << 20, 5
CROWD, BLOCK = 32, 1024


def tune_bands(similarity: float = EDITED, miss: float = MISS, rows: int = ROWS) -> int:
    """The fewest bands with which a pair of that similarity shares none with probability ``miss`` at most."""
    return max(1, ceil(log(miss) / log(1 - similarity**rows)))


def cut_points(s: np.ndarray, starts: int, spread: int) -> np.ndarray:
    """Places that hold the smallest hash of some ``spread`` successive starts (of all, if fewer)."""
    h = mix(s[:starts] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    if starts <= spread:
        return np.array([int(np.argmin(h))])
    low = np.lib.stride_tricks.sliding_window_view(h, spread).argmin(axis=1)
    return np.unique(low + np.arange(len(low)))


def paragraphs(words: np.ndarray, length: int = LENGTH, spread: int = SPREAD):
    """(starts, shingle hashes, content hashes, ends) of the paragraphs of a text's word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return None
    s = window_hashes(words, SHINGLE)
    at = cut_points(s, n, spread)
    sets = s[at[:, None] + np.arange(length - SHINGLE + 1)]
    content = np.zeros(len(at), np.uint64)
    for k in range(0, length - SHINGLE + 1, SHINGLE):
        content = mix(content * np.uint64(0x9E3779B97F4A7C15) + sets[:, k])
    content = mix(content + sets[:, -1])
    first = np.flatnonzero(np.append(True, (content[1:] != content[:-1]) | (np.diff(at) >= length)))
    return at[first], sets[first], content[first], at[np.append(first[1:], len(at)) - 1] + length


BANDED = pa.schema([("key", pa.list_(pa.int64())), ("repeat", pa.bool_()), ("content", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def bander(bands: int, rows: int, length: int, spread: int):
    def make():
        mul, xor = hash_family(bands * rows, 17)
        seen: dict[int, tuple | None] = {}

        def f(batch):
            grid = Grid(batch.column(1))
            parts = [(np.full(len(p[0]), i), *p) for i, w in enumerate(grid.per_text(grid.hashes())) if (p := paragraphs(w, length, spread))]
            if not parts:
                return None
            text, at, sets, content, end = (np.concatenate(x) for x in zip(*parts))
            doc = np.array(batch.column(0).to_pylist(), np.int64)[text]
            content = content.view(np.int64)
            if len(seen) > SEEN:
                seen.clear()
            fresh, again = [], []
            for k, (c, d, a, e) in enumerate(zip(content.tolist(), doc.tolist(), at.tolist(), end.tolist())):
                if c not in seen:
                    seen[c] = (d, a, e)
                    fresh.append(k)
                    continue
                if seen[c]:  # the first occurrence is known as a repeat from now on
                    again.append((c, *seen[c]))
                    seen[c] = None
                again.append((c, d, a, e))
            fresh = np.array(fresh, np.int64)
            keys = np.empty((len(fresh), bands), np.uint64)
            for b in range(bands):
                key = np.full(len(fresh), b + 1, np.uint64)
                for r in range(rows):
                    low = ((sets[fresh] ^ xor[b * rows + r]) * mul[b * rows + r]).min(axis=1)
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
                keys[:, b] = key
            own = [[int(np.int64(hash((d, a)))) ^ c] for c, d, a, _ in again]  # spread over the partitions, meets nothing
            flat = np.append(keys.view(np.int64).ravel(), np.array(own, np.int64).ravel())
            ends = np.append(np.arange(0, len(fresh) * bands + 1, bands), len(fresh) * bands + np.arange(1, len(own) + 1))
            col = lambda first, k: np.append(first[fresh], np.array([x[k] for x in again], first.dtype))
            return {
                "key": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                "repeat": np.append(np.zeros(len(fresh), bool), np.ones(len(own), bool)),
                "content": col(content, 0),
                "doc_id": col(doc, 1),
                "start": col(at.astype(np.int32), 2),
                "end": col(end.astype(np.int32), 3),
            }

        return f

    return make


SETS = pa.schema([("content", pa.int64()), ("items", pa.binary())])


def word_maker(length: int, spread: int):
    """The words of wanted contents, from the texts that hold them.

    Words go by 32 bits here: two paragraphs have 400 pairs of them, so some unequal pair looks
    equal with probability 1e-7.
    """

    def make():
        def f(batch):
            grid = Grid(batch.column(0))
            out = {"content": [], "items": []}
            for w, want in zip(grid.per_text(grid.hashes()), batch.column(1).to_pylist()):
                p = paragraphs(w, length, spread)
                if p is None:
                    continue
                want = set(want)
                for at, c in zip(p[0].tolist(), p[2].view(np.int64).tolist()):
                    if c in want:
                        want.discard(c)
                        out["content"].append(c)
                        out["items"].append(w[at : at + length].astype(np.uint32).tobytes())
            return out

        return f

    return make


def shingles(words: np.ndarray) -> np.ndarray:
    """Row by row the hashes of the ``SHINGLE``-word windows."""
    n = words.shape[1] - SHINGLE + 1
    h = np.zeros((len(words), n), np.uint64)
    for k in range(SHINGLE):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k : k + n])
    return h


def edit_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Word edit distance of each pair of rows, all pairs in step."""
    n = x.shape[1]
    row = np.repeat(np.arange(n + 1, dtype=np.int16)[:, None], len(x), axis=1)
    for i in range(1, n + 1):
        diagonal = row[0].copy()
        row[0] = i
        for j in range(1, n + 1):
            best = diagonal + (x[:, i - 1] != y[:, j - 1])
            np.minimum(best, row[j] + 1, out=best)
            np.minimum(best, row[j - 1] + 1, out=best)
            diagonal, row[j] = row[j].copy(), best
    return row[n]


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of rows of words (32 bits each) with Jaccard or edit similarity of ``threshold`` or more."""
    a, b = shingles(x), shingles(y)
    first = lambda s: ~np.tril(s[:, :, None] == s[:, None, :], -1).any(axis=2)
    distinct_a, distinct_b = first(a), first(b)
    both = (distinct_a & (a[:, :, None] == b[:, None, :]).any(axis=2)).sum(axis=1)
    ok = both >= threshold * (distinct_a.sum(axis=1) + distinct_b.sum(axis=1) - both)
    rest = np.flatnonzero(~ok)
    ok[rest] = edit_distances(x[rest], y[rest]) <= (1 - threshold) * x.shape[1] + 1e-9
    return ok


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def as_words(items: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(items), np.uint32).reshape(len(items), -1).astype(np.uint64) if items else np.empty((0, LENGTH), np.uint64)


def confirmer(threshold: float):
    def make():
        def f(rows):
            keep = pa.array(similar(as_words(rows.column("xa").to_pylist()), as_words(rows.column("xb").to_pylist()), threshold))
            return {"a": rows.column("a").filter(keep), "b": rows.column("b").filter(keep)}

        return f

    return make


def block_linker(threshold: float, at_once: int = 8192):
    """Links between two blocks of a key's contents that join components, as a forest.

    Pairs that can be similar are those that share all distinct words but as many as may be edited,
    or enough shingles; only they are compared.
    """

    def f(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        block, node, label = (t.column(c).to_numpy() for c in ("block", "content", "c"))
        words = as_words(t.column("items").to_pylist())
        a, b = (np.flatnonzero(block == key[k].as_py()) for k in (1, 2))
        out: list[tuple[int, int]] = []
        if len(a) and len(b):
            sets = [np.unique(x) for x in words]
            sizes, edits = np.array([len(x) for x in sets]), int((1 - threshold) * words.shape[1] + 1e-9)
            near = common_counts([sets[k] for k in a], [sets[k] for k in b]) >= np.minimum(sizes[a][:, None], sizes[b][None]) - edits
            sets = [np.unique(x) for x in shingles(words)]
            sizes = np.array([len(x) for x in sets])
            both = common_counts([sets[k] for k in a], [sets[k] for k in b])
            near |= both >= threshold * (sizes[a][:, None] + sizes[b][None] - both)
            near &= label[a][:, None] != label[b][None]
            root: dict[int, int] = {}

            def top(x):
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = root[x]
                return x

            xs, ys = np.nonzero(near)
            for at in range(0, len(xs), at_once):
                x, y = a[xs[at : at + at_once]], b[ys[at : at + at_once]]
                open_ = np.array([top(int(p)) != top(int(q)) for p, q in zip(label[x], label[y])])
                x, y = x[open_], y[open_]
                linked = similar(words[x], words[y], threshold)
                for i, j in zip(x[linked].tolist(), y[linked].tolist()):
                    p, q = top(int(label[i])), top(int(label[j]))
                    if p != q:
                        root[p] = q
                        out.append((int(node[i]), int(node[j])))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], schema=PAIRS)

    return f


def with_wanted(docs: DataFrame, want: DataFrame, size: str) -> DataFrame:
    """``docs`` joined to ``want`` (doc_id and a list); broadcast only if the lists' bytes (counted by ``size``) are few."""
    small = want.agg(F.coalesce(F.sum(F.lit(48) + F.expr(size)), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_BYTES
    return docs.join(F.broadcast(want) if small else want, "doc_id")


@shuffles_dropped
@in_small_batches
def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, bands: int | None = None, length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """Runs of paragraphs of ``docs`` (doc_id, text) that other documents have too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    bands = bands or tune_bands()
    rows = docs.mapInArrow(over_batches(bander(bands, ROWS, length, spread), BANDED, weigh="text"), "key array<long>, repeat boolean, content long, doc_id long, start int, end int")
    rows = rows.select(F.explode("key").alias("key"), "repeat", "content", "doc_id", "start", "end")
    w = Window.partitionBy("key").orderBy("content", "doc_id", "start")
    rows = rows.select("*", F.first("content").over(w).alias("lo"), F.lag("content").over(w).alias("prev"), F.lead("content").over(w).alias("next")).withColumn("hi", F.max("content").over(Window.partitionBy("key")))
    hits = rows.filter("repeat or prev is not null or next is not null").select("content", "doc_id", "start", "end", F.when(F.col("lo") != F.col("hi"), F.col("key")).alias("key"), F.when(F.col("lo") != F.col("content"), F.col("lo")).alias("lo"), F.when((F.col("prev") != F.col("content")) & (F.col("prev") != F.col("lo")), F.col("prev")).alias("prev"))
    hits = stored(hits)
    units = stored(hits.select("content", "doc_id", "start", "end").distinct())
    pairs = stored(hits.select("content", F.explode(F.array("lo", "prev")).alias("o")).filter("o is not null").select(F.least("content", "o").alias("a"), F.greatest("content", "o").alias("b")).distinct())
    mates = hits.filter("key is not null").select("key", "content").distinct()
    label = components(links(docs, units, pairs, mates, threshold, length, spread))
    units = stored(units.join(label, F.col("content") == F.col("node"), "left").select("content", "doc_id", "start", "end", F.coalesce("component", "content").alias("passage")))
    where = F.struct("doc_id", "start", "end")
    passages = cut(units.groupBy("passage").agg(F.min(where).alias("kept"), F.max("doc_id").alias("last")).filter(F.col("kept.doc_id") < F.col("last")).select("passage", "kept"))
    own = units.join(passages.withColumn("doc_id", F.col("kept.doc_id")), ["passage", "doc_id"])
    chain = Window.partitionBy("passage", "doc_id").orderBy("start", "end")
    reach = F.max("end").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("gap", F.when(F.col("start") >= reach, 1).otherwise(0)).withColumn("gap", F.sum("gap").over(chain))
    passages = cut(own.filter("gap = 0").groupBy("passage").agg(F.first("kept").alias("kept"), F.max("end").alias("to")))  # overlapping units are one copy
    stays = (F.col("doc_id") == F.col("kept.doc_id")) & (F.col("start") < F.col("to"))
    kept = (F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), F.col("kept.end").alias("kept_end"))
    marked = units.join(passages, "passage").select("doc_id", "start", "end", *kept, (~stays).alias("removed"))
    return extended(docs, stored(runs(marked.dropDuplicates(["doc_id", "start"]), length, spread)), spread)


def links(docs: DataFrame, units: DataFrame, pairs: DataFrame, mates: DataFrame, threshold: float, length: int, spread: int) -> DataFrame:
    """Verified links ``a, b`` that connect all contents which ``mates`` (key, content) of a key connect; ``pairs`` are tried first."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct()  # all mates: each is its key's first or paired with it
    need = units.join(used, "content").groupBy("content").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("content").alias("want"))  # as many as a text has paragraphs
    need = cut(need)
    if need.isEmpty():
        return pairs
    texts = with_wanted(docs, need, "8 * size(want)").select("text", "want")
    sets = stored(texts.mapInArrow(over_batches(word_maker(length, spread), SETS, weigh="text"), "content long, items binary").dropDuplicates(["content"]))

    def verified(some: DataFrame) -> DataFrame:
        full = some.join(sets.select(F.col("content").alias("a"), F.col("items").alias("xa")), "a").join(sets.select(F.col("content").alias("b"), F.col("items").alias("xb")), "b")
        return cut(full.select("a", "b", "xa", "xb").mapInArrow(over_batches(confirmer(threshold), PAIRS, 8192), "a long, b long"))

    first = verified(pairs)
    placed = mates.join(components(first), F.col("content") == F.col("node"), "left").select("key", "content", F.coalesce("component", "content").alias("c"))
    placed = stored(placed)
    mixed = placed.groupBy("key").agg(F.count("*").alias("members"), F.min("c").alias("x"), F.max("c").alias("y")).filter("members > 2 and x < y").select("key", "members")
    left = stored(placed.join(mixed, "key"))

    few = left.filter(f"members <= {CROWD}")
    l, r = few.alias("l"), few.alias("r")
    cross = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.c") < F.col("r.c"))).select(F.least("l.content", "r.content").alias("a"), F.greatest("l.content", "r.content").alias("b")).distinct()
    more = verified(cross.join(pairs, ["a", "b"], "left_anti"))

    many = left.filter(f"members > {CROWD}").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).join(sets, "content").withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    many = many.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    many = many.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "content", "c", "items")
    crowded = cut(many.groupBy("key", "i", "j").applyInArrow(block_linker(threshold), "a long, b long"))
    return first.unionByName(more).unionByName(crowded)


def runs(marked: DataFrame, length: int, spread: int) -> DataFrame:
    """Paragraphs of a document no farther apart than cut points can be are one run."""
    w = Window.partitionBy("doc_id").orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when((F.col("start") - (reach - length) <= spread) & (F.col("removed") == F.lag("removed").over(w)), 0).otherwise(1)
    numbered = marked.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return numbered.groupBy("doc_id", "run").agg(
        F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.count("*").alias("paragraphs"), F.min("kept_doc_id").alias("kept_doc_id"), F.first("removed").alias("removed"),
        F.min_by(F.struct(F.col("kept_doc_id").alias("doc_id"), F.col("kept_start").alias("place")), "start").alias("left"), F.max_by(F.struct(F.col("kept_doc_id").alias("doc_id"), F.col("kept_end").alias("place")), "end").alias("right"),
    )


CONTEXT = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("before", pa.bool_()), ("words", pa.binary())])


def contexts(spread: int):
    """The ``spread`` words before or after wanted places, nearest first."""

    def make():
        def f(batch):
            grid = Grid(batch.column("text"))
            out = {k: [] for k in CONTEXT.names}
            for doc_id, w, want in zip(batch.column("doc_id").to_pylist(), grid.per_text(grid.hashes()), batch.column("want").to_pylist()):
                w = w.astype(np.uint32)
                for x in want:
                    at = x["place"]
                    near = w[max(0, at - spread) : at][::-1] if x["before"] else w[at : at + spread]
                    for name, value in zip(CONTEXT.names, (doc_id, at, x["before"], near.tobytes())):
                        out[name].append(value)
            return out

        return f

    return make


def shared_words(a: bytes, b: bytes, sure: int = SURE) -> int:
    """How many words two contexts have in common from their first word on; single replaced words before ``sure`` equal ones count."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    n = min(len(x), len(y))
    other = np.append(np.flatnonzero(x[:n] != y[:n]), n)
    k = 0
    while other[k] < n and other[k + 1] - other[k] > sure:
        k += 1
    return int(other[k])


GROWN = pa.schema([("doc_id", pa.int64()), ("run", pa.int64()), ("before", pa.bool_()), ("by", pa.int32())])


def grower():
    def f(batch):
        by = [shared_words(a, b) for a, b in zip(batch.column("own").to_pylist(), batch.column("theirs").to_pylist())]
        return {k: batch.column(k) for k in GROWN.names[:-1]} | {"by": by}

    return f


def extended(docs: DataFrame, found: DataFrame, spread: int) -> DataFrame:
    """Removed runs, grown over the words around them that their kept copies have too, up to the next run."""
    w = Window.partitionBy("doc_id").orderBy("start_word", "run")
    out = found.withColumn("floor", F.coalesce(F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("ceiling", F.lead("start_word").over(w))
    ends = found.filter("removed").select("doc_id", "run", F.explode(F.array(*(F.struct(F.lit(before).alias("before"), F.col(at).alias("place"), F.col(f"{side}.doc_id").alias("kept_doc"), F.col(f"{side}.place").alias("kept_place")) for before, at, side in ((True, "start_word", "left"), (False, "end_word", "right"))))).alias("e")).select("doc_id", "run", "e.*")
    want = ends.select("doc_id", "place", "before").unionByName(ends.select(F.col("kept_doc").alias("doc_id"), F.col("kept_place").alias("place"), "before")).distinct()
    want = cut(want.groupBy("doc_id").agg(F.collect_list(F.struct("place", "before")).alias("want")))  # at most four a run of the text
    around = stored(with_wanted(docs, want, "24 * size(want)").select("doc_id", "text", "want").mapInArrow(over_batches(contexts(spread), CONTEXT, weigh="text"), "doc_id long, place int, before boolean, words binary").dropDuplicates(["doc_id", "place", "before"]))
    pairs = ends.join(around.withColumnRenamed("words", "own"), ["doc_id", "place", "before"])
    pairs = pairs.join(around.select(F.col("doc_id").alias("kept_doc"), F.col("place").alias("kept_place"), "before", F.col("words").alias("theirs")), ["kept_doc", "kept_place", "before"])
    grown = pairs.select("doc_id", "run", "before", "own", "theirs").mapInArrow(over_batches(grower, GROWN, 8192), "doc_id long, run long, before boolean, by int")
    grown = grown.groupBy("doc_id", "run").agg(F.max(F.when(F.col("before"), F.col("by"))).alias("up"), F.max(F.when(~F.col("before"), F.col("by"))).alias("down"))
    out = out.join(grown, ["doc_id", "run"], "left")
    start = F.col("start_word") - F.coalesce("up", F.lit(0))
    end = F.col("end_word") + F.coalesce("down", F.lit(0))
    start = F.when(F.col("removed"), F.least("start_word", F.greatest(start, "floor"))).otherwise(F.col("start_word"))
    end = F.when(F.col("removed"), F.greatest("end_word", F.least(end, F.coalesce("ceiling", end)))).otherwise(F.col("end_word"))
    return out.select("doc_id", start.cast("long").alias("start_word"), end.cast("long").alias("end_word"), "paragraphs", "kept_doc_id", "removed")


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the removed runs cut out of ``text``; all rows and columns stay."""
    spans = found.filter("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("cut"))
    of, cut_ = (unused(docs, name) for name in ("of", "cut"))
    spans = spans.select(F.col("doc_id").alias(of), F.col("cut").alias(cut_))
    joined = docs.join(spans, docs["doc_id"] == spans[of], "left").drop(of)

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            grid, texts = Grid(batch.column(k)), []
            for i, (text, spans) in enumerate(zip(batch.column(k).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())):
                if spans:
                    a, at, raw, parts = grid.first[i], 0, text.encode(), []
                    begin = grid.offsets[i]
                    for s in sorted(spans, key=lambda s: s["start_word"]):
                        lo, hi = int(grid.starts[a + s["start_word"]] - begin), int(grid.ends[a + s["end_word"] - 1] - begin)
                        parts.append(raw[at : max(at, lo)])
                        at = max(at, hi)
                    text = (b"".join(parts) + raw[at:]).decode()
                texts.append(text)
            out = batch.set_column(k, "text", pa.array(texts, pa.string()))
            yield out.select(range(out.num_columns - 1))

    return joined.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
