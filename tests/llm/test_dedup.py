import random
import time
from collections import defaultdict

import numpy as np
from helpers import documents, odd_rows, prose

from scantling.llm import common, near_dedup, substring_dedup


def words(text):
    return [w.decode("utf-8", "surrogatepass") for w in common.lower_words(text)]


def brute_near(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def variants(seed=3, n=130):
    rng = random.Random(seed)
    base = prose(rng, 150)
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = prose(rng, 1)[0] + "x"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(prose(rng, 80))) for i in range(40)]
    rows += [(2000 + i, rows[5][1].upper()) for i in range(5)]
    return rows


def test_near_dedup_equals_brute_force_with_a_crowded_group(spark):
    rows = variants()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_near_dedup_odd_rows(spark):
    got = [tuple(r) for r in near_dedup.near_duplicates(documents(spark, odd_rows())).collect()]
    assert len(got) == len(odd_rows())
    by = defaultdict(list)
    for i, n, c, kept in got:
        by[i].append((n, c, kept))
    assert by[1] == by[2] == by[3] == [(0, by[k][0][1], True) for k in (1,)] or all(by[k][0][0] == 0 and by[k][0][2] for k in (1, 2, 3))
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 5, True)]
    assert {x[1] for k in (6, 7, 8) for x in by[k]} == {6} and len(by[8]) == 2
    assert all(c is None and kept for _, c, kept in by[None])


def test_near_dedup_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_components_equal_union_find_over_many_partitions(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + k) for k in range(60)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.component for r in common.components(edges, per_part=60).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    assert got == {x: top(x) for x in up}


def test_least_matches_never_drops_likely_pairs():
    least = near_dedup.least_matches(0.85, 1e-6, 16, 6)
    assert least == sorted(least) and least[0] >= 1 and least[-1] < 0.85 * 96


def passages(seed=9):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (55, 60, 90)]
    rows = []
    for i in range(60):
        w = prose(rng, 140)
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = shared[i // 3 % 3]
        rows.append((i, " ".join(w)))
    return rows


def test_substring_dedup_finds_pasted_passages_and_only_them(spark):
    rows = passages()
    found = substring_dedup.repeated_passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in found} == {i for i, _ in rows if i % 3 == 0}
    assert {0, 3, 6} <= {r.doc_id for r in found if not r.removed}
    for r in found:
        own, kept = words(dict(rows)[r.doc_id]), " ".join(words(dict(rows)[r.kept_doc_id]))
        assert any(" ".join(own[k : k + 20]) in kept for k in range(r.start_word, r.end_word - 19))


def test_substring_dedup_text_without_repeats(spark):
    docs = documents(spark, passages())
    found = substring_dedup.repeated_passages(docs)
    cut = substring_dedup.without_repeats(docs, found)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = substring_dedup.repeated_passages(cut.select("doc_id", "text")).filter("removed").count()  # ends of passages, under 50 words
    assert left == 0


def test_substring_dedup_odd_rows(spark):
    found = substring_dedup.repeated_passages(documents(spark, odd_rows())).collect()
    assert {r.doc_id for r in found} == {6, 7, 8} and {r.kept_doc_id for r in found} == {6}
    assert substring_dedup.repeated_passages(documents(spark, [])).count() == 0


def test_bands_reach_the_recall():
    b = substring_dedup.tune_bands(0.8, 0.02, 2)
    assert (1 - 0.8**2) ** b <= 0.02 < (1 - 0.8**2) ** (b - 1)
    b, j = substring_dedup.tune_bands(), substring_dedup.EDITED
    assert (1 - j**2) ** b <= substring_dedup.MISS


def edited_passages(every, seed):
    """120 documents, half of which hold one of twenty 80-word passages; two of three with one word in ``every`` replaced."""
    rng = random.Random(seed)
    shared = [prose(rng, 80) for _ in range(20)]
    rows, holds = [], {}
    for i in range(120):
        w = prose(rng, 140)
        if i % 2 == 0:
            own, k = list(shared[i // 2 % 20]), i // 40
            if k:
                for at in range(rng.randrange(every), 80, every):
                    own[at] = "edited" + str(rng.randrange(10**6))
            at = rng.randrange(len(w))
            w[at:at] = own
            holds[i] = (at, at + 80)
        rows.append((i, " ".join(w)))
    return rows, holds


def test_edited_passages_are_found(spark):
    share = {}
    for every in (40, 20, 15):
        caught = total = covered = words_in = 0
        for seed in (1,):
            rows, holds = edited_passages(every, seed)
            found = substring_dedup.repeated_passages(documents(spark, rows)).collect()
            assert {r.doc_id for r in found} <= holds.keys()
            caught, total = caught + len({r.doc_id for r in found}), total + len(holds)
            for r in found:
                if r.removed:
                    a, b = holds[r.doc_id]
                    assert a - 4 <= r.start_word and r.end_word <= b + 4  # what may be edited of a paragraph
                    covered, words_in = covered + r.end_word - r.start_word, words_in + 80
        share[every] = (caught / total, covered / words_in)
    print(share)
    assert share[40][0] >= 0.97 and share[20][0] >= 0.9 and share[15][0] >= 0.75


def naive_distance(x, y):
    d = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        d, last = [i], d
        for j, b in enumerate(y, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (a != b)))
    return d[-1]


def test_similarity_of_paragraphs_equals_naive():
    rng = random.Random(7)
    pairs = []
    for _ in range(400):
        x = [rng.randrange(9 if rng.random() < 0.3 else 10**6) for _ in range(20)]
        y = list(x)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(20)
            y = [*y[:k], rng.randrange(10**6), *y[k:]][:20] if rng.random() < 0.4 else [*y[:k], rng.randrange(10**6), *y[k + 1 :]]
        pairs.append((x, y))
    x, y = (np.array([p[k] for p in pairs], np.uint64) for k in (0, 1))
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(16)}
    want = [len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b)) or naive_distance(a, b) <= 4 for a, b in pairs]
    assert substring_dedup.edit_distances(x, y).tolist() == [naive_distance(a, b) for a, b in pairs]
    assert substring_dedup.similar(x, y, 0.8).tolist() == want and 50 < sum(want) < 350


def test_words_around_a_passage():
    b = lambda *x: np.array(x, np.uint32).tobytes()
    assert substring_dedup.shared_words(b(1, 2, 3, 4), b(1, 2, 9, 4)) == 2
    assert substring_dedup.shared_words(b(1, 2, 3), b(1, 2)) == 2
    assert substring_dedup.shared_words(b(1, 2, 3, 4, 5, 6, 7, 8), b(1, 0, 3, 4, 5, 6, 7, 9)) == 7
    assert substring_dedup.shared_words(b(), b(1)) == 0 and substring_dedup.shared_words(b(1), b(2)) == 0


def test_runs_grow_to_the_whole_passage(spark):
    rows = passages()
    found = substring_dedup.repeated_passages(documents(spark, rows)).collect()
    size = {i: n for i, n in zip(range(0, 60, 3), (55, 60, 90) * 7)}
    marked = defaultdict(set)
    for r in found:
        marked[r.doc_id] |= set(range(r.start_word, r.end_word))
    removed = {r.doc_id for r in found if r.removed}
    assert len(removed) >= 17 and all(size[i] <= len(marked[i]) <= size[i] + 8 for i in removed)


def test_shuffle_files_of_stored_steps_are_dropped(spark):
    def shuffle_files():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rng, before, setting = random.Random(8), shuffle_files(), spark.conf.get(name)
    passage = " ".join(prose(rng, 80))
    found = substring_dedup.repeated_passages(documents(spark, [(i, " ".join(prose(rng, 60)) + " " + passage) for i in range(6)]))
    until = time.time() + 20
    while (left := shuffle_files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(name) == setting
    assert sorted(r.doc_id for r in found.collect() if r.removed) == [1, 2, 3, 4, 5]
