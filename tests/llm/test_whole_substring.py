import random

from helpers import documents, prose

from scantling.llm import substring_dedup


def crowded_variants(seed=2, n=100):
    """Texts of one paragraph each: variants of a template that share its first words and differ after them."""
    rng = random.Random(seed)
    head, rows = prose(rng, 15), []
    for i in range(n):
        own = [w + str(i) for w in prose(rng, 5)]
        rows.append((2 * i, " ".join(head + own)))
        rows.append((2 * i + 1, " ".join(head + own[:-1] + ["other"])))  # a pair shares 15 of 17 shingles, others 11 of 21
    return rows


def test_near_copies_in_a_crowded_bucket_equal_brute_force(spark):
    rows = crowded_variants()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(16)} for i, t in rows}
    want = {i for i in sets for j in sets if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {r.doc_id for r in substring_dedup.repeated_passages(documents(spark, rows)).collect()}
    assert want == set(sets) and got == want


def test_small_and_crowded_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "tune_bands", lambda: 60)
    docs = documents(spark, crowded_variants(n=25))
    by = {}
    for crowd, block in ((1000, 1024), (2, 1024), (2, 7)):
        monkeypatch.setattr(substring_dedup, "CROWD", crowd)
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        by[crowd, block] = sorted((r.doc_id, r.kept_doc_id, r.removed) for r in substring_dedup.repeated_passages(docs).collect())
    assert len(by[2, 7]) == 50 and len({str(x) for x in by.values()}) == 1


def test_text_of_a_short_period_is_found_and_its_kept_copy_stays_whole(spark):
    rng = random.Random(4)
    rows = []
    for k, period in enumerate((1, 2, 3, 5, 7, 11)):
        line = prose(rng, period)
        rows += [(10 * k + c, " ".join(prose(rng, 60) + line * (60 + 10 * c) + prose(rng, 60))) for c in range(2)]
    docs = documents(spark, rows)
    found = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in found if not r.removed} == {10 * k for k in range(6)}
    assert {r.doc_id for r in found if r.removed} == {10 * k + 1 for k in range(6)}
    for r in found:
        period = (1, 2, 3, 5, 7, 11)[r.doc_id // 10]
        assert r.end_word - r.start_word > 60 * period - 60
