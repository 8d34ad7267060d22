"""The trie against one built from nested prefixes, with odd rows, copies and long chains."""

import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from scantling.llm import conversation_trie as ct

DDL = "conv_id long, turn long, role string, text string, key string, bytes long, depth long, length long, node long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], DDL).repartition(3)


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text


def by_hand(rows, fork=True):
    """conv_id, depth to parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, members that end."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), digest(role, text)))
    own = {c: [d[1:] for _, d in sorted(v, key=lambda x: (x[0], x[1][0]))] for c, v in own.items()}
    whole = {}
    for c, said in own.items():
        h = crc32(str(c).encode()) % 9 if fork else 0
        base = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])
        whole[c] = tuple(base[:h]) + tuple(said[h:])
    members = defaultdict(list)
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = sum(not children[q] for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = sorted(c for c in m if whole[c] == p)
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), children[p], leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def collected(trie):
    digests = {(r.conv_id, r.depth): r.ends_sha256 for r in ct.digests(trie.ends).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    rows = [tuple(r) for r in trie.nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: (*r[2:], digests.get(r[:2], empty)) for r in rows}


def odd():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(("user", "bot", None)), rng.choice(("hé", "yes", "", None, "no " * 50))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, None, "user", "null turn"), (50, 1, "user", "a"), (50, 1, "user", "b"), (50, 1, "user", "b"), (None, 0, "user", "lost"), (-7, 0, "user", "hé"), (-7, 3, "bot", "x"), (61, 0, "a", "bc"), (62, 0, "ab", "c"), (78, 5, "user", "only")]
    return rows + [(c, t, "user", f"turn {t}") for c in (70, 71, 72) for t in range(30)] + [(c, t, "user", f"turn {t}") for c in (73,) for t in range(12)]


@pytest.mark.parametrize("fork", [True, False])
def test_by_hand(spark, fork):
    rows = odd()
    t = table(spark, rows)
    trie = ct.build(*ct.forked(ct.turns(t))) if fork else ct.conversation_trie(t)
    assert collected(trie) == by_hand(rows, fork)


def test_forks_leave_some_conversations_without_turns(spark):
    rows = [(c, 0, "user", "x") for c in range(5, 5000, 5)][:3] + [(c, 0, "user", "y") for c in range(1, 30)]
    assert collected(ct.build(*ct.forked(ct.turns(table(spark, rows))))) == by_hand(rows)
    lone = [(c, 0, "user", "x") for c in range(3, 200, 5)]  # no first of the kin: with h > 0 nothing is left
    got = collected(ct.build(*ct.forked(ct.turns(table(spark, lone)))))
    assert got == by_hand(lone) and got[3, 0][1] == len(lone)


def test_one_conversation_and_none(spark):
    rows = [(5, t, "user", f"{t}") for t in range(4)]
    assert collected(ct.conversation_trie(table(spark, rows))) == by_hand(rows, False)
    assert ct.conversation_trie(table(spark, rows).limit(0)).nodes.count() == 0
    assert collected(ct.build(*ct.forked(ct.turns(table(spark, rows).limit(0))))) == {}


def test_long_lists_of_members_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(ct, "PIECE", 7)
    rows = [(c, 0, "user", "same") for c in random.Random(1).sample(range(10_000), 900)]
    assert collected(ct.conversation_trie(table(spark, rows)))[min(r[0] for r in rows), 1][-1] == by_hand(rows, False)[min(r[0] for r in rows), 1][-1]


def test_last_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, None, "c")]
    t = table(spark, rows)
    got = {(r.conv_id, r.depth): (r.role, r.text, r.n_convs) for r in ct.conversation_trie(t).last_turns(t).collect()}
    assert got == {(1, 1): ("user", "a", 2), (1, 2): ("bot", "b", 1), (2, 2): ("", "c", 1)}
