"""URL filter by Bloom filter cascades: exact membership of url keys in lists, without joins.

A url has candidate keys: every host suffix with as many labels as some rule has, followed by
every path prefix as long as some rule's path; and the words of its host and path. All candidate
keys of the corpus are the key universe. A cascade for a list R over the universe U: level 0 is a
Bloom filter of R, level 1 one of the keys of U outside R that pass level 0, level 2 one of the
keys of R that pass level 1, and so on until nothing is left over. A key of U is a member exactly
if the first level it misses is odd (or it passes all of an odd number of levels).

Three lists: allow rules, block rules, block words. The longest rule that fits gives the verdict;
without one, a url with a listed word is blocked, any other allowed. Only the filters (about
``1.44 * log2(1 / rate)`` bits a listed key) are sent to the tasks, and only up to ``MOST_KEYS``
listed keys (checked); a longer list is cut into shards of that size. Each shard is broadcast for a
pass of its own, which reads the rows of the pass before from the shared folder.

Edge cases: a null url, or one without ``://``, has empty host and path and no keys: it is
allowed; null page ids and repeated rows are judged each; other columns are ignored; an empty
table gives no rows; an empty list has no level and no member.
"""

from __future__ import annotations

import re
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, over_batches, pages

#: The rules of the contract, (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words of a host or path that mark adult, gambling or spam pages.
BLOCK_WORDS = ("porn", "xxx", "sex", "nude", "escort", "casino", "poker", "betting", "slots", "jackpot", "viagra", "cialis", "payday", "warez", "torrent", "malware", "phishing", "hentai")
RATES = (1 / 16, 1 / 2)  # of level 0 (at most) and of the others
MOST_KEYS = 20_000_000

WORD = re.compile(r"[a-z0-9]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lowered, path): host ends at the first ``/``, ``?`` or ``#``, path at ``?`` or ``#``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(ASCII_LOWER), slash + path


class Shape:
    """Which host suffixes and path prefixes the rules can ask for."""

    def __init__(self, rules):
        self.labels = sorted({h.count(".") + 1 for _, h, _ in rules})
        self.paths = sorted({len(p) for _, _, p in rules})

    def rule_keys(self, host: str, path: str) -> list[str]:
        labels = host.split(".")
        hosts = [".".join(labels[-n:]) for n in self.labels if host and n <= len(labels)]
        return [h + path[:n] for h in hosts for n in self.paths if n <= len(path)]


def word_keys(host: str, path: str) -> set[str]:
    return {"\0" + w for w in WORD.findall(f"{host} {path}".translate(ASCII_LOWER))}


def hashed(keys) -> np.ndarray:
    """Two 64-bit hashes of every key."""
    return np.array([divmod(xxhash.xxh3_128_intdigest(k.encode("utf-8", "surrogatepass")), 1 << 64) for k in keys], np.uint64).reshape(-1, 2)


class Bloom:
    def __init__(self, bits: int, tries: int, level: int, words: np.ndarray | None = None):
        self.bits, self.tries, self.level = bits, tries, level
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    @classmethod
    def sized(cls, n: int, rate: float, level: int) -> Bloom:
        bits = max(64, ceil(-n * log(rate) / log(2) ** 2 / 64) * 64)
        return cls(bits, max(1, round(-log(rate) / log(2))), level)

    def places(self, h: np.ndarray) -> np.ndarray:
        step = h[:, 1:] | np.uint64(1)
        at = h[:, :1] ^ np.uint64((self.level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        at = at * np.uint64(0xFF51AFD7ED558CCD)
        at ^= at >> np.uint64(32)
        return (at + np.arange(self.tries, dtype=np.uint64) * step) % np.uint64(self.bits)

    def add(self, h: np.ndarray) -> None:
        at = self.places(h).ravel()
        np.bitwise_or.at(self.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=1)


def members(levels: list[Bloom], h: np.ndarray) -> np.ndarray:
    """Which keys of the universe are in the list that the cascade was built for."""
    alive, result = np.arange(len(h)), np.zeros(len(h), bool)
    for i, level in enumerate(levels):
        hit = level.has(h[alive])
        result[alive[~hit]] = i % 2 == 1
        alive = alive[hit]
    result[alive] = len(levels) % 2 == 1
    return result


KEY = pa.schema([("key", pa.string())])
CHUNK = pa.schema([("at", pa.int64()), ("word", pa.int64())])


def built(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """The filter of all ``keys``: tasks set bits of their own, words are united before they are gathered."""
    empty = Bloom.sized(n, rate, level)

    def run(batches):
        own = Bloom(empty.bits, empty.tries, level)
        for b in batches:
            own.add(hashed(b.column(0).to_pylist()))
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.words[at].view(np.int64))], schema=CHUNK)

    rows = keys.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect()
    words = np.zeros(empty.bits // 64, np.int64)
    words[[r["at"] for r in rows]] = [r["word"] for r in rows]
    return Bloom(empty.bits, empty.tries, level, words.view(np.uint64))


def passing(keys: DataFrame, level: Bloom) -> DataFrame:
    def make():
        def f(batch):
            col = batch.column(0)
            return {"key": col.filter(pa.array(level.has(hashed(col.to_pylist()))))}

        return f

    return cut(keys.mapInArrow(over_batches(make, KEY, 8192), "key string"))


def cascade(listed: DataFrame, universe: DataFrame, rates=RATES, most: int = MOST_KEYS) -> list[Bloom]:
    """Levels for the list ``listed`` (key) over ``universe`` (distinct keys)."""
    inside, outside, levels = cut(listed.select("key").distinct()), None, []
    n = inside.count()
    if n > most:
        raise ValueError(f"{n} keys in a cascade; cut the list into shards of {most}")
    # about as many others may pass level 0 as are listed, so that no level outgrows the list however large the universe is
    first = min(rates[0], max(n, 64) / max(1, universe.count()))
    while n := inside.count():
        level = built(inside, n, rates[1] if levels else first, len(levels))
        levels.append(level)
        if outside is None:  # the first time only: what passes outside the list, a small share of the universe
            outside = cut(passing(universe, level).join(inside, "key", "left_anti"))
            inside, outside = outside, inside
        else:
            inside, outside = passing(outside, level), inside
    return levels


def url_keys(rows: DataFrame, shape: Shape) -> DataFrame:
    """Distinct candidate keys of all urls; tasks drop repeats of their own first."""

    def run(batches, most=200_000):
        seen: set[str] = set()
        for b in batches:
            new = []
            for url in b.column(0).to_pylist():
                host, path = split_url(url)
                for k in (*shape.rule_keys(host, path), *word_keys(host, path)):
                    if k not in seen:
                        seen.add(k)
                        new.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], schema=KEY)
            if len(seen) > most:
                seen.clear()

    return cut(rows.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "key string").distinct())


JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def url_filter(rows: DataFrame, rules=RULES, words=BLOCK_WORDS, listed_words: DataFrame | None = None, most: int = MOST_KEYS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``rows`` (page_id, url).

    ``listed_words`` (key: string) adds words from a table to ``words``.
    """
    spark, shape = rows.sparkSession, Shape(rules)
    universe = url_keys(rows, shape)  # written: counted and read once per level 0

    def keys(values) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], "key string")

    allow = cascade(keys([h + p for v, h, p in rules if v == "allow"]), universe)
    block = cascade(keys([h + p for v, h, p in rules if v == "block"]), universe)
    marks, shards = keys(["\0" + w for w in words]), 1
    if listed_words is not None:
        marks = cut(marks.unionByName(listed_words.select(F.concat(F.lit("\0"), F.lower("key")).alias("key"))).distinct())
        shards = max(1, ceil(1.1 * marks.count() / most))  # hashing deals them unevenly
    rule_levels = spark.sparkContext.broadcast((allow, block))

    def ruled():
        def f(batch):
            parsed = [split_url(u) for u in batch.column(1).to_pylist()]
            rule_keys = [shape.rule_keys(*p) for p in parsed]
            flat = [k for x in rule_keys for k in x]
            h = hashed(flat)
            ok, no = (members(levels, h) for levels in rule_levels.value)
            rule, verdict, i = [], [], 0
            for own in rule_keys:
                best = max((k for k in range(i, i + len(own)) if ok[k] or no[k]), key=lambda k: len(flat[k]), default=None)
                rule.append(None if best is None else flat[best])
                verdict.append("block" if best is not None and no[best] else "allow")
                i += len(own)
            hosts, paths = ([p[k] for p in parsed] for k in (0, 1))
            return {"page_id": batch.column(0), "host": hosts, "path": paths, "rule": rule, "verdict": verdict}

        return f

    def worded(levels):
        def make():
            def f(batch):
                col = {k: batch.column(k) for k in JUDGED.names}
                open_ = [r is None and v == "allow" for r, v in zip(col["rule"].to_pylist(), col["verdict"].to_pylist())]
                own = [word_keys(a, b) if o else () for a, b, o in zip(col["host"].to_pylist(), col["path"].to_pylist(), open_)]
                bad = members(levels.value, hashed([k for x in own for k in x]))
                ends = np.cumsum([len(x) for x in own])
                verdict = ["block" if bad[e - len(x) : e].any() else v for x, e, v in zip(own, ends, col["verdict"].to_pylist())]
                return col | {"verdict": verdict}

            return f

        return make

    ddl = "page_id long, host string, path string, rule string, verdict string"
    out = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(over_batches(ruled, JUDGED, 4096), ddl)
    for s in range(shards):
        levels = spark.sparkContext.broadcast(cascade(marks.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == s), universe, most=most))
        out = (cut(out) if s else out).mapInArrow(over_batches(worded(levels), JUDGED, 4096), ddl)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(pages(spark, sf_dir))


_WORDS = "|".join(BLOCK_WORDS)
ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM p),
r(v, rh, rp) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
fit AS (SELECT page_id, max_by(v, length(rh || rp)) AS v, max_by(rh || rp, length(rh || rp)) AS rule
  FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(translate(host || ' ' || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({_WORDS})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fit USING (page_id)
"""
