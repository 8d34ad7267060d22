"""Fill-in-the-middle: texts cut at units into prefix, middle and suffix, and put in another order.

A *unit* is a match of ``UNIT`` (by default a code point), found from left to right; characters that
no match covers are units of one code point. Texts are cut relationally:

* a text's units are matched in blocks of ``BLOCK`` (one expression repeated, so the blocks' ends are
  units' ends), whose lengths are exploded with their positions; a window's running sum says where
  each block starts;
* a cut request (text, ordinal of the first unit after the cut) is joined to the block that holds this
  ordinal; this block's units are exploded, and the running sum of their lengths at the ordinal is
  the offset in code points;
* offsets are aggregated per text, joined to it, and substrings make the parts.

So what is sorted is a number a block, and the units of two blocks a text; texts themselves are moved
once, to their offsets. Rows are told apart by hashes of id and text (128 bits): repeated rows, however
many, are cut once; the join of offsets with texts splits keys with many rows, as Spark does with any
skewed join.

Edge cases: a null text is empty; a null id counts as the empty string where draws are made and stays
null; an empty text, and one that holds a sentinel, is left plain; repeated rows are repeated in the
result; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

UNIT, BLOCK, SEED = r"(?s).", 64, "1"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed at most, and so many of those with the suffix first.
SHARE, SUFFIX_FIRST = 90, 20

ROW = ("row", "row2")


def draws(doc_id: Column, seed: str = SEED, n: int = 4) -> list[Column]:
    """``n`` whole numbers of 32 bits from a text's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def unit_pattern(unit: str) -> tuple[str, str]:
    """Expressions of one unit (any character where ``unit`` doesn't match), and of a block of units."""
    one = f"(?>{unit}|(?s:.))" if unit != UNIT else "(?s:.)"
    return one, f"{one}{{1,{BLOCK}}}+"


def offsets(texts: DataFrame, unit: str = UNIT) -> DataFrame:
    """Offsets in code points of requested units.

    ``texts``: row, row2 (the key), text, ordinals (array of ordinals of units). Returns row, row2, cut
    (place in the array), offset: the code points before the unit; nothing where no such unit is.
    """
    one, block = unit_pattern(unit)
    of_block = lambda o: F.floor(o / BLOCK).cast("int")
    matched = texts.select(*ROW, "ordinals", F.regexp_extract_all("text", F.lit(block), F.lit(0)).alias("blocks"))
    matched = matched.select(*ROW, "ordinals", F.transform("blocks", F.char_length).alias("sizes"), F.transform("ordinals", lambda o: F.get("blocks", of_block(o))).alias("parts")).dropDuplicates(list(ROW))
    w = Window.partitionBy(*ROW).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = matched.select(*ROW, "ordinals", F.posexplode("sizes").alias("block", "size")).withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    starts = starts.filter(F.exists("ordinals", lambda o: of_block(o) == F.col("block"))).select(*ROW, "block", "start")
    asked = matched.select(*ROW, F.posexplode(F.arrays_zip("ordinals", "parts")).alias("cut", "r")).select(*ROW, "cut", of_block(F.col("r.ordinals")).alias("block"), (F.col("r.ordinals") % BLOCK).cast("int").alias("k"), "r.parts")
    held = asked.filter("parts is not null").join(starts, [*ROW, "block"])
    units = F.regexp_extract_all("parts", F.lit(one), F.lit(0))
    units = held.select(*ROW, "block", "cut", "start", "k", F.posexplode(F.slice(units, 1, F.col("k") + 1)).alias("at", "unit"))
    u = Window.partitionBy(*ROW, "block", "cut").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # the join's partitioning serves the window: units aren't moved
    before = units.withColumn("offset", F.col("start") + F.coalesce(F.sum(F.char_length("unit")).over(u), F.lit(0)))
    return before.filter("at = k").select(*ROW, "cut", "offset")


def transform(docs: DataFrame, seed: str = SEED, unit: str = UNIT, share: int = SHARE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, text, n, form, prefix, middle, suffix, output`` of every row of ``docs`` (doc_id, text).

    ``n``: units of the text; ``form``: plain, psm or spm; the parts are null if plain.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("row2", F.xxhash64("text", F.lit(seed), "doc_id"))
    one, _ = unit_pattern(unit)
    count = F.char_length("text") if unit == UNIT else F.regexp_count("text", F.lit(one))
    h = draws(F.col("doc_id"), seed)
    n = F.col("n")
    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (h[2] % 100 >= share)
    texts = texts.withColumn("n", count.cast("long")).withColumn("form", F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"))
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    asked = texts.filter("form <> 'plain'").select(*ROW, "text", F.array(F.least(a, b), F.greatest(a, b)).alias("ordinals"))
    of = F.col("offset")
    own = offsets(asked, unit).groupBy(*ROW).agg(F.max(F.when(F.col("cut") == 0, of)).alias("p"), F.max(F.when(F.col("cut") == 1, of)).alias("m"))
    end = F.char_length("text")  # a cut behind the last unit is there
    out = texts.join(own.hint("shuffle_hash"), list(ROW), "left").withColumn("p", F.coalesce("p", end)).withColumn("m", F.coalesce("m", end))
    part = lambda lo, hi: F.when(F.col("form") != "plain", F.substring("text", lo + 1, hi - lo))
    out = out.select("doc_id", "text", "n", "form", part(F.lit(0), F.col("p")).alias("prefix"), part(F.col("p"), F.col("m")).alias("middle"), part(F.col("m"), end).alias("suffix"))
    p, m, s = (F.col(c) for c in ("prefix", "middle", "suffix"))
    put = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    return out.withColumn("output", F.coalesce(put, "text"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from what was made of it: a changed text holds no sentinel of its own, so the first of each kind is the one put in."""
    out = F.col(output)
    head = F.substring_index(out, MIDDLE, 1)
    middle = F.substring(out, F.char_length(head) + len(MIDDLE) + 1, F.char_length(out))
    first, second = (F.substring_index(head, mark, 1) for mark in (SUFFIX, PREFIX))
    after = lambda whole, before: F.substring(whole, F.char_length(before) + 4, F.char_length(whole))
    psm = F.concat(F.substring(first, len(PREFIX) + 1, F.char_length(first)), middle, after(head, first))
    spm = F.concat(after(head, second), middle, F.substring(second, len(SUFFIX) + 1, F.char_length(second)))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def query(spark, sf_dir: str) -> DataFrame:
    out = transform(documents(spark, sf_dir))
    size = lambda c: F.char_length(c).cast("long").alias(f"{c}_chars")
    return out.select("doc_id", "n", "form", size("prefix"), size("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


_DIGEST = "sha256('1:' || coalesce(doc_id::VARCHAR, ''))"
ORACLE_SQL = f"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, {', '.join(f"('0x' || substr({_DIGEST}, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM documents),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {SHARE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
