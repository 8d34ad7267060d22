"""Places and running sums in two levels: no task sorts a whole group, however large it is.

A group is cut along its order into blocks, by a rule that depends on the value alone. Rows are
placed within their blocks; the blocks' totals, one row each, are summed along the group and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a draw that name its block, and blocks between a number and its double.
DRAW_BITS, OCTAVE = 8, 256
_LARGEST = 1.7976931348623157e308


def draw_block(u: Column, bits: int = DRAW_BITS) -> Column:
    """Draws of 32 bits are uniform, so their first bits cut any group evenly."""
    return F.shiftright(u, 32 - bits)


def number_block(v: Column) -> Column:
    """By sign and size: every power of two has ``OCTAVE`` blocks, zero its own; infinite ones and NaN are in the last."""
    size = F.least(F.abs(v.cast("double")), F.lit(_LARGEST))
    block = F.floor((F.log2(F.when(size > 0, size)) + 1100) * OCTAVE)
    return F.when(size > 0, F.when(v < 0, -block).otherwise(block)).otherwise(F.lit(0).cast("long"))


def placed(rows: DataFrame, keys: list[str], order: list[str], block: Column, sums: tuple[str, ...] = (), following: str | None = None) -> DataFrame:
    """``rows`` with ``place`` in the order within the keys, from 0, and ``n``, how many there are.

    ``before_c`` and ``all_c``: sums of each column of ``sums`` over earlier and over all rows.
    ``next``: the next row's value of ``following``, by which rows are ordered; null after the last.
    ``block`` mustn't fall along the order. Null keys are a group.
    """
    rows = rows.withColumn("_block", block)
    own, all_ = Window.partitionBy(*keys, "_block").orderBy(*order), Window.partitionBy(*keys)
    along = all_.orderBy("_block")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    first = [F.min(following).alias("_first")] if following else []
    totals = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in sums], *first)
    totals = totals.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_block").alias("_of"), F.coalesce(F.sum("_rows").over(before(along)), F.lit(0)).alias("_at"), F.sum("_rows").over(all_).alias("n"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before(along)), F.lit(0)).alias(f"_at_{c}") for c in sums], *[F.sum(f"_sum_{c}").over(all_).alias(f"all_{c}") for c in sums], *[F.lead("_first").over(along).alias("_then") for _ in first],
    )
    here = rows.withColumns({"_place": F.row_number().over(own) - 1} | {f"_before_{c}": F.coalesce(F.sum(c).over(before(own)), F.lit(0)) for c in sums} | ({"_next": F.lead(following).over(own)} if following else {}))
    same = F.col("_block").eqNullSafe(F.col("_of"))  # no filter is inferred from it, so both sides read one exchange
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    more = [(F.col("_place") + F.col("_at")).alias("place"), "n"] + [e for c in sums for e in ((F.col(f"_before_{c}") + F.col(f"_at_{c}")).alias(f"before_{c}"), F.col(f"all_{c}"))]
    if following:
        more.append(F.coalesce("_next", "_then").alias("next"))
    return here.join(totals, same).select(*[c for c in rows.columns if c != "_block"], *more)
