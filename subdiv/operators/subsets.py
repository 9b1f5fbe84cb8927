"""All subsets of an itemset as rows, and joins of many rows to their subsets' values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW_BITS = 12


def explode_subsets(itemsets: DataFrame, strict: bool = False, column: str = "itemset") -> DataFrame:
    """One row per subset: adds ``subset``, ``subset_key``, ``subset_length``.

    Every subset of a frequent itemset is frequent, so this is about as large as
    the itemset table times the subsets of a typical member.  Masks are produced
    in two explodes, so no row ever holds more than 4096 of them.
    """
    size = F.size(column)
    high = F.expr(f"sequence(0L, shiftleft(1L, greatest(size({column}) - {_LOW_BITS}, 0)) - 1)")
    low = F.expr(f"sequence(0L, shiftleft(1L, least(size({column}), {_LOW_BITS})) - 1)")
    masks = itemsets.withColumn("_high", F.explode(high)).withColumn("_low", F.explode(low))
    masks = masks.withColumn("_mask", F.expr(f"shiftleft(_high, {_LOW_BITS}) + _low")).drop("_high", "_low")
    subset = F.expr(f"filter({column}, (x, i) -> (shiftright(_mask, i) & 1L) = 1L)")
    out = masks.withColumn("subset", subset).drop("_mask")
    out = out.withColumns({"subset_key": F.array_join("subset", ", "), "subset_length": F.size("subset")})
    return out.where(F.col("subset_length") < size) if strict else out


# The shorter an itemset, the more others contain it: the empty one and the single items
# meet most rows of a table.  Their values are copied, and the rows that ask for them are
# dealt over the copies by a hash, so that no task holds all rows of one short itemset.
# There are at most attributes / min_support single items, so the copies stay few.

_COPIES = {0: 64, 1: 64, 2: 16, 3: 4}


def _copies(length: Column) -> Column:
    out = F.lit(1)
    for size, copies in _COPIES.items():
        out = F.when(length == size, copies).otherwise(out)
    return out


def join_values(rows: DataFrame, key: str, length: str | int, by: str, values: DataFrame, value_length: str | int) -> DataFrame:
    """Inner join on ``key``; rows of one key are dealt by a hash of ``by`` over the copies of its value.

    ``length`` and ``value_length`` name (or are) the number of items of the key on
    either side.  ``values`` has one row per key and keeps only its other columns.
    """
    number = lambda x: F.lit(x) if isinstance(x, int) else F.col(x)
    copied = values.withColumn("_copy", F.explode(F.sequence(F.lit(0), _copies(number(value_length)) - 1)))
    if not isinstance(value_length, int):
        copied = copied.drop(value_length)
    dealt = rows.withColumn("_copy", F.pmod(F.xxhash64(by), _copies(number(length)).cast("bigint")).cast("int"))
    return dealt.join(copied, [key, "_copy"]).drop("_copy")
