"""Interval arithmetic as column expressions; an interval is two bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: a signed decimal number, and a range "[lo-hi]" of two ------
NUMBER = r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"
RANGE = rf"^[\[(]({NUMBER})-({NUMBER})[\])]$"
LOWER = rf"^>=?({NUMBER})$"
UPPER = rf"^<=?({NUMBER})$"
POINT = rf"^=?({NUMBER})$"
# ------------------------------------------------------------------------------


def overlap_length(lo1, hi1, lo2, hi2) -> Column:
    return F.greatest(F.least(hi1, hi2) - F.greatest(lo1, lo2), F.lit(0.0))


def overlap_normalized(lo1, hi1, lo2, hi2) -> Column:
    """Overlap over the longer of both lengths."""
    return F.try_divide(overlap_length(lo1, hi1, lo2, hi2), F.greatest(hi1 - lo1, hi2 - lo2))


def overlap_interval(lo1, hi1, lo2, hi2) -> Column:
    """Struct ``(lo, hi)``, NULL without overlap."""
    lo, hi = F.greatest(lo1, lo2), F.least(hi1, hi2)
    return F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def point_overlap(lo1, hi1, lo2, hi2) -> Column:
    """Where one interval is a point inside the other: the parts left and right of it."""

    def cut(p, lo, hi):
        return F.when(
            (p >= lo) & (p <= hi),
            F.struct(lo.alias("left_lo"), p.alias("left_hi"), p.alias("right_lo"), hi.alias("right_hi")),
        )

    first = F.when(lo1 == hi1, cut(lo1, lo2, hi2))
    second = F.when(lo2 == hi2, cut(lo2, lo1, hi1))
    return F.coalesce(first, second)


def precision(true_lo, true_hi, lo, hi) -> Column:
    """Share of the found interval that is true; a point has none."""
    return F.coalesce(F.try_divide(overlap_length(true_lo, true_hi, lo, hi), hi - lo), F.lit(0.0))


def recall(true_lo, true_hi, lo, hi) -> Column:
    return F.coalesce(F.try_divide(overlap_length(true_lo, true_hi, lo, hi), true_hi - true_lo), F.lit(0.0))


def f_measure(true_lo, true_hi, lo, hi) -> Column:
    p = precision(true_lo, true_hi, lo, hi)
    r = recall(true_lo, true_hi, lo, hi)
    return F.when((p == 0) | (r == 0), F.lit(0.0)).otherwise(2 * (p * r) / (p + r))


def consecutive(edges: Column) -> Column:
    """Edge array to intervals between neighbours."""
    return F.transform(
        F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))),
        lambda x, i: F.struct(x.alias("lo"), F.element_at(edges, i + 2).alias("hi")),
    )


def edge_pairs(edges: Column) -> Column:
    """Sorted distinct edges taken two by two."""
    e = F.array_sort(F.array_distinct(edges))
    count = F.floor(F.size(e) / 2).cast("int")
    return F.transform(
        F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.element_at(e, 2 * i - 1).alias("lo"), F.element_at(e, 2 * i).alias("hi")),
    )


def item_range(value: Column) -> Column:
    """Bounds of ``>=v``, ``<=v``, ``[a-b]`` and of a point ``v`` or ``=v``; an open end is NULL."""

    def number(pattern, group):
        text = F.regexp_extract(value, pattern, group)
        return F.when(text != "", text.cast("double"))

    return F.struct(
        F.coalesce(number(RANGE, 1), number(LOWER, 1), number(POINT, 1)).alias("lo"),
        F.coalesce(number(RANGE, 2), number(UPPER, 1), number(POINT, 1)).alias("hi"),
    )
