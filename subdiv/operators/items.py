"""Rows to items: ranges, generalized items, admission."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subdiv.functions.metrics import with_divergence, with_outcome_divergence
from subdiv.functions.values import attribute
from subdiv.operators.mine import admit
from subdiv.session import materialize, small_table

# --- fixed values: comparison operators of a discretization -------------------
_OPERATORS = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">=": lambda c, v: c >= v,
    ">": lambda c, v: c > v,
}
# ------------------------------------------------------------------------------


def in_range(col: Column, rels: list[str], vals: list) -> Column:
    """Conjunction of ``col rel val``; NULL values are in no range."""
    tests = [_OPERATORS[r](col, F.lit(v)) for r, v in zip(rels, vals)]
    return reduce(lambda a, b: a & b, tests)


def _interval(rels, vals):
    """``(lo, hi)`` of a range made of bounds only, else None."""
    lo, hi = float("-inf"), float("inf")
    for r, v in zip(rels, vals):
        if isinstance(v, str) or r == "!=":
            return None
        if r in (">=", ">", "="):
            lo = max(lo, v)
        if r in ("<=", "<", "="):
            hi = min(hi, v)
    return lo, hi


def _pick(col: Column, ranges: list, otherwise: Column) -> Column:
    """Label of the range that holds ``col``.

    Sorted disjoint ranges are halved, so a row costs log(n) comparisons.
    """
    if len(ranges) <= 4:
        out = otherwise
        for label, spec in ranges:
            out = F.when(in_range(col, spec["rels"], spec["vals"]), F.lit(label)).otherwise(out)
        return out
    mid = len(ranges) // 2
    boundary = _interval(**_spec(ranges[mid]))[0]
    if any(r in (">",) for r in ranges[mid][1]["rels"]):
        left = col <= F.lit(boundary)
    else:
        left = col < F.lit(boundary)
    return F.when(left, _pick(col, ranges[:mid], otherwise)).otherwise(_pick(col, ranges[mid:], otherwise))


def _spec(entry):
    return {"rels": entry[1]["rels"], "vals": entry[1]["vals"]}


def range_label(col: Column, ranges: dict, unmatched: str = "drop") -> Column:
    """One label per value.  ``ranges`` is ``{label: {"rels": [...], "vals": [...]}}``.

    A value in no range gets NULL; ``unmatched="closest_left"`` gives it to the
    nearest range below, ``"keep"`` leaves the value itself as label.
    When ranges overlap, the later one wins.
    """
    if unmatched not in ("drop", "closest_left", "keep"):
        raise ValueError(f"unknown unmatched mode {unmatched!r}")
    entries = list(ranges.items())
    bounds = [_interval(**_spec(e)) for e in entries]
    if unmatched == "closest_left":
        if any(b is None for b in bounds):
            raise ValueError("closest_left needs interval ranges")
        otherwise = F.lit(None).cast("string")
        for (label, _), (lo, hi) in sorted(zip(entries, bounds), key=lambda p: p[1][1]):
            if hi != float("inf"):
                otherwise = F.when(col > F.lit(hi), F.lit(label)).otherwise(otherwise)
    else:
        otherwise = col.cast("string") if unmatched == "keep" else F.lit(None).cast("string")
    if all(b is not None for b in bounds):
        order = sorted(range(len(entries)), key=lambda i: bounds[i])
        disjoint = all(bounds[a][1] < bounds[b][0] for a, b in zip(order, order[1:]))
        if disjoint:
            return _pick(col, [entries[i] for i in order], otherwise)
    out = otherwise
    for label, spec in entries:
        out = F.when(in_range(col, spec["rels"], spec["vals"]), F.lit(label)).otherwise(out)
    return out


def discretize_ranges(df: DataFrame, discretizations: dict, unmatched: str = "drop") -> DataFrame:
    """Replace each listed attribute by its range label, keeping the column order."""
    missing = [a for a in discretizations if a not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(
        *[
            range_label(attribute(df, c), discretizations[c], unmatched).alias(c)
            if c in discretizations
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def discretize_overlapping(df: DataFrame, discretizations: dict) -> DataFrame:
    """Replace each listed attribute by the array of all its ranges that hold the value."""

    def labels(c):
        col = attribute(df, c)
        flags = [F.when(in_range(col, s["rels"], s["vals"]), F.lit(k)) for k, s in discretizations[c].items()]
        return F.array_compact(F.array(*flags)).alias(c)

    return df.select(*[labels(c) if c in discretizations else F.col(f"`{c}`") for c in df.columns])


def range_flags(df: DataFrame, discretizations: dict, sep: str = "=") -> DataFrame:
    """One 0/1 column per range, named ``attr=label``, in place of the attribute."""
    flags = {}
    for attr, ranges in discretizations.items():
        for label, spec in ranges.items():
            test = F.coalesce(in_range(attribute(df, attr), spec["rels"], spec["vals"]), F.lit(False))
            flags[f"{attr}{sep}{label}"] = test.cast("int")
    return df.withColumns(flags).drop(*discretizations)


def itemize(df: DataFrame, attributes: list[str], name: str = "items") -> DataFrame:
    """Add ``items: array<struct<attr, item>>``; NULL gives no element."""
    parts = []
    for a in attributes:
        col = attribute(df, a)
        if isinstance(df.schema[a].dataType, T.ArrayType):
            parts.append(_tagged(a, col))
        else:
            parts.append(_tagged(a, F.array_compact(F.array(col.cast("string")))))
    return df.withColumn(name, F.concat(*parts))


def _tagged(attr: str, values: Column) -> Column:
    return F.transform(
        values.cast("array<string>"),
        lambda v: F.struct(F.lit(attr).alias("attr"), F.concat(F.lit(f"{attr}="), v).alias("item")),
    )


def one_hot(
    df: DataFrame,
    attributes: list[str],
    max_columns: int = 10_000,
    sep: str = "=",
    items: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """0/1 matrix with one column per item.

    ``items`` lists the wanted ``(attribute, value)`` pairs in the order of their columns;
    the table is then not scanned for them, and their number is not limited.  Without it
    the values are looked up, and more than ``max_columns`` raise.
    """
    if items is None:
        names = item_names(df, attributes).limit(max_columns + 1).collect()
        if len(names) > max_columns:
            raise ValueError(f"more than {max_columns} items; name the wanted items or use itemize")
        items = sorted(((r["attr"], r["value"]) for r in names), key=lambda x: (attributes.index(x[0]), x[1]))
    unknown = sorted({a for a, _ in items} - set(attributes))
    if unknown:
        raise ValueError(f"items of attributes that are not listed: {unknown}")
    flags = {f"{a}{sep}{v}": F.coalesce(attribute(df, a).cast("string") == F.lit(v), F.lit(False)).cast("int") for a, v in items}
    return df.withColumns(flags).drop(*[a for a in attributes if a not in flags])


def item_names(df: DataFrame, attributes: list[str]) -> DataFrame:
    """Distinct ``(attr, value)`` of the listed columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attr"), attribute(df, a).cast("string").alias("value")) for a in attributes])
    return df.select(F.explode(pairs).alias("p")).select("p.attr", "p.value").where("value is not null").distinct()


def from_one_hot(df: DataFrame, columns: list[str], sep: str = "=") -> tuple[DataFrame, list[str]]:
    """0/1 item columns back to one array column per attribute (values may overlap).

    Raises when a column holds anything but 0, 1, true or false.
    """
    check_one_hot(df, columns)
    by_attr: dict[str, list[tuple[str, str]]] = {}
    for c in columns:
        attr, _, value = c.partition(sep)
        by_attr.setdefault(attr, []).append((c, value))
    arrays = {
        attr: F.array_compact(F.array(*[F.when(F.col(f"`{c}`").cast("int") == 1, F.lit(v)) for c, v in cols]))
        for attr, cols in by_attr.items()
    }
    return df.withColumns(arrays).drop(*[c for c in columns if c not in by_attr]), list(by_attr)


def check_one_hot(df: DataFrame, columns: list[str]) -> None:
    bad = invalid_one_hot_counts(df, columns).first().asDict()
    wrong = sorted(c for c, n in bad.items() if n)
    if wrong:
        raise ValueError(f"only 0, 1, true and false are allowed, see {wrong[:5]}")


def invalid_one_hot_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per column the number of values other than 0/1/true/false."""
    def invalid(c):
        col = F.col(f"`{c}`").cast("double")
        return F.count_if(F.coalesce(~col.isin(0.0, 1.0), F.lit(True))).alias(c)

    return df.agg(*[invalid(c) for c in columns])


def extend_items(df: DataFrame, closure: DataFrame, name: str) -> DataFrame:
    """Replace a value column by the array of the value and its ancestors."""
    chains = (
        closure.where(F.col("attr") == name)
        .groupBy(F.col("leaf").alias("_leaf"))
        .agg(F.array_sort(F.collect_set("item")).alias("_up"))
    )
    own = F.array_compact(F.array(F.col(f"`{name}`").cast("string")))
    joined = df.join(chains, F.col(f"`{name}`").cast("string") == F.col("_leaf"), "left")
    both = F.array_union(own, F.coalesce(F.col("_up"), F.array().cast("array<string>")))
    return joined.select(*[both.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


def preserve_values(df: DataFrame, keep: dict[str, list[str]]) -> DataFrame:
    """Set values outside the preserved list of their attribute to NULL (no item)."""
    return df.withColumns(
        {
            a: F.when(F.col(f"`{a}`").cast("string").isin([str(v) for v in vals]), F.col(f"`{a}`"))
            for a, vals in keep.items()
        }
    )


def keep_table(spark, keep: dict[str, list[str]]) -> DataFrame:
    """``{attr: [items]}`` as the ``(attr, item)`` table that mining accepts."""
    rows = []
    for attr, values in keep.items():
        rows.extend((attr, v) for v in values) if values else rows.append((attr, None))
    return small_table(spark, pa.schema([("attr", pa.string()), ("item", pa.string())]), rows)


def admitted_only(df: DataFrame, attributes: list[str], keep: DataFrame) -> DataFrame:
    """Items of the rows that pass an admission list, as ``(attr, item, n)``."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attr"), attribute(df, a).cast("string").alias("item")) for a in attributes])
    items = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.attr", "p.item")
        .where("item is not null")
        .groupBy("attr", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return admit(items, keep)


def divergent_values(df: DataFrame, attributes: list[str], metric: str, measures: list[str]) -> DataFrame:
    """Single values whose metric lies above the whole table: ``(attr, item, metric)``.

    An attribute without such a value is absent, so pruning leaves it whole.
    """
    from subdiv.operators.mine import item_counts

    names = small_table(
        df.sparkSession, pa.schema([("a", pa.int32()), ("attr", pa.string())]), list(enumerate(attributes))
    )
    df = df.select(*[attribute(df, a).alias(a) for a in attributes], *measures)
    counts = item_counts(df, attributes, measures).join(names, "a")
    whole = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures])
    root = whole.select(
        F.lit(None).cast("string").alias("attr"), F.lit(None).cast("string").alias("item"), F.lit(0).alias("length"),
        F.lit(1.0).alias("support"), F.col("n").alias("support_count"), *measures,
    )
    singles = counts.select(
        "attr", F.col("v").alias("item"), F.lit(1).alias("length"),
        (F.col("n") / whole.select("n").scalar()).alias("support"), F.col("n").alias("support_count"), *measures,
    )
    table = materialize(root.unionByName(singles), "singles")
    if metric == "d_outcome":
        scored = with_outcome_divergence(table)
    else:
        scored = with_divergence(table, [metric], significance=False)
    return scored.where((F.col("length") == 1) & (F.col(metric) > 0)).select("attr", "item", metric)
