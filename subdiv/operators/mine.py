"""Frequent itemsets with summed measures.

One operator serves confusion cells and numeric outcomes alike: every measure
is a column that is summed.  The work is four kinds of job:

1. total the table and estimate how many value combinations it holds; where they
   are few, sum rows with equal values (what follows then reads that table);
2. count single items: the shuffle carries one row per distinct value;
3. replace values by ids of frequent items and sum rows with equal ids: from here
   on the data is as large as the number of distinct id combinations, not as
   large as the input;
4. either one grouping over all item combinations, or one grouping per itemset
   length.

A row of the table holds at most ``k`` items, so at most ``k / min_support``
items are frequent.  That bound is what lets the driver hold the item list.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subdiv.functions.metrics import METRICS, optimistic, with_divergence, with_outcome_divergence
from subdiv.functions.values import attribute
from subdiv.session import arrow_type, int_literals, materialize, small_table, string_literals

#: largest number of combinations per row for which one grouping is used
SINGLE_PASS_LIMIT = 4096
#: rows are grouped first when that leaves at most one in this many
_WORTH_GROUPING = 4
#: attributes with at most this many frequent items are encoded without a join
_SHORT_LIST = 32


@dataclass(frozen=True)
class _Items:
    """The frequent items, ids 1..len(names), contiguous per attribute."""

    attributes: list[str]  # in id order
    names: list[str]  # item text "attr=value"
    values: list[str]
    attr_of: list[str]
    last_of_attr: list[int]  # highest id that excludes a partner of this id
    rows: list  # level-1 sums

    @property
    def longest(self) -> int:
        """Upper bound for the length of an itemset."""
        return len(set(self.last_of_attr))


def _check(attributes, min_support, method, overlap):
    if min_support <= 0:
        raise ValueError(f"min_support must be positive, got {min_support}")
    if method not in ("auto", "single_pass", "level_wise"):
        raise ValueError(f"unknown method {method!r}")
    if overlap and method == "single_pass":
        raise ValueError("overlapping items of one attribute need the level-wise method")
    if len(set(attributes)) != len(attributes) or not attributes:
        raise ValueError("attributes must be distinct and not empty")


def _is_array(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def _values(df: DataFrame, name: str) -> Column:
    """Values of one attribute in a row as ``array<string>``."""
    col = F.col(f"`{name}`")
    if _is_array(df, name):
        return F.array_distinct(col.cast("array<string>"))
    return F.array(col.cast("string"))


def item_counts(df: DataFrame, attributes: list[str], measures: list[str], weight: str | None = None) -> DataFrame:
    """Rows and summed measures of every single value: ``(a, v, n, measures)``.

    ``a`` is the attribute's position.  ``weight`` names the row count of
    already grouped rows.
    """

    def tag(position, name):
        if not _is_array(df, name):
            return F.array(F.struct(F.lit(position).alias("a"), F.col(f"`{name}`").cast("string").alias("v")))
        return F.transform(_values(df, name), lambda v: F.struct(F.lit(position).alias("a"), v.alias("v")))

    tags = [tag(i, name) for i, name in enumerate(attributes)]
    count = F.col(weight) if weight else F.lit(1).cast("bigint")
    exploded = df.select(F.explode(F.concat(*tags)).alias("it"), count.alias("n"), *measures)
    return (
        exploded.where(F.col("it.v").isNotNull())
        .groupBy(F.col("it.a").alias("a"), F.col("it.v").alias("v"))
        .agg(*_resum(measures))
    )


def _sums(measures: list[str]) -> list[Column]:
    return [F.sum(m).alias(m) for m in measures]


def _resum(measures: list[str]) -> list[Column]:
    return [F.sum("n").alias("n"), *_sums(measures)]


def admit(items: DataFrame, keep: DataFrame | None, attr: str = "attr", item: str = "item") -> DataFrame:
    """Keep admitted items; attributes that ``keep`` does not name stay whole.

    ``keep`` has columns ``(attr, item)``; a NULL item lists an attribute of
    which nothing is admitted.
    """
    if keep is None:
        return items
    listed = keep.select(F.col("attr").alias("_la")).distinct().withColumn("_listed", F.lit(True))
    admitted = (
        keep.where(F.col("item").isNotNull())
        .select(F.col("attr").alias("_ka"), F.col("item").alias("_ki"))
        .distinct()
        .withColumn("_kept", F.lit(True))
    )
    return (
        items.join(listed, F.col(attr) == F.col("_la"), "left")
        .join(admitted, (F.col(attr) == F.col("_ka")) & (F.col(item) == F.col("_ki")), "left")
        .where(F.col("_listed").isNull() | F.col("_kept").isNotNull())
        .select(*items.columns)
    )


def _group_rows(df: DataFrame, attributes: list[str], measures: list[str], weight: str | None):
    """Totals of the table, and its rows with equal values summed where that pays.

    Grouping whole rows is worth its shuffle when few combinations occur; an
    approximate distinct count, taken along with the totals, tells.
    """
    columns = [F.col(f"`{a}`") for a in attributes]
    count = F.col(f"`{weight}`") if weight else F.lit(1).cast("bigint")
    whole = df.agg(
        F.sum(count).alias("n"),
        *_sums(measures),
        F.approx_count_distinct(F.xxhash64(*columns)).alias("_combinations"),
    ).first()
    if not whole["n"]:
        raise ValueError("the table has no rows")
    rows = df.select(*columns, count.alias("n"), *measures)
    if whole["_combinations"] * _WORTH_GROUPING <= whole["n"]:
        rows = materialize(rows.groupBy(*columns).agg(*_resum(measures)), "grouped")
    return whole, rows


def _frequent_items(counts, attributes, measures, total, min_support, closure, keep, overlap):
    spark = counts.sparkSession
    names = small_table(
        spark,
        pa.schema([("a", pa.int32()), ("attr", pa.string())]),
        list(enumerate(attributes)),
    )
    leaves = counts.join(names, "a").select("attr", "v", "n", *measures)
    items = leaves.withColumn("item", F.col("v"))
    chains = None
    if closure is not None:
        ancestors = leaves.join(
            closure.select("attr", F.col("leaf").alias("v"), F.col("item").alias("item")).distinct(), ["attr", "v"]
        ).where(F.col("item") != F.col("v"))
        items = items.unionByName(ancestors)
        chains = items.select("attr", "v", "item")
    items = admit(items, keep).groupBy("attr", "item").agg(*_resum(measures))
    frequent = items.where(F.col("n") / F.lit(float(total)) >= F.lit(float(min_support))).collect()

    per_attr: dict[str, list] = {}
    for row in frequent:
        per_attr.setdefault(row["attr"], []).append(row)
    # attributes with many items first: the remaining items of a row then
    # collapse to few distinct combinations early
    order = sorted(per_attr, key=lambda a: (-len(per_attr[a]), a))
    ids, last = [], []
    for a in order:
        rows = sorted(per_attr[a], key=lambda r: r["item"])
        end = len(ids) + len(rows)
        for r in rows:
            ids.append(r)
            last.append(len(ids) if overlap else end)
    return (
        _Items(
            attributes=order,
            names=[f"{r['attr']}={r['item']}" for r in ids],
            values=[r["item"] for r in ids],
            attr_of=[r["attr"] for r in ids],
            last_of_attr=last,
            rows=ids,
        ),
        chains,
    )


def _look_up(ids_of: Column, values: Column) -> Column:
    found = F.transform(values, lambda v: F.element_at(ids_of, v))
    return F.array_sort(F.array_compact(found))


def _encode(df, items: _Items, chains, taxonomic, measures):
    """Each attribute becomes ``array<int>`` of frequent item ids; equal rows are summed."""
    spark = df.sparkSession
    encoded = df.select(*[F.col(f"`{a}`") for a in items.attributes], "n", *measures)
    dictionary = small_table(
        spark,
        pa.schema([("attr", pa.string()), ("item", pa.string()), ("id", pa.int32())]),
        [(a, v, i + 1) for i, (a, v) in enumerate(zip(items.attr_of, items.values))],
    )
    codes = []
    for pos, a in enumerate(items.attributes):
        code = f"_code{pos}"
        codes.append(code)
        own = [(v, i + 1) for i, (x, v) in enumerate(zip(items.attr_of, items.values)) if x == a]
        if _is_array(df, a):
            ids_of = F.map_from_arrays(string_literals([v for v, _ in own]), int_literals([i for _, i in own]))
            encoded = encoded.withColumn(code, _look_up(ids_of, _values(df, a)))
            continue
        if a not in taxonomic and len(own) <= _SHORT_LIST:
            # ids of an attribute are consecutive, in the order of the list
            place = F.array_position(string_literals([v for v, _ in own]), F.col(f"`{a}`").cast("string"))
            found = F.when(place > 0, F.array((place + (own[0][1] - 1)).cast("int")))
            encoded = encoded.withColumn(code, found)
            continue
        if a in taxonomic:
            lookup = (
                chains.where(F.col("attr") == a)
                .join(dictionary, ["attr", "item"])
                .groupBy(F.col("v").alias(f"_v{pos}"))
                .agg(F.array_sort(F.collect_set("id")).alias(code))
            )
        else:
            lookup = dictionary.where(F.col("attr") == a).select(
                F.col("item").alias(f"_v{pos}"), F.array("id").alias(code)
            )
        encoded = encoded.join(lookup, F.col(f"`{a}`").cast("string") == F.col(f"_v{pos}"), "left").drop(f"_v{pos}")
    return encoded.groupBy(*codes).agg(*_resum(measures)), codes


def _single_pass(compressed, codes, items, measures, frequent_enough, max_len):
    """One grouping over every combination of 'attribute absent' and its items."""
    rows = compressed
    none = F.array(F.lit(None).cast("int"))
    for c in codes:
        rows = rows.withColumn(c, F.explode(F.when(F.col(c).isNull(), none).otherwise(F.concat(none, F.col(c)))))
    grouped = rows.groupBy(*codes).agg(*_resum(measures)).where(frequent_enough)
    ids = F.array_compact(F.array(*codes))
    longest = len(codes) if max_len is None else max_len
    return grouped.select(ids.alias("ids"), "n", *measures).where(F.size("ids").between(1, longest))


class _Best:
    """The best k itemsets seen so far, and what may still lead to better ones.

    Holds k rows.  The k-th metric is a threshold that only rises; an itemset whose
    bound lies below it has no superset among the best, whatever is counted later.
    """

    def __init__(self, metric, k, min_support, singles, schema, total):
        self.metric, self.k, self.schema, self.total = metric, k, schema, total
        self.spark = singles.sparkSession
        self.rows, self.threshold = [], None
        everything = singles.where(F.size("itemset") == 0)
        self.root = tuple(everything.first())
        sums = dict(zip(["support_count", *schema.names[2:]], self.root[1:]))
        self._bound = optimistic(metric, max(1, ceil(min_support * total - 1e-6)), sums, n="n")
        bounded = singles.where(F.size("itemset") == 1)
        bound = F.lit(float("inf")) if self._bound is None else self._bound
        self.of_item = {r[0][0]: r[1] for r in bounded.select("itemset", bound.alias("b")).collect()}
        self.see(bounded)

    def see(self, level: DataFrame) -> None:
        """Merge the best of a level (``itemset, n, measures``)."""
        seen = small_table(self.spark, self.schema, [self.root, *self.rows]).unionByName(level.select(*self.schema.names))
        score = with_outcome_divergence(_shaped(seen, self.schema.names[2:], self.total), keep_sums=True) if (
            self.metric == "d_outcome"
        ) else with_divergence(_shaped(seen, self.schema.names[2:], self.total), [self.metric], significance=False)
        best = top_k(score, self.metric, self.k).where("length > 0").collect()
        self.rows = [(r["itemset"], r["support_count"], *[r[m] for m in self.schema.names[2:]]) for r in best]
        values = [r[self.metric] for r in best if r[self.metric] is not None]
        if len(values) == self.k:
            self.threshold = min(values) - 1e-9 * max(1.0, abs(min(values)))

    def may_lead(self) -> Column:
        """Over ``n`` and the measures: may a superset be among the best."""
        if self._bound is None or self.threshold is None:
            return F.lit(True)
        return self._bound >= F.lit(self.threshold)

    def items(self, names: list[str]) -> list[int]:
        """Ids of the items that may be part of a better itemset."""
        return [i + 1 for i, x in enumerate(names) if self.threshold is None or self.of_item[x] >= self.threshold]

    def result(self) -> DataFrame:
        return small_table(self.spark, self.schema, [self.root, *self.rows])


def _level_wise(compressed, codes, items, measures, frequent_enough, max_len, best=None):
    """Grow itemsets by one item per level.

    The state is ``(ids, tail)``: an itemset and the items that may still extend
    it in the rows it covers.  Rows with the same pair are summed, so the state
    shrinks as tails get shorter.  With ``best`` only itemsets and items that may
    lead to one of the best are extended, and only those are returned.
    """
    last_of_attr = int_literals(items.last_of_attr)
    sums = ["n", *measures]

    def extended(state):
        return state.select(
            "ids", "tail", F.explode("tail").alias("item"), *sums
        ).select(F.concat("ids", F.array("item")).alias("ids"), "tail", "item", *sums)

    def shorten(rows):
        beyond = F.element_at(last_of_attr, F.col("item"))
        return rows.withColumn("bound", beyond).select(
            "ids", F.filter("tail", lambda x: x > F.col("bound")).alias("tail"), *sums
        ).where(F.size("tail") > 0)

    def promising(tail):
        if best is None:
            return tail
        ids = best.items(items.names)
        return tail if len(ids) == len(items.names) else F.array_intersect(tail, int_literals(ids) if ids else empty)

    empty = F.array().cast("array<int>")
    names = string_literals(items.names)
    longest = items.longest if max_len is None else min(max_len, items.longest)
    tail = promising(F.array_sort(F.concat(*[F.coalesce(F.col(c), empty) for c in codes])))
    start = compressed.select(empty.alias("ids"), tail.alias("tail"), *sums)
    state = materialize(
        shorten(extended(start)).groupBy("ids", "tail").agg(*_resum(measures)), "state"
    )
    grown, length = [], 2
    while True:
        candidates = extended(state)
        level = materialize(
            candidates.groupBy("ids").agg(*_resum(measures)).where(frequent_enough), f"level{length}"
        )
        if level.isEmpty():
            break
        if best is None:
            grown.append(level)
        else:
            best.see(level.withColumn("itemset", _decoded(names)))
            candidates = candidates.withColumn("tail", promising(F.col("tail")))
            level = level.where(best.may_lead())
        if length == longest:
            break
        state = materialize(
            shorten(candidates.join(level.select("ids"), "ids", "left_semi"))
            .groupBy("ids", "tail")
            .agg(*_resum(measures)),
            "state",
        )
        length += 1
    return grown


def _decoded(names: Column) -> Column:
    return F.array_sort(F.transform("ids", lambda i: F.element_at(names, i)))


def _shaped(found: DataFrame, measures: list[str], total: int) -> DataFrame:
    """``itemset, key, length, support, support_count, measures`` of ``itemset, n, measures``."""
    return found.select(
        "itemset",
        F.array_join("itemset", ", ").alias("key"),
        F.size("itemset").alias("length"),
        (F.col("n") / F.lit(float(total))).alias("support"),
        F.col("n").alias("support_count"),
        *measures,
    )


def mine(
    df: DataFrame,
    attributes: list[str],
    measures: list[str],
    min_support: float,
    *,
    closure: DataFrame | None = None,
    keep: DataFrame | None = None,
    max_len: int | None = None,
    overlap: bool = False,
    method: str = "auto",
    weight: str | None = None,
) -> DataFrame:
    """All itemsets with ``rows / total >= min_support`` and their summed measures.

    An attribute column holds one value per row, or ``array<string>`` when a row
    may have several (pass ``overlap=True`` to let them meet in one itemset).
    NULL gives no item.  ``closure (attr, leaf, item)`` adds the ancestors of a
    value as further items of its attribute.  ``weight`` names a column with the
    number of rows that each row stands for; its measures are then sums already.

    Output: ``itemset, key, length, support, support_count, measures``.  The row
    of the empty itemset is the whole table and is always present.
    """
    return _mine(df, attributes, measures, min_support, closure, keep, max_len, overlap, method, weight)


def mine_top_k(
    df: DataFrame,
    attributes: list[str],
    measures: list[str],
    min_support: float,
    metric: str,
    k: int,
    *,
    closure: DataFrame | None = None,
    keep: DataFrame | None = None,
    max_len: int | None = None,
    overlap: bool = False,
    method: str = "auto",
    weight: str | None = None,
) -> DataFrame:
    """What ``top_k`` keeps of the itemsets with their metric, without mining them all.

    While itemsets grow, the k-th best so far is compared with a bound of the metric
    over every superset that is still frequent; what cannot reach it is not extended.
    ``metric`` is a divergence over the cells, or ``d_outcome`` with measures ``y, y2``;
    metrics without a bound are mined whole.  Output as :func:`mine`.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
    _check_k(metric, k)
    return _mine(df, attributes, measures, min_support, closure, keep, max_len, overlap, method, weight, (metric, k))


def _mine(df, attributes, measures, min_support, closure, keep, max_len, overlap, method, weight, ranking=None):
    _check(attributes, min_support, method, overlap)
    spark = df.sparkSession
    df = df.select(*[attribute(df, a).alias(a) for a in attributes], *measures, *([weight] if weight else []))
    root, rows = _group_rows(df, attributes, measures, weight)
    total = root["n"]
    counts = item_counts(rows, attributes, measures, weight="n")
    if closure is not None:
        counts = materialize(counts, "items")
    items, chains = _frequent_items(
        counts, attributes, measures, total, min_support, closure, keep, overlap
    )
    schema = pa.schema(
        [("itemset", pa.list_(pa.string())), ("n", pa.int64())]
        + [(m, arrow_type(counts.schema[m].dataType)) for m in measures]
    )
    singles = small_table(
        spark,
        schema,
        [([], root["n"], *[root[m] for m in measures])]
        + [([name], r["n"], *[r[m] for m in measures]) for name, r in zip(items.names, items.rows)],
    )
    found = [singles]
    best = _Best(*ranking, min_support, singles, schema, total) if ranking else None
    if items.longest > 1 and max_len != 1:
        ancestors = _ancestor_counts(closure)
        compressed, codes = _encode(rows, items, chains, set(ancestors), measures)
        frequent_enough = F.col("n") / F.lit(float(total)) >= F.lit(float(min_support))
        if method == "auto":
            combinations = reduce(
                lambda x, a: x * (1 + min(items.attr_of.count(a), 1 + ancestors.get(a, 0))), items.attributes, 1
            )
            method = "single_pass" if combinations <= SINGLE_PASS_LIMIT and not overlap else "level_wise"
        names = string_literals(items.names)
        if method == "single_pass":
            longer = [_single_pass(compressed, codes, items, measures, frequent_enough, max_len)]
        else:
            longer = _level_wise(compressed, codes, items, measures, frequent_enough, max_len, best)
        for level in longer:
            found.append(
                level.where(F.size("ids") > 1).select(_decoded(names).alias("itemset"), "n", *measures)
            )
            if best is not None:
                best.see(found[-1])
    if best is not None:
        return _shaped(best.result(), measures, total)
    return materialize(_shaped(reduce(DataFrame.unionByName, found), measures, total), "itemsets")


def _ancestor_counts(closure: DataFrame | None) -> dict[str, int]:
    """Per attribute of the taxonomy, the largest number of ancestors of one value."""
    if closure is None:
        return {}
    per_leaf = closure.groupBy("attr", "leaf").agg(F.count(F.lit(1)).alias("n"))
    return {r["attr"]: r["n"] for r in per_leaf.groupBy("attr").agg(F.max("n").alias("n")).collect()}


def _check_k(metric: str, k: int) -> None:
    if not isinstance(metric, str):
        raise ValueError(f"metric must be a column name, got {metric!r}")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"k must be a positive integer, got {k!r}")


def top_k(itemsets: DataFrame, metric: str, k: int) -> DataFrame:
    """The k itemsets with the highest metric, plus the whole-table row."""
    _check_k(metric, k)
    best = (
        itemsets.where(F.col("length") > 0)
        .orderBy(F.col(metric).desc_nulls_last(), F.col("support").desc(), "length", "key")
        .limit(k)
    )
    return best.unionByName(itemsets.where(F.col("length") == 0))
