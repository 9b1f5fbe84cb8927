"""Shapley values of items, inside an itemset and over the whole itemset table."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subdiv.operators.select import itemset_key
from subdiv.operators.subsets import explode_subsets, join_values


def _attr(item: Column) -> Column:
    return F.substring_index(item, "=", 1)



def local_shapley(itemsets: DataFrame, metric: str, targets: list[list[str]] | None = None) -> DataFrame:
    """Contribution of each item to the metric of its itemset: ``(key, item, shapley)``.

    For all itemsets, or for ``targets``.  Each subset is looked up once; an item
    inside the subset gets ``+w(|S|-1)`` of its value, one outside ``-w(|S|)``,
    with ``w(s) = s! (n-s-1)! / n!``.  NULL where a cut table lacks a subset.
    """
    wanted = itemsets.where("length > 0")
    if targets is not None:
        wanted = wanted.where(F.col("key").isin([itemset_key(t) for t in targets]))
    values = itemsets.select(F.col("key").alias("subset_key"), F.col(metric).alias("v"), F.col("length").alias("v_length"))
    subsets = join_values(explode_subsets(wanted.select("key", "itemset", "length")), "subset_key", "subset_length", "key", values, "v_length")
    shares = subsets.select(
        "key", "length", "v", "subset", "subset_length", F.explode("itemset").alias("item")
    )
    inside = F.array_contains("subset", F.col("item"))
    s = F.when(inside, F.col("subset_length") - 1).otherwise(F.col("subset_length"))
    weight = _weight(s, F.col("length"))
    signed = F.when(inside, weight * F.col("v")).otherwise(-weight * F.col("v"))
    whole = F.count(F.lit(1)) == F.pow(F.lit(2.0), F.max("length"))
    return shares.groupBy("key", "item").agg(F.when(whole, F.sum(signed)).alias("shapley"))


def _weight(s: Column, n: Column) -> Column:
    """``1 / (n * C(n-1, s))``, which equals s!(n-s-1)!/n! and stays in range for long itemsets."""
    # C(m, k) as a product of quotients
    m = n - 1
    steps = F.when(s > 0, F.sequence(F.lit(1), s)).otherwise(F.array().cast("array<int>"))
    choose = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (m - i + 1) / i)
    return F.lit(1.0) / (n * choose)


def _cardinalities(itemsets: DataFrame) -> dict[str, int]:
    """Number of frequent single items per attribute."""
    singles = itemsets.where("length = 1").select(_attr(F.element_at("itemset", 1)).alias("attr"))
    return {r["attr"]: r["count"] for r in singles.groupBy("attr").count().collect()}


def _product(items: Column, cardinality: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in cardinality.items() for x in (kv[0], float(kv[1]))]
    lookup = F.create_map(*pairs)
    return F.aggregate(items, F.lit(1.0), lambda acc, i: acc * F.element_at(lookup, _attr(i)))


def global_shapley(itemsets: DataFrame, metric: str, targets: list[list[str]] | None = None) -> DataFrame:
    """Contribution of items over all itemsets they extend: ``(key, shapley)``.

    For single items, or for ``targets`` of any length.  With ``J`` an itemset
    on other attributes, its share is ``v(J+I) - v(J)`` weighted by
    ``|J|! (a-|J|-|I|)! / (a! * product of items per attribute of J+I)``.
    """
    cardinality = _cardinalities(itemsets)
    a = len(cardinality)
    values = itemsets.select(F.col("key").alias("j_key"), F.col(metric).alias("v_j"))
    with_i = itemsets.where("length > 0").select("itemset", F.col(metric).alias("v_ji"))
    if targets is None:
        parts = with_i.select(
            "itemset", "v_ji", F.explode(F.transform("itemset", lambda x: F.array(x))).alias("i")
        )
    else:
        wanted = F.array(*[F.array(*[F.lit(x) for x in sorted(t)]) for t in targets])
        present = F.filter(wanted, lambda t: F.size(F.array_except(t, F.col("itemset"))) == 0)
        parts = with_i.select("itemset", "v_ji", F.explode(present).alias("i"))
    parts = parts.withColumn("j", F.array_except("itemset", "i"))
    # in overlap mode J may hold another range of an attribute of I
    foreign = F.size(F.array_intersect(F.transform("j", _attr), F.transform("i", _attr))) == 0
    parts = parts.where(foreign).withColumns(
        {
            "key": F.array_join(F.array_sort("i"), ", "),
            "j_key": F.array_join("j", ", "),
            "weight": _global_weight(F.size("j"), F.size("i"), a)
            / _product(F.array_union("j", "i"), cardinality),
        }
    )
    return (
        parts.join(values, "j_key")
        .groupBy("key")
        .agg(F.sum((F.col("v_ji") - F.col("v_j")) * F.col("weight")).alias("shapley"))
    )


def _global_weight(j: Column, i: Column, attributes: int) -> Column:
    """``|J|! (a-|J|-|I|)! / a!`` from a table over the possible sizes."""
    rows = []
    for size_i in range(1, attributes + 1):
        rows.append(
            F.array(
                *[
                    F.lit(factorial(size_j) * factorial(attributes - size_j - size_i) / factorial(attributes))
                    for size_j in range(attributes - size_i + 1)
                ]
            )
        )
    return F.element_at(F.element_at(F.array(*rows), i), j + 1)


def mean_shapley(marginal: DataFrame, single_items: int) -> DataFrame:
    """Weighted sum of all marginals of an item: ``(key, shapley)``.

    ``single_items`` is the number of frequent single items ``n``; a marginal
    over ``s`` other items weighs ``s! (n-s-1)! / n!``.
    """
    weight = _weight(F.col("s_length"), F.lit(single_items))
    return marginal.groupBy(F.col("item").alias("key")).agg(F.sum(weight * F.col("delta")).alias("shapley"))


def normalized(values: DataFrame, column: str = "shapley") -> DataFrame:
    """Divide by the largest absolute value."""
    largest = values.agg(F.max(F.abs(column)).alias("m")).scalar()
    return values.withColumn(column, F.try_divide(F.col(column), largest))


def compare(first: DataFrame, second: DataFrame, order_by: str = "first") -> DataFrame:
    """Two results side by side: ``(item, first, second)``, ordered by either."""
    if order_by not in ("first", "second"):
        raise ValueError(f"order_by must be 'first' or 'second', got {order_by!r}")
    a = first.select("item", F.col("shapley").alias("first"))
    b = second.select("item", F.col("shapley").alias("second"))
    return a.join(b, "item").orderBy(F.desc(order_by), "item")
