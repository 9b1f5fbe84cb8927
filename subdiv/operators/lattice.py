"""Lattice of given itemsets: their subsets as nodes, immediate supersets as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdiv.operators.select import itemset_key
from subdiv.operators.subsets import explode_subsets


def nodes(itemsets: DataFrame, metric: str, targets: list[list[str]], digits: int = 4) -> DataFrame:
    """``(lattice, key, itemset, length, value, rounded)`` for each target's subsets."""
    wanted = itemsets.where(F.col("key").isin([itemset_key(t) for t in targets])).select(
        F.col("key").alias("lattice"), "itemset"
    )
    subsets = explode_subsets(wanted).select("lattice", F.col("subset_key").alias("key"))
    values = itemsets.select("key", "itemset", "length", F.col(metric).alias("value"))
    return subsets.join(values, "key").select(
        "lattice", "key", "itemset", "length", "value", F.bround("value", digits).alias("rounded")
    )


def edges(lattice_nodes: DataFrame) -> DataFrame:
    """``(lattice, parent, child, lower)``: the child has one item more; ``lower`` marks a smaller metric."""
    child = lattice_nodes.where("length > 0").select(
        "lattice", F.col("key").alias("child"), F.col("value").alias("child_value"), "itemset",
        F.explode("itemset").alias("item"),
    )
    child = child.withColumn("parent", F.array_join(F.array_remove("itemset", F.col("item")), ", "))
    parent = lattice_nodes.select("lattice", F.col("key").alias("parent"), F.col("value").alias("parent_value"))
    return child.join(parent, ["lattice", "parent"]).select(
        "lattice", "parent", "child", (F.col("child_value") < F.col("parent_value")).alias("lower")
    )


def lower_nodes(lattice_edges: DataFrame) -> DataFrame:
    """Nodes whose metric is below one of their parents'."""
    return lattice_edges.where("lower").select("lattice", F.col("child").alias("key")).distinct()


def groups(lattice_nodes: DataFrame, threshold: float, lower: DataFrame | None = None) -> DataFrame:
    """``(lattice, key, group)``; a node may be in several groups.

    ``greater``: rounded metric reaches the threshold in absolute terms.
    ``all_greater``: the smallest of those whose supersets all reach it too.
    ``lower``: see :func:`lower_nodes`.  ``normal``: none of these.
    """
    reaching = lattice_nodes.where(F.abs("rounded") >= threshold)
    below = lattice_nodes.where(F.abs("rounded") < threshold)
    # a subset of a node below the threshold has a superset below it
    spoiled = explode_subsets(below.select("lattice", "itemset")).select("lattice", F.col("subset_key").alias("key"))
    solid = reaching.join(spoiled.distinct(), ["lattice", "key"], "left_anti")
    inner = explode_subsets(solid.select("lattice", "key", "itemset"), strict=True).join(
        solid.select("lattice", F.col("key").alias("subset_key")), ["lattice", "subset_key"], "left_semi"
    )
    smallest = solid.join(inner.select("lattice", "key").distinct(), ["lattice", "key"], "left_anti")

    def named(df, group):
        return df.select("lattice", "key", F.lit(group).alias("group"))

    found = named(reaching, "greater").unionByName(named(smallest, "all_greater"))
    if lower is not None:
        found = found.unionByName(named(lower, "lower"))
    rest = lattice_nodes.join(found.select("lattice", "key").distinct(), ["lattice", "key"], "left_anti")
    return found.unionByName(named(rest, "normal"))
