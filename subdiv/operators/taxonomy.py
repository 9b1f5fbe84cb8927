"""Taxonomies: edge tables ``(attr, child, parent)`` and their closure.

A taxonomy is metadata, but nothing here assumes it fits a driver: levels and
closure are iterated joins, one per hierarchy level.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.session import materialize, small_table

EDGE = ["attr", "child", "parent"]


def edges_from_dict(spark: SparkSession, taxonomy: dict) -> DataFrame:
    """Edges from ``{attr: {child: parent}}`` or ``{attr: {level: {child: parent}}}``.

    A parent may be a list of parents.
    """
    rows = []
    for attr, tree in taxonomy.items():
        levels = list(tree.values()) if tree and all(isinstance(v, dict) for v in tree.values()) else [tree]
        for level in levels:
            for child, parents in level.items():
                for parent in parents if isinstance(parents, (list, tuple, set, frozenset)) else [parents]:
                    rows.append((attr, str(child), str(parent)))
    schema = pa.schema([(c, pa.string()) for c in EDGE])
    return small_table(spark, schema, sorted(set(rows)))


def write_json(edges: DataFrame, path: str) -> None:
    """Write edges from the executors; every line is a taxonomy ``{attr: {child: parent}}`` of one edge."""
    line = F.to_json(F.create_map("attr", F.create_map("child", "parent")))
    edges.select(*EDGE).distinct().select(line.alias("value")).write.text(path)


def edges_from_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Edges from JSON ``{attr: {child: parent}}``: one per file, or one per line with ``lines``."""
    text = spark.read.text(path, wholetext=not lines)
    parsed = text.select(F.from_json("value", "map<string,map<string,string>>").alias("t"))
    per_attr = parsed.select(F.explode("t").alias("attr", "tree"))
    return per_attr.select("attr", F.explode("tree").alias("child", "parent"))


def edges_to_dict(edges: DataFrame, max_edges: int = 1_000_000) -> dict:
    """The inverse of :func:`edges_from_dict` for a taxonomy of checked size."""
    rows = edges.select(*EDGE).distinct().limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"taxonomy has more than {max_edges} edges")
    out: dict = {}
    for r in sorted(rows):
        parents = out.setdefault(r["attr"], {}).setdefault(r["child"], [])
        parents.append(r["parent"])
    return {a: {c: p[0] if len(p) == 1 else p for c, p in t.items()} for a, t in out.items()}


def _paths(edges: DataFrame) -> DataFrame:
    """Every value above another one with the longest way there: ``(attr, low, high, hops)``.

    Every round joins ways to ways, so a taxonomy of n levels takes log2(n) rounds
    and one that changes nothing.
    """
    known = materialize(edges.select("attr", F.col("child").alias("low"), F.col("parent").alias("high"), F.lit(1).alias("hops")).distinct(), "paths")
    before = None
    while True:
        now = known.agg(F.count(F.lit(1)).alias("n"), F.sum("hops").alias("hops"), F.count_if(F.col("low") == F.col("high")).alias("loops")).first()
        if now["loops"]:
            sample = [(r["attr"], r["low"]) for r in known.where("low = high").limit(3).collect()]
            raise ValueError(f"the taxonomy has a cycle, for example through {sample}")
        if now == before or not now["n"]:
            return known
        before = now
        on = known.select("attr", F.col("low").alias("high"), F.col("high").alias("top"), F.col("hops").alias("more"))
        joined = known.join(on, ["attr", "high"]).select("attr", "low", F.col("top").alias("high"), (F.col("hops") + F.col("more")).alias("hops"))
        known = materialize(known.unionByName(joined).groupBy("attr", "low", "high").agg(F.max("hops").alias("hops")), "paths")


def levels(edges: DataFrame) -> DataFrame:
    """Order children before parents: ``(attr, child, parent, level)``.

    Level 1 children are nobody's parent; a child's level is one above the
    highest of its own children.  A cycle raises ``ValueError``.
    """
    below = _paths(edges).groupBy("attr", F.col("high").alias("child")).agg(F.max("hops").alias("below"))
    return edges.select(*EDGE).distinct().join(below, ["attr", "child"], "left").select(*EDGE, (F.coalesce("below", F.lit(0)) + 1).alias("level"))


def closure(edges: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Every value with each of its ancestors: ``(attr, leaf, item)``.

    ``leaves (attr, leaf)`` restricts the result to values present in the data;
    a taxonomy entry that the data lacks then yields nothing.  A cycle raises
    ``ValueError``, wherever it is.
    """
    reach = _paths(edges).select("attr", F.col("low").alias("leaf"), F.col("high").alias("item"))
    if leaves is not None:
        reach = reach.join(leaves.select("attr", "leaf").distinct(), ["attr", "leaf"], "left_semi")
    return reach


def only_attributes(edges: DataFrame, attributes: list[str]) -> DataFrame:
    return edges.where(F.col("attr").isin(attributes))


def merge(tree_edges: DataFrame, external: DataFrame) -> DataFrame:
    """Union in which the external taxonomy replaces an attribute's own edges."""
    covered = external.select("attr").distinct()
    return tree_edges.select(*EDGE).join(covered, "attr", "left_anti").select(*EDGE).unionByName(
        external.select(*EDGE)
    )


def from_wide(table: DataFrame, attr: str, level_columns: list[str], collapse: dict[str, str] | None = None,
              extra: dict[str, str] | None = None) -> DataFrame:
    """Edges from a table with one column per level, most specific first.

    NULL levels are skipped, self loops dropped, and a child with two different
    parents raises.  ``collapse`` renames any child that contains a given text.
    """
    present = F.array_compact(F.array(*[F.col(f"`{c}`") for c in level_columns]))
    pairs = table.select(present.alias("p")).where(F.size("p") > 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(
            F.element_at("p", i).alias("child"), F.element_at("p", i + 1).alias("parent")))).alias("e")
    ).select("e.*")
    child = F.col("child")
    for part, name in (collapse or {}).items():
        child = F.when(F.col("child").contains(part), F.lit(name)).otherwise(child)
    pairs = pairs.select(child.alias("child"), "parent").where(F.col("child") != F.col("parent")).distinct()
    conflict = pairs.groupBy("child").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = conflict.first()
    if first is not None:
        raise ValueError(f"{first['child']!r} has more than one parent")
    out = pairs
    if extra:
        # manual entries replace what the table says about the same child
        manual = edges_from_dict(table.sparkSession, {attr: extra}).select("child", "parent")
        out = out.join(manual.select("child"), "child", "left_anti").unionByName(manual)
    return out.select(F.lit(attr).alias("attr"), "child", "parent")


def from_prefix(df: DataFrame, column: str, separator: str = "-", attr: str | None = None) -> DataFrame:
    """Parent of a value is its text before the separator; values without one have no parent."""
    value = F.col(f"`{column}`")
    return (
        df.select(value.alias("child"))
        .where(value.contains(separator))
        .distinct()
        .select(
            F.lit(attr or column).alias("attr"), "child", F.substring_index("child", separator, 1).alias("parent")
        )
    )


def unmatched_values(df: DataFrame, column: str, edges: DataFrame, slash_parent: str | None = None):
    """Treat values that the taxonomy does not know.

    Returns ``(edges, rows, deleted)``: edges extended by ``slash_parent`` for
    names of the form ``A/B``, the rows without the remaining unknown values,
    and the row count per deleted value.
    """
    value = F.col(f"`{column}`")
    known = edges.where(F.col("attr") == column).select(F.col("child").alias("_known")).distinct()
    # counted before joining, so one frequent value is one row here
    counts = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    unknown = materialize(counts.join(known, F.col("value") == F.col("_known"), "left_anti"), "unknown")
    has_parent = F.col("value").contains("/") if slash_parent is not None else F.lit(False)
    added = unknown.where(has_parent).select(
        F.lit(column).alias("attr"), F.col("value").alias("child"), F.lit(slash_parent).cast("string").alias("parent")
    )
    deleted = unknown.where(~has_parent)
    gone = deleted.select(F.col("value").alias("_gone_value"))
    rows = df.join(gone, value == F.col("_gone_value"), "left_anti")
    return edges.select(*EDGE).unionByName(added), rows, deleted


def to_json_text(taxonomy: dict) -> str:
    return json.dumps(taxonomy, sort_keys=True)
