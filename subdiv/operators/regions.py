"""Scoring found intervals against known regions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.functions import intervals
from subdiv.session import small_table


def region_table(spark: SparkSession, patterns: list[dict]) -> DataFrame:
    """``[{attr: [[(rel, val), ...]]}]`` as ``(pattern, attr, lo, hi)``; an open end is NULL.

    More than one interval per attribute of a pattern raises.
    """
    rows = []
    for number, pattern in enumerate(patterns):
        for attr, conditions in pattern.items():
            if len(conditions) > 1:
                raise ValueError(f"{attr}: one interval per attribute of a pattern is supported")
            lo = hi = None
            for rel, val in conditions[0]:
                if rel in ("<", "<="):
                    hi = float(val)
                elif rel in (">", ">="):
                    lo = float(val)
                elif rel == "=":
                    lo = hi = float(val)
                else:
                    raise ValueError(f"unknown relation {rel!r}")
            rows.append((number, attr, lo, hi))
    schema = pa.schema(
        [("pattern", pa.int32()), ("attr", pa.string()), ("lo", pa.float64()), ("hi", pa.float64())]
    )
    return small_table(spark, schema, rows)


def close_bounds(ranges: DataFrame, min_max: DataFrame) -> DataFrame:
    """Open ends take the column's smallest or largest value."""
    bounds = min_max.select(F.col("attr"), F.col("min").alias("_min"), F.col("max").alias("_max"))
    return ranges.join(bounds, "attr", "left").withColumns(
        {"lo": F.coalesce("lo", "_min"), "hi": F.coalesce("hi", "_max")}
    ).drop("_min", "_max")


def interval_scores(true: DataFrame, found: DataFrame) -> DataFrame:
    """F-measure of every found interval for the true interval of its attribute."""
    f = found.select("attr", F.col("lo").alias("found_lo"), F.col("hi").alias("found_hi"))
    lo, hi, flo, fhi = F.col("lo"), F.col("hi"), F.col("found_lo"), F.col("found_hi")
    return true.join(f, "attr").withColumns(
        {
            "precision": intervals.precision(lo, hi, flo, fhi),
            "recall": intervals.recall(lo, hi, flo, fhi),
            "f_measure": intervals.f_measure(lo, hi, flo, fhi),
        }
    )


def best_intervals(true: DataFrame, found: DataFrame) -> DataFrame:
    """Best found interval per pattern and attribute; 0 where the attribute has none."""
    rank = F.struct((-F.col("f_measure")).alias("r"), "found_lo", "found_hi")
    best = (
        interval_scores(true, found)
        .groupBy("pattern", "attr")
        .agg(F.min(rank).alias("b"))
        .select("pattern", "attr", "b.found_lo", "b.found_hi", (-F.col("b.r")).alias("f_measure"))
    )
    return true.select("pattern", "attr").join(best, ["pattern", "attr"], "left").withColumn(
        "f_measure", F.coalesce("f_measure", F.lit(0.0))
    )


def pattern_similarity(true: DataFrame, found: DataFrame) -> DataFrame:
    """Mean best F-measure per pattern."""
    return best_intervals(true, found).groupBy("pattern").agg(F.avg("f_measure").alias("similarity"))


def itemset_ranges(itemsets: DataFrame) -> DataFrame:
    """``(key, attr, lo, hi)`` of the interval items of itemsets; other items are left out."""
    item = F.col("item")
    value = F.expr("substr(item, instr(item, '=') + 1)")
    # an item of a tree reads attr=<=v, attr=[a-b] and so on
    return (
        itemsets.select("key", F.explode("itemset").alias("item"))
        .select("key", F.substring_index(item, "=", 1).alias("attr"), intervals.item_range(value).alias("r"))
        .where("r.lo is not null or r.hi is not null")
        .select("key", "attr", "r.lo", "r.hi")
    )


def itemset_similarity(itemsets: DataFrame, true: DataFrame, min_max: DataFrame) -> DataFrame:
    """Similarity of each itemset to each pattern: ``(key, pattern, similarity)``.

    Every itemset is scored for every pattern, which are few and known beforehand; an
    attribute that it does not restrict counts 0.
    """
    found = close_bounds(itemset_ranges(itemsets), min_max)
    closed = close_bounds(true, min_max)
    scored = closed.join(
        found.select("key", "attr", F.col("lo").alias("flo"), F.col("hi").alias("fhi")), "attr"
    ).select(
        "key", "pattern",
        intervals.f_measure(F.col("lo"), F.col("hi"), F.col("flo"), F.col("fhi")).alias("f"),
    )
    width = true.groupBy("pattern").agg(F.count(F.lit(1)).alias("attrs"))
    patterns = true.agg(F.collect_set("pattern").alias("p")).scalar()
    wanted = itemsets.select("key", F.explode(patterns).alias("pattern"))
    totals = scored.groupBy("key", "pattern").agg(F.sum("f").alias("total"))
    return (
        wanted.join(totals, ["key", "pattern"], "left")
        .join(width, "pattern")
        .select("key", "pattern", (F.coalesce("total", F.lit(0.0)) / F.col("attrs")).alias("similarity"))
    )
