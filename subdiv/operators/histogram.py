"""Distributed value histograms with running sums and exact order statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subdiv.session import materialize, small_table


def value_histogram(
    df: DataFrame,
    attributes: list[str],
    measures: list[str],
    *,
    keys: list[str] | None = None,
    text: set[str] | None = None,
    whole: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Rows and summed measures per attribute value, all attributes in one pass.

    Output ``(keys, a, v, s, n, measures)``: position of the attribute, numeric
    value or text value.  NULL and NaN are left out.  ``whole`` adds a row
    ``a = -1`` for the whole table.  ``weight`` names a column with the number of
    rows that each row stands for; its measures are then sums already.
    """
    keys, text = keys or [], text or set()

    def tagged(i, a):
        is_text = a in text
        return F.struct(
            F.lit(i).alias("a"),
            (F.lit(None) if is_text else F.col(f"`{a}`")).cast("double").alias("v"),
            (F.col(f"`{a}`") if is_text else F.lit(None)).cast("string").alias("s"),
        )

    values = [tagged(i, a) for i, a in enumerate(attributes)]
    if whole:
        values.append(F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("v"), F.lit(None).cast("string").alias("s")))
    present = (F.col("x.v").isNotNull() & ~F.isnan("x.v")) | F.col("x.s").isNotNull()
    return (
        df.select(*keys, F.explode(F.array(*values)).alias("x"), *([F.col(weight).alias("n")] if weight else []), *measures)
        .where(present)
        .groupBy(*keys, F.col("x.a").alias("a"), F.col("x.v").alias("v"), F.col("x.s").alias("s"))
        .agg((F.sum("n") if weight else F.count(F.lit(1))).alias("n"), *[F.sum(m).alias(m) for m in measures])
    )


def range_blocks(hist: DataFrame, keys: list[str]) -> DataFrame:
    """A histogram written in ranges of ``(keys, value)``; ``block`` numbers the ranges."""
    ordered = hist.repartitionByRange(*keys, "v", "s").withColumn("block", F.spark_partition_id())
    return materialize(ordered, "histogram")


def running_sums(blocks: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Add ``<sum>_le`` and the next larger value of the same key, ``next_v`` or ``next_s``.

    ``blocks`` comes from :func:`range_blocks`.  Sums run inside a block and are
    shifted by the totals of earlier blocks, of which there are as many as
    partitions.
    """
    totals = blocks.groupBy(*keys, "block").agg(
        F.min("v").alias("first_v"), F.min("s").alias("first_s"), *[F.sum(c).alias(f"{c}_block") for c in sums]
    )
    order = Window.partitionBy(*keys).orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "block",
        F.lead("first_v").over(order).alias("following_v"),
        F.lead("first_s").over(order).alias("following_s"),
        *[F.coalesce(F.sum(f"{c}_block").over(before), F.lit(0)).alias(f"{c}_before") for c in sums],
    )
    inside = Window.partitionBy(*keys, "block").orderBy("v", "s")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.select(
        *blocks.columns,
        F.lead("v").over(inside).alias("v_here"),
        F.lead("s").over(inside).alias("s_here"),
        *[F.sum(c).over(upto).alias(f"{c}_here") for c in sums],
    )
    return local.join(offsets, [*keys, "block"]).select(
        *[c for c in blocks.columns if c != "block"],
        F.coalesce("v_here", "following_v").alias("next_v"),
        F.coalesce("s_here", "following_s").alias("next_s"),
        *[(F.col(f"{c}_here") + F.col(f"{c}_before")).alias(f"{c}_le") for c in sums],
    )


def order_statistics(blocks: DataFrame, attributes: list[str], quantiles: dict[str, list[float]]) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(a, q, value)``.

    ``blocks`` holds a :func:`value_histogram` ranged by attribute.  The wanted
    ranks are a short list; each histogram row looks up which of them it covers.
    """
    spark = blocks.sparkSession
    counts = {
        r["a"]: r["n"] for r in blocks.groupBy("a").agg(F.sum("n").alias("n")).collect()
    }
    wanted = []
    for i, name in enumerate(attributes):
        for q in quantiles.get(name, []):
            if i in counts:
                position = q * (counts[i] - 1)
                low = int(position)
                wanted.append((i, float(q), low, min(low + 1, counts[i] - 1), position - low))
    schema = pa.schema(
        [("a", pa.int32()), ("q", pa.float64()), ("low", pa.int64()), ("high", pa.int64()), ("part", pa.float64())]
    )
    targets = small_table(spark, schema, wanted)
    ranks = (
        targets.select("a", F.explode(F.array("low", "high")).alias("k"))
        .groupBy("a")
        .agg(F.array_sort(F.collect_set("k")).alias("ranks"))
    )
    cumulated = running_sums(blocks, ["a"], ["n"])
    first = F.col("n_le") - F.col("n")
    hits = cumulated.join(ranks, "a").select(
        "a", "v", F.explode(F.filter("ranks", lambda k: (k >= first) & (k < F.col("n_le")))).alias("k")
    )
    hits = materialize(hits, "ranks")
    low = hits.select("a", F.col("k").alias("low"), F.col("v").alias("v_low"))
    high = hits.select("a", F.col("k").alias("high"), F.col("v").alias("v_high"))
    return (
        targets.join(low, ["a", "low"])
        .join(high, ["a", "high"])
        .select("a", "q", (F.col("v_low") + (F.col("v_high") - F.col("v_low")) * F.col("part")).alias("value"))
    )
