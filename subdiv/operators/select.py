"""Queries on an itemset table: ranking, lookup, marginals, redundancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subdiv.operators.subsets import explode_subsets, join_values


def base_metric(metric: str) -> str:
    """Column that breaks ties of a divergence."""
    return metric.split("_")[1] if metric.startswith("d_") else metric


def ranked(itemsets: DataFrame, metric: str, absolute: bool = False) -> DataFrame:
    """Sorted by metric, then its base metric; or by absolute metric."""
    tie = base_metric(metric)
    order = [F.abs(metric).desc_nulls_last()] if absolute else [F.col(metric).desc_nulls_last()]
    if not absolute and tie in itemsets.columns and tie != metric:
        order.append(F.col(tie).desc_nulls_last())
    return itemsets.orderBy(*order, "key")


def top(itemsets: DataFrame, metric: str, k: int = 10, absolute: bool = False) -> DataFrame:
    return ranked(itemsets, metric, absolute).limit(k)


def above(itemsets: DataFrame, metric: str, threshold: float, absolute: bool = False, strict: bool = False) -> DataFrame:
    """Itemsets whose (absolute) metric reaches the threshold, or exceeds it when ``strict``."""
    value = F.abs(metric) if absolute else F.col(metric)
    return itemsets.where(value > threshold if strict else value >= threshold)


def above_top(itemsets, metric, threshold, k=10, absolute=False, strict=False) -> DataFrame:
    return top(above(itemsets, metric, threshold, absolute, strict), metric, k, absolute)


def itemset_key(items) -> str:
    return ", ".join(sorted(items))


def lookup(itemsets: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """Rows of given itemsets."""
    return itemsets.where(F.col("key").isin([itemset_key(w) for w in wanted]))


def key_values(itemsets: DataFrame, value: str) -> DataFrame:
    return itemsets.select("key", value)


def by_length(itemsets: DataFrame, metric: str) -> DataFrame:
    """Per length: number of itemsets and range of the metric."""
    return itemsets.groupBy("length").agg(
        F.count(F.lit(1)).alias("itemsets"), F.min(metric).alias("min"), F.max(metric).alias("max")
    )


def containing(itemsets: DataFrame, item: str) -> DataFrame:
    return itemsets.where(F.array_contains("itemset", item))


def singles_of(itemsets: DataFrame, items: list[str]) -> DataFrame:
    """Rows of the single items of one itemset."""
    return itemsets.where((F.col("length") == 1) & F.col("key").isin(list(items)))


def run_summary(itemsets: DataFrame, metric: str) -> DataFrame:
    """One row: highest metric and number of itemsets of a run."""
    return itemsets.agg(F.max(metric).alias("max_divergence"), F.count(F.lit(1)).alias("itemsets"))


# ---------------------------------------------------------------- marginals


def marginals(itemsets: DataFrame, metric: str) -> DataFrame:
    """What each item adds to each itemset.

    Output ``item, s_key, si_key, s_length, v_i, v_s, v_si, delta``: ``s`` is the
    itemset without the item, ``si`` the one with it.  Two equi-joins on keys, in
    which short itemsets and frequent items are dealt over several tasks.  Rows whose
    subset is not in the table (a top-k table, say) drop out, see
    :func:`missing_subsets`.
    """
    values = itemsets.select(F.col("key").alias("s_key"), F.col(metric).alias("v_s"), F.col("length").alias("v_length"))
    singles = itemsets.where("length = 1").select(F.col("key").alias("item"), F.col(metric).alias("v_i"))
    without = _without_each_item(itemsets, metric)
    found = join_values(without, "s_key", "s_length", "si_key", values, "v_length")
    return join_values(found, "item", 1, "si_key", singles, 1).select(
        "item", "s_key", "si_key", "s_length", "v_i", "v_s", "v_si", (F.col("v_si") - F.col("v_s")).alias("delta")
    )


def _without_each_item(itemsets: DataFrame, metric: str) -> DataFrame:
    return itemsets.where("length > 0").select(
        F.col("key").alias("si_key"),
        F.col(metric).alias("v_si"),
        (F.col("length") - 1).alias("s_length"),
        "itemset",
        F.explode("itemset").alias("item"),
    ).select(
        "item",
        F.array_join(F.array_remove("itemset", F.col("item")), ", ").alias("s_key"),
        "si_key", "s_length", "v_si",
    )


def missing_subsets(itemsets: DataFrame, metric: str) -> DataFrame:
    """One row: how many marginals lack their subset or single item."""
    known = itemsets.select(F.col("key").alias("s_key"))
    lacking = _without_each_item(itemsets, metric).join(known, "s_key", "left_anti")
    return lacking.agg(F.count(F.lit(1)).alias("missing"))


def not_redundant(itemsets: DataFrame, metric: str, threshold: float | None = 0.0) -> DataFrame:
    """Drop itemsets that contain an item adding at most ``threshold`` in absolute terms."""
    if threshold is None:
        return itemsets
    redundant = redundant_marginals(itemsets, metric, threshold).select(F.col("si_key").alias("key")).distinct()
    return itemsets.join(redundant, "key", "left_anti")


def redundant_marginals(itemsets: DataFrame, metric: str, threshold: float = 0.0) -> DataFrame:
    return marginals(itemsets, metric).where(F.abs("delta") <= threshold)


#: Items up to which the subsets of an itemset are listed; longer ones look for sets they contain.
LISTED_ITEMS = 8


def minimal(itemsets: DataFrame, metric: str) -> DataFrame:
    """Drop itemsets that have a strict subset with the very same metric value; NULLs form one group.

    Subsets of short itemsets are looked up by their keys.  A longer itemset meets, by each
    of its items, the sets of its value that have this item as their rarest one, and is
    compared with those.
    """
    valued = itemsets.select("key", "itemset", "length", F.col(metric).alias("value"))
    value = valued.select(F.col("key").alias("subset_key"), F.col("value").alias("subset_value"), F.col("length").alias("v_length"))
    short = explode_subsets(valued.where(F.col("length") <= LISTED_ITEMS).select("key", "itemset", "value"), strict=True)
    listed = join_values(short, "subset_key", "subset_length", "key", value, "v_length").where(F.col("value").eqNullSafe(F.col("subset_value")))
    covered = listed.select("key").unionByName(_containing(valued, F.col("length") > LISTED_ITEMS))
    return itemsets.join(covered.distinct(), "key", "left_anti")


def _containing(valued: DataFrame, which: Column) -> DataFrame:
    """Keys of the chosen itemsets that contain another one with the same value."""
    items = valued.select("key", "length", F.explode("itemset").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    rarest = join_values(items, "item", 1, "key", often, 1).groupBy("key").agg(F.min(F.struct("often", "item")).alias("r"))
    contained = valued.join(rarest, "key", "left").select(
        F.coalesce("r.item", F.lit("")).alias("item"), F.col("itemset").alias("inner"), F.col("length").alias("inner_length"), F.col("value").alias("inner_value")
    )
    # the empty itemset is met by an item that no itemset has
    asking = valued.where(which).select("key", "itemset", "length", "value", F.explode(F.concat("itemset", F.array(F.lit("")))).alias("item"))
    pairs = asking.join(contained, (asking["item"] == contained["item"]) & F.col("value").eqNullSafe(F.col("inner_value")) & (F.col("inner_length") < F.col("length")))
    return pairs.where(F.size(F.array_except("inner", "itemset")) == 0).select("key").distinct()


def strongest_negative(marginal: DataFrame) -> DataFrame:
    """Per item the marginals that lower the metric most, ties kept."""
    return _extreme(marginal.where("delta < 0"), F.min)


def strongest_positive(marginal: DataFrame) -> DataFrame:
    return _extreme(marginal.where("delta > 0"), F.max)


def _extreme(rows: DataFrame, which, value: str = "delta") -> DataFrame:
    best = rows.groupBy("item").agg(which(value).alias("best"))
    return join_values(rows, "item", 1, "si_key", best, 1).where(F.col(value) == F.col("best")).drop("best")


def marginal_statistics(marginal: DataFrame) -> DataFrame:
    """Per item: mean, std, count, extremes with their itemset and multiplicity, MSE, SSE.

    Among equal extremes the alphabetically first itemset is named.
    """
    square = F.col("delta") * F.col("delta")
    spread = marginal.groupBy("item").agg(
        F.avg("delta").alias("mean"),
        F.stddev_samp("delta").alias("std"),
        F.count("delta").alias("count"),
        F.avg(square).alias("mse"),
        F.sum(square).alias("sse"),
    )
    ties = marginal.groupBy("item", "delta").agg(F.count(F.lit(1)).alias("n"), F.min("s_key").alias("s"))
    ends = ties.groupBy("item").agg(
        F.min("delta").alias("delta_min"),
        F.min_by("s", "delta").alias("s_min"),
        F.min_by("n", "delta").alias("count_min"),
        F.max("delta").alias("delta_max"),
        F.max_by("s", "delta").alias("s_max"),
        F.max_by("n", "delta").alias("count_max"),
    )
    larger_low = F.abs("delta_min") > F.abs("delta_max")
    return spread.join(ends, "item").withColumn(
        "delta_abs_max", F.when(larger_low, F.col("delta_min")).otherwise(F.col("delta_max"))
    )


def sort_statistics(stats: DataFrame, by_mse: bool = False) -> DataFrame:
    return stats.orderBy(F.desc("mse") if by_mse else F.abs("delta_abs_max").desc(), "item")


def supersets(itemsets: DataFrame, metric: str) -> DataFrame:
    """Per itemset the itemsets with one more item."""
    return (
        _without_each_item(itemsets, metric)
        .groupBy("s_key")
        .agg(F.array_sort(F.collect_list("si_key")).alias("supersets"))
    )


# ------------------------------------------------------------------- slices


def slice_error_rates(df: DataFrame, slices: list[dict], true: str, predicted: str) -> DataFrame:
    """Error rate of given slices ``{attr: value}``: ``(slice, rows, errors, error_rate)``.

    Slices are a short list, such as the best ones of another tool; each row
    names the slices it lies in.  A slice without rows does not appear.
    """
    hits = []
    for i, s in enumerate(slices):
        test = F.lit(True)
        for a, v in s.items():
            if v is not None:
                test = test & (F.col(f"`{a}`").cast("string") == F.lit(str(v)))
        hits.append(F.when(test, F.lit(i)))
    wrong = (~F.col(f"`{true}`").eqNullSafe(F.col(f"`{predicted}`"))).cast("bigint")
    return (
        df.select(F.explode(F.array_compact(F.array(*hits))).alias("slice"), wrong.alias("wrong"))
        .groupBy("slice")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("wrong").alias("errors"))
        .withColumn("error_rate", F.col("errors") / F.col("rows"))
    )


def best_setting(stats: DataFrame, group: list[str], setting: str, score: str) -> DataFrame:
    """Per group the setting with the highest score; the smaller setting wins ties."""
    rank = F.struct((-F.col(score)).alias("r"), F.col(setting).alias("s"))
    return stats.groupBy(*group).agg(
        F.min_by(setting, rank).alias(setting), F.max(score).alias(score)
    )
