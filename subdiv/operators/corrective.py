"""Corrective items: items that bring a metric closer to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdiv.functions.metrics import beta_mean, beta_variance, t_value, t_value_name
from subdiv.operators.subsets import join_values


def corrective_items(marginal: DataFrame, squared: bool = False) -> DataFrame:
    """Marginals with ``|v(S+i)| < |v(S)|``, strongest first."""
    out = marginal.withColumns(
        {
            "corr_coef": F.abs("v_si") - F.abs("v_s"),
            "corr_coef_sq": F.col("v_si") * F.col("v_si") - F.col("v_s") * F.col("v_s"),
        }
    ).where("corr_coef < 0")
    return out.orderBy("corr_coef_sq" if squared else "corr_coef", "si_key", "item")


def strongest(corrective: DataFrame) -> DataFrame:
    """Per item the itemsets it corrects most, ties kept."""
    best = corrective.groupBy("item").agg(F.min("corr_coef").alias("best"))
    found = join_values(corrective, "item", 1, "si_key", best, 1).where("corr_coef = best")
    return found.select(*corrective.columns).orderBy("corr_coef", "item", "s_key")


def statistics(corrective: DataFrame, marginal: DataFrame) -> DataFrame:
    """Per item: spread and extremes of the coefficient, share of corrected itemsets, MSE, SSE.

    Always the same columns; among equal extremes the alphabetically first
    itemset is named.
    """
    square = F.col("delta") * F.col("delta")
    spread = corrective.groupBy("item").agg(
        F.avg("corr_coef").alias("mean"),
        F.stddev_samp("corr_coef").alias("std"),
        F.count("corr_coef").alias("count"),
        F.min(F.struct("corr_coef", "s_key")).alias("low"),
        F.min(F.struct((-F.col("corr_coef")).alias("c"), "s_key")).alias("high"),
        F.avg(square).alias("mse"),
        F.sum(square).alias("sse"),
    )
    tot = marginal.groupBy("item").agg(F.count(F.lit(1)).alias("tot"))
    return spread.join(tot, "item").select(
        "item",
        F.col("low.s_key").alias("s_min"),
        F.col("low.corr_coef").alias("corr_coef_min"),
        F.col("high.s_key").alias("s_max"),
        (-F.col("high.c")).alias("corr_coef_max"),
        "mean", "std", "count", "tot",
        (F.col("count") / F.col("tot")).alias("share"),
        "mse", "sse",
    )


def significance(corrective: DataFrame, itemsets: DataFrame, metric: str) -> DataFrame:
    """Add ``t_value_corr`` between S and S+i, the t-value of S+i and the corrective factor."""
    beta = itemsets.select("key", "length", beta_mean(metric).alias("m"), beta_variance(metric).alias("v"), t_value_name(metric))
    at_s = beta.select(F.col("key").alias("s_key"), F.col("length").alias("v_length"), F.col("m").alias("m_s"), F.col("v").alias("var_s"))
    at_si = beta.select(
        F.col("key").alias("si_key"), F.col("m").alias("m_si"), F.col("v").alias("var_si"),
        F.col(t_value_name(metric)).alias("t_value_si"),
    )
    return (
        join_values(corrective, "s_key", "s_length", "si_key", at_s, "v_length")
        .join(at_si, "si_key")
        .withColumns(
            {
                "t_value_corr": t_value(F.col("m_s"), F.col("var_s"), F.col("m_si"), F.col("var_si")),
                "corr_factor": F.abs("v_s") - F.abs("v_si"),
            }
        )
        .drop("m_s", "m_si", "var_s", "var_si")
    )


def significant(scored: DataFrame, positive_only: bool = False, at_least: float = 2.0) -> DataFrame:
    """Corrections with a t-value above 2; ``positive_only`` keeps those of a positive base."""
    out = scored.where(F.col("t_value_corr") > at_least)
    return out.where("v_s > 0") if positive_only else out


def corrected_itemsets(itemsets: DataFrame, significant_rows: DataFrame) -> DataFrame:
    """Itemsets with a significant corrective item, strongest correction first."""
    order = significant_rows.groupBy(F.col("si_key").alias("key")).agg(F.min("corr_coef").alias("corr_coef"))
    return itemsets.join(order, "key").orderBy("corr_coef", "key")
