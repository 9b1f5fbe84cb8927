"""Metric and significance columns of an itemset table.

Cells are the summed columns ``tn, fp, fn, tp``; ``support_count`` is the number
of rows.  Values of the whole table come from a scalar subquery, so no row is
collected and no join is planned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CELLS = ["tn", "fp", "fn", "tp"]
#: rate -> (numerator cells, denominator cells)
RATES = {
    "fpr": (["fp"], ["fp", "tn"]),
    "fnr": (["fn"], ["tp", "fn"]),
    "accuracy": (["tp", "tn"], ["tp", "tn", "fp", "fn"]),
    "ppv": (["tp"], ["tp", "fp"]),
    "tpr": (["tp"], ["tp", "fn"]),
    "tnr": (["tn"], ["tn", "fp"]),
    "npv": (["tn"], ["tn", "fn"]),
    "fdr": (["fp"], ["fp", "tp"]),
    "for": (["fn"], ["fn", "tn"]),
    "posr": (["tp", "fn"], ["tp", "tn", "fp", "fn"]),
    "negr": (["tn", "fp"], ["tp", "tn", "fp", "fn"]),
}
#: metric -> (successes, failures) of its Beta distribution
BETA_CELLS = {
    "d_fpr": (["fp"], ["tn"]),
    "d_fnr": (["fn"], ["tp"]),
    "d_accuracy": (["tp", "tn"], ["fp", "fn"]),
    "d_fpr_abs": (["fp"], ["tn"]),
    "d_fnr_abs": (["fn"], ["tp"]),
    "d_accuracy_abs": (["tp", "tn"], ["fp", "fn"]),
    "d_posr": (["tp", "fn"], ["tn", "fp"]),
    "d_negr": (["tn", "fp"], ["tp", "fn"]),
    "d_error": (["fp", "fn"], ["tp", "tn"]),
    "d_ppv": (["tp"], ["fp"]),
    "d_tpr": (["tp"], ["fn"]),
    "d_tnr": (["tn"], ["fp"]),
    "d_npv": (["tn"], ["fn"]),
    "d_fdr": (["fp"], ["tp"]),
    "d_for": (["fn"], ["tn"]),
}
FAIRNESS = ["SPsf", "FPsf", "FNsf", "ACsf"]
# ----------------------------------------------------------------------------

DIVERGENCES = [f"d_{r}" for r in RATES] + ["d_error"]
METRICS = (
    DIVERGENCES
    + ["d_fpr_abs", "d_fnr_abs", "d_accuracy_abs", "d_fpr_w", "d_fnr_w", "d_accuracy_w"]
    + FAIRNESS
    + ["d_outcome"]
)


def total(cells: list[str], get=F.col) -> Column:
    return reduce(lambda a, b: a + b, [get(c) for c in cells])


def rate(name: str, get=F.col) -> Column:
    """A rate from cells; 0/0 is 0."""
    if name == "error":
        right = F.coalesce(F.try_divide(total(["tn", "tp"], get), total(CELLS, get)), F.lit(0.0))
        return F.lit(1.0) - right
    num, den = RATES[name]
    return F.coalesce(F.try_divide(total(num, get), total(den, get)), F.lit(0.0))


def classification_error(get=F.col) -> Column:
    """Error in its direct form, (fp+fn)/all."""
    return F.coalesce(F.try_divide(total(["fp", "fn"], get), total(CELLS, get)), F.lit(0.0))


def beta_mean(metric: str, get=F.col) -> Column:
    a, b = _beta_parameters(metric, get)
    return a / (a + b)


def beta_variance(metric: str, get=F.col) -> Column:
    a, b = _beta_parameters(metric, get)
    return (a * b) / ((a + b) * (a + b) * (a + b + 1))


def beta_std(metric: str, get=F.col) -> Column:
    return F.sqrt(beta_variance(metric, get))


def _beta_parameters(metric: str, get):
    if metric not in BETA_CELLS:
        raise ValueError(f"{metric} has no Beta distribution; known: {sorted(BETA_CELLS)}")
    good, bad = BETA_CELLS[metric]
    return (1 + total(good, get)).cast("double"), (1 + total(bad, get)).cast("double")


def t_value(mean: Column, var: Column, mean0: Column, var0: Column) -> Column:
    """Distance of two means in units of their common spread; NULL when both are constant."""
    return F.try_divide(F.abs(mean - mean0), F.sqrt(var + var0))


def root_values(itemsets: DataFrame, columns: list[str]) -> Column:
    """The row of the whole table as one struct-valued scalar subquery."""
    return itemsets.where(F.col("length") == 0).select(F.struct(*columns).alias("root")).scalar()


def t_value_name(metric: str) -> str:
    return "t_value_" + metric.removeprefix("d_")


def with_divergence(itemsets: DataFrame, metrics: list[str], significance: bool = True) -> DataFrame:
    """Add base metrics, divergences from the whole table and t-values.

    Metrics that need another one (``_abs``, ``_w``) compute it themselves.
    Metrics without a Beta distribution get no t-value.
    """
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {METRICS}")
    if "d_outcome" in metrics:
        raise ValueError("d_outcome needs with_outcome_divergence")
    root = root_values(itemsets, [*CELLS, "support_count"])

    def at_root(cell):
        return root[cell]

    n_root = at_root("support_count")
    added: dict[str, Column] = {}

    def base_and_delta(name):
        if name == "posr":
            added["P"] = total(["tp", "fn"])
        if name == "negr":
            added["N"] = total(["tn", "fp"])
        added[name] = rate(name)
        added[f"d_{name}"] = rate(name) - rate(name, at_root)

    for metric in metrics:
        if metric in DIVERGENCES:
            base_and_delta(metric[2:])
        elif metric.endswith("_abs"):
            name = metric[2:-4]
            base_and_delta(name)
            added[metric] = F.abs(rate(name) - rate(name, at_root))
        elif metric.endswith("_w"):
            name = metric[2:-2]
            base_and_delta(name)
            share = F.col("support") if name == "accuracy" else total(RATES[name][1]) / n_root
            added[metric] = share * (rate(name) - rate(name, at_root))
        elif metric == "SPsf":
            here = total(["tp", "fp"]) / F.col("support_count")
            added[metric] = F.col("support") * F.abs(here - (at_root("tp") + at_root("fp")) / n_root)
        elif metric in ("FPsf", "FNsf"):
            name = "fpr" if metric == "FPsf" else "fnr"
            num, den = RATES[name]
            gap = F.abs(
                F.try_divide(total(num), total(den)) - F.try_divide(total(num, at_root), total(den, at_root))
            )
            added[metric] = total(den) / n_root * gap
        elif metric == "ACsf":
            added["accuracy"] = rate("accuracy")
            overall = (at_root("tp") + at_root("tn")) / n_root
            added["d_accuracy"] = rate("accuracy") - overall
            added[metric] = F.col("support") * F.abs(rate("accuracy") - overall)
    if significance:
        for metric in metrics:
            if metric in BETA_CELLS:
                added[t_value_name(metric)] = t_value(
                    beta_mean(metric), beta_variance(metric), beta_mean(metric, at_root), beta_variance(metric, at_root)
                )
    return itemsets.withColumns(added)


def outcome_variance(get=F.col, y="y", y2="y2") -> Column:
    """Population variance from the sums of y and y squared."""
    mean = outcome_mean(get, y)
    return get(y2).cast("double") / get("support_count") - mean * mean


def outcome_mean(get=F.col, y="y") -> Column:
    return get(y).cast("double") / get("support_count")


def with_outcome_divergence(itemsets: DataFrame, test: str = "welch", keep_sums: bool = False) -> DataFrame:
    """``outcome, d_outcome, t_value_outcome`` from the sums ``y`` and ``y2``.

    ``test="welch"`` divides each variance by its row count, ``"plain"`` does not.
    """
    if test not in ("welch", "plain"):
        raise ValueError(f"unknown test {test!r}")
    root = root_values(itemsets, ["y", "y2", "support_count"])

    def at_root(c):
        return root[c]

    def spread(get):
        return outcome_variance(get) / get("support_count") if test == "welch" else outcome_variance(get)

    out = itemsets.withColumns(
        {
            "outcome": outcome_mean(),
            "d_outcome": outcome_mean() - outcome_mean(at_root),
            "t_value_outcome": t_value(
                outcome_mean(),
                F.greatest(spread(F.col), F.lit(0.0)),
                outcome_mean(at_root),
                F.greatest(spread(at_root), F.lit(0.0)),
            ),
        }
    )
    return out if keep_sums else out.drop("y", "y2")


def optimistic(metric: str, fewest: int, root: dict, n: str = "support_count") -> Column | None:
    """Upper bound of a divergence over all subsets of an itemset's rows with ``fewest`` rows or more.

    A subset has at most the numerator's rows, and lost at most ``n - fewest`` of the
    others; the mean of an outcome is bounded by mean, variance and size.  ``root``
    holds the whole table's sums.  None for metrics without such a bound.
    """
    spare = F.col(n) - F.lit(fewest)
    if metric == "d_outcome":
        mean, square = outcome_mean(_renamed(n)), F.col("y2").cast("double") / F.col(n)
        # the last term covers what the difference of two large sums loses
        spread = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)) + 1e-12 * square)
        return mean + spread * F.sqrt(F.greatest(spare, F.lit(0)) / F.lit(fewest)) - float(root["y"]) / root["support_count"]
    name = metric.removeprefix("d_").removesuffix("_abs")
    if f"d_{name}" not in DIVERGENCES or metric not in (f"d_{name}", f"d_{name}_abs"):
        return None
    num, den = (["fp", "fn"], CELLS) if name == "error" else RATES[name]
    hits, others = total(num), total([c for c in den if c not in num])
    left = F.greatest(others - spare, F.lit(0))
    at_root = rate(name, lambda c: F.lit(root[c]))
    above = F.coalesce(F.try_divide(hits, hits + left), F.lit(0.0)) - at_root
    if metric == f"d_{name}":
        return above
    kept = F.greatest(hits - spare, F.lit(0))
    below = F.coalesce(F.try_divide(kept, kept + others), F.lit(0.0)) - at_root
    return F.greatest(F.abs(above), F.abs(below))


def _renamed(n: str):
    return lambda c: F.col(n if c == "support_count" else c)


def with_mean_ratio(itemsets: DataFrame, metric: str = "outcome") -> DataFrame:
    """Ratio to the whole table and support-weighted log ratio."""
    root = root_values(itemsets, [metric])
    ratio = F.try_divide(F.col(metric), root[metric])
    return itemsets.withColumns(
        {"ratio": ratio, "wlogr": F.col("support") * F.when(ratio > 0, F.log(ratio))}
    )
