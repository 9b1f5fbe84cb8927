"""Split criteria of the divergence trees as column expressions.

A node is given by rows, numerator and denominator of its metric: ``num / den``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CRITERIA = [
    "divergence_criterion",
    "entropy",
    "weighted_sum_abs",
    "weighted_sum_pow",
    "weighted_max_abs",
    "weighted_max_pow",
]
#: metric -> (numerator cells, denominator cells)
NODE_METRICS = {
    "d_fpr": (["fp"], ["fp", "tn"]),
    "d_fnr": (["fn"], ["fn", "tp"]),
    "d_accuracy": (["tp", "tn"], ["tp", "tn", "fp", "fn"]),
    "d_error": (["fp", "fn"], ["tp", "tn", "fp", "fn"]),
}
# ----------------------------------------------------------------------------


def entropy_term(p: Column) -> Column:
    return F.when(p == 0, F.lit(0.0)).otherwise(-p * F.log2(p))


def entropy(p: Column) -> Column:
    return entropy_term(p) + entropy_term(1 - p)


def node_value(criterion: str, p: Column, parent: Column, baseline: Column) -> Column:
    """Value of one child: its metric is ``p``, its parent's ``parent``."""
    if criterion == "entropy":
        return entropy(p)
    if criterion == "divergence_criterion":
        return F.abs(p - parent)
    if criterion in ("weighted_sum_abs", "weighted_max_abs"):
        return F.abs(p - baseline)
    if criterion in ("weighted_sum_pow", "weighted_max_pow"):
        return (p - baseline) * (p - baseline)
    raise ValueError(f"unknown criterion {criterion!r}; known: {CRITERIA}")


def split_value(criterion: str, value1, value2, den1, den2, rows1, rows2, total) -> Column:
    """Value of a split from its children's values."""
    if criterion in ("entropy", "divergence_criterion"):
        den = den1 + den2
        return (den1 / den) * value1 + (den2 / den) * value2
    support1, support2 = rows1 / total, rows2 / total
    if criterion in ("weighted_sum_abs", "weighted_sum_pow"):
        return support1 * value1 + support2 * value2
    return F.greatest(support1 * value1, support2 * value2)


# Further scores of a pair of nodes; a free choice for ad-hoc split ranking.


def sum_abs(d1, d2):
    return F.abs(d1) + F.abs(d2)


def sum_pow(d1, d2):
    return d1 * d1 + d2 * d2


def pow_sum(d1, d2):
    return (d1 + d2) * (d1 + d2)


def max_abs(d1, d2):
    return F.greatest(F.abs(d1), F.abs(d2))


def weighted_log_ratio_sum(m1, m2, support1, support2, baseline):
    """Support-weighted |log2(metric / baseline)|; a metric of 0 counts 0."""

    def one(m):
        return F.when(m == 0, F.lit(0.0)).otherwise(F.abs(F.log2(m / baseline)))

    return support1 * one(m1) + support2 * one(m2)


def kl_divergence(p, q):
    """KL divergence of two Bernoulli distributions in nats; undefined terms are 0."""

    def term(a, b):
        return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(-a * F.ln(b / a))

    return term(p, q) + term(1 - p, 1 - q)


def kl_split(num1, den1, num2, den2, baseline):
    """KL divergence of both children from the baseline, weighted by their denominators."""
    den = den1 + den2
    return (den1 / den) * kl_divergence(num1 / den1, baseline) + (den2 / den) * kl_divergence(num2 / den2, baseline)


def kl_derived(weight, p, q):
    def term(a, b):
        return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(-F.ln(a / b))

    return weight * (term(p, q) + term(1 - p, 1 - q))


def kl_derived_split(num1, den1, num2, den2, num_root, den_root):
    """``kl_derived`` of both children with one added to every count."""
    q = (num_root + 1) / (den_root + 1)

    def one(num, den):
        return kl_derived((den + 1) / (den_root + 1), (num + 1) / (den + 1), q)

    return one(num1, den1) + one(num2, den2)


def log_ratio(p, q):
    """log2(p/q); NULL where it is undefined."""
    return F.when((p > 0) & (q > 0), F.log2(p / q))


def log_ratio_capped(p, q):
    """Log ratio that treats ratios below 1 as 2 - ratio; undefined is 0."""
    ratio = p / q
    return F.when((p == 0) | (q == 0), F.lit(0.0)).otherwise(
        F.when(ratio < 1, F.log2(2 - ratio)).otherwise(F.log2(ratio))
    )
