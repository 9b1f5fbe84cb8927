"""Per-row targets: confusion cells, log loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_cells(true: Column, predicted: Column, negative, positive) -> dict[str, Column]:
    """0/1 columns tn, fp, fn, tp.

    A NULL prediction is a wrong one; a NULL true label lands in no cell.
    """
    same = F.coalesce(true == predicted, F.lit(False))
    is_n = F.coalesce(true == F.lit(negative), F.lit(False))
    is_p = F.coalesce(true == F.lit(positive), F.lit(False))

    def bit(c):
        return c.cast("int").cast("bigint")

    return {"tn": bit(same & is_n), "fp": bit(~same & is_n), "fn": bit(~same & is_p), "tp": bit(same & is_p)}


def class_map(df: DataFrame, true: str, predicted: str | None = None) -> dict:
    """The two labels, sorted: the first is negative.  More than two raise."""
    labels = df.select(F.col(true).alias("label"))
    if predicted is not None:
        labels = labels.unionByName(df.select(F.col(predicted).alias("label")))
    # at most two labels are valid, so three rows settle the question
    found = sorted(r["label"] for r in labels.where("label is not null").distinct().limit(3).collect())
    if len(found) != 2:
        raise ValueError(f"a binary problem needs two labels, found {found}{'...' if len(found) > 2 else ''}")
    return {"N": found[0], "P": found[1]}


def with_cells(df: DataFrame, true: str, predicted: str, classes: dict | None = None) -> DataFrame:
    classes = classes or class_map(df, true, predicted)
    return df.withColumns(
        confusion_cells(F.col(f"`{true}`"), F.col(f"`{predicted}`"), classes["N"], classes["P"])
    )


def with_outcome(df: DataFrame, target: str) -> DataFrame:
    """Columns ``y`` and ``y2``.  Use a DECIMAL target where sums must be exact."""
    y = F.col(f"`{target}`")
    return df.withColumns({"y": y, "y2": y * y})


def check_target(true=None, predicted=None, outcome=None) -> str:
    """Exactly one kind of target must be named."""
    if outcome is not None and (true is not None or predicted is not None):
        raise ValueError("give either class and prediction or an outcome, not both")
    if outcome is not None:
        return "outcome"
    if true is None or predicted is None:
        raise ValueError("give class and prediction, or an outcome")
    return "classification"


def check_criterion(kind: str, criterion: str) -> None:
    if kind == "outcome" and criterion == "entropy":
        raise ValueError("entropy needs a classification target")


def log_loss(y: Column, p: Column) -> Column:
    """Loss of the predicted probability ``p`` of the positive class, clipped off 0 and 1."""
    eps = 2.220446049250313e-16
    clipped = F.least(F.greatest(p.cast("double"), F.lit(eps)), F.lit(1.0 - eps))
    return -(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))
