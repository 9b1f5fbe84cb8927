"""Attribute columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def attribute(df: DataFrame, name: str) -> Column:
    """An attribute's column; NaN counts as missing, as NULL does.

    Spark orders NaN above every number, so it would otherwise fall in the
    highest range.
    """
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col
