"""Result tables for readers: item text, rounding, renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIVERGENCE_SIGN = "Δ"


def abbreviate(text: Column, abbreviations: dict[str, str]) -> Column:
    """Replace parts of a text one after the other."""
    for long, short in abbreviations.items():
        text = F.replace(text, F.lit(long), F.lit(short))
    return text


def itemset_text(itemset: Column, abbreviations: dict[str, str] | None = None) -> Column:
    return abbreviate(F.array_join(F.array_sort(itemset), ", "), abbreviations or {})


def setting_text(name: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """Abbreviate a configuration name; underscores become blanks unless it starts with q_ or u_."""
    short = abbreviate(name, abbreviations or {})
    return F.when(F.substring(short, 1, 2).isin("q_", "u_"), short).otherwise(F.replace(short, F.lit("_"), F.lit(" ")))


def column_title(name: str) -> str:
    if name == "support":
        return "sup"
    if name.startswith("t_value"):
        return "t" + name[len("t_value"):]
    if name.startswith("d_"):
        return f"{DIVERGENCE_SIGN}_{name[2:]}"
    return name


def printable(
    df: DataFrame,
    abbreviations: dict[str, str] | None = None,
    decimals: tuple[int, int] | int = (2, 3),
) -> DataFrame:
    """Rounded and renamed: support to two digits, t-values to one, the rest to three; itemset first."""
    for_support, other = decimals if isinstance(decimals, tuple) else (decimals, decimals)
    columns = []
    for field in df.schema:
        col, name = F.col(f"`{field.name}`"), field.name
        if name == "key":
            continue
        if name == "itemset":
            columns.insert(0, itemset_text(col, abbreviations).alias("itemset"))
            continue
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            digits = for_support if name == "support" else 1 if name.startswith("t_value") else other
            col = F.bround(col, digits)
        columns.append(col.alias(column_title(name)))
    return df.select(*columns)
