"""Table preparation: recodes, filters, bins, profiles, out-of-fold predictions."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subdiv.functions.values import attribute
from subdiv.operators.histogram import order_statistics, range_blocks, value_histogram
from subdiv.session import materialize, small_table

# ------------------------------------------------------------------ recodes


def recode(df: DataFrame, column: str, mapping: dict, to: str | None = None) -> DataFrame:
    """Replace values found in ``mapping``; others stay, and a None target makes NULL.

    Keys take the column's type, a None key stands for NULL, and keys that become
    equal raise.  The result keeps the column's type where all targets are of its
    kind and in its range; else it is text if either side is text, or the type that Spark
    widens both to.  One lookup join, whatever the size of the dictionary.
    """
    source, name = F.col(f"`{column}`"), to or column
    kind = df.schema[column].dataType
    keys = [None if k is None else str(k) for k in mapping]
    if len(set(keys)) < len(keys):
        raise ValueError("keys of the mapping repeat")
    if not keys:
        return df.withColumn(name, source)
    values = pa.array(list(mapping.values()))
    if pa.types.is_null(values.type):
        values = values.cast(pa.string())
    table = small_table(
        df.sparkSession,
        pa.schema([("__from", pa.string()), ("__to", values.type)]),
        list(zip(keys, values.to_pylist())),
    )
    new, old = F.col("__to"), source
    if _fits(values, kind):
        new = new.cast(kind)
    elif pa.types.is_string(values.type) or isinstance(kind, T.StringType):
        new, old = new.cast("string"), source.cast("string")
    key = F.col("__from").try_cast(kind)  # a key that the column cannot hold occurs nowhere
    table = table.where(F.col("__from").isNull() | key.isNotNull()).select(key.alias("__from"), new.alias("__to"), F.lit(True).alias("__found"))
    clash = table.groupBy("__from").count().where("count > 1").first()  # "1" and "01" are one integer
    if clash is not None:
        raise ValueError(f"keys of the mapping become equal as {kind.simpleString()}: {clash['__from']!r}")
    joined = df.join(table, source.eqNullSafe(F.col("__from")), "left")
    return joined.withColumn(name, F.when(F.col("__found"), F.col("__to")).otherwise(old)).drop("__from", "__to", "__found")


def _fits(values: pa.Array, kind: T.DataType) -> bool:
    """Whether a column of this type can hold the targets as they are."""
    if values.null_count == len(values):
        return True
    if pa.types.is_integer(values.type) and isinstance(kind, T.IntegralType):
        bits = {"tinyint": 8, "smallint": 16, "int": 32}.get(kind.simpleString(), 64)
        return all(-(1 << bits - 1) <= v < 1 << bits - 1 for v in values.drop_null().to_pylist())
    if pa.types.is_string(values.type):
        return isinstance(kind, T.StringType)
    numbers = pa.types.is_integer(values.type) or pa.types.is_floating(values.type)
    return numbers and isinstance(kind, T.DoubleType)


def exclude(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is not listed; NULL stays, as it is in no list."""
    return df.where(F.coalesce(~F.col(f"`{column}`").isin(values), F.lit(True)))


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


def fill_text(df: DataFrame, columns: list[str], text: str = "NaN") -> DataFrame:
    """NULL becomes a value of its own."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(text)) for c in columns})


def reshape(df: DataFrame, rename: dict[str, str] | None = None, drop=(), select=None) -> DataFrame:
    out = df.withColumnsRenamed(rename or {}).drop(*drop)
    return out.select(*[F.col(f"`{c}`") for c in select]) if select else out


def stack(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(F.to_date(end), F.to_date(start))


def threshold_label(col: Column, at_least, yes: str, no: str) -> Column:
    """``yes`` from the threshold on; NULL compares as false."""
    return F.when(col >= at_least, F.lit(yes)).otherwise(F.lit(no))


def above_label(col: Column, above, yes: str, no: str) -> Column:
    return F.when(col > above, F.lit(yes)).otherwise(F.lit(no))


# -------------------------------------------------------------- expert bins
# --- fixed values: bin edges and labels ------------------------------------


def prior_count_bin(x: Column) -> Column:
    return F.when(x <= 0, "0").when((x >= 1) & (x <= 3), "[1,3]").otherwise(">3")


def stay_length_bin(x: Column) -> Column:
    """Values above 7 and up to 8 fall in the last bin, as the middle one starts above 8."""
    return F.when(x <= 7, "<week").when((x > 8) & (x <= 93), "1w-3M").otherwise(">3Months")


def age_bin(x: Column) -> Column:
    return F.when(x < 25, "<25").when((x >= 25) & (x < 45), "[25-45]").otherwise(">45")


# ----------------------------------------------------------------------------


def edge_bin(x: Column, edges: list) -> Column:
    """Bins from one to three edges."""
    e = list(edges)
    if not 1 <= len(e) <= 3:
        raise ValueError("one to three edges are supported")
    out = F.when(x <= e[0], F.lit(f"<={e[0]}"))
    if len(e) == 1:
        return out.otherwise(F.lit(f">{e[0]}"))
    out = out.when((x > e[0]) & (x < e[1]), F.lit(f"({e[0]}-{e[1]})"))
    if len(e) == 3:
        out = out.when((x >= e[1]) & (x < e[2]), F.lit(f"[{e[1]}-{e[2]})"))
    return out.otherwise(F.lit(f">={e[-1]}"))


def zero_low_high(df: DataFrame, columns: list[str]) -> DataFrame:
    """``0``, ``Low``, ``High``: split at the median of the positive values."""
    slim = df.select(*[F.when(F.col(f"`{c}`") > 0, F.col(f"`{c}`")).alias(c) for c in columns])
    hist = range_blocks(value_histogram(slim, columns, []), ["a"])
    medians = {
        columns[r["a"]]: r["value"]
        for r in order_statistics(hist, columns, {c: [0.5] for c in columns}).collect()
    }

    def label(c):
        x = attribute(df, c).cast("double")
        return (
            F.when(x <= 0, "0")
            .when(x <= F.lit(medians.get(c, 0.0)), "Low")
            .when(x.isNotNull(), "High")
        )

    return df.withColumns({c: label(c) for c in columns})


# ------------------------------------------------------------ quantile bins


def _inner_edges(edges: list[float], round_v: int) -> list[float]:
    """Inner edges, rounded, without repetitions; bins of no width go first."""
    distinct = edges[:1] + [b for a, b in zip(edges, edges[1:]) if b - a > 1e-8]
    out: list[float] = []
    for e in distinct[1:-1]:
        r = round(e, round_v)
        if not out or out[-1] != r:
            out.append(r)
    return out


def bin_edges(
    df: DataFrame,
    attributes: list[str],
    bins: int = 3,
    strategy: str = "quantile",
    adaptive: bool = False,
    round_v: int = 0,
    approximate: bool = False,
    few: int = 10,
) -> dict[str, dict]:
    """Per attribute ``{"edges", "min", "max"}``; attributes with at most ``few`` values are left out.

    Quantiles are exact unless ``approximate``.  ``adaptive`` tries up to four
    more bins until the wanted number remains after rounding.
    """
    if strategy not in ("quantile", "uniform"):
        raise ValueError(f"unknown strategy {strategy!r}")
    slim = df.select(*[F.col(f"`{c}`") for c in attributes])
    hist = range_blocks(value_histogram(slim, attributes, []), ["a"])
    facts = {
        attributes[r["a"]]: r
        for r in hist.groupBy("a")
        .agg(F.count(F.lit(1)).alias("distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    }
    wide = [a for a in attributes if a in facts and facts[a]["distinct"] > few]
    counts = range(bins, bins + 5) if adaptive else [bins]
    grids: dict[tuple[str, int], list[float]] = {}
    if strategy == "uniform":
        for a in wide:
            lo, hi = facts[a]["lo"], facts[a]["hi"]
            for b in counts:
                grids[a, b] = [lo + (hi - lo) * i / b for i in range(b)] + [hi]
    else:
        wanted = sorted({i / b for b in counts for i in range(1, b)})
        values = _quantiles(slim, hist, attributes, wide, wanted, approximate)
        for a in wide:
            for b in counts:
                inner = [values[a, i / b] for i in range(1, b)]
                grids[a, b] = [facts[a]["lo"], *inner, facts[a]["hi"]]
    out = {}
    for a in wide:
        chosen = None
        for b in counts:
            edges = _inner_edges(grids[a, b], round_v)
            if not adaptive or len(edges) + 1 == bins:
                chosen = edges
                break
        if chosen is None:
            chosen = _inner_edges(grids[a, bins], round_v)
            warnings.warn(f"{a}: {len(chosen) + 1} bins instead of {bins}")
        out[a] = {"edges": chosen, "min": facts[a]["lo"], "max": facts[a]["hi"]}
    return out


def _quantiles(slim, hist, attributes, wide, wanted, approximate):
    if not wide:
        return {}
    if approximate:
        row = slim.agg(
            *[F.percentile_approx(F.col(f"`{a}`").cast("double"), wanted, 10_000).alias(f"q{i}") for i, a in enumerate(wide)]
        ).first()
        return {(a, q): v for i, a in enumerate(wide) for q, v in zip(wanted, row[f"q{i}"])}
    stats = order_statistics(hist, attributes, {a: wanted for a in wide}).collect()
    return {(attributes[r["a"]], r["q"]): r["value"] for r in stats}


def edge_labels(edges: list[float], round_v: int = 0) -> list[str]:
    text = [f"{e:.{round_v}f}" for e in edges]
    middle = [f"({a}-{b}]" for a, b in zip(text, text[1:])]
    return [f"<={text[0]}", *middle, f">{text[-1]}"]


def label_bins(x: Column, edges: list[float], round_v: int = 0) -> Column:
    labels = edge_labels(edges, round_v)
    out = F.when(x <= F.lit(edges[0]), F.lit(labels[0]))
    for e, label in zip(edges[1:], labels[1:]):
        out = out.when(x <= F.lit(e), F.lit(label))
    return out.when(x.isNotNull(), F.lit(labels[-1]))


def bin_columns(
    df: DataFrame,
    attributes: list[str] | None = None,
    bins: int = 3,
    strategy: str = "quantile",
    adaptive: bool = False,
    round_v: int = 0,
    approximate: bool = False,
    few: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Bin numeric columns; returns the table and its edges ``(attr, edges)``.

    Columns with at most ``few`` distinct values become strings and have no row among
    the edges; a column whose bins collapse to one is dropped with a warning.
    """
    numeric = [a for a in (attributes or df.columns) if isinstance(df.schema[a].dataType, T.NumericType)]
    found = bin_edges(df, numeric, bins, strategy, adaptive, round_v, approximate, few)
    dropped = [a for a, f in found.items() if not f["edges"]]
    if dropped:
        warnings.warn(f"no cut found for {dropped}; dropped")
    columns = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in dropped:
            continue
        if c in found:
            columns.append(label_bins(attribute(df, c), found[c]["edges"], round_v).alias(c))
        elif c in numeric:
            columns.append(col.cast("string").alias(c))
        else:
            columns.append(col)
    edges = small_table(
        df.sparkSession,
        pa.schema([("attr", pa.string()), ("edges", pa.list_(pa.float64()))]),
        [(a, [f["min"], *f["edges"], f["max"]]) for a, f in found.items()],
    )
    return df.select(*columns), edges


def discretize(
    df: DataFrame,
    bins: int = 4,
    attributes: list[str] | None = None,
    *,
    expert: dict[str, Callable[[Column], Column]] | None = None,
    zero_split: list[str] | None = None,
    binned: bool = True,
    **options,
) -> DataFrame:
    """Expert bins where given, quantile bins elsewhere, other columns untouched.

    ``expert`` maps a column to one of the bin functions above; ``zero_split``
    columns are split at zero and at the median of their positive values;
    ``binned=False`` leaves the remaining numeric columns as they are.
    """
    wanted = list(attributes or df.columns)
    out = df
    for c, fn in (expert or {}).items():
        if c in out.columns:
            out = out.withColumn(c, fn(F.col(f"`{c}`")))
    if zero_split:
        out = zero_low_high(out, zero_split)
    if binned:
        out, _ = bin_columns(out, wanted, bins, **options)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c in out.columns])


def bin_counts(df: DataFrame, attributes: list[str]) -> DataFrame:
    """Distinct values per column: ``(attr, bins)``."""
    one = df.agg(*[F.count_distinct(F.col(f"`{a}`")).alias(f"c{i}") for i, a in enumerate(attributes)])
    pairs = F.array(
        *[F.struct(F.lit(a).alias("attr"), F.col(f"c{i}").alias("bins")) for i, a in enumerate(attributes)]
    )
    return one.select(F.explode(pairs).alias("r")).select("r.*")


def check_bin_counts(df: DataFrame, bins: int, attributes: list[str]) -> None:
    wrong = bin_counts(df, attributes).where(F.col("bins") != bins).collect()
    if wrong:
        raise ValueError(f"expected {bins} bins: " + ", ".join(f"{r['attr']} has {r['bins']}" for r in wrong))


# ----------------------------------------------------------------- profiles


def continuous_attributes(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def profile(df: DataFrame, name: str, targets: list[str]) -> DataFrame:
    """One row: rows, attributes, numerical, nominal; target columns not counted."""
    attributes = [c for c in df.columns if c not in targets]
    numerical = continuous_attributes(df.select(*[F.col(f"`{c}`") for c in attributes]))
    return df.agg(F.count(F.lit(1)).alias("instances")).select(
        F.lit(name).alias("dataset"),
        "instances",
        F.lit(len(attributes)).cast("bigint").alias("attributes"),
        F.lit(len(numerical)).cast("bigint").alias("numerical"),
        F.lit(len(attributes) - len(numerical)).cast("bigint").alias("nominal"),
    )


# ------------------------------------------------------ out-of-fold scoring


def fold_ranks(df: DataFrame, id_column: str, label: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``_rank`` and ``_of``: a row's place from 0 in a shuffled order of its label, and their number.

    The order is that of the MD5 hash of id and seed, then the id.  Rows are ranged by
    label and hash, numbered inside a range and shifted by the counts of earlier ranges, so
    a label that most rows have is not one task.  Without ``label`` the whole table is
    one group; a NULL label is a group of its own.
    """
    key = F.col(f"`{label}`").cast("string") if label else F.lit("")
    shuffled = F.md5(F.concat_ws(":", F.col(f"`{id_column}`").cast("string"), F.lit(str(seed))))
    order = ["_hash", f"`{id_column}`"]
    ranged = materialize(
        df.withColumns({"_group": key, "_hash": shuffled})
        .repartitionByRange("_group", *order)
        .withColumn("_block", F.spark_partition_id()),
        "folds",
    )
    counts = ranged.groupBy(F.col("_group").alias("_g"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    blocks = Window.partitionBy("_g").orderBy("_b")
    offsets = counts.select(
        "_g", "_b",
        (F.sum("_n").over(blocks) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_g")).alias("_of"),
    )
    inside = Window.partitionBy("_group", "_block").orderBy(*order)
    return (
        ranged.withColumn("_place", F.row_number().over(inside))
        .join(offsets, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
        .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_place") - 1).alias("_rank"), "_of")
    )


def folds_of(df: DataFrame, label: str, id_column: str, folds: int = 10, seed: int = 42, stratified: bool = True) -> DataFrame:
    """Add ``fold``, 0 to ``folds - 1``; sizes differ by one at most, per label if ``stratified``."""
    if folds < 2:
        raise ValueError(f"folds must be at least 2, got {folds}")
    ranked = fold_ranks(df, id_column, label if stratified else None, seed)
    return ranked.withColumn("fold", F.pmod("_rank", F.lit(folds)).cast("int")).drop("_rank", "_of")


def held_out(df: DataFrame, id_column: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``held_out``: true for the share of the rows, rounded up, that is for testing."""
    if not 0 < share < 1:
        raise ValueError(f"share must lie between 0 and 1, got {share}")
    ranked = fold_ranks(df, id_column, None, seed)
    return ranked.withColumn("held_out", F.col("_rank") < F.ceil(F.col("_of") * F.lit(share))).drop("_rank", "_of")


def out_of_fold(
    df: DataFrame,
    label: str,
    features: list[str],
    id_column: str,
    folds: int = 10,
    trees: int = 100,
    seed: int = 42,
    validation: str = "cv",
    stratified: bool = True,
    test_share: float = 0.3,
    probability: str | None = None,
) -> DataFrame:
    """Add ``predicted``, the label that a random forest gives to each row.

    ``validation="cv"`` scores every row by a forest that did not see its fold (exact
    folds, per label if ``stratified``), ``"test"`` learns from the rest and returns only
    the held-out share of the rows, ``"all"`` learns from and scores every row.
    Text features become a hash number, so no list of categories is kept anywhere; a
    missing feature is -1.  More than 100 labels raise.  Rows without a label are scored but not learned from.
    ``probability`` names a column for the share of the last label in sorted order.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if validation not in ("cv", "test", "all"):
        raise ValueError(f"unknown validation {validation!r}")
    kind = df.schema[label].dataType
    found = [r["y"] for r in df.select(F.col(f"`{label}`").cast("string").alias("y")).where("y is not null").distinct().sort("y").limit(101).collect()]
    if not 2 <= len(found) <= 100:
        raise ValueError(f"a forest needs 2 to 100 labels, found {len(found)}{' or more' if len(found) > 100 else ''}")
    if validation == "cv":
        data = folds_of(df, label, id_column, folds, seed, stratified).withColumnRenamed("fold", "_fold")
    elif validation == "test":
        data = held_out(df, id_column, test_share, seed).withColumn("_fold", F.when(F.col("held_out"), 0).otherwise(1)).drop("held_out")
    else:
        data = df.withColumn("_fold", F.lit(0))

    def number(name):
        column = F.col(f"`{name}`")
        if not isinstance(df.schema[name].dataType, T.NumericType):
            column = F.when(column.isNotNull(), F.shiftrightunsigned(F.xxhash64(column.cast("string")), 12))
        return F.coalesce(F.nanvl(column.cast("double"), F.lit(None)), F.lit(-1.0))

    named = {f"_x{i}": number(c) for i, c in enumerate(features)}
    place = F.array_position(F.array(*[F.lit(y) for y in found]), F.col(f"`{label}`").cast("string")) - 1
    data = data.withColumns({**named, "_y": place.cast("double")})
    # every forest reads this table, not its source
    ready = materialize(VectorAssembler(inputCols=list(named), outputCol="_features").transform(data).drop(*named), "features")
    parts = []
    for part in range(folds) if validation == "cv" else [0]:
        forest = RandomForestClassifier(labelCol="_y", featuresCol="_features", predictionCol="_p", numTrees=trees, seed=seed)
        learn = ready if validation == "all" else ready.where(F.col("_fold") != part)
        model = forest.fit(learn.where(F.col("_y").isNotNull()))
        parts.append(model.transform(ready.where(F.col("_fold") == part)))
    named_label = F.element_at(F.array(*[F.lit(y) for y in found]), (F.col("_p") + 1).cast("int")).cast(kind)
    columns = [F.col(f"`{c}`") for c in df.columns] + [named_label.alias("predicted")]
    if probability:
        shares = vector_to_array(F.col("probability"))
        # a fold may lack the last label, and its forest then has fewer shares
        columns.append(F.coalesce(F.get(shares, F.lit(len(found) - 1)), F.lit(0.0)).alias(probability))
    return stack(*[p.select(*columns) for p in parts])


def effect_size(df: DataFrame, slice_column: str, value: str) -> DataFrame:
    """Effect size of each slice against the rest of the table: ``(slice, n, effect_size)``.

    One grouped pass; the rest follows from the totals.  A slice that is the
    whole table gets 0.
    """
    s = df.groupBy(F.col(f"`{slice_column}`").alias("slice")).agg(
        F.count(F.col(value)).alias("n"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )
    overall = df.agg(
        F.struct(
            F.avg(value).alias("mu"), F.stddev_pop(value).alias("s"), F.count(F.col(value)).alias("n")
        ).alias("o")
    ).scalar()
    n_rest = overall["n"] - F.col("n")
    rest_mean = F.try_divide(overall["mu"] * overall["n"] - F.col("total"), n_rest)
    rest_var = F.try_divide(
        F.pow(overall["s"], 2) * (overall["n"] - 1) - F.pow("std", 2) * (F.col("n") - 1), n_rest - 1
    )
    spread = F.sqrt((F.col("std") + F.sqrt(F.greatest(rest_var, F.lit(0.0)))) / 2.0)
    effect = F.try_divide(F.col("mean") - rest_mean, spread)
    return s.select("slice", "n", F.when(n_rest == 0, F.lit(0.0)).otherwise(effect).alias("effect_size"))


