"""End-to-end studies: exploration, hierarchical exploration, sweeps, comparisons."""

from __future__ import annotations

import time
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subdiv.functions.cells import check_target, with_cells, with_outcome
from subdiv.functions.metrics import CELLS, METRICS, with_divergence, with_outcome_divergence
from subdiv.functions.values import attribute
from subdiv.operators import items as item_ops
from subdiv.operators import taxonomy
from subdiv.operators.mine import admit, mine, mine_top_k, top_k
from subdiv.operators.prepare import bin_columns
from subdiv.operators.select import not_redundant, ranked
from subdiv.operators.tree import Trees, grow, grow_each
from subdiv.session import materialize, small_table


def explore(
    df: DataFrame,
    attributes: list[str],
    min_support: float,
    metrics: list[str],
    *,
    true: str | None = None,
    predicted: str | None = None,
    outcome: str | None = None,
    classes: dict | None = None,
    closure: DataFrame | None = None,
    keep: DataFrame | None = None,
    max_len: int | None = None,
    overlap: bool = False,
    k: int | None = None,
    k_metric: str | None = None,
    mark: str | None = None,
    method: str = "auto",
    weight: str | None = None,
) -> DataFrame:
    """Itemsets of a discrete table with metrics, divergences and t-values.

    ``k`` keeps the best itemsets by ``k_metric`` (the first metric by default);
    ``mark`` adds a constant true column of that name.  ``weight`` names a column with
    the number of rows that each row stands for, which holds their summed cells or
    ``y`` and ``y2`` already.
    """
    if method not in ("auto", "single_pass", "level_wise"):
        raise ValueError(f"unknown method {method!r}")
    target = check_target(true, predicted, outcome)
    options = dict(closure=closure, keep=keep, max_len=max_len, overlap=overlap, method=method, weight=weight)
    ranking = k_metric or metrics[0]

    def found(rows, measures, known):
        if k is not None and ranking in known:
            return mine_top_k(rows, attributes, measures, min_support, ranking, k, **options)
        return mine(rows, attributes, measures, min_support, **options)

    if target == "outcome":
        rows = df if weight else with_outcome(df, outcome)
        scored = with_outcome_divergence(found(rows, ["y", "y2"], ["d_outcome"]))
    else:
        cells = [m for m in METRICS if m in metrics and m != "d_outcome"]
        rows = df if weight else with_cells(df, true, predicted, classes)
        scored = with_divergence(found(rows, CELLS, cells), metrics)
    if k is not None:
        scored = top_k(scored, ranking, k)
    return scored.withColumn(mark, F.lit(True)) if mark else scored


def explore_hierarchical(
    df: DataFrame,
    attributes: list[str],
    discretizations: dict,
    edges: DataFrame | None,
    min_support: float,
    metrics: list[str],
    *,
    generalize: bool = True,
    overlap: bool = False,
    continuous_only: list[str] | None = None,
    all_attributes: bool = False,
    **options,
) -> DataFrame:
    """Discretize, add generalized items, explore.

    ``discretizations`` are leaf ranges (with ``overlap``: any ranges, several
    may hold a value).  ``continuous_only`` restricts generalization to the
    named attributes.  Ranges of an all-attributes tree overlap, so they need
    both ``generalize`` and ``overlap``.
    """
    if all_attributes and not (generalize and overlap):
        raise ValueError("ranges of an all-attributes tree need generalize=True and overlap=True")
    if overlap:
        rows = item_ops.discretize_overlapping(df, discretizations)
        return explore(rows, attributes, min_support, metrics, overlap=True, **options)
    rows = item_ops.discretize_ranges(df, discretizations)
    closed = None
    if generalize and edges is not None:
        if continuous_only is not None:
            edges = taxonomy.only_attributes(edges, continuous_only)
        closed = taxonomy.closure(edges)
    return explore(rows, attributes, min_support, metrics, closure=closed, **options)


def tree_hierarchy(df: DataFrame, continuous: list[str], metric: str, min_support: float, **options):
    """Grow trees and return ``(trees, discretizations, edges)`` of the continuous attributes.

    Ranges of one-at-a-time trees are leaves with their generalizations; those of
    a joint tree are all nodes, which overlap, without generalizations.
    """
    inputs = options.pop("attributes", continuous)
    trees = grow(df, inputs, metric, min_support, **options)
    if options.get("splitting") == "all_attributes":
        return trees, trees.discretizations("all", continuous), None
    return trees, trees.discretizations(attributes=continuous), trees.generalization()


#: ends the extra item of a value that occurs in rows and also stands above other values
_RAW = "\u0002raw"


def sweep(
    df: DataFrame,
    attributes: list[str],
    discretizations: dict,
    edges: DataFrame,
    supports: list[float],
    metric: str,
    *,
    keep: DataFrame | None = None,
    k: int | list[int | None] | None = None,
    trees: Trees | None = None,
    gains: list[float | None] | None = None,
    dataset: str = "",
    criterion: str = "divergence_criterion",
    min_sup_tree: float | None = None,
    continuous_only: list[str] | None = None,
    **options,
) -> DataFrame:
    """Number of itemsets and highest divergence per support, gain and k; base and generalized, pruned and not.

    The rows of an itemset depend on none of these settings, so the table is mined
    once at the lowest support; every other run is a filter on it, and one pass
    answers all.  A value that occurs in rows and is also a parent has two items, one
    of its own rows for base runs and one with all below it for generalized runs.

    ``gains`` needs the separate ``trees`` that gave the ranges, grown without a
    minimal gain: a tree of a higher gain is a prefix of them, so its ranges are those
    whose cuts above all gain more, and its leaves those of them not cut any further.
    """
    if gains is not None and trees is None:
        raise ValueError("gains need the trees of the ranges")
    if continuous_only is not None:
        edges = taxonomy.only_attributes(edges, continuous_only)
    closed = materialize(taxonomy.closure(edges), "closure")
    parents = closed.where(F.col("leaf") != F.col("item")).select("attr", "item").distinct()
    own = parents.select("attr", F.col("item").alias("leaf"), F.concat("item", F.lit(_RAW)).alias("item"))
    mined = explore(
        item_ops.discretize_ranges(df, discretizations), attributes, min(supports), [metric],
        closure=closed.select("attr", "leaf", "item").unionByName(own), **options,
    )
    flagged = mined.join(_marks(mined, parents, keep, trees), "key", "left")
    ks = k if isinstance(k, list) else [k]
    settings = [
        (generalized, pruned, support, gain)
        for generalized in (False, True)
        for pruned in ((False, True) if keep is not None else (False,))
        for support in supports
        for gain in (gains or [None])
    ]

    def included(generalized, pruned, support, gain):
        least = F.lit(float("-inf") if gain is None else float(gain))
        test = (F.col("support") >= support) & F.coalesce(F.col("above") > least, F.lit(True))
        if generalized:
            test = test & ~F.coalesce("raw", F.lit(False))
        else:
            test = test & F.coalesce(F.col("below") <= least, F.lit(True))
        if pruned:
            test = test & ~F.coalesce("not_kept", F.lit(False))
        return test | (F.col("length") == 0)

    aggs = []
    for i, setting in enumerate(settings):
        test = included(*setting)
        aggs += [F.count_if(test).alias(f"n{i}"), F.max(F.when(test, F.col(metric))).alias(f"m{i}")]
    counted = flagged.agg(*aggs)

    def run(i, top):
        # the best k and the whole table; the highest value is among them
        n = F.col(f"n{i}") if top is None else F.least(F.col(f"n{i}") - 1, F.lit(top)) + 1
        return F.struct(F.lit(i).alias("i"), F.lit(top).cast("int").alias("top_k"), n.alias("n"), F.col(f"m{i}").alias("m"))

    cells = [run(i, top) for i in range(len(settings)) for top in ks]
    runs = counted.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    described = small_table(
        df.sparkSession,
        pa.schema(
            [("i", pa.int32()), ("generalized", pa.bool_()), ("pruned", pa.bool_()), ("min_sup", pa.float64()), ("minimal_gain", pa.float64())]
        ),
        [(i, g, p, float(s), None if gain is None else float(gain)) for i, (g, p, s, gain) in enumerate(settings)],
    )
    return runs.join(described, "i").select(
        F.lit(dataset).alias("dataset"),
        F.lit(metric).alias("metric"),
        F.lit(criterion).alias("criterion"),
        F.lit(min_sup_tree).cast("double").alias("min_sup_tree"),
        "minimal_gain",
        "min_sup",
        "generalized",
        "pruned",
        "top_k",
        F.expr("stack(2, 'itemsets', cast(n as double), 'max_divergence', m) as (stat, value)"),
    )


def _marks(mined: DataFrame, parents: DataFrame, keep: DataFrame | None, trees: Trees | None) -> DataFrame:
    """Per itemset ``(key, raw, above, below, not_kept)``.

    ``raw``: holds an item of a parent's own rows.  ``above``: smallest gain of the cuts
    over its ranges, NULL without ranges.  ``below``: largest gain of the cuts of its
    items, infinite for values with others below that no tree has cut.
    """
    single = mined.where("length > 0").select("key", F.explode("itemset").alias("name"))
    single = single.select(
        "key", F.col("name").endswith(F.lit(_RAW)).alias("raw"), F.replace("name", F.lit(_RAW), F.lit("")).alias("item")
    )
    name = F.concat_ws("=", "attr", "item").alias("item")
    general = parents.select(name).withColumn("general", F.lit(True))
    flagged = single.join(general, "item", "left")
    if trees is not None:
        flagged = flagged.join(trees.stop_gains().select(name, "above", "own", F.lit(True).alias("range")), "item", "left")
    else:
        none = F.lit(None).cast("double")
        flagged = flagged.withColumns({"above": none, "own": none, "range": F.lit(None).cast("boolean")})
    uncut = F.coalesce("raw", F.lit(False)) | F.col("general").isNull()
    below = F.when(F.col("range"), F.col("own")).when(~uncut, F.lit(float("inf")))
    if keep is not None:
        pairs = single.select(
            F.substring_index("item", "=", 1).alias("attr"),
            F.expr("substr(item, instr(item, '=') + 1)").alias("value"),
            "item",
        ).distinct()
        admitted = admit(pairs, keep, "attr", "value").select("item").withColumn("kept", F.lit(True))
        flagged = flagged.join(admitted, "item", "left")
    else:
        flagged = flagged.withColumn("kept", F.lit(True))
    return flagged.groupBy("key").agg(
        F.bool_or("raw").alias("raw"),
        F.min("above").alias("above"),
        F.max(below).alias("below"),
        F.bool_or(F.col("kept").isNull()).alias("not_kept"),
    )


#: rows that a summed row stands for
_WEIGHT = "__rows"


def _needed(df: DataFrame, attributes: list[str], metric: str, true, predicted, outcome) -> DataFrame:
    """Columns that the trees and the itemsets read."""
    names = [*attributes, *[c for c in (true, predicted, outcome) if c is not None]]
    names += ["y"] if metric == "d_outcome" else CELLS
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(names)])


def _told_apart(df: DataFrame, attributes: list[str], forest: dict[float, Trees], *, true, predicted, outcome, classes) -> DataFrame:
    """Rows with equal values summed, where values between the same neighbouring cuts of the forest count as equal.

    A value stands for those it is summed with.  An attribute that some tree does not
    cut keeps its values, which are then items themselves.
    """
    if check_target(true, predicted, outcome) == "outcome":
        measured, measures = with_outcome(df, outcome), ["y", "y2"]
    else:
        measured, measures = with_cells(df, true, predicted, classes), CELLS
    cuts: dict[str, list] = {}
    for trees in forest.values():
        for attr, pairs in trees.cuts().items():
            cuts.setdefault(attr, []).append(pairs)
    keys, values = [], {}
    for a in attributes:
        if len(cuts.get(a, [])) < len(forest):
            keys.append(attribute(df, a).alias(a))
            continue
        pairs = sorted(set().union(*cuts[a]))
        lows, highs = [None, *[right for _, right in pairs]], [*[left for left, _ in pairs], None]
        ranges = {}
        for i, (lo, hi) in enumerate(zip(lows, highs)):
            bounds = [(r, v) for r, v in ((">=", lo), ("<=", hi)) if v is not None]
            ranges[str(i)] = {"rels": [r for r, _ in bounds], "vals": [v for _, v in bounds]}
        keys.append(item_ops.range_label(attribute(df, a), ranges).alias(f"__range {a}"))
        values[a] = F.min(f"`{a}`").alias(a)
    sums = [F.sum(m).alias(m) for m in measures]
    summed = measured.groupBy(*keys).agg(*values.values(), F.count(F.lit(1)).alias(_WEIGHT), *sums)
    return materialize(summed.select(*[F.col(f"`{a}`") for a in attributes], _WEIGHT, *measures), "told-apart")


def tree_support_sweep(
    df: DataFrame,
    attributes: list[str],
    continuous: list[str],
    tree_supports: list[float],
    min_support: float,
    metric: str,
    *,
    timed: bool = False,
    **options,
) -> DataFrame:
    """Leaf ranges, itemsets and highest divergence for several tree supports.

    The source is read once.  The trees of all supports are grown together, and rows
    that no tree tells apart are summed, so that mining a setting reads at most as many
    rows as there are ranges between neighbouring cuts and values of other attributes.
    Supports whose trees have the same ranges share one run of mining.  ``timed`` adds
    the seconds of growing all trees, with the sums, and of mining those of a setting.
    """
    start = time.time()
    target = {name: options.get(name) for name in ("true", "predicted", "outcome")}
    source = materialize(_needed(df, [*attributes, *continuous], metric, **target), "source")
    forest = grow_each(source, continuous, metric, tree_supports)
    rows = _told_apart(source, attributes, forest, classes=options.pop("classes", None), **target)
    grown = time.time() - start
    mined: dict[str, tuple[DataFrame, float]] = {}
    parts = []
    for support, trees in forest.items():
        ranges = trees.discretizations(attributes=continuous)
        setting = repr(sorted(trees.discretizations("all", continuous).items()))
        if setting not in mined:
            start = time.time()
            found = explore_hierarchical(rows, attributes, ranges, trees.generalization(), min_support, [metric], weight=_WEIGHT, **options)
            summary = materialize(found.agg(F.count(F.lit(1)).alias("itemsets"), F.max(metric).alias("max_divergence")), "setting")
            mined[setting] = summary, time.time() - start
        found, seconds = mined[setting]
        leaves = sum(len(r) for r in ranges.values())
        part = found.select(F.lit(support).alias("min_sup_tree"), "itemsets", "max_divergence", F.lit(leaves).cast("bigint").alias("leaf_ranges"))
        if timed:
            part = part.withColumns({"tree_seconds": F.lit(grown), "seconds": F.lit(seconds)})
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def compare_methods(
    df: DataFrame,
    continuous: list[str],
    other: list[str],
    min_support: float,
    metric: str,
    *,
    expert: dict | None = None,
    bins: int = 4,
    tree_support: float = 0.1,
    round_v: int = 0,
    redundancy: float | None = 0.0,
    **options,
) -> DataFrame:
    """Best itemset of expert bins, quantile bins, tree ranges and tree hierarchies."""
    attributes = [*continuous, *other]
    runs = {}
    if expert:
        binned = df.withColumns({c: fn(F.col(f"`{c}`")) for c, fn in expert.items()})
        runs["expert"] = explore(binned, attributes, min_support, [metric], **options)
    quantile, _ = bin_columns(df, continuous, bins, round_v=round_v)
    left = [a for a in attributes if a in quantile.columns]
    runs["quantile"] = explore(quantile, left, min_support, [metric], **options)
    _, ranges, edges = tree_hierarchy(df, continuous, metric, tree_support)
    runs["tree"] = explore_hierarchical(
        df, attributes, ranges, edges, min_support, [metric], generalize=False, **options
    )
    runs["tree_hierarchy"] = explore_hierarchical(df, attributes, ranges, edges, min_support, [metric], **options)
    tops = [
        ranked(not_redundant(found, metric, redundancy), metric).limit(1).withColumn("method", F.lit(name))
        for name, found in runs.items()
    ]
    return reduce(DataFrame.unionByName, tops)


def pruning_difference(stats: DataFrame, stat: str = "max_divergence") -> DataFrame:
    """Per setting that was run both ways: unpruned minus pruned value of a statistic."""
    on = ["dataset", "metric", "criterion", "min_sup_tree", "minimal_gain", "min_sup", "generalized", "top_k"]
    both = stats.where(F.col("stat") == stat).groupBy(*on).agg(
        F.max(F.when(~F.col("pruned"), F.col("value"))).alias("full"),
        F.max(F.when(F.col("pruned"), F.col("value"))).alias("pruned"),
        F.count_distinct("pruned").alias("ways"),
    )
    return both.where("ways = 2").drop("ways").withColumn("difference", F.col("full") - F.col("pruned"))

