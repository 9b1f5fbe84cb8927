"""Divergence trees: cut attributes where a metric differs most.

Trees grow level by level; one job per depth finds the best cut of every open
node.  A node holds at least ``min_support`` of all rows, so a depth has at most
``attributes / min_support`` open nodes; only that list passes through the driver.

``one_at_time``: a value histogram with running sums is built once.  Nodes are
intervals of it, so the sums left of any cut are a difference of two running
sums, and a depth is one scan of the histogram with a small aggregate.

``all_attributes``: a node is a conjunction over attributes.  The source is read
once, into equal rows with their sums; every histogram is kept until its node is
cut, rows of the smaller child are counted, and the larger child has what is left.

Running sums are taken in range-partitioned blocks plus block offsets, so no
attribute has to fit in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subdiv.functions import criteria
from subdiv.functions.cells import check_criterion
from subdiv.functions.values import attribute
from subdiv.operators.histogram import range_blocks, running_sums, value_histogram
from subdiv.session import arrow_type, materialize, small_table

@dataclass
class Node:
    id: int
    tree: str
    parent: int | None
    depth: int
    attr: str | None
    rel: str
    val: object
    n: int
    sums: dict
    metric: float
    divergence: float
    value: float | None
    base_n: int = 0
    base: dict = field(default_factory=dict)
    parent_split: float | None = None
    split: float | None = None
    gain: float | None = None
    path: list = field(default_factory=list)  # [(attr, rel, val)]
    is_leaf: bool = True
    total_n: int | None = None  # rows usable for a split, without NULLs
    min_support: float = 0.0  # of its tree
    total: dict = field(default_factory=dict)


@dataclass
class _Spec:
    attributes: list[str]
    integral: dict[str, bool]
    text: set[str]
    measures: list[str]
    num: list[str]
    den: list[str]
    criterion: str
    min_support: float
    minimal_gain: float | None
    max_depth: int | None
    max_discrete: int
    total: int = 0
    baseline: float = 0.0
    #: text attributes cut by equality, as they have few values; others by order
    discrete: set[str] = field(default_factory=set)


# ---------------------------------------------------------------- best cuts
#
# A cut is a row with the sums on its left, l_n, l_num and l_den, the sums of its
# node, t_n, t_num and t_den, and the node's divergence and last criterion.  The
# measures travel in one struct, so that the wide part of a row costs little.


def _open_table(spark: SparkSession, nodes: list[Node], spec: _Spec, num_type: pa.DataType) -> DataFrame:
    schema = pa.schema(
        [
            ("node", pa.int64()), ("a", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()),
            ("rows", pa.int64()), ("min_support", pa.float64()), ("t_div", pa.float64()), ("t_value", pa.float64()), ("t_split", pa.float64()), ("t_n", pa.int64()), ("t_num", num_type), ("t_den", pa.int64()),
            ("b_n", pa.int64()), ("b_num", num_type), ("b_den", pa.int64()),
        ]
    )

    def sums(n, m):
        return n, _pick_sum(m, spec.num, n), _pick_sum(m, spec.den, n)

    def interval(nd):
        """Attribute and bounds of a node; a joint tree has no single one."""
        if nd.tree not in spec.attributes:
            return None, None, None
        _, lo, hi, _, _ = _summary(nd.path, nd.tree)
        inf = float("inf")
        return spec.attributes.index(nd.tree), -inf if lo is None else float(lo), inf if hi is None else float(hi)

    return small_table(
        spark,
        schema,
        [
            (nd.id, *interval(nd), nd.n, nd.min_support, nd.divergence, nd.value, nd.parent_split, *sums(nd.total_n, nd.total), *sums(nd.base_n, nd.base))
            for nd in nodes
        ],
    )


def _pick_sum(sums: dict, cols: list[str], n: int):
    values = [n if c == "n" else sums[c] for c in cols]
    total = values[0]
    for v in values[1:]:
        total += v
    return total


def _sum_columns(cols: list[str], suffix: str = ""):
    total = F.col(f"{cols[0]}{suffix}")
    for c in cols[1:]:
        total = total + F.col(f"{c}{suffix}")
    return total


def _cut_rows(cumulated: DataFrame, keys: list[str], spec: _Spec) -> DataFrame:
    """Running sums as the left sides of numeric cuts."""
    return cumulated.where("next_v is not null or next_s is not null").select(
        *keys, "v", "next_v", "s", F.col("next_s").alias("other"),
        F.col("n_le").alias("l_n"),
        _sum_columns(spec.num, "_le").alias("l_num"),
        _sum_columns(spec.den, "_le").alias("l_den"),
        F.struct(*[F.col(f"{m}_le").alias(m) for m in spec.measures]).alias("sums"),
    )


def _with_sides(rows: DataFrame, spec: _Spec) -> DataFrame:
    """Metric, divergence and criterion value of both sides; the right side is the difference.

    Each step is a projection of its own, so that what later steps use several times is
    computed once: code that repeats the whole criterion is too large to be compiled.
    """
    base = F.lit(spec.baseline)
    parent = F.col("t_div") + base
    right = rows.withColumns({f"r_{x}": F.col(f"t_{x}") - F.col(f"l_{x}") for x in ("n", "num", "den")})

    def rate(side):
        num, den = F.col(f"{side}_num"), F.col(f"{side}_den")
        return F.when(den != 0, num.cast("double") / den.cast("double"))

    rates = right.withColumns({f"{side}_p": rate(side) for side in ("l", "r")})
    out = {}
    for side in ("l", "r"):
        out[f"{side}_div"] = F.col(f"{side}_p") - base
        out[f"{side}_value"] = criteria.node_value(spec.criterion, F.col(f"{side}_p"), parent, base)
    return rates.withColumns(out)


def candidate_cuts(rows: DataFrame, spec: _Spec) -> DataFrame:
    """Cuts with enough rows on both sides, with their split criterion and ``order``.

    The smallest ``order`` is best; it is NULL where the criterion is undefined or the
    same as that of the cut above.
    """
    total = F.lit(float(spec.total))
    right_n = F.col("t_n") - F.col("l_n")
    enough = (F.col("l_n") / total >= F.col("min_support")) & (right_n / total >= F.col("min_support"))
    double = {f"{s}_{x}": F.col(f"{s}_{x}").cast("double") for s in ("l", "r") for x in ("n", "den")}
    split = criteria.split_value(
        spec.criterion, F.col("l_value"), F.col("r_value"), double["l_den"], double["r_den"], double["l_n"], double["r_n"], total
    )
    scored = _with_sides(rows.where(enough), spec).withColumn("split", split)
    order = F.col("split") if spec.criterion == "entropy" else -F.col("split")
    return scored.withColumn("order", F.when(~F.col("split").eqNullSafe(F.col("t_split")), order))


def gain(spec: _Spec):
    """Gain of a cut, weighted by the node's support."""
    support = F.col("rows") / F.lit(float(spec.total))
    if spec.criterion == "entropy":
        both = (F.col("l_n") + F.col("r_n")).cast("double")
        left = F.col("l_n") / both * F.col("l_value")
        right = F.col("r_n") / both * F.col("r_value")
        return support * (F.col("t_value") - left - right)
    if spec.criterion == "divergence_criterion":
        return support * F.col("split")
    return support * (F.greatest(F.abs("l_div"), F.abs("r_div")) - F.abs("t_div"))


def best_cuts(scored: DataFrame, opened: DataFrame, spec: _Spec, *, again: bool) -> DataFrame:
    """Per node the best cut; ties go to the first attribute, then the lowest value.

    ``again`` finds the best criteria in a first pass that sorts nothing, and the cuts
    that have them in a second; for cuts that are cheap to read twice.  Otherwise there
    is one aggregate over all cuts; those of a joint tree come sorted by node already.
    """
    payload = ["a", "v", "s", "next_v", "binary", "other", "split", "l_n", "l_num", "l_den", "t_n", "t_num", "t_den", "sums", "t_sums"]
    if again:
        found = scored.groupBy("node").agg(F.min("order").alias("least")).where("least is not null").collect()  # at most one row per open node
        least = small_table(scored.sparkSession, pa.schema([("node", pa.int64()), ("least", pa.float64())]), [tuple(r) for r in found])
        # a key that needs no test for NULL of its own, which would repeat the criterion
        has = F.coalesce("order", F.lit(float("inf"))) == F.col("least")
        scored = scored.join(least.withColumnRenamed("node", "least_of"), (F.col("node") == F.col("least_of")) & has)
    cut = F.when(F.col("order").isNotNull(), F.struct("order", *payload))
    first = scored.groupBy("node").agg(F.min(cut).alias("b")).where("b is not null").select("node", "b.*")
    chosen = (
        _with_sides(first.join(opened.select("node", "rows", "t_div", "t_value"), "node"), spec)
        .withColumn("gain", gain(spec))
        .where(~((F.col("l_div") == F.col("t_div")) & (F.col("r_div") == F.col("t_div"))))
    )
    if spec.minimal_gain is not None:
        chosen = chosen.where(F.col("gain") > F.lit(float(spec.minimal_gain)))
    return chosen


# ---------------------------------------------------------------- growth


def _root(tree, node_id, whole, spec, total_n, total, min_support) -> Node:
    sums = {m: whole[m] for m in spec.measures}
    return Node(
        id=node_id, tree=tree, parent=None, depth=0, attr=None, rel="", val=None, n=whole["n"], sums=sums,
        metric=spec.baseline, divergence=0.0, value=_root_value(spec),
        base_n=0, base={m: _zero(sums[m]) for m in spec.measures}, total_n=total_n, total=total, min_support=min_support,
    )


def _root_value(spec: _Spec) -> float:
    import math

    if spec.criterion == "entropy":
        p = spec.baseline
        return sum(-q * math.log2(q) for q in (p, 1 - p) if q > 0)
    return 0.0


def _zero(x):
    return Decimal(0) if isinstance(x, Decimal) else type(x)(0)


def _number(v: float, integral: bool):
    return int(v) if integral else v


def _children(row, nd: Node, spec: _Spec, next_id: int) -> list[Node]:
    attr = spec.attributes[row["a"]]
    if attr in spec.discrete:
        left_val, left_rel = row["s"], "="
        right_val, right_rel = (row["other"], "=") if row["binary"] else (row["s"], "!=")
    elif attr in spec.text:
        left_val, left_rel, right_val, right_rel = row["s"], "<=", row["other"], ">="
    else:
        left_val, left_rel = _number(row["v"], spec.integral[attr]), "<="
        right_val, right_rel = _number(row["next_v"], spec.integral[attr]), ">="
    joint = nd.tree not in spec.attributes  # whose nodes have histograms of their own
    totals = nd.total if row["t_sums"] is None else row["t_sums"].asDict()
    left_sums = {m: row["sums"][m] - nd.base[m] for m in spec.measures}
    right_sums = {m: totals[m] - left_sums[m] for m in spec.measures}

    def child(offset, side, rel, val, sums, base_n, base):
        return Node(
            id=next_id + offset, tree=nd.tree, parent=nd.id, depth=nd.depth + 1, attr=attr, rel=rel, val=val,
            n=row[f"{side}_n"], sums=sums, metric=row[f"{side}_p"], divergence=row[f"{side}_div"],
            value=row[f"{side}_value"], base_n=base_n, base=base, parent_split=row["split"],
            path=[*nd.path, (attr, rel, val)], total_n=row[f"{side}_n"], total=sums, min_support=nd.min_support,
        )

    return [
        child(0, "l", left_rel, left_val, left_sums, nd.base_n, nd.base),
        child(
            1, "r", right_rel, right_val, right_sums,
            *((nd.base_n, nd.base) if joint else (nd.base_n + row["l_n"], {m: nd.base[m] + left_sums[m] for m in spec.measures})),
        ),
    ]


def _apply(cuts, open_nodes: dict[int, Node], spec: _Spec, next_id: int):
    made: list[Node] = []
    for row in sorted(cuts, key=lambda r: r["node"]):
        nd = open_nodes[row["node"]]
        nd.is_leaf, nd.split, nd.gain = False, row["split"], row["gain"]
        made += _children(row, nd, spec, next_id + len(made))
    return made


def _cut_table(spark, made: list[Node], spec: _Spec) -> DataFrame:
    schema = pa.schema(
        [
            ("node", pa.int64()), ("cut_a", pa.int32()), ("cut_v", pa.float64()), ("cut_s", pa.string()),
            ("left", pa.int64()), ("right", pa.int64()),
        ]
    )
    rows = []
    for left, right in zip(made[::2], made[1::2]):
        text = left.attr in spec.text
        rows.append(
            (
                left.parent, spec.attributes.index(left.attr), None if text else float(left.val),
                left.val if text else None, left.id, right.id,
            )
        )
    return small_table(spark, schema, rows)


def _grow_separately(df: DataFrame, spec: _Spec, supports: list[float]) -> list[Node]:
    """Trees of every attribute for every support, all from one histogram and one scan of it per depth."""
    spark = df.sparkSession
    hist = range_blocks(value_histogram(df, spec.attributes, spec.measures, whole=True), ["a"])
    whole = hist.where("a = -1").first()
    _set_baseline(spec, whole)
    sums = ["n", *spec.measures]
    cumulated = running_sums(hist.where("a >= 0"), ["a"], sums)
    num_type = arrow_type(hist.schema[spec.num[0]].dataType)
    rows = materialize(_cut_rows(cumulated, ["a"], spec).drop("s", "other"), "cuts")
    per_attr = {
        r["a"]: r for r in hist.where("a >= 0").groupBy("a").agg(*[F.sum(c).alias(c) for c in sums]).collect()
    }
    all_nodes = [
        _root(a, k * len(spec.attributes) + i, whole, spec, per_attr[i]["n"], {m: per_attr[i][m] for m in spec.measures}, support)
        for k, support in enumerate(supports)
        for i, a in enumerate(spec.attributes)
        if i in per_attr
    ]
    open_nodes = {nd.id: nd for nd in all_nodes}
    next_id, depth = len(spec.attributes) * len(supports), 0
    none = F.lit(None)
    while open_nodes and (spec.max_depth is None or depth < spec.max_depth):
        opened = _open_table(spark, list(open_nodes.values()), spec, num_type)
        # a node is an interval of its attribute; the plan is the same at every depth
        here = (rows["a"] == opened["a"]) & (F.col("v") >= F.col("lo")) & (F.col("next_v") <= F.col("hi"))
        inside = rows.join(opened, here).select(
            "node", rows["a"], "v", none.cast("string").alias("s"), "next_v", F.lit(False).alias("binary"),
            none.cast("string").alias("other"), "sums", none.cast(rows.schema["sums"].dataType).alias("t_sums"),
            *[(F.col(f"l_{x}") - F.col(f"b_{x}")).alias(f"l_{x}") for x in ("n", "num", "den")],
            "t_n", "t_num", "t_den", "t_div", "t_split", "min_support",
        )
        cuts = best_cuts(candidate_cuts(inside, spec), opened, spec, again=True).collect()
        made = _apply(cuts, open_nodes, spec, next_id)
        if not made:
            break
        depth += 1
        next_id += len(made)
        all_nodes += made
        open_nodes = {nd.id: nd for nd in made if _may_split(nd, spec)}
    return all_nodes


def _grow_jointly(df: DataFrame, spec: _Spec) -> list[Node]:
    """The source is read once, into equal rows with their sums and the node they are in."""
    spark, sums = df.sparkSession, ["n", *spec.measures]
    groups = df.groupBy(*[F.col(f"`{a}`") for a in spec.attributes]).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(m).alias(f"__{m}") for m in spec.measures])
    packed = F.struct(*[F.col(f"__{c}").alias(c) for c in sums]).alias("__sums")
    rows = materialize(groups.select(F.lit(0).cast("bigint").alias("__node"), *[F.col(f"`{a}`") for a in spec.attributes], packed), "row-groups")
    whole = rows.agg(*[F.sum(f"__sums.{c}").alias(c) for c in sums]).first()
    _set_baseline(spec, whole)
    all_nodes = [_root("*", 0, whole, spec, whole["n"], {m: whole[m] for m in spec.measures}, spec.min_support)]
    open_nodes = {0: all_nodes[0]}
    hist = range_blocks(_group_histogram(rows, ["__node"], spec).withColumnRenamed("__node", "node"), ["node", "a"])
    num_type = arrow_type(hist.schema[spec.num[0]].dataType)
    spec.discrete = _few_valued(hist, spec)
    next_id, depth = 1, 0
    while open_nodes and (spec.max_depth is None or depth < spec.max_depth):
        opened = _open_table(spark, list(open_nodes.values()), spec, num_type)
        scored = candidate_cuts(_joint_cuts(hist, opened, spec), spec)
        made = _apply(best_cuts(scored, opened, spec, again=False).collect(), open_nodes, spec, next_id)
        if not made:
            break
        depth += 1
        next_id += len(made)
        all_nodes += made
        open_nodes = {nd.id: nd for nd in made if _may_split(nd, spec)}
        if open_nodes and (spec.max_depth is None or depth < spec.max_depth):
            moved = materialize(_descend(rows, _cut_table(spark, made, spec), spec), "row-groups")
            hist = materialize(_child_histograms(hist, moved, made, spec), "histogram")
            kept = [nd.id for nd in made if nd.id in open_nodes]
            rows = moved.where(F.col("__node").isin(kept)).drop("__parent")
    return all_nodes


def _group_histogram(rows: DataFrame, keys: list[str], spec: _Spec) -> DataFrame:
    flat = rows.select(*keys, *[F.col(f"`{a}`") for a in spec.attributes], F.col("__sums.n").alias("__weight"), *[F.col(f"__sums.{m}").alias(f"__{m}") for m in spec.measures])
    found = value_histogram(flat, spec.attributes, [f"__{m}" for m in spec.measures], keys=keys, text=spec.text, weight="__weight")
    return found.withColumnsRenamed({f"__{m}": m for m in spec.measures})


def _child_histograms(hist: DataFrame, moved: DataFrame, made: list[Node], spec: _Spec) -> DataFrame:
    """Histograms of the children that may split, in the blocks of the root's.

    Per cut only rows that do not go to the larger child are counted; the larger
    child has its parent's histogram less theirs.  Rows without a value of the cut
    attribute go to no child.
    """
    sums = ["n", *spec.measures]
    pairs = list(zip(made[::2], made[1::2]))
    larger = [max(pair, key=lambda nd: nd.n) for pair in pairs]
    smaller = [min(reversed(pair), key=lambda nd: nd.n) for pair in pairs]
    going = F.when(F.col("__node").isin([nd.id for nd in smaller]), F.col("__node"))
    counted = moved.where(F.col("__node").isNull() | going.isNotNull()).withColumn("__small", going.isNotNull())
    less = _group_histogram(counted, ["__parent", "__small"], spec)
    less = less.groupBy("__parent", "a", "v", "s").agg(
        F.struct(*[F.sum(c).alias(c) for c in sums]).alias("out"),
        F.struct(*[F.sum(F.when(F.col("__small"), F.col(c))).alias(c) for c in sums]).alias("small"),
    )
    parent = [nd.parent for nd in larger]
    children = small_table(
        hist.sparkSession,
        pa.schema([("node", pa.int64()), ("large_id", pa.int64()), ("small_id", pa.int64())]),
        [(p, nd.id, other.id) for p, nd, other in zip(parent, larger, smaller)],
    )
    same = (F.col("node") == F.col("__parent")) & (F.col("h.a") == F.col("l.a")) & F.col("h.v").eqNullSafe(F.col("l.v")) & F.col("h.s").eqNullSafe(F.col("l.s"))
    both = hist.join(children, "node").alias("h").join(less.alias("l"), same, "left")
    rest = [(F.col(f"h.{c}") - F.coalesce(F.col(f"out.{c}"), F.lit(0))).cast(hist.schema[c].dataType).alias(c) for c in sums]
    small = [F.col(f"small.{c}").cast(hist.schema[c].dataType).alias(c) for c in sums]
    child = F.explode(F.array(F.struct(F.col("large_id").alias("node"), *rest), F.struct(F.col("small_id").alias("node"), *small)))
    open_ids = [nd.id for nd in made if _may_split(nd, spec)]
    return both.select("h.a", "h.v", "h.s", "h.block", child.alias("c")).where((F.col("c.n") > 0) & F.col("c.node").isin(open_ids)).select("c.node", "a", "v", "s", *[f"c.{c}" for c in sums], "block")


def _few_valued(hist: DataFrame, spec: _Spec) -> set[str]:
    counts = hist.where("s is not null").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return {spec.attributes[r["a"]] for r in counts.where(F.col("n") <= spec.max_discrete).collect()}


def _joint_cuts(hist: DataFrame, opened: DataFrame, spec: _Spec) -> DataFrame:
    """Cuts of all attributes of all nodes; totals leave out an attribute's NULLs."""
    keys, sums = ["node", "a"], ["n", *spec.measures]
    packed = F.struct(*spec.measures)
    summed = hist.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    totals = summed.select(
        *keys, F.col("n").alias("t_n"), _sum_columns(spec.num).alias("t_num"), _sum_columns(spec.den).alias("t_den"),
        packed.alias("t_sums"),
    )
    singled = F.col("a").isin([i for i, a in enumerate(spec.attributes) if a in spec.discrete])
    none = F.lit(None)
    ordered = _cut_rows(running_sums(hist.where(~singled), keys, sums), keys, spec).withColumn("binary", F.lit(False))
    cuts = ordered
    if spec.discrete:
        # a cut singles out one value; of a two-valued attribute only the first is tried
        group = Window.partitionBy(*keys)  # at most max_discrete rows
        values = hist.where(singled).withColumns(
            {
                "binary": F.count(F.lit(1)).over(group) == 2,
                "first_s": F.min("s").over(group),
                "other": F.max("s").over(group),
            }
        )
        discrete = values.where(~F.col("binary") | (F.col("s") == F.col("first_s"))).select(
            *keys, none.cast("double").alias("v"), none.cast("double").alias("next_v"), F.col("n").alias("l_n"),
            _sum_columns(spec.num).alias("l_num"), _sum_columns(spec.den).alias("l_den"), packed.alias("sums"),
            "s", "binary", "other",
        )
        cuts = ordered.unionByName(discrete)
    facts = opened.select("node", "t_div", "t_split", "min_support")
    return cuts.join(totals, keys).join(facts, "node")


def _descend(rows: DataFrame, cuts: DataFrame, spec: _Spec) -> DataFrame:
    """Move each row of a cut node to a child, or to none where it has no value of the cut attribute."""
    left = right = None
    for i, a in enumerate(spec.attributes):
        here = F.col("cut_a") == i
        value = F.col(f"`{a}`")
        if a in spec.discrete:
            is_left = here & (value.cast("string") == F.col("cut_s"))
            is_right = here & (value.cast("string") != F.col("cut_s"))
        elif a in spec.text:
            is_left = here & (value.cast("string") <= F.col("cut_s"))
            is_right = here & (value.cast("string") > F.col("cut_s"))
        else:
            is_left = here & (value.cast("double") <= F.col("cut_v"))
            is_right = here & (value.cast("double") > F.col("cut_v"))
        left = is_left if left is None else left | is_left
        right = is_right if right is None else right | is_right
    moved = F.when(left, F.col("left")).when(right, F.col("right"))
    kept = [F.col(f"`{a}`") for a in spec.attributes]
    return rows.join(cuts, F.col("__node") == F.col("node")).select(F.col("node").alias("__parent"), moved.alias("__node"), *kept, "__sums")


def _may_split(nd: Node, spec: _Spec) -> bool:
    """Whether both sides of a cut could hold the least rows of a node."""
    least = ceil(nd.min_support * spec.total)
    least += (least / spec.total < nd.min_support) - (least > 0 and (least - 1) / spec.total >= nd.min_support)
    return nd.total_n >= 2 * least


def _set_baseline(spec: _Spec, whole) -> None:
    if whole is None or not whole["n"]:
        raise ValueError("the table has no rows")
    spec.total = whole["n"]
    num = sum(float(whole[m]) for m in spec.num)
    den = float(whole["n"]) if spec.den == ["n"] else sum(float(whole[m]) for m in spec.den)
    spec.baseline = num / den if den else 0.0


def grow(
    df: DataFrame,
    attributes: list[str],
    metric: str,
    min_support: float = 0.1,
    *,
    splitting: str = "one_at_time",
    criterion: str = "divergence_criterion",
    minimal_gain: float | None = None,
    max_depth: int | None = None,
    max_discrete: int = 10,
) -> "Trees":
    """Grow divergence trees.

    ``df`` carries the cells ``tn, fp, fn, tp`` for a classification metric, or
    ``y`` for ``d_outcome``.  ``splitting`` is ``one_at_time`` (one tree per
    numeric attribute) or ``all_attributes`` (one tree over all of them; text
    attributes with at most ``max_discrete`` values are cut by equality, others by
    order).
    """
    if splitting not in ("one_at_time", "all_attributes"):
        raise ValueError(f"unknown splitting {splitting!r}")
    spec = _spec_of(df, attributes, metric, min_support, criterion, minimal_gain, max_depth, max_discrete)
    if spec.text and splitting == "one_at_time":
        raise ValueError(f"not numeric: {sorted(spec.text)}")
    slim = df.select(*[attribute(df, a).alias(a) for a in attributes], *spec.measures)
    nodes = _grow_separately(slim, spec, [spec.min_support]) if splitting == "one_at_time" else _grow_jointly(slim, spec)
    return Trees(df.sparkSession, nodes, spec, metric, slim)


def grow_each(
    df: DataFrame,
    attributes: list[str],
    metric: str,
    supports: list[float],
    *,
    criterion: str = "divergence_criterion",
    minimal_gain: float | None = None,
    max_depth: int | None = None,
) -> dict[float, "Trees"]:
    """Trees of every attribute for each of several supports, grown together.

    The same trees as :func:`grow` makes, from one histogram: the nodes of all
    supports are open at once, and a depth is one scan for all of them.
    """
    specs = {float(s): _spec_of(df, attributes, metric, s, criterion, minimal_gain, max_depth, 0) for s in supports}
    if not specs:
        return {}
    spec = next(iter(specs.values()))
    if spec.text:
        raise ValueError(f"not numeric: {sorted(spec.text)}")
    slim = df.select(*[attribute(df, a).alias(a) for a in attributes], *spec.measures)
    nodes = _grow_separately(slim, spec, list(specs))
    out = {}
    for support, own in specs.items():
        own.total, own.baseline = spec.total, spec.baseline
        out[support] = Trees(df.sparkSession, [nd for nd in nodes if nd.min_support == support], own, metric, slim)
    return out


def _spec_of(df, attributes, metric, min_support, criterion, minimal_gain, max_depth, max_discrete) -> _Spec:
    if min_support is None or min_support <= 0:
        raise ValueError("min_support must be positive")
    if criterion not in criteria.CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}; known: {criteria.CRITERIA}")
    if metric == "d_outcome":
        check_criterion("outcome", criterion)
        measures, num, den = ["y"], ["y"], ["n"]
    elif metric in criteria.NODE_METRICS:
        measures = ["tn", "fp", "fn", "tp"]
        num, den = criteria.NODE_METRICS[metric]
    else:
        raise ValueError(f"unknown tree metric {metric!r}")
    kinds = {a: df.schema[a].dataType for a in attributes}
    numeric = {a for a, t in kinds.items() if isinstance(t, T.NumericType)}
    text = set(attributes) - numeric
    return _Spec(
        attributes=list(attributes),
        integral={a: isinstance(kinds[a], T.IntegralType) for a in attributes},
        text=text, measures=measures, num=num, den=den, criterion=criterion,
        min_support=float(min_support), minimal_gain=minimal_gain, max_depth=max_depth, max_discrete=max_discrete,
    )


# ---------------------------------------------------------------- node names


def _summary(path, attr):
    """Bounds, equality and exclusions of one attribute along a path."""
    own = [(r, v) for a, r, v in path if a == attr]
    lo = max((v for r, v in own if r in (">=", ">")), default=None)
    hi = min((v for r, v in own if r == "<="), default=None)
    eq = next((v for r, v in own if r == "="), None)
    ne = [v for r, v in own if r == "!="]
    return own, lo, hi, eq, ne


def item_name(path, attr: str, open_lower: bool = False) -> str:
    """Short name of a node's range on ``attr``.

    ``<=v``, ``>=v`` (``>v``), ``[lo-hi]``, ``v`` where both bounds meet,
    ``=v``, ``!=v``; several exclusions are joined by a comma.
    """
    own, lo, hi, eq, ne = _summary(path, attr)
    if eq is not None:
        return f"={eq}" if len(own) == 1 else f"{eq}"
    if ne:
        return ", ".join(f"!={v}" for v in ne)
    if lo is not None and hi is not None:
        return f"{hi}" if lo == hi and not open_lower else f"[{lo}-{hi}]"
    return f"<={hi}" if lo is None else f"{'>' if open_lower else '>='}{lo}"


def relations(path, attr: str, open_lower: bool = False) -> tuple[list[str], list]:
    own, lo, hi, eq, ne = _summary(path, attr)
    if eq is not None or ne:
        return [r for r, _ in own], [v for _, v in own]
    if lo is not None and hi is not None:
        if lo == hi and not open_lower:
            return ["="], [lo]
        return [">" if open_lower else ">=", "<="], [lo, hi]
    return (["<="], [hi]) if lo is None else ([">" if open_lower else ">="], [lo])


def _bound(x):
    """A bound as number; bounds of text are found in the relations."""
    return None if x is None or isinstance(x, str) else float(x)


class Trees:
    """Grown trees and the tables derived from them (at most a few thousand nodes)."""

    def __init__(self, spark, nodes: list[Node], spec: _Spec, metric: str, rows: DataFrame):
        self._spark, self._nodes, self._spec, self.metric, self._rows = spark, nodes, spec, metric, rows
        self._by_id = {nd.id: nd for nd in nodes}

    def _path(self, nd: Node, open_lower: bool):
        """Path with right children as ``> left value`` when lower bounds are open."""
        if not open_lower:
            return nd.path
        out, cur = [], nd
        while cur.parent is not None:
            rel, val = cur.rel, cur.val
            if rel == ">=":
                sibling = next(x for x in self._nodes if x.parent == cur.parent and x.rel == "<=")
                rel, val = ">", sibling.val
            out.append((cur.attr, rel, val))
            cur = self._by_id[cur.parent]
        return out[::-1]

    def nodes(self, open_lower: bool = False) -> DataFrame:
        """One row per node, roots included."""
        spec = self._spec
        fields = [
            ("tree", pa.string()), ("node", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()),
            ("attr", pa.string()), ("rel", pa.string()), ("val", pa.string()),
            ("lo", pa.float64()), ("lo_incl", pa.bool_()), ("hi", pa.float64()), ("eq", pa.string()),
            ("ne", pa.list_(pa.string())), ("item", pa.string()), ("parent_item", pa.string()),
            ("rels", pa.list_(pa.string())), ("vals", pa.list_(pa.string())),
            ("path", pa.list_(pa.string())), ("parent_items", pa.list_(pa.string())),
            ("is_leaf", pa.bool_()), ("n", pa.int64()), ("support", pa.float64()),
            ("metric", pa.float64()), ("divergence", pa.float64()), ("criterion", pa.float64()),
            ("split_criterion", pa.float64()), ("gain", pa.float64()),
            *[(m, self._sum_type(m)) for m in spec.measures],
        ]
        rows = []
        for nd in self._nodes:
            path = self._path(nd, open_lower)
            lo = hi = eq = item = parent_item = None
            ne, rels, vals, above = [], [], [], []
            if nd.attr is not None:
                _, lo, hi, eq, ne = _summary(path, nd.attr)
                item = item_name(path, nd.attr, open_lower)
                rels, vals = relations(path, nd.attr, open_lower)
                if any(a == nd.attr for a, _, _ in path[:-1]):
                    parent_item = item_name(path[:-1], nd.attr, open_lower)
                for a in dict.fromkeys(a for a, _, _ in path[:-1]):
                    above.append(f"{a}={item_name(path[:-1], a, open_lower)}")
            rows.append(
                (
                    nd.tree, nd.id, nd.parent, nd.depth, nd.attr, path[-1][1] if path else "",
                    None if not path else str(path[-1][2]),
                    _bound(lo), not open_lower, _bound(hi),
                    None if eq is None else str(eq), [str(x) for x in ne], item, parent_item,
                    rels, [str(v) for v in vals], [f"{a}{r}{v}" for a, r, v in path], above,
                    nd.is_leaf, nd.n, nd.n / spec.total, nd.metric, nd.divergence, nd.value, nd.split, nd.gain,
                    *[nd.sums[m] for m in spec.measures],
                )
            )
        return small_table(self._spark, pa.schema(fields), rows)

    def _sum_type(self, m):
        x = self._nodes[0].sums[m]
        if isinstance(x, Decimal):
            return pa.decimal128(38, -x.as_tuple().exponent)
        return pa.float64() if isinstance(x, float) else pa.int64()

    def generalization(self, open_lower: bool = False) -> DataFrame:
        """Edges from a range to the range it was cut from, per attribute."""
        return (
            self.nodes(open_lower)
            .where("parent_item is not null")
            .select("attr", F.col("item").alias("child"), F.col("parent_item").alias("parent"))
            .distinct()
        )

    def stop_gains(self) -> DataFrame:
        """Ranges of separate trees ``(attr, item, above, own)``.

        ``above`` is the smallest gain of the cuts that lead to a range, ``own`` that of
        the range's own cut, NULL for leaves.  A tree of ``minimal_gain=g`` has the
        ranges with ``above > g``; its leaves are those whose ``own`` is not above g.
        """
        rows = []
        for nd in self._nodes:
            if nd.attr is None:
                continue
            above, cur = float("inf"), nd
            while cur.parent is not None:
                cur = self._by_id[cur.parent]
                above = min(above, float(cur.gain))
            rows.append((nd.attr, item_name(nd.path, nd.attr, False), above, None if nd.is_leaf else float(nd.gain)))
        schema = pa.schema([("attr", pa.string()), ("item", pa.string()), ("above", pa.float64()), ("own", pa.float64())])
        return small_table(self._spark, schema, rows)

    def cuts(self) -> dict[str, set]:
        """Values ``(left, right)`` next to every cut of separate trees, per attribute with cuts."""
        out: dict[str, set] = {}
        left = {nd.parent: nd for nd in self._nodes if nd.rel == "<="}
        for nd in self._nodes:
            if nd.rel == ">=":
                out.setdefault(nd.attr, set()).add((left[nd.parent].val, nd.val))
        return out

    def discretization_table(self, mode: str = "hierarchy_leaves", open_lower: bool = False) -> DataFrame:
        """Ranges ``(attr, item, rels, vals, lo, hi, min, max)``; open ends take the column's min or max.

        ``mode``: ``all`` nodes, tree ``leaves``, or ``hierarchy_leaves``: ranges
        that no other range of their attribute was cut from.
        """
        return self._ranges(mode, open_lower).join(self.min_max(), "attr", "left").select(
            "attr", "item", "rels", "vals",
            F.coalesce("lo", F.when(F.col("eq").isNull() & (F.size("ne") == 0), F.col("min"))).alias("lo"),
            F.coalesce("hi", F.when(F.col("eq").isNull() & (F.size("ne") == 0), F.col("max"))).alias("hi"),
            "eq", "ne",
        )

    def _ranges(self, mode: str, open_lower: bool = False) -> DataFrame:
        """The nodes of a mode, each range once."""
        nodes = self.nodes(open_lower).where("attr is not null")
        if mode == "leaves":
            nodes = nodes.where("is_leaf")
        elif mode == "hierarchy_leaves":
            parents = self.generalization(open_lower).select("attr", F.col("parent").alias("item")).distinct()
            nodes = nodes.join(parents, ["attr", "item"], "left_anti")
        elif mode != "all":
            raise ValueError(f"unknown mode {mode!r}")
        return nodes.dropDuplicates(["attr", "item"])

    def discretizations(self, mode: str = "hierarchy_leaves", attributes=None, open_lower: bool = False) -> dict:
        """``{attr: {label: {"rels", "vals"}}}`` for :mod:`subdiv.operators.items`."""
        parents = set()
        if mode == "hierarchy_leaves":
            for nd in self._nodes:
                path = self._path(nd, open_lower)
                if nd.attr is not None and any(a == nd.attr for a, _, _ in path[:-1]):
                    parents.add((nd.attr, item_name(path[:-1], nd.attr, open_lower)))
        elif mode not in ("all", "leaves"):
            raise ValueError(f"unknown mode {mode!r}")
        out: dict = {}
        for nd in self._nodes:
            if nd.attr is None or (attributes is not None and nd.attr not in attributes):
                continue
            path = self._path(nd, open_lower)
            label = item_name(path, nd.attr, open_lower)
            if (mode == "leaves" and not nd.is_leaf) or (nd.attr, label) in parents:
                continue
            rels, vals = relations(path, nd.attr, open_lower)
            out.setdefault(nd.attr, {})[label] = {"rels": rels, "vals": vals}
        return out

    def conditioned(self) -> DataFrame:
        """Leaf ranges with the ranges of other attributes on their path (all-attributes trees)."""
        ranges = self._ranges("hierarchy_leaves").select("attr", "item", "rels", "vals")
        paths = self.nodes().where("attr is not null").select("attr", "item", "parent_items")
        return ranges.join(paths, ["attr", "item"]).select("attr", "item", "rels", "vals", "parent_items")

    def min_max(self) -> DataFrame:
        """Smallest and largest value per numeric attribute."""
        return min_max(self._rows, [a for a in self._spec.attributes if a not in self._spec.text])

    def node_counts(self) -> DataFrame:
        """Internal and leaf nodes per tree, roots not counted."""
        return (
            self.nodes()
            .groupBy("tree")
            .agg(
                F.count_if(~F.col("is_leaf") & F.col("parent").isNotNull()).alias("internal_nodes"),
                F.count_if(F.col("is_leaf") & F.col("parent").isNotNull()).alias("leaf_nodes"),
            )
        )

    def divergent_items(self) -> DataFrame:
        """Ranges of positive divergence ``(attr, item)``, leaves and inner nodes.

        An attribute whose tree has none is listed with a NULL item.
        """
        nodes = self.nodes()
        positive = nodes.where("attr is not null and divergence > 0").select("attr", "item").distinct()
        split = nodes.where("attr is not null").select("attr").distinct()
        none = split.join(positive.select("attr").distinct(), "attr", "left_anti")
        return positive.unionByName(none.select("attr", F.lit(None).cast("string").alias("item")))

    def raw_table(self) -> DataFrame:
        """Each node as its full path with support and sums."""
        return self.nodes().select("tree", "node", "path", "support", "divergence", *self._spec.measures)

    def hierarchy_table(self) -> DataFrame:
        """Each range with its parent range, all ranges above it, relations and level."""
        return self.nodes().where("attr is not null").select(
            "attr", "item", "parent_item", "parent_items", "rels", "vals", (F.col("depth") - 1).alias("level"),
            (~F.col("is_leaf")).alias("has_child"),
        )

    def condition_text(self) -> DataFrame:
        """Text of each node's own condition, ``root`` for roots."""
        return self.nodes().select(
            "tree", "node",
            F.when(F.col("attr").isNull(), F.lit("root")).otherwise(F.concat("attr", "rel", "val")).alias("condition"),
            F.when(
                F.col("attr").isNotNull(),
                F.when(F.substring("item", 1, 1).isin("<", ">", "="), F.concat("attr", "item")).otherwise(
                    F.concat_ws("=", "attr", "item")
                ),
            ).alias("item_text"),
        )


def min_max(df: DataFrame, attributes: list[str]) -> DataFrame:
    """``(attr, min, max)`` of numeric columns in one aggregation."""
    aggs = []
    for i, a in enumerate(attributes):
        col = attribute(df, a).cast("double")
        aggs += [F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}")]
    one = df.agg(*aggs)
    packed = F.array(
        *[
            F.struct(F.lit(a).alias("attr"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
            for i, a in enumerate(attributes)
        ]
    )
    return one.select(F.explode(packed).alias("r")).select("r.*")
