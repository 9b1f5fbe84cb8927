import random

import pytest
from pyspark.sql import functions as F

from subdiv.functions.criteria import CRITERIA
from subdiv.operators import tree as T
from tests import brute

SCHEMA = "x double, y0 int, t string, tn bigint, fp bigint, fn bigint, tp bigint"


def table(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = float(rng.randrange(40)) / 4
        wrong = rng.random() < (0.7 if 3 < x < 6 else 0.2)
        positive = rng.random() < 0.4
        rows.append(
            {
                "x": x, "y0": rng.randrange(12), "t": rng.choice("abc"),
                "tn": int(not wrong and not positive), "fp": int(wrong and not positive),
                "fn": int(wrong and positive), "tp": int(not wrong and positive),
            }
        )
    return rows


def nodes(trees):
    return sorted(
        [(r["lo"], r["hi"], r["n"], round(r["divergence"], 9)) for r in trees.nodes().collect()], key=repr
    )


@pytest.mark.parametrize("criterion", CRITERIA)
def test_trees_match_brute_force(spark, criterion):
    rows = table(7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = nodes(T.grow(df, ["x"], "d_error", 0.1, criterion=criterion))
    want = brute.tree(rows, "x", lambda r: r["fp"] + r["fn"], lambda r: 1, 0.1, criterion)
    assert got == want
    assert len(got) > 3


def test_denominator_of_the_metric_counts(spark):
    rows = table(8)
    df = spark.createDataFrame(rows, SCHEMA)
    got = nodes(T.grow(df, ["x"], "d_fpr", 0.15))
    assert got == brute.tree(rows, "x", lambda r: r["fp"], lambda r: r["fp"] + r["tn"], 0.15, "divergence_criterion")


def test_joint_tree_of_one_attribute_equals_its_own_tree(spark):
    df = spark.createDataFrame(table(9), SCHEMA)
    own = nodes(T.grow(df, ["x"], "d_error", 0.15))
    joint = nodes(T.grow(df, ["x"], "d_error", 0.15, splitting="all_attributes"))
    assert own == joint


def test_integers_keep_their_look_and_nulls_stay_out(spark):
    rows = [{**r, "y0": None if i % 10 == 0 else r["y0"]} for i, r in enumerate(table(10))]
    df = spark.createDataFrame(rows, SCHEMA)
    trees = T.grow(df, ["y0"], "d_error", 0.15)
    items = [r["item"] for r in trees.nodes().where("attr is not null").collect()]
    assert items and all("." not in i for i in items)
    level1 = trees.nodes().where("depth = 1").agg(F.sum("n")).first()[0]
    assert level1 == sum(r["y0"] is not None for r in rows)


def test_unsplittable_attribute_and_ties(spark):
    rows = [{**r, "y0": 3} for r in table(11)]
    trees = T.grow(spark.createDataFrame(rows, SCHEMA), ["y0"], "d_error", 0.1)
    assert trees.nodes().count() == 1 and trees.discretizations() == {}
    # symmetric halves: both cuts score the same, the lower one wins
    sym = [(float(v), e) for v, e in [(1, 1), (2, 0), (3, 1)] for _ in range(10)]
    df = spark.createDataFrame(sym, "x double, e bigint").select(
        "x", F.lit(0).cast("bigint").alias("tn"), F.col("e").alias("fp"), F.lit(0).cast("bigint").alias("fn"),
        (1 - F.col("e")).alias("tp"),
    )
    first = T.grow(df, ["x"], "d_error", 0.3, max_depth=1).nodes().where("depth = 1").orderBy("n").collect()
    assert [(r["lo"], r["hi"]) for r in first] == [(None, 1.0), (2.0, None)]


def test_undefined_metric_is_never_the_best_cut(spark):
    # the low half has neither fp nor tn, so its false-positive rate is undefined
    rows = [(1.0, 0, 0, 0, 1)] * 20 + [(2.0, 1, 0, 0, 0)] * 10 + [(3.0, 0, 1, 0, 0)] * 10
    df = spark.createDataFrame(rows, "x double, tn bigint, fp bigint, fn bigint, tp bigint")
    top = T.grow(df, ["x"], "d_fpr", 0.1, max_depth=1).nodes().where("depth = 1 and rel = '<='").first()
    assert top["hi"] == 2.0


def test_discrete_attributes(spark):
    df = spark.createDataFrame(table(12), SCHEMA)
    trees = T.grow(df, ["t", "x"], "d_error", 0.1, splitting="all_attributes", max_depth=3)
    assert trees.nodes().count() > 1
    with pytest.raises(ValueError):
        T.grow(df, ["t"], "d_error", 0.1)
    two = df.withColumn("t", F.when(F.col("t") == "c", "b").otherwise(F.col("t")))
    items = {r["item"] for r in T.grow(two, ["t"], "d_error", 0.1, splitting="all_attributes").nodes().where("attr is not null").collect()}
    assert items in ({"=a", "=b"}, set())


def test_text_with_many_values_is_cut_by_order(spark):
    rows = table(14)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("t", F.lpad((F.col("x") * 4).cast("int").cast("string"), 3, "0"))
    text = T.grow(df, ["t"], "d_error", 0.15, splitting="all_attributes")
    number = T.grow(df, ["x"], "d_error", 0.15)
    sizes = lambda trees: sorted((r["n"], r["divergence"]) for r in trees.nodes().collect())
    assert sizes(text) == sizes(number)
    ranges = text.discretizations()["t"]
    assert any(r["rels"] == ["<="] and isinstance(r["vals"][0], str) for r in ranges.values())


def test_names():
    path = [("x", "<=", 9), ("x", ">=", 2), ("y", "<=", 1), ("x", "<=", 5)]
    assert T.item_name(path, "x") == "[2-5]"
    assert T.item_name(path, "y") == "<=1"
    assert T.item_name([("x", ">=", 4), ("x", "<=", 4)], "x") == "4"
    assert T.item_name([("c", "!=", "a"), ("c", "!=", "b")], "c") == "!=a, !=b"
    assert T.item_name([("c", "=", "a")], "c") == "=a"
    assert T.item_name([("c", "!=", "a"), ("c", "=", "b")], "c") == "b"
    assert T.relations(path, "x") == ([">=", "<="], [2, 5])


def test_arguments(spark):
    df = spark.createDataFrame(table(13), SCHEMA)
    for options in ({"criterion": "sum_abs"}, {"splitting": "other"}):
        with pytest.raises(ValueError):
            T.grow(df, ["x"], "d_error", **options)
    with pytest.raises(ValueError):
        T.grow(df, ["x"], "d_ppv")
    with pytest.raises(ValueError):
        T.grow(df.withColumn("y", F.col("x")), ["x"], "d_outcome", criterion="entropy")


@pytest.mark.parametrize("seed", range(3))
def test_nodes_of_a_joint_tree_hold_the_rows_of_their_path(spark, seed):
    """Histograms of larger children are differences; rows without a value of a cut attribute leave."""
    rng = random.Random(seed)
    rows = table(seed + 20, 400)
    for r in rows:
        r["t"] = rng.choice([None, "a", "b", "c", "d"])
        r["x"] = None if rng.random() < 0.2 else r["x"]
        r["y0"] = None if rng.random() < 0.1 else r["y0"]
    trees = T.grow(spark.createDataFrame(rows, SCHEMA), ["x", "t", "y0"], "d_error", 0.05, splitting="all_attributes")
    hold = {"<=": lambda x, v: x <= v, ">=": lambda x, v: x >= v, "=": lambda x, v: x == v, "!=": lambda x, v: x != v}
    cut = set()
    for node in trees._nodes:
        inside = [r for r in rows if all(r[a] is not None and hold[rel](r[a], v) for a, rel, v in node.path)]
        assert node.n == len(inside)
        assert node.sums == {m: sum(r[m] for r in inside) for m in ("tn", "fp", "fn", "tp")}
        cut.add((node.attr, node.depth > 2))
    assert {("t", True), ("x", True)} <= cut or {("y0", True), ("x", True)} <= cut


def test_a_joint_tree_reads_its_source_once(spark):
    df = spark.createDataFrame(table(31, 300), SCHEMA).repartition(2)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    trees = T.grow(df.mapInArrow(count, df.schema), ["x", "t"], "d_error", 0.05, splitting="all_attributes")
    assert max(n.depth for n in trees._nodes) > 2 and read.value == 300


def test_trees_grown_together_equal_trees_grown_alone(spark):
    df = spark.createDataFrame(table(41, 400), SCHEMA)
    supports = [0.02, 0.1, 0.3]
    forest = T.grow_each(df, ["x", "y0"], "d_error", supports)
    facts = lambda trees: [(n.tree, n.depth, n.path, n.n, n.sums, n.divergence, n.gain) for n in trees._nodes]
    for support in supports:
        alone = T.grow(df, ["x", "y0"], "d_error", support)
        assert facts(forest[support]) == facts(alone)
        assert forest[support].discretizations() == alone.discretizations()
    with pytest.raises(ValueError):
        T.grow_each(df, ["x"], "d_error", [0.1, 0.0])


def test_the_sweep_over_tree_supports_reads_its_source_once(spark):
    from subdiv.functions.cells import with_cells
    from subdiv.plans.explore import explore_hierarchical, tree_support_sweep

    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rnd = random.Random(8)
    n = 240
    rows = [(rnd.choice([None, float("nan"), *range(-20, 20)]), rnd.choice("ab"), rnd.random() < 0.4, rnd.random() < 0.5) for _ in range(n)]
    table_ = spark.createDataFrame([(None if x is None else float(x), g, int(t), int(p)) for x, g, t, p in rows], "x double, g string, cls int, pred int")
    plain = with_cells(table_, "cls", "pred", {"N": 0, "P": 1})
    read = with_cells(table_.mapInArrow(count, table_.schema), "cls", "pred", {"N": 0, "P": 1})
    roles = {"true": "cls", "predicted": "pred", "classes": {"N": 0, "P": 1}}
    supports = [0.05, 0.2, 0.45, 0.6]  # the last tree is not cut, so values are items
    found = tree_support_sweep(read, ["x", "g"], ["x"], supports, 0.02, "d_fpr", **roles).collect()
    assert reads.value == n
    got = {r["min_sup_tree"]: (r["itemsets"], r["max_divergence"], r["leaf_ranges"]) for r in found}
    for support in supports:
        trees = T.grow(plain, ["x"], "d_fpr", support)
        ranges = trees.discretizations(attributes=["x"])
        alone = explore_hierarchical(plain, ["x", "g"], ranges, trees.generalization(), 0.02, ["d_fpr"], **roles)
        want = alone.agg(F.count(F.lit(1)).alias("n"), F.max("d_fpr").alias("m")).first()
        assert got[support] == (want["n"], want["m"], sum(len(r) for r in ranges.values()))


def test_the_criterion_of_a_cut_is_computed_once(spark):
    rows = spark.createDataFrame(
        [(0, 5, 2, 4, 9, 4, 8, 0.0, 0.5, 0.1)],
        "node long, l_n long, l_num long, l_den long, t_n long, t_num long, t_den long, t_div double, t_split double, min_support double",
    )
    spec = T._spec_of(spark.createDataFrame([(1.0, 0, 0, 0, 0)], "x double, tn long, fp long, fn long, tp long"), ["x"], "d_fpr", 0.1, "entropy", None, None, 0)
    spec.total, spec.baseline = 9, 0.5
    plan = T.candidate_cuts(rows, spec)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("LOG2(") == 4  # two terms of either side


def test_conditioned_ranges_do_not_read_the_source_again(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(table(5), SCHEMA)
    trees = T.grow(df.mapInArrow(count, df.schema), ["x"], "d_error", 0.2, splitting="all_attributes")
    assert reads.value == 150 and trees.conditioned().collect()
    assert reads.value == 150


def test_a_node_smaller_than_two_children_is_not_searched():
    spec = T._Spec(["x"], {}, set(), [], [], [], "entropy", 0.1, None, None, 0, total=30)

    def node(n, support):
        return T.Node(1, "x", 0, 1, "x", "<=", 1, n, {}, 0.0, 0.0, 0.0, total_n=n, min_support=support)

    assert not T._may_split(node(5, 0.1), spec) and T._may_split(node(6, 0.1), spec)
    for total in range(1, 60):
        spec.total = total
        for support in (0.05, 0.1, 0.15, 0.3, 0.7):
            for n in range(total + 1):
                able = any(a / total >= support and (n - a) / total >= support for a in range(n + 1))
                assert T._may_split(node(n, support), spec) == able
