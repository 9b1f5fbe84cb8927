"""Preparation, taxonomies, ranges, regions, readers and writers."""

import warnings

import pytest
from pyspark.sql import functions as F

from subdiv.functions import intervals as V
from subdiv.operators import items as I
from subdiv.operators import prepare as P
from subdiv.operators import regions as G
from subdiv.operators import taxonomy as X
from subdiv.plans import explore as E
from subdiv.sources import tables as S


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_expert_bins(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (3.5,), (7.5,), (8.5,), (None,)], "x double")
    x = F.col("x")
    assert one(df, P.prior_count_bin(x)) == [("0",), ("[1,3]",), (">3",), (">3",), (">3",), (">3",)]
    # values between 7 and 8 belong to no week and no month
    assert one(df, P.stay_length_bin(x)) == [("<week",), ("<week",), ("<week",), (">3Months",), ("1w-3M",), (">3Months",)]
    assert one(df, P.age_bin(x))[-1] == (">45",)
    with pytest.raises(ValueError):
        P.edge_bin(x, [1, 2, 3, 4])


def test_recode_and_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert one(P.recode(df, "x", {"a": "z"}), "x") == [("z",), ("b",), (None,)]
    long = {str(i): "n" for i in range(100)} | {"b": "y"}
    assert sorted(one(P.recode(df, "x", long), "x"), key=str) == [("a",), ("y",), (None,)]
    numbers = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")
    for more in ({}, {i: i for i in range(100, 200)}):  # the same at any length
        out = P.recode(numbers, "x", {1: 10, 2: None} | more)
        assert out.schema["x"].dataType.simpleString() == "int"
        assert sorted(one(out, "x"), key=str) == [(10,), (3,), (None,), (None,)]
    assert P.recode(numbers, "x", {1: "one"}).schema["x"].dataType.simpleString() == "string"
    assert P.recode(numbers, "x", {1: 1 << 40}).schema["x"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        P.recode(numbers, "x", {1: 2, "1": 3})
    assert one(P.exclude(df, "x", ["a"]), "x") == [("b",), (None,)]
    assert one(P.fill_text(df, ["x"]), "x")[-1] == ("NaN",)


def test_quantile_edges(spark):
    df = spark.createDataFrame([(float(i), i % 3, "t") for i in range(101)], "x double, few int, name string")
    out, edges = P.bin_columns(df, bins=4)
    assert one(edges, "attr", "edges") == [("x", [0.0, 25.0, 50.0, 75.0, 100.0])]
    assert {r["x"] for r in out.collect()} == {"<=25", "(25-50]", "(50-75]", ">75"}
    assert out.schema["few"].dataType.simpleString() == "string"
    approx = P.bin_edges(df, ["x"], 4, approximate=True)["x"]["edges"]
    assert approx == pytest.approx([25, 50, 75], abs=2)


def test_collapsing_bins(spark):
    # three quarters of the values are equal, so most quantiles coincide
    df = spark.createDataFrame([(float(max(i, 75)),) for i in range(101)], "x double")
    assert P.bin_edges(df, ["x"], 4)["x"]["edges"] == []
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        assert P.bin_columns(df, bins=4)[0].columns == []
    half = spark.createDataFrame([(float(max(i, 60)),) for i in range(101)], "x double")
    assert len(P.bin_edges(half, ["x"], 3)["x"]["edges"]) == 1
    assert len(P.bin_edges(half, ["x"], 3, adaptive=True)["x"]["edges"]) == 2
    with pytest.raises(ValueError):
        P.check_bin_counts(half, 3, ["x"])


def test_zero_low_high(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (2.0,), (3.0,), (None,)], "g double")
    assert one(P.zero_low_high(df, ["g"]), "g") == [("0",), ("0",), ("Low",), ("Low",), ("High",), (None,)]


def test_effect_size_of_the_whole_table(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "s string, v double")
    assert P.effect_size(df, "s", "v").first()["effect_size"] == 0.0


def test_out_of_fold_uses_every_row_once(spark):
    rows = [(i, "u" if i % 2 else "v", float(i % 7), int(i % 2 and i % 7 > 1)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, t string, x double, y int")
    out = P.out_of_fold(df, "y", ["t", "x"], "id", folds=3, trees=5)
    assert out.count() == 80 and out.select("id").distinct().count() == 80
    assert out.where("predicted = y").count() > 60


def _written(edges, folder):
    X.write_json(edges, str(folder / "edges"))
    return str(folder / "edges")


def test_taxonomy_cycle_and_levels(spark, tmp_path):
    loop = X.edges_from_dict(spark, {"a": {"x": "y", "y": "z", "z": "x"}})
    with pytest.raises(ValueError):
        X.levels(loop)
    with pytest.raises(ValueError):
        X.closure(loop)
    dag = X.edges_from_dict(spark, {"a": {1: {"x": ["y", "z"]}, 2: {"y": "z"}}})
    assert {tuple(r) for r in X.levels(dag).select("child", "level").collect()} == {("x", 1), ("y", 2)}
    assert {(r["leaf"], r["item"]) for r in X.closure(dag).collect()} == {("x", "y"), ("x", "z"), ("y", "z")}
    back = X.edges_from_json(spark, _written(dag, tmp_path), lines=True)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in dag.collect()}
    assert X.edges_to_dict(dag) == {"a": {"x": ["y", "z"], "y": "z"}}
    with pytest.raises(ValueError):
        X.from_wide(spark.createDataFrame([("c", "r1"), ("c", "r2")], "a string, b string"), "n", ["a", "b"])


def test_ranges_in_gaps(spark):
    df = spark.createDataFrame([(1.0,), (2.5,), (3.0,), (9.0,), (None,)], "x double")
    ranges = {"x": {"<=2": {"rels": ["<="], "vals": [2.0]}, ">=3": {"rels": [">="], "vals": [3.0]}}}
    assert one(I.discretize_ranges(df, ranges), "x") == [("<=2",), (None,), (">=3",), (">=3",), (None,)]
    assert one(I.discretize_ranges(df, ranges, "closest_left"), "x")[1] == ("<=2",)
    assert one(I.discretize_ranges(df, ranges, "keep"), "x")[1] == ("2.5",)
    many = {"x": {f"[{i}-{i}.5]": {"rels": [">=", "<="], "vals": [float(i), i + 0.5]} for i in range(20)}}
    assert one(I.discretize_ranges(df, many), "x") == [("[1-1.5]",), ("[2-2.5]",), ("[3-3.5]",), ("[9-9.5]",), (None,)]


def test_nan_is_missing(spark):
    from subdiv.operators import tree as T
    from subdiv.operators.mine import mine

    nan = float("nan")
    rows = [(float(i % 20), nan if i % 4 == 0 else 1.5, 1, int(i % 20 > 9), 0, int(i % 20 <= 9)) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double, tn int, fp int, fn int, tp int")
    found = {r["key"]: r["support_count"] for r in mine(df, ["y"], ["tn", "fp", "fn", "tp"], 0.01).collect()}
    assert found == {"": 100, "y=1.5": 75}
    ranges = {"y": {">=1": {"rels": [">="], "vals": [1.0]}}}
    assert I.discretize_ranges(df, ranges).where("y is null").count() == 25
    assert I.discretize_overlapping(df, ranges).where("size(y) = 0").count() == 25
    holes = df.withColumn("x", F.when(F.col("x") == 0, F.lit(nan)).otherwise(F.col("x")))
    binned = P.bin_columns(holes.select("x"), bins=4)[0]
    assert binned.where("x is null").count() == 5
    joint = T.grow(holes, ["x"], "d_error", 0.2, splitting="all_attributes", max_depth=2)
    assert joint.nodes().where("depth = 1").agg(F.sum("n")).first()[0] == 95
    assert joint.min_max().first()["max"] == 19.0


def test_items_of_missing_values(spark):
    df = spark.createDataFrame([("x=1", None), (None, 2)], "a string, b int")
    got = [[tuple(i) for i in r["items"]] for r in I.itemize(df, ["a", "b"]).collect()]
    assert got == [[("a", "a=x=1")], [("b", "b=2")]]
    wide = I.one_hot(df, ["a", "b"])
    assert wide.columns == ["a=x=1", "b=2"] and [tuple(r) for r in wide.collect()] == [(1, 0), (0, 1)]
    with pytest.raises(ValueError):
        I.one_hot(df, ["a", "b"], max_columns=1)


def test_item_ranges(spark):
    df = spark.createDataFrame([(v,) for v in [">=1.5", "<=-2", "[-3--1]", "[-3.5-2]", "[1-2]", "x", "5", "=-5.5"]], "v string")
    got = [tuple(r["r"]) for r in df.select(V.item_range(F.col("v")).alias("r")).collect()]
    assert got == [(1.5, None), (None, -2.0), (-3.0, -1.0), (-3.5, 2.0), (1.0, 2.0), (None, None), (5.0, 5.0), (-5.5, -5.5)]


def test_region_scores(spark):
    true = G.region_table(spark, [{"a": [[(">=", 0.0), ("<=", 10.0)]], "b": [[("=", 1.0)]]}])
    found = spark.createDataFrame([("a", 0.0, 5.0), ("a", 5.0, 10.0), ("a", 10.0, 10.0)], "attr string, lo double, hi double")
    best = {r["attr"]: (r["found_lo"], r["f_measure"]) for r in G.best_intervals(true, found).collect()}
    assert best["a"][0] == 0.0 and best["a"][1] == pytest.approx(2 / 3) and best["b"] == (None, 0.0)
    assert G.pattern_similarity(true, found).first()["similarity"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        G.region_table(spark, [{"a": [[(">=", 0)], [("<=", 1)]]}])


def test_known_peak_is_found(spark):
    """Errors sit in one box; the best itemset overlaps it."""
    rows = [(x / 2, y / 2, 1, int(not (4 <= x / 2 <= 7 and 2 <= y / 2 <= 6))) for x in range(20) for y in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, cls int, pred int")
    from subdiv.functions.cells import with_cells

    cells = with_cells(df, "cls", "pred", {"N": 0, "P": 1})
    trees, ranges, edges = E.tree_hierarchy(cells, ["a", "b"], "d_error", 0.1)
    roles = {"true": "cls", "predicted": "pred", "classes": {"N": 0, "P": 1}}
    found = E.explore_hierarchical(df, ["a", "b"], ranges, edges, 0.05, ["d_error"], **roles)
    best = found.orderBy(F.desc("d_error"), F.desc("support")).limit(1)
    region = G.region_table(spark, [{"a": [[(">=", 4), ("<=", 7)]], "b": [[(">=", 2), ("<=", 6)]]}])
    assert G.itemset_similarity(best, region, trees.min_max()).first()["similarity"] > 0.7
    with pytest.raises(ValueError):
        E.explore_hierarchical(df, ["a"], ranges, edges, 0.05, ["d_error"], all_attributes=True, **roles)


def test_files(spark, tmp_path):
    path = tmp_path / "countries.csv"
    path.write_bytes('﻿1,"Korea, North",PRK,408,Eastern Asia,,Asia\r\n2,Chad,TCD,148,Middle Africa,Sub-Saharan Africa,Africa\r\n'.encode())
    got = S.read_country_table(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["country"], r["region2"], r["continent"]) for r in got] == [
        (1, "Korea, North", None, "Asia"), (2, "Chad", "Sub-Saharan Africa", "Africa")
    ]
    with pytest.raises(ValueError):
        S.read_csv(spark, str(tmp_path / "absent.csv"), "a int")
    stats = tmp_path / "stats.json"
    stats.write_text('{"0.1": {"base": 1.5, "generalized": 2.0}}')
    rows = S.read_nested_statistics(spark, str(stats), "time").collect()
    assert {(r["min_sup"], r["configuration"], r["value"]) for r in rows} == {(0.1, "base", 1.5), (0.1, "generalized", 2.0)}


def test_itemset_files_keep_commas(spark, tmp_path):
    df = spark.createDataFrame([(["a=x, y", "b=1"], 2)], "itemset array<string>, length int")
    S.write_itemsets(df, str(tmp_path / "its"))
    assert S.read_itemsets(spark, str(tmp_path / "its")).first()["itemset"] == ["a=x, y", "b=1"]


def test_folds_are_exact_per_label(spark):
    rows = [(i, "hot" if i % 10 else ("rare" if i % 20 else None)) for i in range(1003)]
    df = spark.createDataFrame(rows, "id int, y string").repartition(5)
    out = P.folds_of(df, "y", "id", 7)
    sizes = out.groupBy("y", "fold").count().collect()
    for label in ("hot", "rare", None):
        own = [r["count"] for r in sizes if r["y"] == label]
        assert len(own) == 7 and max(own) - min(own) <= 1
    plain = [r["count"] for r in P.folds_of(df, "y", "id", 7, stratified=False).groupBy("fold").count().collect()]
    assert sum(plain) == 1003 and max(plain) - min(plain) <= 1
    assert sorted(map(tuple, out.select("id", "fold").collect())) == sorted(map(tuple, P.folds_of(df, "y", "id", 7).select("id", "fold").collect()))
    assert P.held_out(df, "id", 0.3).where("held_out").count() == 301
    assert P.folds_of(df.limit(0), "y", "id", 7).count() == 0
    with pytest.raises(ValueError):
        P.folds_of(df, "y", "id", 1)


def test_out_of_fold_modes(spark):
    rows = [(i, "u" if i % 2 else None, float(i % 7), "yes" if i % 2 and i % 7 > 1 else "no") for i in range(80)]
    df = spark.createDataFrame(rows + [(80, "u", None, None)], "id int, t string, x double, y string")
    tested = P.out_of_fold(df, "y", ["t", "x"], "id", trees=5, validation="test", probability="share")
    assert tested.count() == 25 and tested.columns == ["id", "t", "x", "y", "predicted", "share"]
    learned = P.out_of_fold(df, "y", ["t", "x"], "id", trees=5, validation="all", probability="share")
    assert learned.count() == 81 and learned.where("(share > 0.5) = (predicted = 'yes')").count() == 81
    assert learned.where("predicted = y").count() > 70
    with pytest.raises(ValueError):
        P.out_of_fold(df, "y", ["t", "x"], "id", validation="half")
    with pytest.raises(ValueError):
        P.out_of_fold(df.limit(0), "y", ["t", "x"], "id")


def test_one_hot_of_named_items(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), ("y", 1)], "a string, b int")
    out = I.one_hot(df, ["a", "b"], items=[("b", "1"), ("a", "x"), ("a", "z")])
    assert out.columns == ["b=1", "a=x", "a=z"]
    assert sorted(map(tuple, out.collect())) == [(0, 0, 0), (1, 0, 0), (1, 1, 0)]
    assert I.one_hot(df, ["a", "b"]).columns == ["a=x", "a=y", "b=1", "b=2"]
    with pytest.raises(ValueError):
        I.one_hot(df, ["a", "b"], max_columns=3)
    with pytest.raises(ValueError):
        I.one_hot(df, ["a"], items=[("b", "1")])
