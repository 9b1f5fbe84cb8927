import random

import pytest
from pyspark.sql import functions as F

from subdiv.functions.cells import with_outcome
from subdiv.functions.metrics import CELLS, with_divergence, with_outcome_divergence
from subdiv.operators import items as I
from subdiv.operators import taxonomy as X
from subdiv.operators.mine import mine, mine_top_k, top_k
from subdiv.session import materialize, shared_dir
from tests import brute


def table(seed=1, n=120, nulls=True):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        cell = rng.randrange(4)
        rows.append(
            {
                # one value holds a third of all rows and a separator
                "a": rng.choice(["x, y", "x, y", "k=v", "z", None if nulls else "z"]),
                "b": rng.choice(["p", "q", "r"]),
                "c": rng.choice(["u", "v"]),
                "d": rng.choice(["m", "n"]),
                **{c: int(i == cell) for i, c in enumerate(CELLS)},
            }
        )
    return rows


SCHEMA = "a string, b string, c string, d string, tn bigint, fp bigint, fn bigint, tp bigint"


def as_dict(df):
    return {r["key"]: (r["support_count"], *[r[c] for c in CELLS]) for r in df.collect()}


@pytest.mark.parametrize("method", ["auto", "single_pass", "level_wise"])
def test_flat_itemsets_match_brute_force(spark, method):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_dict(mine(df, list("abcd"), CELLS, 0.03, method=method))
    want = brute.itemsets(rows, lambda r: [(a, r[a]) for a in "abcd" if r[a] is not None], CELLS, 0.03)
    assert got == want
    assert max(k.count("=") for k in got) >= 4


def test_rows_that_do_not_group(spark):
    """An attribute of distinct values takes the path without grouping."""
    rows = [{**r, "a": f"id{i}"} for i, r in enumerate(table(2))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_dict(mine(df, list("abc"), CELLS, 0.05))
    assert got == brute.itemsets(rows, lambda r: [(a, r[a]) for a in "abc"], CELLS, 0.05)


TAX = {"a": {"x, y": "G1", "k=v": ["G1", "G2"], "z": "G2", "G1": "TOP", "G2": "TOP", "absent": "G1"}}
UP = {"x, y": ["G1", "TOP"], "k=v": ["G1", "G2", "TOP"], "z": ["G2", "TOP"]}


def general(r):
    own = [(a, r[a]) for a in "abcd" if r[a] is not None]
    return own + [("a", g) for g in UP.get(r["a"], [])]


@pytest.mark.parametrize("method", ["single_pass", "level_wise"])
def test_two_parents_and_absent_children(spark, method):
    rows = table(3)
    df = spark.createDataFrame(rows, SCHEMA)
    closed = X.closure(X.edges_from_dict(spark, TAX))
    got = as_dict(mine(df, list("abcd"), CELLS, 0.04, closure=closed, method=method))
    assert got == brute.itemsets(rows, general, CELLS, 0.04)
    assert "a=absent" not in got


def test_overlapping_items(spark):
    rows = table(4)
    for i, r in enumerate(rows):
        r["w"] = [w for w, m in (("two", 2), ("three", 3), ("five", 5)) if i % m == 0]
    df = spark.createDataFrame(rows, SCHEMA + ", w array<string>")
    got = as_dict(mine(df, ["w", "b"], CELLS, 0.05, overlap=True))
    want = brute.itemsets(rows, lambda r: [("w", x) for x in r["w"]] + [("b", r["b"])], CELLS, 0.05, overlap=True)
    assert got == want
    assert "w=three, w=two" in got


def test_support_is_antimonotone_and_leaves_add_up(spark):
    rows = table(5, nulls=False)
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_dict(mine(df, list("abcd"), CELLS, 0.02))
    for key, value in got.items():
        items = key.split(", ") if "x, y" not in key else []
        for i in range(len(items)):
            assert got[", ".join(items[:i] + items[i + 1:])][0] >= value[0]
    assert sum(v[0] for k, v in got.items() if k.startswith("b=") and k.count("=") == 1) == len(rows)


def test_max_len_and_admission(spark):
    rows = table(6)
    df = spark.createDataFrame(rows, SCHEMA)
    keep = I.keep_table(spark, {"b": ["p"], "c": []})
    full = as_dict(mine(df, list("abcd"), CELLS, 0.03))
    short = as_dict(mine(df, list("abcd"), CELLS, 0.03, max_len=2, method="level_wise"))
    kept = as_dict(mine(df, list("abcd"), CELLS, 0.03, keep=keep))
    sizes = {r["key"]: r["length"] for r in mine(df, list("abcd"), CELLS, 0.03).select("key", "length").collect()}
    assert short == {k: v for k, v in full.items() if sizes[k] <= 2}
    assert kept == {k: v for k, v in full.items() if "c=" not in k and "b=q" not in k and "b=r" not in k}
    assert mine(df, list("abcd"), CELLS, 0.03, max_len=1).agg(F.max("length")).first()[0] == 1


def test_arguments(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    for bad in (0, -0.1):
        with pytest.raises(ValueError):
            mine(df, ["b"], CELLS, bad)
    with pytest.raises(ValueError):
        mine(df, ["b"], CELLS, 0.1, method="other")
    with pytest.raises(ValueError):
        mine(df.limit(0), ["b"], CELLS, 0.1)
    scored = with_divergence(mine(df, ["b", "c"], CELLS, 0.05), ["d_error"])
    with pytest.raises(ValueError):
        top_k(scored, "d_error", 0)
    with pytest.raises(ValueError):
        top_k(scored, ["d_error"], 3)
    best = top_k(scored, "d_error", 3).collect()
    assert len(best) == 4 and sum(r["length"] == 0 for r in best) == 1


def test_no_frequent_item_leaves_the_root(spark):
    df = spark.createDataFrame([(str(i), 1, 0, 0, 0) for i in range(50)], "a string, tn bigint, fp bigint, fn bigint, tp bigint")
    assert as_dict(mine(df, ["a"], CELLS, 0.5)) == {"": (50, 50, 0, 0, 0)}


def test_written_tables_use_the_named_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5), "numbers")
    assert shared_dir(spark) in df.inputFiles()[0]
    assert df.count() == 5


def test_one_hot_validation(spark):
    bad = spark.createDataFrame([(1, 2), (0, 1)], "`a=x` int, `a=y` int")
    with pytest.raises(ValueError):
        I.from_one_hot(bad, ["a=x", "a=y"])
    good = spark.createDataFrame([(1, 0), (0, 1), (1, 1)], "`a=x` int, `a=y` int")
    arrays, attrs = I.from_one_hot(good, ["a=x", "a=y"])
    assert attrs == ["a"]
    assert [r["a"] for r in arrays.collect()] == [["x"], ["y"], ["x", "y"]]


def test_top_k_while_mining_equals_top_k_of_all(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    everything = mine(df, list("abcd"), CELLS, 0.05)
    settings = [("d_fpr", 4, "level_wise"), ("d_fnr_abs", 1, "level_wise"), ("FPsf", 4, "level_wise"), ("d_error", 900, "single_pass")]
    for metric, k, method in settings:
        expected = top_k(with_divergence(everything, [metric]), metric, k)
        assert as_dict(mine_top_k(df, list("abcd"), CELLS, 0.05, metric, k, method=method)) == as_dict(expected)


def test_top_k_of_an_outcome_counts_fewer_candidates(spark, monkeypatch):
    import subdiv.operators.mine as module

    rng = random.Random(5)
    rows = [tuple(rng.choice("pqrs") for _ in range(5)) for _ in range(600)]
    rows = [(*r, (40.0 if r[:3] == ("p", "q", "r") else 0.0) + rng.random()) for r in rows]
    df = with_outcome(spark.createDataFrame(rows, "a string, b string, c string, d string, e string, v double"), "v")
    counted, write = [], module.materialize

    def counting(frame, name, *rest):
        out = write(frame, name, *rest)
        if name.startswith("level"):
            counted.append(out.count())
        return out

    monkeypatch.setattr(module, "materialize", counting)
    found = mine_top_k(df, list("abcde"), ["y", "y2"], 0.005, "d_outcome", 5, method="level_wise")
    few, counted[:] = sum(counted), []
    everything = mine(df, list("abcde"), ["y", "y2"], 0.005, method="level_wise")
    best = top_k(with_outcome_divergence(everything), "d_outcome", 5)
    assert {r["key"] for r in found.collect()} == {r["key"] for r in best.collect()}
    assert few < sum(counted) / 2


def test_top_k_of_overlapping_items_and_a_taxonomy(spark):
    df = spark.createDataFrame(table(), SCHEMA).withColumn("b", F.array("b", F.concat(F.lit("x"), F.col("c"))))
    found = mine_top_k(df, list("abd"), CELLS, 0.05, "d_error", 6, overlap=True)
    expected = top_k(with_divergence(mine(df, list("abd"), CELLS, 0.05, overlap=True), ["d_error"]), "d_error", 6)
    assert as_dict(found) == as_dict(expected)
    with pytest.raises(ValueError):
        mine_top_k(df, list("abd"), CELLS, 0.05, "d_nothing", 6, overlap=True)
