"""Metrics, selection, Shapley values, corrections and lattices on small itemset tables."""

import random
from itertools import combinations
from math import factorial, isclose

import pytest
from pyspark.sql import functions as F

from subdiv.functions import cells as C
from subdiv.functions import metrics as M
from subdiv.functions.metrics import CELLS
from subdiv.operators import corrective as R
from subdiv.operators import lattice as L
from subdiv.operators import report as P
from subdiv.operators import select as S
from subdiv.operators import shapley as H
from subdiv.operators.mine import mine
from subdiv.operators.subsets import explode_subsets
from tests.test_mine import SCHEMA, table


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(table(21, nulls=False), SCHEMA)
    return M.with_divergence(mine(df, list("bcd"), CELLS, 0.02), ["d_fpr", "d_error"])


def values(df, metric="d_fpr"):
    return {r["key"]: r[metric] for r in df.select("key", metric).collect()}


def test_cells_of_missing_labels(spark):
    df = spark.createDataFrame(
        [(1, 1), (1, 0), (0, 1), (0, 0), (1, None), (0, None), (None, 1), (None, None)], "y int, p int"
    )
    got = [tuple(r) for r in C.with_cells(df, "y", "p", {"N": 0, "P": 1}).select(*CELLS).collect()]
    assert got == [
        (0, 0, 0, 1), (0, 0, 1, 0), (0, 1, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0), (0, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)
    ]


def test_class_map_and_targets(spark):
    assert C.class_map(spark.createDataFrame([("b",), ("a",)], "y string"), "y") == {"N": "a", "P": "b"}
    with pytest.raises(ValueError):
        C.class_map(spark.createDataFrame([("b",), ("a",), ("c",)], "y string"), "y")
    for bad in ({}, {"true": "a"}, {"true": "a", "predicted": "b", "outcome": "c"}):
        with pytest.raises(ValueError):
            C.check_target(**bad)
    with pytest.raises(ValueError):
        C.check_criterion("outcome", "entropy")


def test_zero_denominators(spark):
    rows = [([], "", 0, 1.0, 4, 1, 1, 1, 1), (["a=x"], "a=x", 1, 0.5, 2, 0, 0, 1, 1)]
    df = spark.createDataFrame(
        rows, "itemset array<string>, key string, length int, support double, support_count bigint, "
        "tn bigint, fp bigint, fn bigint, tp bigint",
    )
    r = M.with_divergence(df, ["d_fpr", "FPsf", "d_ppv"]).where("length = 1").first()
    assert r["fpr"] == 0 and r["d_fpr"] == -0.5 and r["FPsf"] is None and r["ppv"] == 1.0
    with pytest.raises(ValueError):
        M.with_divergence(df, ["d_unknown"])
    with pytest.raises(ValueError):
        M.beta_mean("d_fpr_w")


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (0, 0.25)], "y int, p double")
    got = [r[0] for r in df.select(C.log_loss(F.col("y"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(0, abs=1e-12) and 30 < got[1] < 40 and got[2] == pytest.approx(0.2876820724517809)


def test_local_shapley_adds_up(scored):
    v = values(scored)
    total = {}
    for r in H.local_shapley(scored, "d_fpr").collect():
        total[r["key"]] = total.get(r["key"], 0) + r["shapley"]
    assert len(total) == len(v) - 1
    assert all(isclose(total[k], v[k] - v[""], abs_tol=1e-12) for k in total)


def test_global_shapley_against_definition(scored):
    v = values(scored)
    singles = [k for k in v if k.count("=") == 1]
    card = {}
    for k in singles:
        card[k[0]] = card.get(k[0], 0) + 1
    a = len(card)
    want = {}
    for i in singles:
        s = 0.0
        for j in v:
            parts = j.split(", ") if j else []
            if any(p[0] == i[0] for p in parts):
                continue
            ji = ", ".join(sorted([*parts, i]))
            if ji in v:
                prod = 1
                for p in [*parts, i]:
                    prod *= card[p[0]]
                s += (v[ji] - v[j]) * factorial(len(parts)) * factorial(a - len(parts) - 1) / (factorial(a) * prod)
        want[i] = s
    got = {r["key"]: r["shapley"] for r in H.global_shapley(scored, "d_fpr").collect()}
    assert got.keys() == want.keys() and all(isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    norm = {r["key"]: r["shapley"] for r in H.normalized(H.global_shapley(scored, "d_fpr")).collect()}
    assert max(abs(x) for x in norm.values()) == pytest.approx(1)


def test_marginals_cover_every_item(scored):
    v = values(scored)
    rows = S.marginals(scored, "d_fpr").collect()
    assert len(rows) == sum(k.count("=") for k in v)
    assert all(isclose(r["delta"], v[r["si_key"]] - v[r["s_key"]], abs_tol=1e-15) for r in rows)
    assert S.missing_subsets(scored, "d_fpr").first()[0] == 0
    few = scored.where("length <> 1")
    assert S.missing_subsets(few, "d_fpr").first()[0] > 0


def test_minimal_itemsets_with_nulls(spark):
    rows = [([], 0.0), (["a=1"], 0.5), (["b=1"], None), (["a=1", "b=1"], 0.5), (["a=1", "c=1"], None), (["b=1", "c=1"], None), (["c=1"], 0.0)]
    df = spark.createDataFrame([(i, ", ".join(i), len(i), x) for i, x in rows], "itemset array<string>, key string, length int, m double")
    kept = {r["key"] for r in S.minimal(df, "m").collect()}
    assert kept == {"", "a=1", "b=1", "a=1, c=1"}


def test_long_itemsets_explode_in_two_steps(spark):
    items = [f"i{n:02d}=1" for n in range(14)]
    df = spark.createDataFrame([(items,)], "itemset array<string>")
    out = explode_subsets(df)
    assert out.count() == 2**14 and out.select("subset_key").distinct().count() == 2**14
    assert explode_subsets(df, strict=True).agg(F.max("subset_length")).first()[0] == 13


def test_corrections(scored):
    m = S.marginals(scored, "d_fpr")
    c = R.corrective_items(m)
    rows = c.collect()
    assert rows and all(abs(r["v_si"]) < abs(r["v_s"]) for r in rows)
    stats = R.statistics(c, m).collect()
    assert sum(r["count"] for r in stats) == len(rows)
    assert all(0 < r["share"] <= 1 and r["corr_coef_min"] <= r["corr_coef_max"] for r in stats)
    t = R.significance(c, scored, "d_fpr").collect()
    assert len(t) == len(rows) and all(r["t_value_corr"] >= 0 for r in t)


def test_lattice_groups(scored):
    target = ["b=p", "c=u", "d=m"]
    n = L.nodes(scored, "d_fpr", [target])
    v = {r["key"]: r["rounded"] for r in n.collect()}
    assert len(v) == 8
    th = sorted(abs(x) for x in v.values())[4]
    sets = {k: frozenset(k.split(", ")) if k else frozenset() for k in v}
    good = [k for k in v if all(abs(v[j]) >= th for j in v if sets[k] <= sets[j])]
    smallest = {k for k in good if not any(sets[j] < sets[k] for j in good)}
    got = L.groups(n, th).collect()
    assert {r["key"] for r in got if r["group"] == "all_greater"} == smallest
    assert {r["key"] for r in got if r["group"] == "greater"} == {k for k in v if abs(v[k]) >= th}
    assert L.edges(n).count() == 12


def test_ranking_modes(scored):
    v = values(scored)
    top = S.top(scored, "d_fpr", 3).collect()
    assert [r["d_fpr"] for r in top] == sorted(v.values(), reverse=True)[:3]
    strict = {r["key"] for r in S.above(scored, "d_fpr", 0.0, strict=True).collect()}
    assert "" not in strict and strict == {k for k, x in v.items() if x > 0}
    assert S.lookup(scored, [["c=u", "b=p"], []]).count() == 2
    assert S.itemset_key(["c=u", "b=p"]) == "b=p, c=u"


def test_slices_and_settings(spark):
    df = spark.createDataFrame([("x", "p", 1, 1), ("x", "q", 1, 0), ("y", "p", 0, None)], "a string, b string, y int, p int")
    got = {r["slice"]: r["error_rate"] for r in S.slice_error_rates(df, [{"a": "x"}, {"a": "y", "b": None}, {"a": "z"}], "y", "p").collect()}
    assert got == {0: 0.5, 1: 1.0}
    stats = spark.createDataFrame([(0.1, 3, 0.5), (0.1, 2, 0.5), (0.2, 2, 0.1)], "sup double, bins int, score double")
    best = {r["sup"]: r["bins"] for r in S.best_setting(stats, ["sup"], "bins", "score").collect()}
    assert best == {0.1: 2, 0.2: 2}


def test_printable(spark):
    df = spark.createDataFrame(
        [(["b=x", "a=y"], "a=y, b=x", 0.125, 0.0625, 0.25, 0.5)],
        "itemset array<string>, key string, support double, fdr double, d_fdr double, t_value_fdr double",
    )
    out = P.printable(df, {"a=": "A:"})
    assert out.columns == ["itemset", "sup", "fdr", "Δ_fdr", "t_fdr"]
    assert tuple(out.first()) == ("A:y, b=x", 0.12, 0.062, 0.25, 0.5)


def test_outcome_variance_matches_the_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), float(rng.randrange(100))) for _ in range(60)]
    df = C.with_outcome(spark.createDataFrame(rows, "b string, y0 double"), "y0")
    out = M.with_outcome_divergence(mine(df, ["b"], ["y", "y2"], 0.1))
    for r in out.collect():
        ys = [y for b, y in rows if r["key"] in ("", f"b={b}")]
        assert r["outcome"] == pytest.approx(sum(ys) / len(ys))
    assert len(list(combinations("pq", 1))) + 1 == out.count()
