"""Marginals, Shapley values, minimal itemsets and recodes on tables with one dominant item or very long itemsets."""

import random
import statistics
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from subdiv.operators import select as S
from subdiv.operators import subsets
from subdiv.operators.prepare import recode
from subdiv.operators.shapley import local_shapley

SCHEMA = "key string, itemset array<string>, length int, m double"


def rows_of(itemsets):
    return [(", ".join(sorted(i)), sorted(i), len(i), v) for i, v in itemsets.items()]


def dominant(n_items=14):
    """All itemsets of up to three items that hold the first item, and what they contain."""
    rng = random.Random(2)
    names = [f"a{i:02d}=x" for i in range(n_items)]
    whole = {frozenset(c) for k in (0, 1, 2) for c in combinations(names[1:], k)}
    whole |= {frozenset({names[0], *c}) for c in whole}
    return {i: rng.choice([0.0, 0.25, 0.5, 1.0]) for i in whole}


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_marginals_of_a_dominant_item(spark, no_broadcast):
    table = dominant()
    got = S.marginals(spark.createDataFrame(rows_of(table), SCHEMA), "m").collect()
    want = {(i, ", ".join(sorted(s - {i})), table[s] - table[s - {i}], table[frozenset([i])]) for s in table for i in s}
    assert {(r["item"], r["s_key"], r["delta"], r["v_i"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("ask", "length"), [("", 0), ("a00=x", 1)])
def test_rows_of_one_short_key_are_dealt_over_tasks(spark, no_broadcast, ask, length):
    """Without copies, all of these rows would be read by one task of the join."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # neither merged nor split parts
    try:
        rows = spark.range(20_000).select(F.lit(ask).alias("k"), F.lit(length).alias("n"), F.col("id").cast("string").alias("by"))
        values = spark.createDataFrame([(ask, length, 1.5), ("b", 1, 2.5)], "k string, vn int, v double")
        out = subsets.join_values(rows, "k", "n", "by", values, "vn")
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(tasks) == 20_000 and len(tasks) == 4
    assert max(tasks) < 3 * statistics.median(tasks)


def test_shapley_of_a_dominant_item_adds_up(spark, no_broadcast):
    table = dominant(8)
    found = local_shapley(spark.createDataFrame(rows_of(table), SCHEMA), "m").groupBy("key").agg(F.sum("shapley").alias("s"))
    got = {r["key"]: r["s"] for r in found.collect()}
    assert set(got) == {", ".join(sorted(i)) for i in table if i}
    for i, v in table.items():
        if i:
            assert got[", ".join(sorted(i))] == pytest.approx(v - table[frozenset()])


@pytest.mark.parametrize("listed", [0, 2, 8])
def test_minimal_by_lists_and_by_containment(spark, monkeypatch, listed):
    monkeypatch.setattr(S, "LISTED_ITEMS", listed)
    rng = random.Random(listed)
    table = {frozenset(): 0.5}
    names = [f"a{i}=x" for i in range(7)]
    while len(table) < 90:
        table[frozenset(rng.sample(names, rng.randint(1, 5)))] = rng.choice([None, 0.0, 0.25, 0.5, 1.0])
    got = {r["key"] for r in S.minimal(spark.createDataFrame(rows_of(table), SCHEMA), "m").collect()}
    assert got == {", ".join(sorted(i)) for i, v in table.items() if not any(j < i and w == v for j, w in table.items())}


def test_minimal_of_itemsets_of_twenty_items(spark):
    names = [f"a{i:02d}=x" for i in range(24)]
    table = {frozenset(names[k : k + 20]): 0.25 for k in range(5)} | {frozenset(names[k : k + 12]): 0.25 + 0.5 * (k % 2) for k in range(0, 12, 3)}
    table |= {frozenset(): 0.75, frozenset(names[:3]): 0.75}
    got = {r["key"] for r in S.minimal(spark.createDataFrame(rows_of(table), SCHEMA), "m").collect()}
    assert got == {", ".join(sorted(i)) for i, v in table.items() if not any(j < i and w == v for j, w in table.items())}


@pytest.mark.parametrize(("kind", "mapping"), [("int", {"1": 10, "01": 20}), ("double", {"1": 10.0, "1.0": 20.0}), ("int", {None: 1, "x": 2, "1": 3, "+1": 4})])
def test_recode_of_keys_that_become_equal_raises(spark, kind, mapping):
    df = spark.createDataFrame([("1",), ("2",)], "c string").select(F.col("c").cast(kind).alias("c"))
    with pytest.raises(ValueError, match="become equal"):
        recode(df, "c", mapping)
    assert sorted(r["c"] for r in recode(df, "c", {"1": 10, "x": 5}).collect()) == [2, 10]
