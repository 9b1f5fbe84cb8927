"""Levels and closures of deep, wide and cyclic taxonomies."""

import random

import pytest

from subdiv.operators import taxonomy as X

EDGE = "attr string, child string, parent string"


def test_a_chain_of_64_parents_takes_seven_rounds(spark, monkeypatch):
    rounds = []
    write = X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, name, **k: (rounds.append(name), write(df, name, **k))[1])
    edges = spark.createDataFrame([("a", f"n{i:02d}", f"n{i + 1:02d}") for i in range(64)], EDGE)
    got = {(r["leaf"], r["item"]) for r in X.closure(edges).collect()}
    assert got == {(f"n{i:02d}", f"n{j:02d}") for i in range(65) for j in range(i + 1, 65)}
    assert len(rounds) - 1 <= 7  # the first one writes the edges


@pytest.mark.parametrize("seed", range(2))
def test_closure_and_levels_of_random_taxonomies(spark, seed):
    rng = random.Random(seed)
    edges = {("a" if rng.random() < 0.5 else "b", x, y) for x, y in (sorted(rng.sample(range(25), 2)) for _ in range(40))}
    table = spark.createDataFrame([(a, str(x), str(y)) for a, x, y in edges], EDGE)

    def above(attr, x):
        direct = {y for a, c, y in edges if (a, c) == (attr, x)}
        return direct.union(*(above(attr, y) for y in direct))

    def level(attr, x):
        return 1 + max((level(attr, c) for a, c, y in edges if (a, y) == (attr, x)), default=0)

    values = {(a, x) for a, x, _ in edges}
    assert {tuple(r) for r in X.closure(table).collect()} == {(a, str(x), str(y)) for a, x in values for y in above(a, x)}
    assert {tuple(r) for r in X.levels(table).collect()} == {(a, str(x), str(y), level(a, x)) for a, x, y in edges}
    some = spark.createDataFrame([("a", "3"), ("b", "4"), ("a", "99")], "attr string, leaf string")
    assert {tuple(r) for r in X.closure(table, some).collect()} == {(a, str(x), str(y)) for a, x in (("a", 3), ("b", 4)) for y in above(a, x)}


@pytest.mark.parametrize("size", [1, 2, 5])
def test_cycles_raise(spark, size):
    edges = [("a", "x", "n0"), *[("a", f"n{i}", f"n{(i + 1) % size}") for i in range(size)]]
    for call in (X.closure, X.levels):
        with pytest.raises(ValueError, match="cycle"):
            call(spark.createDataFrame(edges, EDGE))


def test_an_empty_taxonomy(spark):
    empty = spark.createDataFrame([], EDGE)
    assert X.closure(empty).collect() == [] and X.levels(empty).collect() == []
