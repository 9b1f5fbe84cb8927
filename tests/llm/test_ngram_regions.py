"""Inner regions of the n-gram join hold no more of a set than a link needs."""

import random

from subdiv.llm import ngram_join
from test_brute_force import jaccard_components


def test_sets_far_from_the_pivot_enter_few_inner_regions(spark):
    base, shared = list(range(100)), list(range(1000, 1060))
    near = [[*base, 100 + i] for i in range(8)]
    far = [[*shared, *range(2000 + 100 * i, 2040 + 100 * i)] for i in range(5)]
    linked = [list(range(9000, 9100)), [*range(9000, 9099), 9200]]
    sets = list(enumerate(near + far + linked))
    regions = spark.createDataFrame([(0, len(sets), i, i) for i, _ in sets], "pivot long, size long, x long, root long")
    reps = spark.createDataFrame([(i, len(s)) for i, s in sets], "set_id long, n long")
    shingles = spark.createDataFrame(sets, "set_id long, shingles array<long>")
    links, inner = ngram_join._recentred(regions, reps, shingles, 90)
    assert {frozenset(r) for r in links.collect()} >= {frozenset((0, i)) for i in range(1, 8)}
    together = {}
    for r in inner.collect():
        together.setdefault(r.pivot, set()).add(r.x)
    assert any(x >= {13, 14} for x in together.values())
    assert sum(len(x) for x in together.values()) < 60, together


def test_a_crowd_in_many_regions_is_divided_once(spark, monkeypatch):
    """Near copies share most of their parts, so each is in many large regions; most of their pairs do not link."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(6):
            words[rng.randrange(200)] = f"c{i}x{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i][1] + " tail") for i in range(5)]
    made = []

    def counted(df, name, *more, real=ngram_join.materialize):
        out = real(df, name, *more)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "REGION", 8)
    monkeypatch.setattr(ngram_join, "materialize", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == jaccard_components(rows, 3, 90)
    divided = [n for name, n in made if name == "rests"]
    assert divided and divided[0] <= len(rows), made
