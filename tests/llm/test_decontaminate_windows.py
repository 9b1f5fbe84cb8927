"""Walks embed only windows in which a leak is possible."""

import random

from subdiv.llm import decontaminate
from subdiv.llm import text as X


def test_windows_without_a_whole_piece_are_not_embedded(spark, monkeypatch):
    rng, search, embedded = random.Random(2), [], []

    def kept(df, fn, schema, real=X.map_batches):
        search.extend([fn] if fn.__name__ == "search" else [])
        return real(df, fn, schema)

    monkeypatch.setattr(X, "map_batches", kept)
    words = [f"w{i}" for i in range(60)]
    item = [rng.choice(words) for _ in range(40)]
    # every pair of the item, and no four words of it in a row: pairs do not rule these windows out
    mixed = " ".join(" ".join(item[i : i + 2]) for i in rng.choices(range(39), k=2000))
    leak = " ".join([*rng.choices(words, k=30), *item[:20], "other", *item[21:], *rng.choices(words, k=30)])
    docs = spark.createDataFrame([(0, mixed), (1, leak)], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.distance) for r in found.collect()] == [(1, 7, 1)]

    def counted(hashes, starts, size, real=decontaminate.window_keys):
        embedded.append(len(starts))
        return real(hashes, starts, size)

    monkeypatch.setattr(decontaminate, "window_keys", counted)
    search[0](docs.where("doc_id = 0").toArrow().combine_chunks().to_batches()[0])
    assert sum(embedded) < 1000, embedded  # of about 4,000 windows
    search[0](docs.where("doc_id = 1").toArrow().combine_chunks().to_batches()[0])
    assert sum(embedded) > 0
