"""Near vectors, hard negatives and phrases against plain definitions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from subdiv.llm import hard_negatives as H
from subdiv.llm import near_vectors as N
from subdiv.llm import phrases as P
from subdiv.llm.cover_tree import CoverTree, traverse
from subdiv.llm.fm_index import TwoWay
from tests.llm.conftest import odd_embeddings

VECTORS = "vec_id long, embedding array<double>, label int"


def clusters(rng, n, d=8, centers=12):
    base = rng.normal(size=(centers, d))
    return base[rng.integers(0, centers, n)] + rng.normal(size=(n, d)) * rng.choice([0.02, 0.1, 0.2, 1.0], size=(n, 1))


def near_by_definition(rows, cosine):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [np.array(v) / np.linalg.norm(v) if usable(v, label) else None for _, v, label in rows]
    links = [[j for j, w in enumerate(units) if i != j and u is not None and w is not None and rows[i][2] == rows[j][2] and len(u) == len(w) and u @ w >= cosine] for i, u in enumerate(units)]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - group
            group |= new
            todo += new
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf", [2048, 12])
def test_near_vectors(spark, monkeypatch, leaf):
    monkeypatch.setattr(N, "LEAF", leaf)
    monkeypatch.setattr(N, "SAMPLE", 10)
    monkeypatch.setattr(N, "SHARE", 16)
    rng = np.random.default_rng(leaf)
    rows = odd_embeddings() + [(1000 + i, v.tolist(), i % 2) for i, v in enumerate(clusters(rng, 150))]
    rows += [(2000 + i, [1.0 + i, 0.0, 0.0], 7) for i in range(40)]  # one direction, many lengths
    found = N.near_vectors(spark.createDataFrame(rows, VECTORS), 0.93).collect()
    assert sorted((tuple(r) for r in found), key=str) == near_by_definition(rows, 0.93)


@pytest.mark.parametrize("seed", range(4))
def test_cover_tree_and_traversal(seed):
    rng = np.random.default_rng(seed)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (clusters(rng, 200), clusters(rng, 150)))
    y[:40] = x[:40]
    one, other = CoverTree.of(x), CoverTree.of(y)
    for t, v in ((one, x), (other, y)):
        for low, high, center, radius in zip(t.low, t.high, t.center, t.radius):
            apart = np.linalg.norm(v[t.order[low:high]] - v[center], axis=1)
            assert center in t.order[low:high] and apart.max() <= radius + 1e-6
    w, z = rng.integers(1, 5, len(x)), rng.integers(1, 5, len(y))
    links = x @ y.T >= 0.93
    found = traverse(one, x, other, y, w, z, 0.93)
    assert (found.counts(0) == links @ z).all() and (found.counts(1) == links.T @ w).all()
    roots = found.groups()
    assert all(roots[i] == roots[len(x) + j] for i, j in zip(*np.nonzero(links)))
    assert len(set(roots)) >= (~links.any(axis=1)).sum() + (~links.any(axis=0)).sum()


def negatives_by_definition(rows):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows]
    out = []
    for anchor, label, q in rows:
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, w)), i, other) for i, other, w in rows if i != anchor)
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score]
            out += [(anchor, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(inside[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(8192, 1024, 256), (37, 2, 1)])
def test_hard_negatives(spark, tmp_path, monkeypatch, sizes):
    for name, value in zip(("BLOCK_ROWS", "CHUNK_ANCHORS", "STEP_ROWS"), sizes):
        monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(3)
    vectors = clusters(rng, 500)
    vectors[100:200] = np.round(vectors[100:200])  # ties
    vectors[300:330] = vectors[300]
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    odd = [(None, rows[3][1], 1), (700, None, 1), (700, rows[0][1], None), (700, [float("nan")] * 8, 1), (700, [1.0, 2.0], 1), (700, [1e300] * 8, 1), rows[5]]
    spark.createDataFrame(rows + odd, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = H.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == negatives_by_definition(rows)


def test_exact_scores_of_large_numbers():
    rng = np.random.default_rng(1)
    q = rng.integers(-(2**29), 2**29, size=(20, 4))
    block = H.Block(np.arange(20), np.zeros(20, np.int64), q, np.zeros(20, np.int64), (np.zeros((1, 2)), np.zeros((1, 2))))
    assert block.scores(0, 20, q[3]).tolist() == [sum(int(a) * int(b) for a, b in zip(r, q[3])) for r in q]


@pytest.mark.parametrize("seed", range(3))
def test_visits_bound_every_later_row(seed):
    rng = np.random.default_rng(seed)
    q = np.floor(256 * clusters(rng, 300)).astype(np.int64)
    books = H.codebook(q[:, :4], 5), H.codebook(q[:, 4:], 5)
    cell = H.nearest(q[:, :4], books[0]) * H.CODEWORDS + H.nearest(q[:, 4:], books[1])
    order = np.argsort(cell, kind="stable")
    block = H.Block(order, order, q[order], cell[order], books)
    left, scores = set(range(300)), q[order] @ q[7]
    for lo, hi, bound in block.visits(q[7]):
        left -= set(range(lo, hi))
        assert not left or max(scores[list(left)]) <= bound
    assert not left


def phrase_counts_by_definition(docs, longest):
    counts, left, right = Counter(), Counter(), Counter()
    fold = {c: c + 32 for c in range(65, 91)}
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    key = ("und" if lang is None else lang, " ".join(words[i : i + n]), n)
                    counts[key] += 1
                    left[key] += i > 0
                    right[key] += i + n < len(words)
    return {k: (c, left[k], right[k]) for k, c in counts.items()}


def collocations_by_definition(docs, most=2000):
    f, total = defaultdict(Counter), Counter()
    for (lang, phrase, n), (c, _, _) in phrase_counts_by_definition(docs, 3).items():
        f[lang][tuple(phrase.split(" "))] = c
        total[lang] += c * (n == 1)
    out = []
    for lang, counts in f.items():
        candidates, found = {p: a for p, a in counts.items() if len(p) > 1 and a >= 10}, []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, total[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def odd_texts(seed):
    rng = random.Random(seed)
    words = ["the", "THE", "of", "a", "Zu", "über", "ÜBER", "x-y", " ", "naïve", "end\x0b", "\x1f"]
    rows = [(" ".join(rng.choice(words[:4] if rng.random() < 0.6 else words) + rng.choice(["", "", "", ",", ".", "\t", "\n", "!?"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(80)]
    return rows + [(None, "en"), ("", "de"), (" .,. ", None), ("one two " * 30_000, "en"), rows[0], rows[0]]


@pytest.mark.parametrize("shard_words", [1 << 20, 50])
def test_phrases(spark, tmp_path, monkeypatch, shard_words):
    monkeypatch.setattr(P, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(P, "BUCKET_BYTES", 1000)
    docs = odd_texts(1)
    table = spark.createDataFrame(docs, "text string, lang string").withColumn("phrase", F.lit("x")).repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in P.op13_phrases(spark, str(tmp_path)).collect()) == collocations_by_definition(docs)


@pytest.mark.parametrize(("longest", "least"), [(1, 1), (2, 1), (4, 1), (4, 5)])
def test_phrase_counts(spark, longest, least):
    docs = odd_texts(2)
    want = {k: v for k, v in phrase_counts_by_definition(docs, longest).items() if v[0] >= least}
    found = P.phrase_counts(spark.createDataFrame(docs, "text string, lang string"), longest, least).where(F.col("count") >= least).collect()
    assert {(r["lang"], r["phrase"], r["words"]): (r["count"], r["left"], r["right"]) for r in found} == want


def test_scores_beyond_64_bits(spark):
    n = 3 * 10**12
    counts = spark.createDataFrame([("en", "a", 1, n), ("en", "b", 1, 2 * n), ("en", "a b", 2, n - 1)], "lang string, phrase string, words int, count long")
    row = P.collocations(counts).first()
    assert row.score == 1000000 * (n - 1) ** 2 // (2 * n * n)


def test_index_moves_both_ways():
    rng = np.random.default_rng(0)
    text = np.concatenate([[0], *[np.append(rng.integers(1, 5, rng.integers(0, 9)), 0) for _ in range(60)]]).astype(np.int32)
    index = TwoWay(text, 4, 5)
    count = lambda words: sum(tuple(text[i : i + len(words)]) == words for i in range(len(text)))
    level = index.single()
    for step in (index.to_left, index.to_right, index.to_left):
        level = step(level)
        assert {tuple(w): c for w, c in zip(level.words.tolist(), level.count.tolist())} == {tuple(w): count(tuple(w)) for w in level.words.tolist()}
    assert level.count.sum() == sum(0 not in text[i : i + 4] for i in range(len(text) - 3))
