"""Toxicity: a linear-chain CRF tags tokens, and its marginals give scores and offsets.

Learning documents carry one label each.  A lexicon of words and word beginnings that
are far more frequent in toxic ones labels their tokens; every token of a clean document
is clean.  The CRF learns from these labelled tokens, so that weak lexicon entries, which
also stand in clean documents, lose their weight.  A token without a lexicon entry is
neutral, and a run of neutral tokens is one power of the neutral step, so marginals are
those of the whole text although only the other tokens are visited.

Null texts and texts without a word score as a text without toxic tokens.  Without both
labels in the learning rows the score is the share of label 1 (0 without any).  Repeated
rows each get their own, equal result; other columns of the input are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.llm import crf
from subdiv.llm import text as X
from subdiv.session import materialize

#: Labelled rows of each label to learn from, at most; lexicon entries, at most (the strongest).
LEARN_PER_LABEL, LEXICON = 5000, 20_000
#: Least toxic documents of an entry, its least log ratio of document shares, and how many standard errors that ratio must lie above 0.
#: None of them grows with the sample, so a larger one only adds rarer entries.
LEAST_DOCUMENTS, LEAST_RATIO, ERRORS = 4, 2.0, 2.0
#: Tokens around a lexicon token that the CRF sees when it learns.
AROUND = 4
THRESHOLD = 0.3

#: Token features: the word (None) and its first bytes.
_PREFIXES = (None, 4, 5, 6)
_RATIO_EDGES = np.array([2.5, 3.0, 3.75, 4.5])
_COUNT_EDGES = np.array([7, 10, 20, 40, 80, 160, 320])  # toxic learning documents
_PER_GROUP = 1 + (len(_RATIO_EDGES) + 1) * (len(_COUNT_EDGES) + 1)
N_BINS = _PER_GROUP * len(_PREFIXES)
_NEUTRAL = np.arange(len(_PREFIXES)) * _PER_GROUP
_FOLDED = X.byte_values(True)


def token_features(block: X.Block) -> tuple[X.Words, np.ndarray]:
    """Words, and a 64-bit feature per word and prefix length; shorter words repeat as 0."""
    words = block.words(X.ALNUM)
    length = words.end - words.start
    columns = []
    for group, prefix in enumerate(_PREFIXES):
        h = X.mix(words.hashes(_FOLDED, prefix) + np.uint64(group + 1))
        if prefix is not None:
            h = np.where(length > prefix, h, np.uint64(0))
        columns.append(h)
    return words, np.stack(columns, axis=1)


@dataclass
class ToxicModel:
    keys: np.ndarray  # sorted features
    bins: np.ndarray  # of each
    chain: crf.Crf | None
    logistic: np.ndarray  # intercept, weight of the highest marginal, of the log of their sum

    def token_bins(self, features: np.ndarray) -> np.ndarray:
        out = np.tile(_NEUTRAL, (len(features), 1))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
            hit = self.keys[at] == features
            out[hit] = self.bins[at[hit]]
        return out


def lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Features, bins and rows by label of a sample ``(text, toxic, half)``; documents are counted, not occurrences.

    An entry must be toxic in either half of the sample by itself, or entries that are
    toxic by chance alone would be trusted.
    """

    def count(batch):
        labels = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        labels = labels + 2 * batch.column("half").to_numpy(zero_copy_only=False).astype(np.int64)
        seen = []
        for block in X.blocks(batch.column("text")):
            words, features = token_features(block)
            label = labels[block.first : block.first + block.n]
            for group in range(features.shape[1]):
                f = features[:, group]
                ok = f != 0
                text, f = words.text[ok], f[ok]
                first = np.unique(X.mix(f + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
                for y in range(4):
                    keys, n = np.unique(f[first[label[text[first]] == y]], return_counts=True)
                    seen.append((keys, n, np.full(len(keys), group), np.full(len(keys), y)))
        if not seen:
            return []
        keys, n, group, y = (np.concatenate(c) for c in zip(*seen))
        return X.record_batch(feature=keys.astype(np.int64), kind=group.astype(np.int32), n=n, of=y.astype(np.int32))

    totals = {(int(r.toxic), int(r.half)): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    by_label = {y: totals.get((y, 0), 0) + totals.get((y, 1), 0) for y in (0, 1)}
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), by_label
    if len(totals) < 4:
        return none

    def ratio(half: int | None):
        toxic, clean = (F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")) if half is None else (F.col(f"t{half}"), F.col(f"c{half}"))
        t, c = (by_label[1], by_label[0]) if half is None else (totals[1, half], totals[0, half])
        return F.log((toxic + 0.5) / (t + 1.0)) - F.log((clean + 0.5) / (c + 1.0))

    counts = [F.sum(F.when(F.col("of") == y + 2 * h, F.col("n")).otherwise(0)).alias(f"{'ct'[y]}{h}") for y in (0, 1) for h in (0, 1)]
    error = F.sqrt(1 / (F.col("t0") + F.col("t1") + 0.5) + 1 / (F.col("c0") + F.col("c1") + 0.5))
    found = (
        X.map_batches(sample.select("text", "toxic", "half"), count, "feature long, kind int, n long, of int")
        .groupBy("feature", "kind")
        .agg(*counts)
        .withColumn("toxic", F.col("t0") + F.col("t1"))
        .where((F.col("toxic") >= LEAST_DOCUMENTS) & (ratio(None) >= ERRORS * error) & (ratio(0) >= LEAST_RATIO) & (ratio(1) >= LEAST_RATIO))
        .withColumn("ratio", ratio(None))
        .orderBy(F.desc(F.col("ratio") * F.col("toxic")), "feature")
        .limit(LEXICON)
        .select("feature", "kind", "toxic", "ratio")
        .toPandas()
        .assign(key=lambda d: d["feature"].to_numpy().astype(np.int64).view(np.uint64))
        .drop_duplicates("key")
        .sort_values("key")
    )
    if not len(found):
        return none
    level = np.searchsorted(_RATIO_EDGES, found["ratio"], side="right") * (len(_COUNT_EDGES) + 1) + np.searchsorted(_COUNT_EDGES, found["toxic"], side="right")
    return found["key"].to_numpy(), found["kind"].to_numpy() * _PER_GROUP + 1 + level, by_label


def _windows(interesting: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions within AROUND of an interesting one of the same text, and where each stretch starts."""
    n = len(interesting)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    near = np.zeros(n, dtype=bool)
    at = np.flatnonzero(interesting)
    for d in range(-AROUND, AROUND + 1):
        to = at + d
        ok = (to >= 0) & (to < n)
        near[to[ok & (text[np.clip(to, 0, max(0, n - 1))] == text[at])]] = True
    pos = np.flatnonzero(near)
    start = np.ones(len(pos), dtype=bool)
    start[1:] = (np.diff(pos) > 1) | (np.diff(text[pos]) > 0)
    return pos, np.flatnonzero(start)


def learn(sample: DataFrame) -> ToxicModel:
    """Fit lexicon, CRF and score on a bounded sample ``(text, toxic)``; equal texts count once."""
    rows = sample.where(F.col("text").isNotNull()).select("text", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["text"])
    sample = materialize(rows.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "toxic-sample")
    keys, bins, totals = lexicon(sample)
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    model = ToxicModel(keys, bins, None, np.array([np.log(max(share, 1e-3) / max(1 - share, 1e-3)), 0.0, 0.0]))
    if not len(keys):
        return model

    def stretches(batch):
        labels, rows = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64), []
        for block in X.blocks(batch.column("text")):
            words, features = token_features(block)
            b = model.token_bins(features)
            hot = (b != _NEUTRAL).any(axis=1)
            pos, start = _windows(hot, words.bounds)
            state = hot[pos] * labels[block.first + words.text[pos]]
            for lo, hi in zip(start, np.append(start[1:], len(pos))):
                rows.append((b[pos[lo:hi]].ravel().tolist(), state[lo:hi].tolist()))
        return X.record_batch(bins=pa.array([r[0] for r in rows], pa.list_(pa.int32())), states=pa.array([r[1] for r in rows], pa.list_(pa.int32())))

    rows = X.map_batches(sample.select("text", "toxic"), stretches, "bins array<int>, states array<int>").toPandas()
    if not len(rows):
        return model
    lengths = rows["states"].map(len).to_numpy()
    order = np.argsort(lengths, kind="stable")
    sequences = rows["bins"].to_numpy()[order]
    model.chain = crf.train(
        np.concatenate([np.asarray(b).reshape(-1, len(_PREFIXES)) for b in sequences]),
        np.concatenate([np.asarray(s) for s in rows["states"].to_numpy()[order]]),
        np.concatenate([[0], np.cumsum(lengths[order])]),
        N_BINS,
        rounds=80,
    )
    seen = score(sample.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.col("toxic").cast("boolean").alias("held_out")), model)
    model.logistic = _logistic(seen.select("highest", "total", "held_out").toPandas())
    return model


def _logistic(rows) -> np.ndarray:
    """Weights of a document's marginals by Newton's method with a small ridge."""
    x = np.stack([np.ones(len(rows)), rows["highest"].to_numpy(), np.log1p(rows["total"].to_numpy())], axis=1)
    y, w = rows["held_out"].to_numpy().astype(float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1.0, 1.0])
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - np.array([0, 1.0, 1.0]) * w)
    return w


def marginals(model: ToxicModel, words: X.Words, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the non-neutral tokens and their probability of being toxic."""
    bins = model.token_bins(features)
    hot = (bins != _NEUTRAL).any(axis=1)
    ends = np.zeros(len(hot), dtype=bool)
    some = words.count > 0
    ends[words.bounds[:-1][some]] = ends[words.bounds[1:][some] - 1] = True
    pos = np.flatnonzero(hot | ends)
    if not len(pos):
        return pos, np.zeros(0)
    starts = np.concatenate([[True], words.text[pos][1:] != words.text[pos][:-1]])
    gaps = np.where(starts, 0, np.diff(pos, prepend=pos[0]) - 1)
    neutral = np.exp(model.chain.scores(_NEUTRAL[None, :])[0])
    step = np.exp(model.chain.moves)
    table = [step]
    for _ in range(256):  # a longer run changes nothing more
        power = table[-1] @ (neutral[:, None] * step)
        table.append(power / power.sum())
    moves = np.log(np.stack(table))[np.minimum(gaps, 256)]
    bounds = np.append(np.flatnonzero(starts), len(pos))
    p, _, _ = crf.forward_backward(model.chain.scores(bins[pos]), moves, bounds)
    return pos, p[:, 1]


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Score, highest and summed marginal and offending spans (in characters) of ``(doc_id, held_out, text)``."""

    def run(batch):
        parts = []
        for block in X.blocks(batch.column("text")):
            highest, total, spans = np.zeros(block.n), np.zeros(block.n), [[] for _ in range(block.n)]
            if model.chain is not None:
                words, features = token_features(block)
                pos, p = marginals(model, words, features)
                text = words.text[pos]
                np.maximum.at(highest, text, p)
                total = np.bincount(text, p, block.n)
                chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                for i, w in zip(text[p >= 0.5], pos[p >= 0.5]):
                    base = chars[block.offsets[i]]
                    start, end = int(chars[words.start[w]] - base), int(chars[words.end[w]] - base)
                    if spans[i] and spans[i][-1]["word"] == w - 1:
                        spans[i][-1].update(end=end, word=w)
                    else:
                        spans[i].append({"start": start, "end": end, "word": w})
            a, b, c = model.logistic
            value = 1 / (1 + np.exp(-np.clip(a + b * highest + c * np.log1p(total), -30, 30)))
            spans = [[{"start": s["start"], "end": s["end"]} for s in each] for each in spans]
            parts.append(
                X.record_batch(
                    doc_id=batch.column("doc_id").slice(block.first, block.n), held_out=batch.column("held_out").slice(block.first, block.n),
                    score=value, predicted=(value >= THRESHOLD).astype(np.int32), highest=highest, total=total,
                    spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                )
            )
        return parts

    schema = "doc_id long, held_out boolean, score double, predicted int, highest double, total double, spans array<struct<start:int,end:int>>"
    return X.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"), run, schema)


def learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(text, toxic)`` of LEARN_PER_LABEL documents of each label at most, none held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    open_rows = labels.where(F.col("toxic").isin(0, 1) & ~X.held_out(F.col("doc_id"), 4, 2))
    chosen = X.bounded_sample(open_rows.where("toxic = 1"), "doc_id", LEARN_PER_LABEL).unionByName(X.bounded_sample(open_rows.where("toxic = 0"), "doc_id", LEARN_PER_LABEL))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most 2 LEARN_PER_LABEL rows


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn(learning_rows(spark, sf_dir))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", X.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "text"), model)
