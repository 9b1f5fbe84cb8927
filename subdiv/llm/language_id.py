"""Language ID: nearest centroid over TF-IDF vectors of byte n-grams.

Every language has several centroids from spherical k-means on a bounded sample of its
learning texts.  A text farther from its centroid than nearly all learning texts were is
marked ``rejected``.  Null texts and texts without a letter are ``und`` with score 0, as
all texts are when there is nothing to learn from.  Ties go to the alphabetically first
language.  Repeated rows each get their own, equal result; other columns of the input are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.llm import text as X
from subdiv.session import materialize

#: Learning texts a language may use, about; and the number of centroids of each.
LEARN_PER_LANGUAGE, CENTROIDS = 1000, 4
#: Hash buckets of n-grams of 1 to 3 bytes; texts handled at a time.
BUCKETS, ROWS = 4096, 256
#: Sharpness of the softmax over cosines that gives the score.
SHARPNESS = 25.0

_LETTERS = X.byte_class([*range(65, 91), *range(97, 123)])
_GRAM_BYTE = np.where(_LETTERS | (np.arange(256) >= 128), np.arange(256), 32).astype(np.uint64)
_GRAM_BYTE[65:91] = _GRAM_BYTE[97:123]


def gram_counts(block: X.Block) -> np.ndarray:
    """Counts of hashed n-grams, one row per text; all but letters counts as a blank."""
    b = _GRAM_BYTE[block.data]
    text = np.repeat(np.arange(block.n), np.diff(block.offsets))
    out = np.zeros(block.n * BUCKETS)
    grams = b.copy()
    for n in (1, 2, 3):
        if n > 1:
            grams = grams[:-1] * np.uint64(257) + b[n - 1 :]
        if not len(grams):
            break
        whole = text[: len(grams)] == text[n - 1 :]
        at = text[: len(grams)] * BUCKETS + (X.mix(grams + np.uint64(n << 40)) % np.uint64(BUCKETS)).astype(np.int64)
        out += np.bincount(at[whole], minlength=block.n * BUCKETS)
    return out.reshape(block.n, BUCKETS)


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


@dataclass
class LanguageModel:
    idf: np.ndarray
    names: list[str]  # of each centroid
    centroids: np.ndarray
    reach: np.ndarray  # cosine below which a text is rejected, by centroid


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from evenly spaced starting rows; centroids and the cosines of the rows to theirs."""
    k = min(k, len(vectors))
    centers = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(vectors @ centers.T, axis=1)
        centers = unit(np.stack([vectors[near == i].sum(axis=0) if (near == i).any() else centers[i] for i in range(k)]))
    return centers, near


def learn(rows: DataFrame) -> LanguageModel | None:
    """Fit on ``(lang, text)`` of about LEARN_PER_LANGUAGE rows per language."""
    rows = materialize(rows, "language-sample")

    def seen(batch):
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for block in X.blocks(batch.column("text"), rows=ROWS):
            total += (gram_counts(block) > 0).sum(axis=0)
            n += block.n
        return X.record_batch(bucket=np.arange(BUCKETS + 1, dtype=np.int32), n=np.append(total, n))

    counted = {r.bucket: r.n for r in X.map_batches(rows.select("text"), seen, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = counted.get(BUCKETS, 0)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + np.array([counted[i] for i in range(BUCKETS)]))) + 0.1

    def centroids(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("text")
        vectors = unit(np.concatenate([gram_counts(b) for b in X.blocks(pa.array(group["text"]), rows=ROWS)]) * idf)
        vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
        if not len(vectors):
            return pd.DataFrame({"lang": [], "vector": [], "reach": []})
        centers, near = cluster(vectors, CENTROIDS)
        cosines = (vectors * centers[near]).sum(axis=1)
        reach = [2 * np.quantile(cosines[near == i], 0.005) - 1 if (near == i).any() else -1.0 for i in range(len(centers))]
        return pd.DataFrame({"lang": key[0], "vector": [c.tolist() for c in centers], "reach": reach})

    found = rows.groupBy("lang").applyInPandas(centroids, "lang string, vector array<double>, reach double").toPandas().sort_values(["lang"], kind="stable")
    if not len(found):
        return None
    return LanguageModel(idf, found["lang"].tolist(), np.array(found["vector"].tolist()), found["reach"].to_numpy())


def _has_letter(block: X.Block) -> np.ndarray:
    found = block.sums(_LETTERS[block.data]) > 0
    for i in np.flatnonzero(~found):
        text = bytes(block.data[block.offsets[i] : block.offsets[i + 1]]).decode("utf-8", "replace")
        found[i] = any(c.isalpha() for c in text)
    return found


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    names = sorted(set(model.names)) if model else []
    group = np.array([names.index(n) for n in model.names]) if model else None

    def run(batch):
        parts = []
        for block in X.blocks(batch.column("text"), rows=ROWS):
            lang, score, far = ["und"] * block.n, np.zeros(block.n), np.zeros(block.n, dtype=bool)
            if model is not None:
                cosine = unit(gram_counts(block) * model.idf) @ model.centroids.T
                best = np.stack([cosine[:, group == i].max(axis=1) for i in range(len(names))], axis=1)
                soft = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
                ok, pick = _has_letter(block), best.argmax(axis=1)
                lang = [names[p] if o else "und" for p, o in zip(pick, ok)]
                score = np.where(ok, soft.max(axis=1) / soft.sum(axis=1), 0.0)
                near = cosine.argmax(axis=1)
                far = ok & (cosine.max(axis=1) < model.reach[near])
            parts.append(X.record_batch(doc_id=batch.column("doc_id").slice(block.first, block.n), held_out=batch.column("held_out").slice(block.first, block.n), lang_pred=pa.array(lang, pa.string()), score=score, rejected=far))
        return parts

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), X.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return X.map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def learning_rows(docs: DataFrame) -> DataFrame:
    """``(lang, text)`` of about LEARN_PER_LANGUAGE rows per language, none held out, chosen by a hash of the id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~X.held_out(F.col("doc_id"), 3, 1))
    share = rows.groupBy(F.col("lang").alias("of")).agg((F.lit(float(LEARN_PER_LANGUAGE)) / F.count("*")).alias("share"))
    hashed = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1e6
    return rows.join(share, (F.col("lang") == F.col("of")) & (hashed < F.col("share"))).select("lang", "text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, learn(learning_rows(docs)))
