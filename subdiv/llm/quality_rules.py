"""Quality rules: a linear-chain CRF marks lines as content or boilerplate.

Nulls and texts without a word have no lines and are rejected by the base rule.
Repeated rows each get their own, equal result; other columns of the input are
ignored, so clashing names do no harm; an empty table gives an empty result.
Without labelled rows every line counts as content and the base rule decides alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.llm import crf
from subdiv.llm import text as X

#: Labelled rows the line model learns from, at most.
LEARN_ROWS = 4000
#: A document stays when at least this share of its word characters lies in content lines.
CONTENT_SHARE = 0.5

# Edges of the bins of each line feature.
_EDGES = {
    "words": [2, 4, 8, 16, 32, 64],
    "symbols": [0.001, 0.01, 0.03, 0.1, 0.2],
    "mean_length": [2.5, 3.5, 4.25, 4.75, 5.25, 6.0, 7.0, 8.5],
    "upper": [0.005, 0.02, 0.05, 0.1, 0.3],
    "distinct": [0.1, 0.3, 0.5, 0.7, 0.9],
    "punctuation": [0.001, 0.015, 0.03, 0.05, 0.1],
    "copies": [2, 3, 5],
    "ends": [1],
}
_STARTS = np.cumsum([0] + [len(e) + 1 for e in _EDGES.values()])
N_BINS = int(_STARTS[-1])

_SYMBOLS = X.byte_class(b"#*$%&|<>")
_UPPER = X.byte_class(range(65, 91))
_PUNCT = X.byte_class(b".,;:!?")
_LEADS = ~X.byte_class(range(0x80, 0xC0))
_CASED = X.byte_values(False)


def line_table(block: X.Block) -> dict[str, np.ndarray]:
    """Base counts of every text of a block, and the bins of its lines that hold a word."""
    words = block.words(X.NOT_SPACE)
    hashes = words.hashes(_CASED)
    running, undo = block.prefix_hashes(_CASED)
    inside = X.NOT_SPACE[block.data]
    out = {
        "n_words": words.count.astype(np.int64),
        "word_chars": block.sums(inside & _LEADS[block.data]),
        "n_symbols": block.sums(_SYMBOLS[block.data]),
    }
    # words in windows of five that stand twice or more in the text
    at, grams = words.ngrams(hashes, 5)
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(at):
        _, inverse, count = np.unique(X.mix(grams + words.text[at].astype(np.uint64)), return_inverse=True, return_counts=True)
        twice = at[count[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 5, -1)
    covered = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(words.text, covered, block.n).astype(np.int64)

    breaks = np.flatnonzero(block.data == 10)
    line_of_word = np.searchsorted(breaks, words.start) + words.text  # grows with every line break and every text
    _, first_word, in_line = np.unique(line_of_word, return_index=True, return_inverse=True)
    text = words.text[first_word]
    k = np.searchsorted(breaks, words.start[first_word])
    padded = np.concatenate([[-1], breaks, [len(block.data)]])
    start = np.maximum(block.offsets[text], padded[k] + 1)
    end = np.minimum(block.offsets[text + 1], padded[k + 1])
    n = len(text)
    keys = X.mix((running[end] - running[start]) * undo[start] + (end - start).astype(np.uint64)) + text.astype(np.uint64)
    _, first, inverse, copies = np.unique(X.mix(keys), return_index=True, return_inverse=True, return_counts=True)
    again = np.ones(n, dtype=bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(text, again, block.n).astype(np.int64)

    def share(table):
        total = np.concatenate([[0], np.cumsum(table[block.data], dtype=np.int64)])
        return (total[end] - total[start]) / np.maximum(1, end - start)

    n_words = np.bincount(in_line, minlength=n)
    leads = np.concatenate([[0], np.cumsum(inside & _LEADS[block.data], dtype=np.int64)])
    chars = leads[end] - leads[start]
    distinct = np.zeros(n)
    if n:
        pairs = np.unique(X.mix(hashes + in_line.astype(np.uint64)), return_index=True)[1]
        distinct = np.bincount(in_line[pairs], minlength=n)
    last_word_end = np.zeros(n, dtype=np.int64)
    last_word_end[in_line] = words.end
    values = {
        "words": n_words,
        "symbols": share(_SYMBOLS),
        "mean_length": chars / np.maximum(1, n_words),
        "upper": share(_UPPER),
        "distinct": distinct / np.maximum(1, n_words),
        "punctuation": share(_PUNCT),
        "copies": copies[inverse] if n else np.zeros(0),
        "ends": _PUNCT[block.data[last_word_end - 1]] if n else np.zeros(0),
    }
    out["bins"] = np.stack([np.searchsorted(e, values[k], side="right") + s for (k, e), s in zip(_EDGES.items(), _STARTS)], axis=1)
    out["bounds"] = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=block.n))])
    out["line_chars"] = chars
    return out


def learn_lines(sample: DataFrame) -> crf.Crf | None:
    """Fit the line model on a bounded sample ``(text, quality)``; a line takes its document's label.

    Bins of the sample's lines, not texts, reach the driver.
    """

    def bins(batch):
        rows = []
        quality = batch.column("quality").to_numpy(zero_copy_only=False)
        for block in X.blocks(batch.column("text")):
            t = line_table(block)
            for i in range(block.n):
                lines = t["bins"][t["bounds"][i] : t["bounds"][i + 1]]
                if len(lines):
                    rows.append((lines.ravel().tolist(), int(quality[block.first + i])))
        return X.record_batch(bins=pa.array([r[0] for r in rows], pa.list_(pa.int32())), quality=pa.array([r[1] for r in rows], pa.int32()))

    rows = X.map_batches(sample.select("text", "quality"), bins, "bins array<int>, quality int").toPandas().sort_values("quality", kind="stable")
    if rows.quality.nunique() < 2:
        return None
    sequences = [np.asarray(b).reshape(-1, len(_EDGES)) for b in rows["bins"]]
    lengths = [len(s) for s in sequences]
    states = np.repeat(rows.quality.to_numpy(), lengths)
    return crf.train(np.concatenate(sequences), states, np.concatenate([[0], np.cumsum(lengths)]), N_BINS)


def judge(docs: DataFrame, model: crf.Crf | None, share: float = CONTENT_SHARE) -> DataFrame:
    """Counts, verdict and content share of every document; one pass, nothing is shuffled."""

    def run(batch):
        ids = batch.column("doc_id")
        parts = []
        for block in X.blocks(batch.column("text")):
            t = line_table(block)
            if model is None:
                content = np.ones(len(t["bins"]))
            else:
                content = crf.viterbi(model.scores(t["bins"]), model.moves, t["bounds"])
            text = np.repeat(np.arange(block.n), np.diff(t["bounds"]))
            total = np.bincount(text, t["line_chars"], block.n)
            part = np.bincount(text, t["line_chars"] * content, block.n) / np.maximum(1, total)
            failed = (t["n_words"] < 10) | (100 * t["n_repeat_words"] > 20 * t["n_words"])
            parts.append(
                X.record_batch(
                    doc_id=ids.slice(block.first, block.n),
                    **{k: t[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
                    base_failed=failed,
                    content_share=part,
                    kept=~failed & (part >= share),
                )
            )
        return parts

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return X.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rows, LEARN_ROWS at most: documents with a quality label whose id is not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chosen = X.bounded_sample(labels.where(F.col("quality").isNotNull() & ~X.held_out(F.col("doc_id"), 3, 1)), "doc_id", LEARN_ROWS)
    return docs.join(F.broadcast(chosen), "doc_id")  # at most LEARN_ROWS rows


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn_lines(labelled_documents(spark, sf_dir))
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose lines are mostly content."""
    model = learn_lines(labelled_documents(spark, sf_dir))
    return filter_with(docs, lambda d: judge(d, model).where("kept").select("doc_id"))


def filter_with(docs: DataFrame, decide) -> DataFrame:
    """Rows of ``docs`` whose id ``decide(docs)`` returns; columns and repeated rows stay."""
    kept = decide(docs).distinct().withColumnRenamed("doc_id", "__kept_id")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi")
