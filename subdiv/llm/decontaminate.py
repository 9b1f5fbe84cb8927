"""Benchmark decontamination: windows near a benchmark item in edit distance.

Words (runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased) are
the symbols.  A document leaks an item when some stretch of it lies within
``floor(SHARE * words of the item)`` edits of the item.

Item-sized windows start at every word.  CGK random walks embed windows and items so that
few edits change few coordinates, and repeated samples of coordinates are the LSH keys.
Insertions and deletions part the walks, so what the walks miss is caught exactly: an item
is cut into one more piece than it may have edits, so every leak holds a whole piece, and
pieces are keys too.  Pairs that share a key are verified by an exact semi-global edit
distance.  Windows whose word pairs rule an item out are skipped before both: an edit
removes at most three changes of a word pair, and the words before a window one more, so
this loses nothing.  Neither do the walks by leaving out windows without a whole piece.

Null texts count as empty and leak nothing; items without words are ignored; repeated
rows, items or both give one row per pair of ids, the closest match (ties: the earliest).
Other columns are ignored, so clashing names do no harm; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.llm import text as X
from subdiv.session import materialize

#: Edits allowed, as a share of the item's words.
SHARE = 0.2
#: Random walks, key tables per walk, and coordinates per table.
WALKS, TABLES, SAMPLED = 6, 5, 4
#: Items whose lengths differ by less than this factor share windows.
CLASS_FACTOR = 1.25

_FOLDED = X.byte_values(True)
_STEP = 0x9E3779B97F4A7C15


def classes(lengths: list[int]) -> list[tuple[int, int]]:
    """Shortest and longest item length of each class."""
    out: list[list[int]] = []
    for n in sorted(set(lengths)):
        if out and n <= out[-1][0] * CLASS_FACTOR:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [(a, b) for a, b in out]


def window_keys(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """LSH keys (rows: windows of ``size`` words from ``starts``; one column per table)."""
    keys = np.zeros((len(starts), WALKS * TABLES), dtype=np.uint64)
    steps = 2 * size  # a walk moves on at every other step, so it sees about the whole window
    rng = np.random.default_rng(size)
    hashes = np.append(hashes, np.uint64(0))
    for walk in range(WALKS):
        samples = [set(rng.choice(steps, size=min(SAMPLED, steps), replace=False).tolist()) for _ in range(TABLES)]
        last = max(max(s) for s in samples)
        at = np.zeros(len(starts), dtype=np.int64)
        for step in range(last + 1):
            symbol = np.where(at < size, hashes[np.minimum(starts + at, len(hashes) - 1)], np.uint64(1))
            bits = X.mix(symbol + np.uint64(((walk << 32) + step + 1) * _STEP % (1 << 64)))
            for table, sample in enumerate(samples):
                if step in sample:
                    column = walk * TABLES + table
                    keys[:, column] = X.mix(keys[:, column] + symbol)
            at += (bits >> np.uint64(63)).astype(np.int64)
        for table in range(TABLES):
            column = walk * TABLES + table
            keys[:, column] = X.mix(keys[:, column] + np.uint64((size << 16) + column))
    return keys


def pieces(n: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of an item of n words, one more than its edits."""
    parts = int(SHARE * n) + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(s, e - s) for s, e in zip(cuts, cuts[1:])]


def piece_keys(grams: np.ndarray, size: int, length: int) -> np.ndarray:
    """Keys of pieces of ``length`` words (their ``ngrams`` hashes) of the class whose windows have ``size``."""
    return X.mix(X.mix(grams) + np.uint64((size << 16) + length))


def near_pieces(start: np.ndarray, whole: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """The starts of windows in whose ``reach`` words a whole piece of an item starts; others hold no leak."""
    until = np.concatenate([[0], np.cumsum(whole)])
    return start[until[np.minimum(start + reach, ends[start])] > until[start]]


def _gram(words: np.ndarray) -> np.ndarray:
    total = np.zeros(1, dtype=np.uint64)
    for w in words:
        total = X.mix(total + w)
    return total


def word_hashes(block: X.Block) -> tuple[X.Words, np.ndarray]:
    words = block.words(X.ALNUM)
    return words, words.hashes(_FOLDED)


def _changes(words: X.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word pairs that differ from the pair before: index of their first word, and hash."""
    at, pair = words.ngrams(hashes, 2)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (np.diff(at) > 1)
    return at[new], pair[new]


def item_words(items: DataFrame) -> DataFrame:
    """``item_id, words`` (hashes) and how many changes of a word pair start at or before each word."""

    def run(batch):
        rows = []
        for block in X.blocks(batch.column("text")):
            words, hashes = word_hashes(block)
            marks = np.zeros(len(hashes), dtype=np.int64)
            at, pairs = _changes(words, hashes)
            marks[at] = 1
            pair_of = np.zeros(len(hashes), dtype=np.uint64)
            pair_of[at] = pairs
            for i in range(block.n):
                a, b = words.bounds[i], words.bounds[i + 1]
                rows.append((hashes[a:b].view(np.int64), np.cumsum(marks[a:b]), pair_of[a:b][marks[a:b] > 0].view(np.int64)))
        arrays = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in range(3)]
        return X.record_batch(item_id=batch.column("item_id"), words=arrays[0], changes=arrays[1], pairs=arrays[2])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return X.map_batches(rows, run, "item_id long, words array<long>, changes array<long>, pairs array<long>").where(F.size("words") > 0)


def _class_of(groups, n: int) -> tuple[int, int]:
    return next(g for g in groups if g[0] <= n <= g[1])


def edit_distances(item: list[np.ndarray], region: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each item and any stretch of its region, and the end of the first best stretch."""
    n, width = len(item), max(len(r) for r in region)
    text = np.zeros((n, width), dtype=np.int64)
    real = np.zeros((n, width), dtype=bool)
    for i, r in enumerate(region):
        text[i, : len(r)] = r
        real[i, : len(r)] = True
    length = np.array([len(x) for x in item])
    pattern = np.zeros((n, length.max()), dtype=np.int64)
    for i, x in enumerate(item):
        pattern[i, : len(x)] = x
    columns = np.arange(width + 1)
    row = np.zeros((n, width + 1), dtype=np.int64)
    done = row.copy()
    for k in range(length.max()):
        new = np.empty_like(row)
        new[:, 0] = k + 1
        other = ~(real & (text == pattern[:, k : k + 1]))
        new[:, 1:] = np.minimum(row[:, :-1] + other, row[:, 1:] + 1)
        row = np.minimum.accumulate(new - columns, axis=1) + columns
        done[length == k + 1] = row[length == k + 1]
    done[:, 1:][~real] = np.iinfo(np.int32).max
    best = done.argmin(axis=1)
    return done[np.arange(n), best], best


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_words, distance, end_word`` of every document and item it leaks."""
    spark = docs.sparkSession
    listed = materialize(item_words(items), "benchmark-words")
    per_length = listed.groupBy(F.size("words").alias("n")).agg(F.count("*").alias("items")).collect()  # one row per item length
    groups = classes([r["n"] for r in per_length])
    empty = spark.createDataFrame([], "doc_id long, item_id long, n_words long, distance long, end_word long")
    if not groups:
        return empty
    # how many changes of a word pair a window must share with the items of its class
    size = F.lit(0)
    for a, b in groups:
        size = F.when(F.size("words").between(a, b), a).otherwise(size)
    fewest = {r["size"]: r["fewest"] for r in listed.groupBy(size.alias("size")).agg(F.min(F.element_at("changes", size)).alias("fewest")).collect()}
    edits = {a: int(SHARE * b) for a, b in groups}
    need = {a: max(0, fewest[a] - 3 * edits[a] - 1) for a, _ in groups}
    lengths = {a: sorted({q for r in per_length if a <= r["n"] <= b for _, q in pieces(r["n"])}) for a, b in groups}

    def keys_of_items(batch):
        rows = []
        for item, words in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist()):
            a, _ = _class_of(groups, len(words))
            hashes = np.array(words, dtype=np.int64).view(np.uint64)
            keys = [window_keys(hashes, np.zeros(1, dtype=np.int64), a)[0]]
            keys += [piece_keys(_gram(hashes[s : s + q]), a, q) for s, q in pieces(len(words))]
            rows += [(k, item, words) for k in np.unique(np.concatenate(keys)).view(np.int64)]
        ids, items_, words_ = zip(*rows) if rows else ((), (), ())
        return X.record_batch(key=pa.array(ids, pa.int64()), item_id=pa.array(items_, pa.int64()), item=pa.array(words_, pa.list_(pa.int64())))

    keyed = materialize(X.map_batches(listed.select("item_id", "words"), keys_of_items, "key long, item_id long, item array<long>"), "benchmark-keys")
    key_bits = X.bitmap_of(keyed, "key")
    pair_bits = X.bitmap_of(listed.select(F.explode("pairs").alias("pair")), "pair")

    def search(batch):
        found = []
        for block in X.blocks(batch.column("text")):
            words, hashes = word_hashes(block)
            at, pairs = _changes(words, hashes)
            hit = np.zeros(len(hashes) + 1, dtype=np.int64)
            hit[at] = X.in_bitmap(pair_bits, pairs.view(np.int64))
            hits = np.concatenate([[0], np.cumsum(hit)])
            ends = words.bounds[1:][words.text]
            grams = {q: words.ngrams(hashes, q) for q in {q for each in lengths.values() for q in each}}
            for a, b in groups:
                k = edits[a]
                start = np.arange(len(hashes))
                near = hits[np.minimum(start + a + k, ends)] - hits[start]
                able = (near >= need[a]) & (start + a - k <= ends)
                start = start[able]
                if not len(start):
                    continue
                # a piece counts where an item that holds it can start; its region is all such an item can reach
                before = np.concatenate([[0], np.cumsum(able)])
                whole = np.zeros(len(hashes), dtype=np.int64)
                for q in lengths[a]:
                    at, gram = grams[q]
                    first = words.bounds[words.text[at]]
                    possible = before[at + 1] > before[np.maximum(at - b - k, first)]
                    at, keys = at[possible], piece_keys(gram[possible], a, q).view(np.int64)
                    hit_at = np.flatnonzero(X.in_bitmap(key_bits, keys))
                    whole[at[hit_at]] = 1
                    reached: dict[tuple[int, int], int] = {}
                    for s, key in zip(at[hit_at], keys[hit_at]):
                        text = words.text[s]
                        if reached.get((text, key), -1) >= s:
                            continue  # the region of the earlier piece covers this one
                        reached[(text, key)] = s + k
                        lo = max(words.bounds[text], s - b - k)
                        hi = min(words.bounds[text + 1], s + b + 2 * k)
                        found.append((block.first + int(text), int(key), int(lo - words.bounds[text]), hashes[lo:hi].view(np.int64)))
                start = near_pieces(start, whole, ends, b + k)
                if not len(start):
                    continue
                # a window that reaches past its text is padded by what follows; verification reads the text alone
                keys = window_keys(hashes, start, a).view(np.int64)
                row, column = np.nonzero(X.in_bitmap(key_bits, keys))
                seen: dict[int, int] = {}
                for r, key in zip(row, keys[row, column]):
                    s, text = start[r], words.text[start[r]]
                    if seen.get((text, key), -b) + max(1, k) > s:
                        continue  # the region of the earlier window covers this one
                    seen[(text, key)] = s
                    lo = max(words.bounds[text], s - b)
                    hi = min(words.bounds[text + 1], s + 2 * b + 2 * k)
                    found.append((block.first + int(text), int(key), int(lo - words.bounds[text]), hashes[lo:hi].view(np.int64)))
        which, key, first, region = zip(*found) if found else ((), (), (), ())
        return X.record_batch(doc_id=batch.column("doc_id").take(pa.array(which, pa.int64())), key=pa.array(key, pa.int64()), first=pa.array(first, pa.int64()), region=pa.array(region, pa.list_(pa.int64())))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    candidates = X.map_batches(rows, search, "doc_id long, key long, first long, region array<long>").join(keyed, "key").drop("key").dropDuplicates(["doc_id", "item_id", "first", "region"])

    def verify(batch):
        keep, distance, end, n_words = [], [], [], []
        items_, regions = batch.column("item"), batch.column("region")
        first = batch.column("first").to_numpy()
        for lo in range(0, batch.num_rows, 512):
            item = [np.array(x.as_py()) for x in items_[lo : lo + 512]]
            region = [np.array(x.as_py()) for x in regions[lo : lo + 512]]
            d, e = edit_distances(item, region)
            length = np.array([len(x) for x in item])
            ok = np.flatnonzero(d <= (SHARE * length).astype(np.int64))
            keep += (lo + ok).tolist()
            distance += d[ok].tolist()
            end += (first[lo + ok] + e[ok]).tolist()
            n_words += length[ok].tolist()
        take = pa.array(keep, pa.int64())
        return X.record_batch(doc_id=batch.column("doc_id").take(take), item_id=batch.column("item_id").take(take), n_words=pa.array(n_words, pa.int64()), distance=pa.array(distance, pa.int64()), end_word=pa.array(end, pa.int64()))

    verified = X.map_batches(candidates, verify, "doc_id long, item_id long, n_words long, distance long, end_word long")
    best = verified.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_word", "n_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_words", "best.distance", "best.end_word")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents only: one row per document and benchmark item."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that leak no benchmark item."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("__leaking_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__leaking_id"]), "left_anti")
