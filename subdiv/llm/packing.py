"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bulk-synchronous best fit.  Documents sorted by length are runs of equal lengths, and
gaps sorted by room are runs of equal room; a round sweeps the document runs from long to
short and gives each run its successors among the gap runs (the smallest room that fits,
one document per gap and round), then updates the gaps and repeats.  Documents of one
length are interchangeable, so the sweeps need only the runs (at most ``capacity`` of
each), and a document finds its place by its rank within its length, which Spark counts
over salted parts of a length.

Null texts count as empty and make one piece of the closing id.  Repeated rows are packed
each for itself; other columns of the input are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subdiv.llm import text as X
from subdiv.session import materialize

CAPACITY, END_ID = 1024, 2
#: Documents of one length that are ranked in one task, about.
RANKED_TOGETHER = 50_000

_ENCODERS: dict[str, object] = {}


def encoder(path: str | None):
    """Byte-level BPE by rank file, with the added tokens of the tokenizer file (.json) beside it, if any; the tests compare the ids with it."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        file = Path(path).with_suffix(".json")
        added = {t["content"]: t["id"] for t in json.loads(file.read_text("utf-8"))["added_tokens"]} if file.exists() else {}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={w: r for w, r in ranks.items() if r not in added.values()}, special_tokens=added)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids; only the first may be short of the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces."""

    def run(batch):
        encode, out = encoder(ranks_path), []
        for block in X.blocks(batch.column("text")):
            which, rows = [], []
            for i in range(block.n):
                text = bytes(block.data[block.offsets[i] : block.offsets[i + 1]]).decode("utf-8", "replace")
                ids = np.append(encode.encode_to_numpy(text, allowed_special="all", disallowed_special=()), END_ID).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    which.append(block.first + i)
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            k, start, length, crc = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
            out.append(X.record_batch(doc_id=batch.column("doc_id").take(X.pa.array(which, X.pa.int64())), piece=k.astype(np.int32), start=start, length=length, ids_crc32=crc))
        return out

    return X.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places of runs of documents: ``(length, first rank, documents, first sequence, offset)``, and the sequences used."""
    left = {n: c for n, c in counts.items() if c > 0}
    taken: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of sequences (first, how many)
    places, sequences = [], 0

    def place(length, n, first, room, into):
        places.append((length, taken[length], n, first, capacity - room))
        taken[length] += n
        left[length] -= n
        if room > length:
            into[room - length].append((first, n))

    while any(left.values()):
        fresh: dict[int, list[tuple[int, int]]] = defaultdict(list)
        rooms, matched = sorted(g for g in gaps if gaps[g]), False
        for length in sorted((n for n in left if left[n]), reverse=True):
            for room in rooms[int(np.searchsorted(rooms, length)) :]:
                while gaps[room] and left[length]:
                    first, n = gaps[room].pop()
                    fits = min(n, left[length])
                    if fits < n:
                        gaps[room].append((first + fits, n - fits))
                    place(length, fits, first, room, fresh)
                    matched = True
                if not left[length]:
                    break
        for room, runs in fresh.items():
            gaps[room] += runs
        if not matched:  # no gap holds any document left: open as many sequences as these fill at least
            need = -(-sum(n * c for n, c in left.items()) // capacity)
            for length in sorted((n for n in left if left[n]), reverse=True):
                n = left[length] if 2 * length > capacity else min(left[length], need)
                if n <= 0:
                    break
                place(length, n, sequences, capacity, gaps)
                sequences, need = sequences + n, need - n
    return places, sequences


def pack(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces."""
    pieces_ = materialize(pieces_, "pieces")
    counts = {r["length"]: r["count"] for r in pieces_.groupBy("length").count().collect()}  # at most ``capacity`` rows
    full = counts.pop(capacity, 0)
    places, sequences = best_fit(counts, capacity)
    whole = pieces_.where(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id() + sequences, "offset": F.lit(0).cast("long")})
    if not places:
        return whole
    salts = -(-sum(counts.values()) // RANKED_TOGETHER)
    salted = pieces_.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    table = np.array(sorted(places), dtype=np.int64)
    keys = (table[:, 0] << 40) + table[:, 1]

    def run(batch):
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
        columns = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return X.record_batch(**columns, sequence_id=table[at, 3] + rank - table[at, 1], offset=table[at, 4])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = X.map_batches(ranked, run, schema)
    return packed.unionByName(whole) if full else packed


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces of the documents left, packed."""
    return pack(pieces(docs))
