"""Words, lines and hashes of whole Arrow batches of text, without a Python loop per word."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside a task; one longer text makes a longer block.
BLOCK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)  # odd, so that its powers can be undone


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    """A 64-bit value per byte; with ``fold_case`` A-Z count as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if fold_case:
        values[65:91] = values[97:123]
    return values


def byte_class(pattern_bytes) -> np.ndarray:
    """Boolean table over bytes, true for the given ones."""
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


#: Bytes of words split at ASCII white space: everything but 0x20 and 0x09-0x0D.
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Bytes of words of digits, ASCII letters and all non-ASCII characters.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


_KEPT: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers of ``base``; those for usual blocks are kept."""
    have = _KEPT.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * BLOCK_BYTES), np.uint64(base))
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 2 * BLOCK_BYTES:
            _KEPT[base] = have
    return have[:n]


class Block:
    """The bytes of some consecutive texts of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def words(self, inside: np.ndarray) -> Words:
        return Words(self, inside)

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """Sum over each text of a per-byte array."""
        running = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return running[self.offsets[1:]] - running[self.offsets[:-1]]

    def prefix_hashes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running hash before each byte and the factor that shifts it to position 0."""
        n = len(self.data)
        running = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[self.data] * _powers(n, int(_STEP)), dtype=np.uint64, out=running[1:])
        return running, _powers(n + 1, pow(int(_STEP), -1, 1 << 64))


class Words:
    """Start, end (bytes) and text number of every word of a block, in order."""

    def __init__(self, block: Block, inside: np.ndarray):
        w = inside[block.data]
        first, last = w.copy(), w.copy()
        if len(w):
            first[1:] &= ~w[:-1]
            last[:-1] &= ~w[1:]
            edges = block.offsets[:-1][np.diff(block.offsets) > 0]  # a text never continues a word of the one before
            first[edges] = w[edges]
            last[edges[1:] - 1] = w[edges[1:] - 1]
        self.block = block
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, block.offsets)  # of each text's words
        self.count = np.diff(self.bounds)
        self.text = np.repeat(np.arange(block.n), self.count)

    def hashes(self, values: np.ndarray, prefix: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``prefix`` bytes."""
        running, undo = self.block.prefix_hashes(values)
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        return mix((running[end] - running[self.start]) * undo[self.start] + (end - self.start).astype(np.uint64))

    def ngrams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every n consecutive words of one text."""
        k = len(hashes) - n + 1
        if k <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.text[:k] == self.text[n - 1 :])
        total = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            total = mix(total + hashes[at + j])
        return at, total


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, rows: int = 4096) -> Iterator[Block]:
    """Cut a text column (null: empty) into blocks of about ``limit`` bytes and ``rows`` texts; no text is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column), lo + rows)
        yield Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package wherever it was started from."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(RecordBatch) -> RecordBatch or list of them``."""
    workers_find_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            out = fn(batch)
            yield from out if isinstance(out, list) else [out]

    return df.mapInArrow(run, schema)


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))


def held_out(doc_id, modulus: int, remainder: int):
    """Rows kept out of learning: crc32 of the id as text has the given remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows with the smallest hash of ``key``: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)


BITMAP_BITS = 1 << 23


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray:
    """Bitmap of fixed size (1 MB) with a bit set for every value of a long column.

    Tested values may show set by chance, never unset by chance; so it only saves work.
    """
    bit = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    rows = (
        hashes.where(F.col(column).isNotNull())
        .groupBy((bit / 32).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))).alias("bits"))
        .collect()  # at most BITMAP_BITS / 32 rows
    )
    words = np.zeros(BITMAP_BITS // 32, dtype=np.uint32)
    for r in rows:
        words[r.word] = r.bits
    return words


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) % BITMAP_BITS
    return (words[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0
