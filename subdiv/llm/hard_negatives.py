"""Hard-negative mining with an inverted multi-index.

Vectors are made integer and cut in half; each half has a codebook from k-means on a
bounded sample.  Rows lie in the cell of their two codewords, and rows sorted by cell are
cut into blocks, in which cells are ranges and every codeword knows the radius of its rows.
A search visits the cells of a block in descending order of the sum of two half scores that
no row of the cell can pass (inner product with the codeword, plus radius times length of
the query half), found by a heap over the two sorted lists, and stops once no unvisited row
can enter what it looks for.  One pass finds each anchor's positives, a second the best rows
of every window of scores below them.  Anchors are a stated query set: chunks of them meet
all blocks, each block returns a bounded answer for every anchor, and the answers are
merged.  Codebooks and bounds only decide the order and the end of the search, so results
are exact.

Rows with a null id, label or vector, with null, NaN or infinite components, or with another
number of components than most rows (the smaller one on a tie) take no part; neither do rows
so long that inner products could pass 64 bits (a squared length of 2^62 after scaling).
Rows equal in id, label and vector count once; a row is never its own positive or negative,
nor is another row with the same id.  Ties of the score go to the smaller id.  Other columns
are ignored; anchors without positives, or positives without negatives, give no rows, as an
empty table does.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subdiv.llm import text as X
from subdiv.session import materialize

#: Codewords of each half; rows the codebooks are learnt from, about; rounds of k-means.
CODEWORDS, LEARN_ROWS, ROUNDS = 32, 20_000, 12
#: Rows of a block; anchors that visit a block together; rows scored at a time, at least.
BLOCK_ROWS, CHUNK_ANCHORS, STEP_ROWS = 8192, 1024, 256
_EXACT = 2.0**53  # whole numbers below this are exact in double precision


def integer_rows(rows: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, q`` of the rows that take part; ``q`` holds floor(256 * component)."""
    q = F.transform("embedding", lambda v: F.floor(v.cast("double") * 256))
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < 2.0**54))
    length = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    numbered = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(ok, q).alias("q"))
    whole = numbered.where("vec_id is not null and label is not null and q is not null").where(length < 2.0**62)
    whole = materialize(whole.dropDuplicates(["vec_id", "label", "q"]), "integer-vectors")
    most = whole.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return whole.where(F.size("q") == (most["d"] if most else 0))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def codebook(sample: np.ndarray, k: int = CODEWORDS) -> np.ndarray:
    """k-means from evenly spaced rows of the sample."""
    x = sample.astype(np.float64)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    words = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = nearest(x, words)
        words = np.stack([x[near == i].mean(axis=0) if (near == i).any() else words[i] for i in range(len(words))])
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(axis=1)[None, :] - 2 * (x.astype(np.float64) @ words.T), axis=1)


def learn_codebooks(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves from about LEARN_ROWS rows, the same ones on every run."""
    total = rows.count()
    at = F.xxhash64("vec_id").cast("double") / 2.0**64 + 0.5
    sample = rows.where(at < LEARN_ROWS / max(total, 1)).select("vec_id", "q").toArrow().sort_by("vec_id")
    if not sample.num_rows:
        return np.zeros((1, 0)), np.zeros((1, 0))
    q = _matrix(sample["q"])
    half = q.shape[1] // 2
    return codebook(q[:, :half]), codebook(q[:, half:])


def row_blocks(rows: DataFrame, books: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``block, ids, labels, q, cells``: rows in the order of their cells, at most BLOCK_ROWS in each block."""

    def cells(batch):
        q = _matrix(batch.column("q"))
        half = q.shape[1] // 2
        one, two = (nearest(h, w) if len(q) and h.shape[1] == w.shape[1] else np.zeros(len(q), np.int64) for h, w in zip((q[:, :half], q[:, half:]), books))
        return X.record_batch(vec_id=batch.column("vec_id"), label=batch.column("label"), q=batch.column("q"), cell=one * CODEWORDS + two)

    placed = X.map_batches(rows.select("vec_id", "label", "q"), cells, "vec_id long, label long, q array<long>, cell long")
    ordered = materialize(placed, "cells").repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    return packed(ordered, "block", BLOCK_ROWS)


def packed(rows: DataFrame, name: str, most: int) -> DataFrame:
    """Consecutive rows of a partition as one row of arrays; ``name`` numbers these from 0."""
    columns = rows.columns

    def run(batches):
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            lists = {c: pa.array([_flat(table[c])], pa.list_(pa.int64())) for c in columns}
            return X.record_batch(part=pa.array([number], pa.int64()), **lists)

        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, most - n)
                held, n, batch = [*held, piece], n + piece.num_rows, batch.slice(piece.num_rows)
                if n == most:
                    yield out()
                    number, held, n = number + 1, [], 0
        if n:
            yield out()

    X.workers_find_package(rows.sparkSession)
    made = rows.mapInArrow(run, "part long, " + ", ".join(f"{c} array<long>" for c in columns))
    made = materialize(made, f"packed-{name}")
    # one number for thousands of rows
    numbers = made.select("part").withColumn(name, F.row_number().over(Window.orderBy("part")) - 1)
    return made.join(numbers, "part").drop("part")


def _flat(column: pa.ChunkedArray):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column.to_numpy()


class Block:
    """Rows of one block with the cells they lie in."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, cell: np.ndarray, books):
        self.ids, self.labels, self.q = ids, labels, q
        self.half = q.shape[1] // 2
        self.exact = float(np.abs(q).max(initial=0)) ** 2 * q.shape[1] < _EXACT
        self.x = q.astype(np.float64)
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.range = {(c // CODEWORDS, c % CODEWORDS): (lo, hi) for c, lo, hi in zip(cell[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cell)])}
        self.words, self.radii, self.names = [], [], []
        for part, of_row, book in ((self.x[:, : self.half], cell // CODEWORDS, books[0]), (self.x[:, self.half :], cell % CODEWORDS, books[1])):
            names = np.unique(of_row)
            far = np.sqrt(((part - book[of_row]) ** 2).sum(axis=1)) if part.shape[1] else np.zeros(len(part))
            self.names.append(names.tolist())
            self.words.append(book[names])
            self.radii.append(np.array([far[of_row == n].max() for n in names]))

    def scores(self, lo: int, hi: int, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products of a range of rows."""
        if self.exact and float(np.abs(anchor).max(initial=0)) * float(np.abs(self.x[lo:hi]).max(initial=0)) * len(anchor) < _EXACT:
            return (self.x[lo:hi] @ anchor.astype(np.float64)).astype(np.int64)
        return self.q[lo:hi] @ anchor

    def visits(self, anchor: np.ndarray):
        """Ranges of rows, each with a bound on the scores of all rows after it, best cells first."""
        halves = (anchor[: self.half].astype(np.float64), anchor[self.half :].astype(np.float64))
        lists = []
        for a, words, radii, names in zip(halves, self.words, self.radii, self.names):
            most = words @ a + np.sqrt((a * a).sum()) * radii
            order = np.argsort(-most, kind="stable")
            lists.append((most[order].tolist(), [names[i] for i in order]))
        (s1, n1), (s2, n2) = lists
        room = 1e-9 * (abs(s1[0]) + abs(s1[-1]) + abs(s2[0]) + abs(s2[-1])) + 1e-6
        heap, cell = [(-(s1[0] + s2[0]), 0, 0)], None
        while heap:
            bound, i, j = heapq.heappop(heap)
            if cell is not None:
                yield (*cell, -bound + room)
                cell = None
            cell = self.range.get((n1[i], n2[j]))
            if j + 1 < len(s2):
                heapq.heappush(heap, (-(s1[i] + s2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(s1):
                heapq.heappush(heap, (-(s1[i + 1] + s2[0]), i + 1, 0))
        yield (*(cell or (0, 0)), -np.inf)


def search(block: Block, anchor: np.ndarray, wanted, certified):
    """Rows and scores visited until ``certified(scores, bound)``; ``wanted(rows, scores)`` tells which ones are held."""
    rows, scores, waiting, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for lo, hi, bound in block.visits(anchor):
        waiting.append((lo, hi))
        n += hi - lo
        if n < STEP_ROWS and bound > -np.inf:
            continue
        new_rows = np.concatenate([np.arange(lo, hi) for lo, hi in waiting])
        new_scores = np.concatenate([block.scores(lo, hi, anchor) for lo, hi in waiting])
        held = wanted(new_rows, new_scores)
        rows, scores = np.concatenate([rows, new_rows[held]]), np.concatenate([scores, new_scores[held]])
        waiting, n = [], 0
        if certified(scores, bound):
            break
    return rows, scores


def best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Positions of the highest scores, smaller ids first among equal ones."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:most]


def positives_of(block: Block, anchors, most: int):
    """Each anchor's best rows of its own label in this block."""
    for k, (anchor_id, label, q) in enumerate(anchors):
        rows, scores = search(
            block, q,
            lambda r, s, label=label, anchor_id=anchor_id: (block.labels[r] == label) & (block.ids[r] != anchor_id),
            lambda s, bound: bound == -np.inf or (s > bound).sum() >= most,
        )
        top = best(block.ids[rows], scores, most)
        yield k, block.ids[rows][top], scores[top]


def negatives_of(block: Block, anchors, windows, most: int):
    """Each anchor's best rows of other labels in this block for every window ``(lowest, highest)`` of scores."""
    for k, ((anchor_id, label, q), wanted) in enumerate(zip(anchors, windows)):
        if not len(wanted):
            continue
        low, high = min(w[0] for w in wanted), max(w[1] for w in wanted)

        def certified(scores, bound, wanted=wanted):
            return all(bound < lo or ((scores > bound) & (scores >= lo) & (scores <= hi)).sum() >= most for lo, hi in wanted)

        rows, scores = search(
            block, q,
            lambda r, s, label=label, anchor_id=anchor_id, low=low, high=high: (block.labels[r] != label) & (block.ids[r] != anchor_id) & (s >= low) & (s <= high),
            certified,
        )
        for w, (lo, hi) in enumerate(wanted):
            inside = np.flatnonzero((scores >= lo) & (scores <= hi))
            top = inside[best(block.ids[rows[inside]], scores[inside], most)]
            yield k, w, block.ids[rows[top]], scores[top]


def window_of(score: int, low_percent: int, high_percent: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -((-low_percent * score) // 100), high_percent * score // 100


def _met(blocks: DataFrame, chunks: DataFrame, task, schema: str) -> DataFrame:
    """Run ``task(block row, chunk row)`` on every chunk of anchors with every block."""
    n_blocks, n_chunks = blocks.count(), chunks.count()
    if not n_blocks or not n_chunks:
        return blocks.sparkSession.createDataFrame([], schema)
    one = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).groupBy("block", "chunk")
    other = chunks.withColumnRenamed("chunk", "of_chunk").withColumn("of_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).groupBy("of_block", "of_chunk")

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        return task({c: _flat(rows[c]) for c in rows.schema.names}, {c: _flat(anchors[c]) for c in anchors.schema.names})

    return one.cogroup(other).applyInArrow(run, schema)


def _anchors(chunk: dict):
    q = chunk["q"].reshape(len(chunk["anchor_id"]), -1)
    return list(zip(chunk["anchor_id"].tolist(), chunk["anchor_label"].tolist(), q))


def _block(rows: dict, books) -> Block:
    return Block(rows["vec_id"], rows["label"], rows["q"].reshape(len(rows["vec_id"]), -1), rows["cell"], books)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows`` of :func:`integer_rows`.

    An anchor's positives are its best rows of the same label, a positive's negatives the
    best rows of other labels that score between two percentages of the positive's score.
    """
    books = learn_codebooks(rows)
    blocks = materialize(row_blocks(rows, books), "row-blocks")
    anchors = materialize(rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "q").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    chunks = materialize(packed(anchors, "chunk", CHUNK_ANCHORS), "anchor-chunks")

    def find_positives(block, chunk):
        parts = list(positives_of(_block(block, books), _anchors(chunk), positives))
        sizes = [len(ids) for _, ids, _ in parts]
        return pa.table(
            {
                "anchor": np.repeat(chunk["anchor"], sizes), "anchor_id": np.repeat(chunk["anchor_id"], sizes),
                "positive_id": np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)]), "positive_score": np.concatenate([np.zeros(0, np.int64), *(p[2] for p in parts)]),
            }
        )

    def ranked(found: DataFrame, keys: list[str], by: str, other: str, name: str, most: int) -> DataFrame:
        """The best rows of a key; the answers of blocks are first merged in parts."""
        order = [F.desc(by), F.asc(other)]
        part = F.pmod(F.xxhash64(other), F.lit(16))
        some = found.withColumn("part", part).withColumn(name, F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))).where(F.col(name) <= most).drop(name, "part")
        return some.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)

    found = _met(blocks, chunks, find_positives, "anchor long, anchor_id long, positive_id long, positive_score long")
    pairs = materialize(ranked(found, ["anchor"], "positive_score", "positive_id", "turn", positives), "positives")
    listed = pairs.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    # a chunk's anchors with their positives' scores, padded to the same number
    wide = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("scores", i), F.lit(0).cast("long")))
    known = anchors.join(listed, "anchor").withColumns({"scores": wide, "n_scores": F.size("scores").cast("long")})
    chunks = materialize(packed(known, "chunk", CHUNK_ANCHORS), "anchor-windows")

    def find_negatives(block, chunk):
        scores = chunk["scores"].reshape(-1, positives)
        windows = [[window_of(s, low_percent, high_percent) for s in row[:n]] for row, n in zip(scores.tolist(), chunk["n_scores"].tolist())]
        parts = list(negatives_of(_block(block, books), _anchors(chunk), windows, negatives))
        sizes = [len(p[2]) for p in parts]
        return pa.table(
            {
                "anchor": np.repeat(chunk["anchor"][[p[0] for p in parts]], sizes) if parts else np.zeros(0, np.int64), "turn": np.repeat(np.array([p[1] + 1 for p in parts], dtype=np.int32), sizes),
                "negative_id": np.concatenate([np.zeros(0, np.int64), *(p[2] for p in parts)]), "negative_score": np.concatenate([np.zeros(0, np.int64), *(p[3] for p in parts)]),
            }
        )

    found = _met(blocks, chunks, find_negatives, "anchor long, turn int, negative_id long, negative_score long")
    chosen = ranked(found, ["anchor", "turn"], "negative_score", "negative_id", "rank", negatives)
    return pairs.join(chosen, ["anchor", "turn"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of all anchors (ids divisible by 100); the label of every seventh id is moved on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integer_rows(rows, moved), F.col("vec_id") % 100 == 0)


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id as other_id, b.label as other_label,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
pos as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where anchor_label = other_label
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
),
neg as (
  select p.anchor_id, p.positive_id, p.positive_score, s.other_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as rank
  from pos p join scored s on s.anchor_id = p.anchor_id and s.anchor_label <> s.other_label
    and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id::bigint as anchor_id, positive_id::bigint as positive_id, rank::int as rank, negative_id::bigint as negative_id, positive_score, negative_score
from neg where rank <= 10
"""
