"""N-gram Jaccard join: exact components of documents by the Jaccard distance of their shingle sets.

Unrelated documents are all at distance 1 of each other, so a Voronoi partition by pivots
drawn from the whole table would replicate every document into every region.  Pivots are
therefore drawn inside neighbourhoods that provably hold every linked pair: a set is cut
by hash into more parts than a linked pair can differ in, so linked sets agree in a whole
part.  The smallest set of a neighbourhood is its pivot, and a set joins the region of
every pivot its neighbourhoods name.

In a region the distance to the pivot is taken first: sets within the radius are linked
to it, and connected through it without a pair of their own.  What is left of a region of
at most ``REGION`` sets is joined: two sets of different components are compared only if
their distances to the pivot differ by the radius at most (triangle inequality) and a
parity bitmap allows the link.

The sets of larger regions are joined once, whatever the number of regions they are in:
each names as many of its rarest shingles as it needs to share one with every set it links
to, and the sets that name a shingle are compared if they are few.  Only sets that name a
shingle which many name (a crowd of near copies) stay in large regions; of those that
overlap one is made, and it gets a new pivot, the shingles most of a sample of its sets
have.  The pivot links sets near it without a pair, and divides the others by what they
differ in from it into inner regions about half as large, and so on.  Links found are
checked on the whole sets.

Equal sets count once, so copies are not paired.  Null texts and texts without a word have
an empty set and are linked with nothing.  Rows with a null id can link others, and their
component is null only if it holds no other id.  Repeated rows, ties (the smallest id
names a component), extra columns (ignored) and empty tables need no special care.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from subdiv.llm import text as X
from subdiv.session import materialize

#: Sets of a region that are compared with each other; larger regions are divided.
REGION = 32
#: Sets of a large region, on average, whose majority of shingles is its new pivot.
SAMPLE = 16

_FOLDED = X.byte_values(True)
_BITMAP = 512  # bits of a set's parity bitmap
_SALT = 0x9E3779B97F4A7C15
_SLOTS, _SLOT_BLOCK = 1 << 20, 1 << 14  # counters by which shingles are ordered from rare to frequent, and those in one row


def shingle_sets(block: X.Block, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; fewer words make one shingle."""
    words = block.words(X.NOT_SPACE)
    hashes = words.hashes(_FOLDED)
    at, grams = words.ngrams(hashes, n)
    edges = np.searchsorted(at, words.bounds)
    out = []
    for i in range(block.n):
        if edges[i + 1] > edges[i]:
            out.append(np.unique(grams[edges[i] : edges[i + 1]]))
        else:
            whole = hashes[words.bounds[i] : words.bounds[i + 1]]
            total = np.zeros(1 if len(whole) else 0, dtype=np.uint64)
            for h in whole:
                total = X.mix(total + h)
            out.append(X.mix(total + np.uint64(len(whole))) if len(whole) else total)
    return out


def set_id(shingles: np.ndarray) -> int:
    return int(X.mix(np.array([X.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0].astype(np.int64))


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of shingles hash to i; two sets differ in at least as many shingles as bits.

    There are two to four bits a shingle, a power of two; a longer bitmap folds to a shorter one by XOR of its halves.
    """
    width = _BITMAP
    while width < 2 * len(shingles):
        width *= 2
    bits = np.bincount((X.mix(shingles + np.uint64(7)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def size_class(n: int, percent: int) -> tuple[int, int, int]:
    """Number and largest set size of the class of size n, and of the next; linked sets share or neighbour a class."""
    i, low = 0, 1
    while True:
        high = max(low, low * 100 // percent)
        if n <= high:
            return i, high, max(high + 1, (high + 1) * 100 // percent)
        i, low = i + 1, high + 1


def signatures(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts of a set, of which linked sets share some, and what may be left out.

    Linked sets of at most m shingles differ in k = 2m(100-p)/(100+p) shingles at most, so
    of k + 1 + e parts e + 1 hold no difference, and a set with f empty parts shares at
    least e + 1 - f others with any set it links to.  So each set may leave out its last
    e - f parts in an order that all sets follow.  The second array has, for each hash, the
    number of its class and e - f as ``class * 2**16 + (e - f)``.
    """
    i, high, higher = size_class(len(shingles), percent)
    out, notes = [], []
    for number, most in ((i, high), (i + 1, higher)):
        k = 2 * most * (100 - percent) // (100 + percent)
        spare = 1 + k // 10 if k else 0
        parts = k + 1 + spare
        salt = np.uint64((number + 1) * _SALT % (1 << 64))
        part = (X.mix(shingles + salt) % np.uint64(parts)).astype(np.int64)
        total = np.zeros(parts, dtype=np.uint64)
        np.add.at(total, part, X.mix(shingles ^ salt))
        filled = np.bincount(part, minlength=parts) > 0
        empty = int(parts - filled.sum())
        if empty > spare:
            filled[:] = True
        at = np.flatnonzero(filled).astype(np.uint64)
        out.append(X.mix(total[filled] + X.mix(at + salt)))
        notes.append(np.full(len(at), (number << 16) + min(0xFFFF, max(0, spare - empty)), dtype=np.int32))
    return np.concatenate(out).view(np.int64), np.concatenate(notes)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def members(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, set_id, n_shingles`` and a coarse and a fine parity bitmap (``bits``, ``fine``) of every document."""

    def run(batch):
        out = []
        for block in X.blocks(batch.column("text")):
            sets = shingle_sets(block, n)
            fine = [parity(s) for s in sets]
            out.append(
                X.record_batch(
                    doc_id=batch.column("doc_id").slice(block.first, block.n),
                    set_id=pa.array([set_id(s) for s in sets], pa.int64()),
                    n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                    bits=pa.array([np.bitwise_xor.reduce(f.reshape(-1, _BITMAP // 64), axis=0) for f in fine], pa.list_(pa.int64())),
                    fine=pa.array(fine, pa.list_(pa.int64())),
                )
            )
        return out

    return X.map_batches(_rows(docs), run, "doc_id long, set_id long, n_shingles long, bits array<long>, fine array<long>")


def neighbourhoods(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``sig, set_id`` of the signatures that two different sets share, without those a set may leave out.

    The order is by frequency, so what goes are the parts made of passages that many
    otherwise different documents have.
    """

    def run(batch):
        for block in X.blocks(batch.column("text")):
            sets = [s for s in shingle_sets(block, n) if len(s)]
            sigs = [signatures(s, percent) for s in sets]
            ids = np.repeat(np.array([set_id(s) for s in sets], dtype=np.int64), [len(x) for x, _ in sigs])
            yield X.record_batch(sig=np.concatenate([np.zeros(0, np.int64), *(x for x, _ in sigs)]), note=np.concatenate([np.zeros(0, np.int32), *(y for _, y in sigs)]), set_id=ids)

    group = Window.partitionBy("sig")
    rows = X.map_batches(docs.select("text"), lambda batch: list(run(batch)), "sig long, note int, set_id long")
    shared = rows.withColumns({"low": F.min("set_id").over(group), "high": F.max("set_id").over(group), "n": F.count("*").over(group)}).where("low <> high")
    last = Window.partitionBy("set_id", "note").orderBy(F.desc("n"), F.desc("sig"))
    return shared.select("sig", "set_id", "note", "n").distinct().withColumn("turn", F.row_number().over(last)).where("turn > note % 65536").select("sig", "set_id")


def _shingles_of(docs: DataFrame, n: int, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set_id, shingles`` of the sets in ``wanted``, read from their representatives' texts.

    Ids are looked up in bitmaps, so a few more sets, or a set twice, may come along.
    """
    some = reps.join(wanted, "set_id").select("set_id", F.coalesce("doc_id", F.lit(0)).alias("doc_id"))
    wanted_docs, wanted_sets = X.bitmap_of(some, "doc_id"), X.bitmap_of(some, "set_id")

    def run(batch):
        out = []
        doc_ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(X.in_bitmap(wanted_docs, doc_ids))
        for block in X.blocks(batch.column("text").take(pa.array(some, pa.int64()))):
            sets = shingle_sets(block, n)
            ids = np.array([set_id(s) for s in sets], dtype=np.int64)
            keep = np.flatnonzero(X.in_bitmap(wanted_sets, ids))
            out.append(X.record_batch(set_id=ids[keep], shingles=pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))))
        return out

    return materialize(X.map_batches(_rows(docs), run, "set_id long, shingles array<long>"), "shingles")


def _differ() -> Column:
    """Bits in which the coarse bitmaps of sets a and b differ; cheap."""
    one = [F.bit_count(F.col(f"c{i}_a").bitwiseXOR(F.col(f"c{i}_b"))) for i in range(_BITMAP // 64)]
    return sum(one[1:], one[0])


def _differ_finely() -> Column:
    """Bits in which their fine bitmaps differ, at the width of the shorter one; linked sets' widths differ by one fold at most."""
    xor = lambda x, y: x.bitwiseXOR(y)

    def fitted(x: str, other: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        folded = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), xor)
        return F.when(F.size(x) > F.size(other), folded).otherwise(F.col(x))

    return F.aggregate(F.zip_with(fitted("fine_a", "fine_b"), fitted("fine_b", "fine_a"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0)))


def _sizes_near(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _may_link(percent: int) -> Column:
    """Whether sizes and bitmaps of sets a and b allow a link; the cheap tests come first."""
    most = (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return _sizes_near(percent) & (_differ() * (100 + percent) <= most) & (_differ_finely() * (100 + percent) <= most)


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add the exact number of shingles in common to pairs ``a, n_a, b, n_b``; best with few different ``a``."""
    left, right = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("s_a")), sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("s_b"))
    left = left.join(pairs.select("a").distinct(), "a", "left_semi")
    return pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("s_a", "s_b"))).drop("s_a", "s_b")


def _linked(percent: int) -> Column:
    return 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of its component) of every node that an edge ``a, b`` has."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if state == before or state["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "edges")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)) if links.limit(1).count() else roots


def _open(regions: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """Rows ``pivot, x, low, high`` (and ``rest``) of regions with several components, with ``root`` and ``size``; of equal regions one stays."""
    rows = materialize(regions.join(roots, F.col("x") == F.col("node"), "left").select(*regions.columns, F.coalesce("root", "x").alias("root")), name)
    same = [F.bit_xor(F.xxhash64("x", F.lit(i))).alias(f"h{i}") for i in range(2)]
    kept = rows.groupBy("pivot").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"), *same).where("r0 <> r1")
    kept = kept.groupBy("size", "h0", "h1").agg(F.min("pivot").alias("pivot"))
    return materialize(rows.join(kept.select("pivot", "size"), "pivot"), name)


def _large(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("size") > REGION)


def _region_pairs(regions: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, n_a, b, n_b`` of the small regions that size, distance to the pivot and bitmaps allow to link."""
    rows = regions.where(F.col("size") <= REGION).select("pivot", "x", "low", "high", "root").join(reps.withColumnRenamed("set_id", "x").drop("doc_id"), "x")
    side = lambda s: rows.select("pivot", *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "pivot"])
    radius = 1 - percent / 100 + 1e-9
    window = (F.col("low_a") - F.col("high_b") <= radius) & (F.col("low_b") - F.col("high_a") <= radius)
    pairs = side("a").join(side("b"), "pivot").where((F.col("x_a") < F.col("x_b")) & (F.col("root_a") != F.col("root_b")) & _sizes_near(percent) & window & _may_link(percent))
    return pairs.select(F.col("x_a").alias("a"), F.col("n_a"), F.col("x_b").alias("b"), F.col("n_b")).distinct()


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and how many each has."""
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False)


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (X.mix(shingles + np.uint64(11)) % np.uint64(_SLOTS)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """Counters of fixed size (4 MB) of the shingles of ``x, shingles``; shingles of one slot share a counter.

    They only order shingles: any order finds all links, and a good one compares fewer sets.
    """

    def count(batch):
        slots = np.bincount(_slots(_flat(batch.column("shingles"))[0]), minlength=_SLOTS).astype(np.uint32).reshape(-1, _SLOT_BLOCK)
        some = np.flatnonzero(slots.any(axis=1))
        return X.record_batch(block=pa.array(some, pa.int64()), counts=pa.array([slots[i].tobytes() for i in some], pa.binary()))

    def total(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in table["counts"].to_pylist())
        return pa.table({"block": table["block"][:1], "counts": pa.array([np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    schema = "block long, counts binary"
    out = np.zeros((_SLOTS // _SLOT_BLOCK, _SLOT_BLOCK), dtype=np.uint32)
    for r in X.map_batches(sets.select("shingles"), count, schema).groupBy("block").applyInArrow(total, schema).collect():  # at most _SLOTS / _SLOT_BLOCK rows
        out[r.block] = np.frombuffer(r.counts, np.uint32)
    return out.reshape(-1)


def _rare_keys(sets: DataFrame, percent: int) -> DataFrame:
    """``x, e``: the rarest shingles ``e`` of each set of ``x, shingles``, one more than it can have that a linked set has not.

    All sets follow one order, so the first shingle in it that two linked sets have in common is named by both.
    """
    often = _frequencies(sets)

    def run(batch):
        shingles, n = _flat(batch.column("shingles"))
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((shingles, often[_slots(shingles)], owner))
        turn = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        named = order[turn <= n[owner] * (100 - percent) // 100]
        return X.record_batch(x=batch.column("x").take(pa.array(owner[named], pa.int64())), e=shingles[named].view(np.int64))

    return X.map_batches(sets.select("x", "shingles"), run, "x long, e long")


def _crowds(large: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the sets of large regions that rare shingles find, and the regions ``pivot, x`` that hold all other links.

    Two linked sets name a common shingle.  If few sets name it they are compared here; else
    both sets are in a crowd.  So large regions keep only sets that name a crowded shingle,
    and regions with a set in common are made one: each set is divided once, not once a region.
    """
    shingles = sets.select(F.col("set_id").alias("x"), "shingles").join(large.select("x").distinct(), "x", "left_semi").groupBy("x").agg(F.first("shingles").alias("shingles"))
    keys = materialize(_rare_keys(materialize(shingles, "crowded-shingles"), percent), "rare-keys")
    named = keys.join(keys.groupBy("e").agg(F.count("*").alias("size")).where("size > 1"), "e").select(F.col("e").alias("pivot"), "x", "size")
    small = named.where(F.col("size") <= REGION).join(large.select("x", "root").distinct(), "x").withColumns({"low": F.lit(0.0), "high": F.lit(1.0)})
    pairs = materialize(_region_pairs(small, reps, percent), "rare-pairs")
    crowd = materialize(large.join(_large(named).select("x").distinct(), "x", "left_semi").select("pivot", "x"), "crowds")
    whole = components(crowd.select(F.col("pivot").alias("a"), F.col("x").alias("b")))
    return pairs, crowd.select("x").distinct().join(whole, F.col("x") == F.col("node")).select(F.col("root").alias("pivot"), "x", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))


def _recentred(regions: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` of large regions that need no pair, and the inner regions that hold all others.

    The new pivot is the set of the shingles that most of a sample of a region's sets have.
    What a set differs by from it is its rest; sets x and y differ in ``|rest x| + |rest y| - 2 common``
    shingles.  With ``slack = |rest| (100 + p) - n (100 - p)`` they link if and only if their
    slacks add up to ``2 (100 + p) common`` at most.  So a pair with slacks of sum 0 or less
    links, and then both link with the set of the smallest slack.  All other links share a
    shingle of their rests: inner regions are the rests' rarest shingles, as many as the
    smallest slack leaves to a set, and one more at most than linked sets can differ in
    (rests differ in what the sets differ in).  About half of a region at most has the same
    shingle in its rest, and never all of it, so inner regions are smaller each time.

    Inner regions that may be large bring ``rest``, from which they are divided again: rests
    of sets of one region differ as the sets do, and are shorter.
    """
    rows = regions.join(reps.select(F.col("set_id").alias("x"), "n"), "x")
    if "rest" not in regions.columns:
        shingles = sets.select(F.col("set_id").alias("x"), F.col("shingles").alias("rest")).join(regions.select("x").distinct(), "x", "left_semi").groupBy("x").agg(F.first("rest").alias("rest"))
        rows = rows.join(shingles, "x")
    rows = materialize(rows.select("pivot", "size", "x", "root", "n", "rest"), "region-shingles")
    some = rows.where(F.pmod(F.xxhash64("x", "pivot"), "size") < SAMPLE)
    seen = some.groupBy("pivot").agg(F.count("*").alias("seen"))
    most = some.select("pivot", F.explode("rest").alias("e")).groupBy("pivot", "e").count().join(seen, "pivot").where(2 * F.col("count") > F.col("seen"))
    center = most.groupBy("pivot").agg(F.collect_list("e").alias("center"))
    none = F.array().cast("array<long>")
    rows = rows.join(center, "pivot", "left").withColumn("center", F.coalesce("center", none))
    rows = rows.withColumn("rest", F.concat(F.array_except("rest", "center"), F.array_except("center", "rest")))
    more, less = 100 + percent, 100 - percent
    differ = F.floor(F.col("n") * less / percent)  # sets of n shingles and of 100 n / p at most
    rows = materialize(rows.select("pivot", "x", "root", "rest", (F.size("rest") * more - F.col("n") * less).alias("slack"), differ.alias("differ")), "rests")
    first = rows.groupBy("pivot").agg(F.min(F.struct("slack", "x")).alias("first"))
    near = rows.join(first, "pivot")
    links = materialize(near.where((F.col("x") != F.col("first.x")) & (F.col("slack") + F.col("first.slack") <= 0)).select(F.col("first.x").alias("a"), F.col("x").alias("b")).distinct(), "sure-links")
    common = F.greatest(F.lit(1), F.ceil((F.col("slack") + F.col("first.slack")) / (2 * more)), F.size("rest") - F.col("differ"))
    parts = near.select("pivot", "x", "root", (F.size("rest") - common + 1).alias("most"), F.explode("rest").alias("e")).where("most > 0")
    often = parts.groupBy("pivot", "e").agg(F.count("*").alias("sets"), (F.min("root") != F.max("root")).alias("open"))
    turn = F.row_number().over(Window.partitionBy("pivot", "x").orderBy("sets", "e"))
    inner = parts.join(often, ["pivot", "e"]).withColumn("turn", turn).where("turn <= most and open").select("pivot", "x", "e", "sets")
    again = F.when(F.col("sets") > REGION, F.col("rest")).alias("rest")
    inner = inner.join(rows.select("pivot", "x", "rest"), ["pivot", "x"])
    return links, inner.select(F.xxhash64("pivot", "e").alias("pivot"), "x", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), again)


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id``; documents link when their Jaccard similarity is ``percent`` / 100 or more."""
    rows = materialize(members(docs, n), "shingle-members")
    shared = materialize(neighbourhoods(docs, n, percent), "neighbourhoods")
    ids = shared.select("set_id").distinct()
    coarse = [f"c{i}" for i in range(_BITMAP // 64)]
    first = rows.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("fine").alias("fine"))
    reps = materialize(first.join(ids, "set_id").select("set_id", "doc_id", "n", "fine", *[F.get("bits", F.lit(i)).alias(c) for i, c in enumerate(coarse)]), "representatives")

    pivots = shared.groupBy("sig").agg(F.min("set_id").alias("pivot"))
    region = shared.join(pivots, "sig").select("pivot", "set_id").distinct()
    of = lambda s: reps.select(F.col("set_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "fine", *coarse)])
    star = region.where("pivot <> set_id").select(F.col("pivot").alias("a"), F.col("set_id").alias("b")).join(of("a"), "a").join(of("b"), "b")
    differ = F.greatest(_differ(), F.when(_sizes_near(percent), _differ_finely()))
    star = materialize(star.select("a", "b", "n_a", "n_b", _may_link(percent).alias("maybe"), differ.alias("differ")), "star")
    maybe = star.where("maybe").drop("maybe")
    both = lambda pairs: pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    sets = _shingles_of(docs, n, reps, both(maybe))
    # the home region first; other pivots only for sets that are still apart from them
    home = maybe.groupBy("b").agg(F.min_by(F.struct("a", "n_a", "n_b"), F.struct("differ", "a")).alias("home")).select("home.a", "home.n_a", "b", "home.n_b")
    near = materialize(_distances(home, sets), "home-distances")
    roots = components(near.where(_linked(percent)).select("a", "b"))
    apart = _apart(maybe.join(home.select("a", "b"), ["a", "b"], "left_anti"), roots).select("a", "n_a", "b", "n_b")
    others = materialize(_distances(apart, sets), "other-distances")
    near = near.unionByName(others)
    roots = _joined(roots, others.where(_linked(percent)).select("a", "b"))

    # bounds of every distance to the pivot, then what is left of each region with several components
    exact = (F.col("n_a") + F.col("n_b") - 2 * F.col("common")) / (F.col("n_a") + F.col("n_b") - F.col("common"))
    least = 2 * F.col("differ") / (F.col("n_a") + F.col("n_b") + F.col("differ"))
    known = near.select("a", "b", exact.alias("d"))
    spread = star.join(known, ["a", "b"], "left").select(F.col("a").alias("pivot"), F.col("b").alias("x"), F.coalesce("d", least).alias("low"), F.coalesce("d", F.lit(1.0)).alias("high"))
    spread = spread.unionByName(star.select(F.col("a").alias("pivot"), F.col("a").alias("x"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).distinct())
    now = _open(spread, roots, "open-regions")
    pairs = materialize(_region_pairs(now, reps, percent), "region-pairs")
    sets = _shingles_of(docs, n, reps, both(pairs).unionByName(_large(now).select(F.col("x").alias("set_id"))).distinct())
    found = [pairs]
    if _large(now).limit(1).count():
        rare, crowds = _crowds(_large(now), reps, sets, percent)
        now = _open(crowds, roots, "crowded-regions")
        found += [rare, materialize(_region_pairs(now, reps, percent), "crowded-pairs")]
    while _large(now).limit(1).count():
        links, inner = _recentred(_large(now), reps, sets, percent)
        roots = _joined(roots, links)
        now = _open(inner, roots, "inner-regions")
        found.append(materialize(_region_pairs(now, reps, percent), "inner-pairs"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    links = _distances(_apart(pairs.distinct(), roots).select("a", "n_a", "b", "n_b"), sets).where(_linked(percent)).select("a", "b")
    roots = _joined(roots, materialize(links, "region-links"))

    class_of = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_id")).join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("root"))
    least_id = class_of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = class_of.join(least_id, "root").select("set_id", "component_id")
    # an empty set equals other empty sets but is linked with nothing; its key is left out of the join
    full = rows.where("n_shingles > 0").join(named, "set_id").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of near duplicates (five words, 0.8) the document with the smallest id stays, once."""
    found = materialize(ngram_join(docs), "duplicates")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count()
    once, again = (kept.where(c).select(F.col("doc_id").alias("__kept_id")) for c in ("count = 1 or doc_id is null", "count > 1 and doc_id is not null"))
    out = docs.join(once, docs["doc_id"].eqNullSafe(once["__kept_id"]), "left_semi")
    if again.limit(1).count():  # rows that repeat an id
        out = out.unionByName(docs.join(again, docs["doc_id"] == again["__kept_id"], "left_semi").dropDuplicates(["doc_id"]))
    return out
