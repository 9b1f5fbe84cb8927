"""Phrase collocations: counts of word n-grams from FM-indexes of shards, and their scores.

Texts become shards of about SHARD_WORDS words: a dictionary and a sequence of word ids with
0 between pieces.  Every shard is indexed in both directions (``fm_index``).  A first pass
extends single words to the left and sums the hashes of word pairs over all shards; pairs
that reach ``least`` go back to the shards that hold them.  A second pass extends only
those, to the left and then to the right, as no phrase can be more frequent than the pairs
it consists of: words outside of frequent pairs leave the text before it is indexed again.
It emits phrases with their counts and with how often a word stands before and behind them.  Sums over all shards are exact: hashes only choose what is extended, and
chance equality of two hashes makes work, not errors.

Null texts are empty; a null language is ``und``.  Rows that repeat count again, other
columns are ignored, texts without words add nothing, an empty table gives an empty result.
A long text is never cut, it makes a longer shard.  Ties of the score go to the larger
count, then to the smaller phrase in byte order, so ranks are unique.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subdiv.llm import text as X
from subdiv.llm.fm_index import Index, TwoWay
from subdiv.session import materialize

#: Words of a shard, about; the index takes some 300 bytes a word in its task.
SHARD_WORDS = 1 << 19
#: Bytes of pair hashes that one task adds up, about.
BUCKET_BYTES = 32 << 20
#: Bits of the hash of a word pair.
PAIR_BITS = 48
#: Copies of the counts of single phrases, so that candidates of one very frequent word join in several tasks; and first parts of a ranking.
SALTS, RANK_PARTS = 8, 64

_BREAKS, _BLANKS = X.byte_class(b".,;:!?\n\x0b\x0c\r"), X.byte_class(b" \t")
_WORD = ~(_BREAKS | _BLANKS)
_FOLDED, _EXACT = X.byte_values(fold_case=True), X.byte_values(fold_case=False)
_NO_LANG = "und"
_CODEC = pa.Codec("zstd", compression_level=3)


class _Shard:
    """Words of some blocks of texts, until they are enough for an index."""

    def __init__(self):
        self.blocks, self.starts, self.known, self.n = [], [], {}, 0

    def add(self, block: X.Block, langs: list[str]) -> None:
        words = block.words(_WORD)
        if not len(words.start):
            return
        seeds = {lang: X.mix(np.frombuffer(lang.encode() + b"\0" * (-len(lang.encode()) % 8), dtype=np.uint64).copy() + np.uint64(1)) for lang in set(langs)}
        seeds = {lang: np.bitwise_xor.reduce(X.mix(s + np.arange(len(s), dtype=np.uint64)), initial=0) for lang, s in seeds.items()}
        of_text = np.array([seeds[lang] for lang in langs], dtype=np.uint64)
        hashes = X.mix(words.hashes(_FOLDED) + of_text[words.text])
        piece = np.cumsum(_BREAKS[block.data])[words.start]
        starts = np.concatenate([[True], (piece[1:] != piece[:-1]) | (words.text[1:] != words.text[:-1])])
        unique, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        for h, i in zip(unique.tolist(), at.tolist()):
            if h not in self.known:
                word = bytes(block.data[words.start[i] : words.end[i]]).lower().decode("utf-8", "replace")
                self.known[h] = f"{word}\t{langs[words.text[i]]}"  # a word holds no tab
        self.blocks.append((unique, which.astype(np.int32)))
        self.starts.append(starts)
        self.n += len(hashes)

    def row(self, number: int) -> pa.RecordBatch:
        starts = np.concatenate(self.starts)
        unique, names = np.unique(np.concatenate([u for u, _ in self.blocks]), return_inverse=True)
        ends = np.cumsum([len(u) for u, _ in self.blocks])
        ids = np.concatenate([names[end - len(u) : end][which] for (u, which), end in zip(self.blocks, ends)])
        counts = np.bincount(ids, minlength=len(unique))
        order = np.argsort(-counts, kind="stable")  # frequent words have small ids, of which three bytes are mostly 0
        new = np.empty(len(order), dtype=np.int64)
        new[order] = np.arange(1, len(order) + 1)
        tokens = np.zeros(len(ids) + int(starts.sum()) + 1, dtype=np.int32)
        tokens[np.arange(len(ids)) + np.cumsum(starts)] = new[ids]
        planes = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T)
        words = json.dumps([self.known[h] for h in unique[order].tolist()], ensure_ascii=False).encode()
        return X.record_batch(
            shard=pa.array([number], pa.int64()), n_words=pa.array([self.n], pa.int64()), n_bytes=pa.array([len(words)], pa.int64()), n_tokens=pa.array([len(tokens)], pa.int64()),
            words=pa.array([_CODEC.compress(words, asbytes=True)], pa.binary()), tokens=pa.array([_CODEC.compress(planes.tobytes(), asbytes=True)], pa.binary()),
        )


def shards(docs: DataFrame) -> DataFrame:
    """One row per shard: words and languages of the ids from 1, and ids with 0 between pieces, both compressed."""

    def run(batches):
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            langs = [_NO_LANG if x is None else x for x in batch.column("lang").to_pylist()]
            for block in X.blocks(batch.column("text")):
                shard.add(block, langs[block.first : block.first + block.n])
                if shard.n >= SHARD_WORDS:
                    yield shard.row(number)
                    number, shard = number + 1, _Shard()
        if shard.n:
            yield shard.row(number)

    X.workers_find_package(docs.sparkSession)
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "shard long, n_words long, n_bytes long, n_tokens long, words binary, tokens binary")


def _tokens(row) -> np.ndarray:
    n = row["n_tokens"].as_py()
    planes = np.frombuffer(_CODEC.decompress(row["tokens"].as_py(), decompressed_size=4 * n, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32)[:, 0]


def _words(row) -> list[list[str]]:
    """Word and language of every id from 1."""
    return [w.split("\t", 1) for w in json.loads(_CODEC.decompress(row["words"].as_py(), decompressed_size=row["n_bytes"].as_py(), asbytes=True))]


def _hashes(words: list[list[str]]) -> np.ndarray:
    """Hash of every word id; that of 0 is never used."""
    joined = pa.array(["\t".join(w) for w in words], pa.large_string())
    parts = [_whole_hash(block) for block in X.blocks(joined, rows=1 << 16)]
    return np.concatenate([np.zeros(1, np.uint64), *parts])


def _whole_hash(block: X.Block) -> np.ndarray:
    running, undo = block.prefix_hashes(_EXACT)
    start, end = block.offsets[:-1], block.offsets[1:]
    return X.mix((running[end] - running[start]) * undo[start] + (end - start).astype(np.uint64))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """PAIR_BITS of a hash; equal ones of different pairs only make both be extended."""
    return X.mix(X.mix(first + np.uint64(0x5851F42D4C957F2D)) + second) >> np.uint64(64 - PAIR_BITS)


def _floor(bucket: int, buckets: int) -> int:
    """Smallest pair hash of a bucket."""
    return -(-(bucket << PAIR_BITS) // buckets)


def _steps(sorted_pairs: np.ndarray, floor: int) -> bytes:
    """Sorted hashes as differences, in four bytes each where they fit."""
    steps = np.diff(sorted_pairs, prepend=np.uint64(floor))
    return (steps.astype(np.uint32) if not len(steps) or steps.max() < 1 << 32 else steps).tobytes()


def _pairs(steps: bytes, n: int, floor: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, dtype=np.uint32 if len(steps) == 4 * n else np.uint64), dtype=np.uint64) + np.uint64(floor)


def _rows_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names}


def frequent_pairs(indexed: DataFrame, least: int, buckets: int) -> DataFrame:
    """``shard, pairs``: sorted hashes of the pairs of a shard that occur ``least`` times in all shards."""
    cap = np.min_scalar_type(least)

    def count(batches):
        for row in _rows_of(batches):
            text, hashes = _tokens(row), _hashes(_words(row))
            index, _ = Index.of(text, 2, len(hashes))
            owner, word, low, high = index.extend(index.first[1:-1], index.first[2:])
            # owner k is word k + 1; a count over ``least`` adds no more than ``least``
            pairs, counts = _pair_hash(hashes[word], hashes[owner + 1]), np.minimum(high - low, least).astype(cap)
            order = np.argsort(pairs)
            pairs, counts = pairs[order], counts[order]
            floors = [_floor(i, buckets) for i in range(buckets)]
            edges = [*np.searchsorted(pairs, np.array(floors, dtype=np.uint64)).tolist(), len(pairs)]
            some = [i for i in range(buckets) if edges[i] < edges[i + 1]]
            yield X.record_batch(
                bucket=pa.array(some, pa.int32()),
                shard=pa.array([row["shard"].as_py()] * len(some), pa.int64()),
                pairs=pa.array([_steps(pairs[edges[i] : edges[i + 1]], floors[i]) for i in some], pa.binary()),
                counts=pa.array([counts[edges[i] : edges[i + 1]].tobytes() for i in some], pa.binary()),
            )

    def add_up(table: pa.Table) -> pa.Table:
        floor = _floor(table["bucket"][0].as_py(), buckets)
        counts = [np.frombuffer(x, dtype=cap) for x in table["counts"].to_pylist()]
        pairs = [_pairs(x, len(c), floor) for x, c in zip(table["pairs"].to_pylist(), counts)]
        unique, which = np.unique(np.concatenate(pairs), return_inverse=True)
        enough = (np.bincount(which, weights=np.concatenate(counts)) >= least)[which]
        ends = np.cumsum([len(x) for x in pairs])
        kept = [x[enough[end - len(x) : end]] for x, end in zip(pairs, ends)]
        some = [i for i, x in enumerate(kept) if len(x)]
        return pa.table({"shard": table["shard"].take(pa.array(some, pa.int64())), "pairs": pa.array([kept[i].tobytes() for i in some], pa.binary())})

    emitted = indexed.mapInArrow(count, "bucket int, shard long, pairs binary, counts binary")
    return emitted.groupBy("bucket").applyInArrow(add_up, "shard long, pairs binary").groupBy("shard").agg(F.collect_list("pairs").alias("pairs"))


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """``lang, phrase, words, count, left, right`` of all words and of phrases of up to ``longest`` words.

    Exact over all of ``docs(text, lang)`` for phrases that occur ``least`` times or more;
    of rarer ones only words are sure to be returned.  ``left`` and ``right`` count
    occurrences with a word before and behind in the same piece.
    """
    indexed = materialize(shards(docs), "phrase-shards")
    amount = indexed.agg(F.sum("n_words")).first()[0] or 0
    parts = max(16, -(-amount * 16 // BUCKET_BYTES))
    wanted = frequent_pairs(indexed, least, max(16, -(-amount * 5 // BUCKET_BYTES))) if longest > 1 else None  # a pair takes five bytes

    def enumerate_phrases(batches):
        for row in _rows_of(batches):
            text, words = _tokens(row), _words(row)
            hashes = _hashes(words)
            names = pa.array([None, *(w for w, _ in words)], pa.string())
            langs = pa.array([None, *(lang for _, lang in words)], pa.string())
            for length, ids, count, left, right in _enumerated(text, hashes, row["pairs"].as_py() or [], longest):
                whole = hashes[ids[:, 0]]
                for k in range(1, length):
                    whole = _pair_hash(whole, hashes[ids[:, k]])
                bucket = (whole % np.uint64(parts)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                ids, count, left, right = ids[order], count[order], left[order], right[order]
                columns = [names.take(pa.array(ids[:, k])) for k in range(length)]
                table = pa.table(
                    {
                        "lang": langs.take(pa.array(ids[:, 0])).dictionary_encode(), "phrase": pc.binary_join_element_wise(*columns, " "),
                        "words": pa.array(np.full(len(ids), length, dtype=np.int32)), "count": pa.array(count, pa.int64()), "left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64()),
                    }
                )
                edges = np.searchsorted(bucket[order], np.arange(parts + 1))
                some = [i for i in range(parts) if edges[i] < edges[i + 1]]
                yield X.record_batch(bucket=pa.array(some, pa.int32()), rows=pa.array([_packed(table.slice(edges[i], edges[i + 1] - edges[i])) for i in some], pa.binary()))

    def add_up(table: pa.Table) -> pa.Table:
        rows = pa.concat_tables([pa.ipc.open_stream(x).read_all().cast(_PHRASES) for x in table["rows"].to_pylist()])
        sums = rows.group_by(["lang", "phrase", "words"]).aggregate([(c, "sum") for c in ("count", "left", "right")])
        return sums.select(["lang", "phrase", "words", "count_sum", "left_sum", "right_sum"]).rename_columns(_PHRASES.names)

    rows = indexed.withColumn("pairs", F.lit(None).cast("array<binary>")) if wanted is None else indexed.join(wanted, "shard", "left")
    emitted = rows.mapInArrow(enumerate_phrases, "bucket int, rows binary")
    return emitted.groupBy("bucket").applyInArrow(add_up, "lang string, phrase string, words int, count long, left long, right long")


_PHRASES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("count", pa.int64()), ("left", pa.int64()), ("right", pa.int64())])


def _packed(table: pa.Table) -> bytes:
    """Rows of one bucket, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _enumerated(text: np.ndarray, hashes: np.ndarray, pairs: list[bytes], longest: int):
    """Length, words, count, and occurrences with a word before and behind: all words, and phrases made of ``pairs`` only."""
    real = text != 0
    count, before, behind = (np.bincount(text[x], minlength=len(hashes)) for x in (real, real & np.roll(real, 1), real & np.roll(real, -1)))
    yield 1, np.arange(1, len(hashes))[:, None], count[1:], before[1:], behind[1:]
    if longest < 2:
        return
    # what no frequent pair covers leaves the text, and runs of frequent pairs become its pieces
    sorted_pairs = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, dtype=np.uint64) for x in pairs)]))
    at = np.flatnonzero(real[:-1] & real[1:])
    hashed = _pair_hash(hashes[text[at]], hashes[text[at + 1]])
    found = np.searchsorted(sorted_pairs, hashed)
    joined = np.zeros(len(text), dtype=bool)
    if len(sorted_pairs):
        joined[at[sorted_pairs[np.minimum(found, len(sorted_pairs) - 1)] == hashed]] = True
    kept = np.flatnonzero(joined | np.roll(joined, 1))
    if not len(kept):
        return
    to = np.arange(len(kept)) + 1 + np.concatenate([[0], np.cumsum(~joined[kept])[:-1]])
    size = int(to[-1]) + 2
    short, left, right = np.zeros(size, dtype=text.dtype), np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    short[to], left[to], right[to] = text[kept], real[kept - 1], real[kept + 1]
    index = TwoWay(short, longest, len(hashes), (left, right))
    level = index.to_left(index.single())
    for length in range(2, longest + 1):
        level = index.to_right(level) if length > 2 else level
        yield (length, level.words, level.count, *index.neighbours(level))


def collocations(counts: DataFrame, least: int = 10, inside_percent: int = 50) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score`` of the candidates among ``phrase_counts``.

    A phrase of two words or more with ``a >= least`` is a candidate.  The lowest score of
    all cuts in two counts, and the earliest cut among equal ones.  Candidates inside a
    longer one that has at least ``inside_percent`` of their count are dropped.
    """
    total = counts.where("words = 1").groupBy("lang").agg(F.sum("count").alias("n"))
    frequent = counts.where(F.col("count") >= least).select("lang", "phrase", "words", F.col("count").alias("a"))
    candidates = frequent.where("words > 1").withColumn("w", F.split("phrase", " "))

    longest = candidates.where("words > 2")
    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")))
    )
    covered = longest.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))

    # a very frequent word is part of many candidates: its count is copied SALTS times, they are dealt over the copies
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cuts = kept.select("lang", "phrase", "words", "a", "w", salt.alias("salt"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    side = lambda name, part: parts.select("lang", "salt", F.col("part").alias(part), F.col("f").alias(name))
    cut = (
        cuts.withColumns({"first": F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")})
        .drop("w")
        .join(side("l", "first"), ["lang", "salt", "first"])
        .join(side("r", "rest"), ["lang", "salt", "rest"])
    )
    # a is at most l and at most r, so the score is at most a million
    wide = "cast({} as decimal(38,0))".format
    score = F.expr(f"(1000000 * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.join(total, "lang").select("lang", "phrase", "words", "a", "b.l", "b.r", "n", "b.score")


def first_of_each(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best phrases of each language with their rank; a language's rows are first ranked in parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).drop("part")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 most associated phrases of two and three words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    counts = materialize(phrase_counts(docs).where("words = 1 or count >= 10"), "phrase-counts")
    found = first_of_each(collocations(counts), 2000)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
with texts as (
  select coalesce(lang, 'und') as lang,
         translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ',;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9), '......... ') as t
  from documents where text is not null
),
pieces as (select lang, unnest(string_split(t, '.')) as p from texts),
listed as (select lang, list_filter(string_split(p, ' '), lambda x: x <> '') as w from pieces),
sized as (select lang, w, len(w) as c from listed where len(w) > 0),
grams as (
  select lang, 1 as words, unnest(w) as phrase from sized
  union all
  select lang, 2, unnest(list_transform(range(1, c), lambda i: array_to_string(w[i:i+1], ' '))) from sized where c >= 2
  union all
  select lang, 3, unnest(list_transform(range(1, c - 1), lambda i: array_to_string(w[i:i+2], ' '))) from sized where c >= 3
),
f as (select lang, words, phrase, count(*) as a from grams group by all),
total as (select lang, sum(a) as n from f where words = 1 group by lang),
often as (select * from f where a >= 10),
cand as (select *, string_split(phrase, ' ') as w from often where words > 1),
inside as (
  select lang, part, max(a) as longer
  from (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part, a from cand where words = 3)
  group by all
),
kept as (
  select c.* from cand c left join inside i on c.lang = i.lang and c.phrase = i.part and c.words = 2
  where i.longer is null or 100 * i.longer < 50 * c.a
),
cuts as (select *, unnest(range(1, words)) as k from kept),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.a as l, y.a as r,
         (1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a) as score
  from cuts c
  join often x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
  join often y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k+1:c.words], ' ')
),
least_cut as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (
  select s.*, t.n, row_number() over (partition by s.lang order by score desc, a desc, phrase) as rank
  from least_cut s join total t on t.lang = s.lang
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked where rank <= 2000
"""
