"""Embedding near-duplicates: exact threshold pairs by dual traversal of a cover tree.

Equal vectors of one label count as one point with their number as weight.  The upper
levels of the tree are tables: a place with more than LEAF points gets a net of centers
from a bounded sample of it, all its points go to their nearest center in groups of
bounded size, and the radius that covers each new place is measured.  Places of at most
LEAF points become blocks with a cover tree of their own (``cover_tree``).  The dual
traversal opens pairs of places level by level: pairs too far apart go, pairs that lie
close enough as a whole are counted as a whole, and what is left are pairs of blocks, each
traversed in its own task.  Tasks return weights and a spanning forest of what they link,
never the pairs themselves, so a large group of copies costs no square of its size.

Vectors are compared with others of the same label and number of components; every cosine
that is not settled by a bound with room to spare is computed in double precision.  Null
labels, null, empty or zero vectors, and null, NaN or infinite components link with nothing:
no links, their own component, kept.  Rows that repeat are vectors of their own, linked
with each other; of a component the rows with its smallest id are kept.  Rows without an id
take part, but name no component: theirs is that of the smallest id they reach, else null,
and then they are kept.  Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.llm import text as X
from subdiv.llm.cover_tree import SLACK, CoverTree, distance, level_radius, traverse
from subdiv.llm.ngram_join import components
from subdiv.session import materialize

#: Points of a block; points of a place from which its centers are drawn, about; most centers of a place; points that one task assigns.
LEAF, SAMPLE, FANOUT, SHARE = 2048, 384, 64, 8192


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, place, unit``; place names label and number of components, both null where a row links with nothing."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    largest = F.array_max(F.transform("x", F.abs))
    ok = F.col("label").isNotNull() & (F.size("x") > 0) & fine & (largest > 0)
    return (
        rows.select("vec_id", "label", x.alias("x"))
        .select("vec_id", "label", F.when(ok, F.transform("x", lambda v: v / largest)).alias("y"))
        .withColumn("norm", F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, v: s + v * v)))
        .select(
            "vec_id",
            F.when(F.col("y").isNotNull(), F.concat(F.col("label").cast("string"), F.lit(":"), F.size("y").cast("string"))).alias("place"),
            F.transform("y", lambda v: v / F.col("norm")).alias("unit"),
        )
    )


def _net(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Centers of a place from its sample: farthest first, while they are more than the level's radius apart."""
    place, size = (k.as_py() for k in key)
    order = np.argsort(table["node"].to_numpy())
    x = _matrix(table["unit"])[order]
    most = int(min(FANOUT, max(2, -(-2 * size // LEAF))))
    near = distance(x[:1], x)[0]
    chosen, spread = [0], float(near.max())
    if spread > SLACK:
        radius = level_radius(spread)
        while len(chosen) < most and near.max() > radius:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distance(x[chosen[-1] :][:1], x)[0])
    else:  # all in one spot: the place is cut by hash
        chosen = [0] * most
    return pa.table({"place": [place] * len(chosen), "child": pa.array(range(len(chosen)), pa.int32()), "center": pa.array(x[chosen].tolist(), pa.list_(pa.float64()))})


def _assign(points: pa.Table, centers: pa.Table) -> pa.Table:
    schema = {"node": pa.int64(), "copies": pa.int64(), "unit": pa.list_(pa.float64()), "place": pa.string(), "far": pa.float64()}
    if not points.num_rows or not centers.num_rows:
        return pa.table({k: pa.array([], t) for k, t in schema.items()})
    x, c = _matrix(points["unit"]), _matrix(centers["center"])
    child, number = centers["child"].to_numpy(), points["node"].to_numpy()
    far = distance(x, c)
    pick = far.argmin(axis=1)
    if distance(c[:1], c).max() <= SLACK:
        pick = (X.mix(number.astype(np.uint64)) % np.uint64(len(c))).astype(np.int64)
    places = [f"{points['place'][0].as_py()}/{k}" for k in child.tolist()]
    return pa.table(
        {
            "node": points["node"], "copies": points["copies"], "unit": points["unit"],
            "place": pa.array([places[i] for i in pick], pa.string()), "far": far[np.arange(len(x)), pick],
        }
    )


def _block(table: pa.Table) -> pa.Table:
    """A place's points with their cover tree, around the point nearest to their mean."""
    order = np.argsort(table["node"].to_numpy())
    x = _matrix(table["unit"])[order]
    middle = int(np.argmax(x @ x.mean(axis=0)))
    order = np.concatenate([order[middle : middle + 1], np.delete(order, middle)])
    x = _matrix(table["unit"])[order]
    ids, copies, tree = table["node"].to_numpy()[order], table["copies"].to_numpy()[order], CoverTree.of(x)
    return pa.table(
        {
            "place": [table["place"][0].as_py()], "weight": pa.array([int(copies.sum())], pa.int64()), "first": pa.array([int(ids.min())], pa.int64()),
            "center": pa.array([x[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([float(tree.radius[0])]),
            "block": pa.array([pickle.dumps((ids, copies, x, tree), protocol=5)], pa.binary()),
        }
    )


def _linked(cosine: float):
    """Task over one pair of blocks: weight linked to each point, and the smallest point it is connected with here."""

    def run(key: tuple[pa.Scalar, ...], one: pa.Table, other: pa.Table) -> pa.Table:
        a, b = (pickle.loads(t.column(2)[0].as_py()) for t in (one, other))
        found = traverse(a[3], a[2], b[3], b[2], a[1], b[1], cosine)
        self_pair = key[0].as_py() == key[1].as_py()
        ids, roots = np.concatenate([a[0], b[0]]), found.groups()
        linked = np.concatenate([found.counts(0), found.counts(1)])
        if self_pair:
            linked[len(a[0]) :] = 0  # the same points again
        some = np.flatnonzero(linked)
        return pa.table({"node": ids[some], "linked": linked[some], "root": ids[roots[some]]})

    return run


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def upper_tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Points with the place of at most LEAF points they end in, and the places above: ``place, parent, center, radius``."""
    points, done, inner = nodes.select("node", "copies", "unit", "place"), [], None
    while True:
        sized = points.groupBy("place").agg(F.count("*").alias("size"))
        opened = materialize(sized.where(F.col("size") > LEAF), "open-places")
        if not opened.limit(1).count():
            return _union([*done, points]), inner
        done.append(points.join(opened, "place", "left_anti"))
        large = points.join(opened, "place")
        at = F.xxhash64("node").cast("double") / 2.0**64 + 0.5
        sample = large.where(at < F.lit(float(SAMPLE)) / F.col("size"))
        centers = materialize(sample.select("place", "size", "node", "unit").groupBy("place", "size").applyInArrow(_net, "place string, child int, center array<double>"), "centers")
        parts = F.ceil(F.col("size") / SHARE).cast("int")
        dealt = large.select("node", "copies", "unit", "place", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
        copies = centers.join(opened, "place").select("place", "child", "center", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        assigned = dealt.groupBy("place", "part").cogroup(copies.groupBy("place", "part")).applyInArrow(_assign, "node long, copies long, unit array<double>, place string, far double")
        assigned = materialize(assigned, "assigned-points")
        name = F.concat_ws("/", F.col("place"), F.col("child").cast("string"))
        radius = assigned.groupBy("place").agg(F.max("far").alias("radius"))
        level = centers.select(name.alias("place"), F.col("place").alias("parent"), "center").join(radius, "place")
        inner = level if inner is None else inner.unionByName(level)
        points = assigned.drop("far")


def place_pairs(blocks: DataFrame, inner: DataFrame | None, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Dual traversal of the upper levels: pairs ``a, b`` linked as a whole, and pairs of blocks still to be compared."""
    reach = float(np.sqrt(2 - 2 * cosine))
    leaves = blocks.select("place", "center", "radius")
    root = F.split("place", "/")[0]
    # what a place opens to: its children, or itself if it is a block
    down = leaves.select("place", F.col("place").alias("child"), "center", "radius", F.lit(True).alias("leaf"))
    if inner is not None:
        above = inner.join(leaves.select("place"), "place", "left_anti").select(F.col("parent").alias("place"), F.col("place").alias("child"), "center", "radius", F.lit(False).alias("leaf"))
        last = inner.select("place", "parent").join(leaves, "place").select(F.col("parent").alias("place"), F.col("place").alias("child"), "center", "radius", F.lit(True).alias("leaf"))
        down = down.unionByName(above).unionByName(last)
    down = materialize(down, "tree-edges")
    pairs = leaves.select(root.alias("a")).distinct().select("a", F.col("a").alias("b"))
    whole, blockwise = [], []
    while True:
        side = lambda s: down.select(F.col("place").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("child", "center", "radius", "leaf")])
        dot = F.aggregate(F.zip_with("center_a", "center_b", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        apart = F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))
        both = F.col("radius_a") + F.col("radius_b")
        opened = (
            pairs.join(side("a"), "a")
            .join(side("b"), "b")
            .where((F.col("a") != F.col("b")) | (F.col("child_a") <= F.col("child_b")))
            .withColumns({"apart": apart, "both": both})
            .where(F.col("apart") - F.col("both") <= reach + SLACK)
            .select(F.col("child_a").alias("a"), F.col("child_b").alias("b"), (F.col("apart") + F.col("both") < reach - SLACK).alias("inside"), (F.col("leaf_a") & F.col("leaf_b")).alias("leaves"))
        )
        opened = materialize(opened, "place-pairs")
        whole.append(opened.where("inside").select("a", "b"))
        blockwise.append(opened.where("not inside and leaves").select("a", "b"))
        pairs = opened.where("not inside and not leaves").select("a", "b")
        if not pairs.limit(1).count():
            return _union(whole), _union(blockwise)


def near_vectors(rows: DataFrame, cosine: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for ``rows(vec_id, embedding, label)``."""
    # two hashes name a vector, so that no column of vectors is compared or joined
    named = unit_vectors(rows).withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit")})
    named = materialize(named.withColumn("vec_id", F.col("vec_id").cast("long")), "unit-vectors")
    valid = named.where("unit is not null")
    key = ["place", "h1", "h2"]
    nodes = valid.groupBy(*key).agg(F.first("unit").alias("unit"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")

    points, inner = upper_tree(nodes)
    block_schema = "place string, weight long, first long, center array<double>, radius double, block binary"
    blocks = materialize(points.groupBy("place").applyInArrow(_block, block_schema), "vector-blocks")
    whole, blockwise = place_pairs(blocks, inner, cosine)
    blockwise = materialize(blockwise, "block-pairs")
    side = lambda s: blockwise.join(blocks.select(F.col("place").alias(s), "block"), s).select(*[F.col(c).alias(f"{c}_{s}") for c in ("a", "b", "block")]).groupBy(f"a_{s}", f"b_{s}")
    compared = materialize(side("a").cogroup(side("b")).applyInArrow(_linked(cosine), "node long, linked long, root long"), "block-links")

    # what pairs of whole places add goes down to their blocks by the names of the places above these
    steps = F.split("place", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    under = materialize(blocks.select("place", "weight", "first", F.explode(above).alias("over")), "blocks-under")
    facts = under.groupBy("over").agg(F.sum("weight").alias("weight"), F.min("first").alias("first"))
    of = lambda s: facts.select(F.col("over").alias(s), F.col("weight").alias(f"weight_{s}"), F.col("first").alias(f"first_{s}"))
    together = materialize(whole.join(of("a"), "a").join(of("b"), "b"), "whole-places")
    gained = together.select(F.col("a").alias("over"), F.col("weight_b").alias("linked")).unionByName(together.where("a <> b").select(F.col("b").alias("over"), F.col("weight_a").alias("linked")))
    by_block = gained.groupBy("over").agg(F.sum("linked").alias("linked")).join(under, "over").groupBy("place").agg(F.sum("linked").alias("linked"), F.min("first").alias("first"))
    in_block = points.select("node", "place").join(by_block, "place").select("node", "linked", F.col("first").alias("root"))
    linked = compared.unionByName(in_block)
    totals = linked.groupBy("node").agg((F.sum("linked") - 1).alias("n_links"))

    reached = together.select(F.col("a").alias("over"), F.col("first_a").alias("top")).unionByName(together.select(F.col("b").alias("over"), F.col("first_b").alias("top"))).distinct()
    edges = (
        linked.select(F.col("node").alias("a"), F.col("root").alias("b"))
        .unionByName(under.join(reached, "over").select(F.col("first").alias("a"), F.col("top").alias("b")))
        .unionByName(together.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))
    )
    roots = components(edges)
    rooted = nodes.select(*key, "node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    facts_of_node = rooted.join(least, "root").join(totals, "node").select(*key, "n_links", "component_id")
    found = valid.select("vec_id", *key).join(facts_of_node, key).select("vec_id", "n_links", "component_id")
    alone = named.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.93."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"), 0.93)


OP11_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as x, len(embedding) as d from embeddings
),
u as (
  select vec_id, label, x, d from v
  where vec_id is not null and label is not null and x is not null and d > 0
    and len(list_filter(x, lambda e: e is null or isnan(e) or isinf(e))) = 0
    and len(list_filter(x, lambda e: e <> 0)) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from u a join u b
    on a.label = b.label and a.d = b.d and a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.93
),
reach(id, seen) as (
  select vec_id, vec_id from u
  union
  select r.id, l.b from reach r join links l on l.a = r.seen
),
c as (select id, min(seen) as component_id from reach group by id),
n as (select a as id, count(*) as n from links group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.component_id, v.vec_id)::bigint as component_id,
       v.vec_id = coalesce(c.component_id, v.vec_id) as kept
from v left join c on c.id = v.vec_id left join n on n.id = v.vec_id
"""
