"""Intervals, known regions and readable results."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    SQL_IT_UP, mined_orders_up, orders_cls, q9, query, r9, sql_with_metric, table,
)
from catalog.mining import RANGES, hier_edges, sql_hier
from catalog.trees import _PTREE, _part_trees
from subdiv.functions import intervals as V
from subdiv.functions import metrics as M
from subdiv.operators import regions as G
from subdiv.operators import report as P
from subdiv.operators import tree as T
from subdiv.plans import explore as E

# the price range of each priority (found) against a window around its average (true)
_PAIRS = """p AS (SELECT o_orderpriority AS prio, o_orderstatus AS st, avg(o_totalprice) - 60000 AS lo1, avg(o_totalprice) + 60000 AS hi1,
 min(o_totalprice) + 50000 AS lo2, avg(o_totalprice) + 20000 AS hi2 FROM orders GROUP BY o_orderpriority, o_orderstatus)"""


def _pairs(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("st")).agg(
        (F.avg(price) - 60000).alias("lo1"), (F.avg(price) + 60000).alias("hi1"),
        (F.min(price) + 50000).alias("lo2"), (F.avg(price) + 20000).alias("hi2"),
    )


def _b():
    return [F.col(c) for c in ("lo1", "hi1", "lo2", "hi2")]


_OV = "greatest(least(hi1, hi2) - greatest(lo1, lo2), 0)"


@query(
    "int1_relations_to_intervals",
    f"{_PTREE} SELECT CASE WHEN lo IS NULL THEN '<=' || hi::BIGINT WHEN hi IS NULL THEN '>=' || lo::BIGINT WHEN lo = hi THEN (lo::BIGINT)::VARCHAR ELSE '[' || lo::BIGINT || '-' || hi::BIGINT || ']' END AS item, coalesce(lo, (SELECT min(p_size) FROM prt0))::DOUBLE AS lo, coalesce(hi, (SELECT max(p_size) FROM prt0))::DOUBLE AS hi FROM nodes WHERE attr IS NOT NULL",
)
def int1(spark, d):
    trees = _part_trees(spark, d)
    ranges = trees.nodes().where("attr is not null").select("attr", "item", "lo", "hi")
    return G.close_bounds(ranges, trees.min_max()).select("item", "lo", "hi")


@query(
    "int2_overlaps",
    f"""WITH {_PAIRS} SELECT prio, st, {q9(_OV)} AS length, {q9(f'{_OV} / greatest(hi1 - lo1, hi2 - lo2)')} AS normalized,
CASE WHEN greatest(lo1, lo2) <= least(hi1, hi2) THEN {q9('greatest(lo1, lo2)')} END AS lo, CASE WHEN greatest(lo1, lo2) <= least(hi1, hi2) THEN {q9('least(hi1, hi2)')} END AS hi,
CASE WHEN hi1 BETWEEN lo2 AND hi2 THEN {q9('lo2')} END AS left_lo, CASE WHEN hi1 BETWEEN lo2 AND hi2 THEN {q9('hi2')} END AS right_hi FROM p""",
)
def int2(spark, d):
    lo1, hi1, lo2, hi2 = _b()
    point = V.point_overlap(hi1, hi1, lo2, hi2)
    common = V.overlap_interval(lo1, hi1, lo2, hi2)
    return _pairs(spark, d).select(
        "prio", "st", r9(V.overlap_length(lo1, hi1, lo2, hi2)).alias("length"),
        r9(V.overlap_normalized(lo1, hi1, lo2, hi2)).alias("normalized"),
        r9(common["lo"]).alias("lo"), r9(common["hi"]).alias("hi"),
        r9(point["left_lo"]).alias("left_lo"), r9(point["right_hi"]).alias("right_hi"),
    )


_PR, _RC = f"({_OV} / (hi2 - lo2))", f"({_OV} / (hi1 - lo1))"


@query(
    "int3_interval_scores",
    f"""WITH {_PAIRS} SELECT prio, st, {q9(_PR)} AS precision, {q9(_RC)} AS recall,
{q9(f'CASE WHEN {_PR} = 0 OR {_RC} = 0 THEN 0 ELSE 2 * ({_PR} * {_RC}) / ({_PR} + {_RC}) END')} AS f_measure FROM p""",
)
def int3(spark, d):
    args = _b()
    return _pairs(spark, d).select(
        "prio", "st", r9(V.precision(*args)).alias("precision"), r9(V.recall(*args)).alias("recall"),
        r9(V.f_measure(*args)).alias("f_measure"),
    )


_PATTERNS = [
    {"size": [[(">=", 10), ("<=", 20)]], "weight": [[(">=", 1)]]},
    {"size": [[(">=", 30)]]},
]
_F = "CASE WHEN ov <= 0 OR fhi = flo OR thi = tlo THEN 0 ELSE 2 * (ov / (fhi - flo)) * (ov / (thi - tlo)) / (ov / (fhi - flo) + ov / (thi - tlo)) END"
_INT4 = f"""{_PTREE}, t(pattern, attr, tlo, thi) AS (SELECT 0, 'size', 10.0::DOUBLE, 20.0::DOUBLE UNION ALL SELECT 0, 'weight', 1.0, NULL UNION ALL SELECT 1, 'size', 30.0, (SELECT max(p_size) FROM prt0)::DOUBLE),
fd AS (SELECT coalesce(lo, (SELECT min(p_size) FROM prt0))::DOUBLE AS flo, coalesce(hi, (SELECT max(p_size) FROM prt0))::DOUBLE AS fhi FROM nodes WHERE attr IS NOT NULL AND split IS NULL),
sc AS (SELECT pattern, attr, flo, fhi, least(thi, fhi) - greatest(tlo, flo) AS ov, tlo, thi FROM t, fd WHERE attr = 'size'),
fm AS (SELECT *, {_F} AS f FROM sc),
best AS (SELECT pattern, attr, flo, fhi, f FROM fm QUALIFY row_number() OVER (PARTITION BY pattern, attr ORDER BY f DESC, flo, fhi) = 1)"""


def _found(spark, d):
    trees = _part_trees(spark, d)
    found = trees.discretization_table("leaves").select("attr", "lo", "hi")
    true = G.close_bounds(G.region_table(spark, _PATTERNS), trees.min_max())
    return true, found


@query(
    "int4_best_intervals",
    f"{_INT4} SELECT t.pattern, t.attr, flo AS found_lo, fhi AS found_hi, {q9('coalesce(f, 0)')} AS f_measure FROM t LEFT JOIN best USING (pattern, attr)",
)
def int4(spark, d):
    best = G.best_intervals(*_found(spark, d))
    return best.select("pattern", "attr", "found_lo", "found_hi", r9("f_measure").alias("f_measure"))


@query(
    "int4_pattern_similarity",
    f"{_INT4} SELECT t.pattern, {q9('avg(coalesce(f, 0))')} AS similarity FROM t LEFT JOIN best USING (pattern, attr) GROUP BY t.pattern",
)
def int4_mean(spark, d):
    return G.pattern_similarity(*_found(spark, d)).select("pattern", r9("similarity").alias("similarity"))


_HIER = sql_hier(0.02)


def _hier_itemsets(spark, d):
    return E.explore_hierarchical(
        orders_cls(spark, d), ["acctbal", "nat", "seg"], RANGES, hier_edges(spark, d), 0.02, ["d_fpr"],
        true="cls", predicted="pred", classes={"N": 0, "P": 1},
    )


_RANGE_VALUES = "(VALUES ('<=2000.0', NULL, 2000.0), ('[2000.01-6000.0]', 2000.01, 6000.0), ('>=6000.01', 6000.01, NULL), ('>=2000.01', 2000.01, NULL)) rv(acctbal, lo, hi)"


@query(
    "int5_item_ranges",
    f"{_HIER} SELECT key, 'acctbal' AS attr, rv.lo::DOUBLE AS lo, rv.hi::DOUBLE AS hi FROM it JOIN {_RANGE_VALUES} USING (acctbal)",
)
def int5(spark, d):
    return G.itemset_ranges(_hier_itemsets(spark, d))


_SIM_F = "greatest(least(hi, 5000) - greatest(lo, 2500), 0)"


@query(
    "int6_itemset_similarity",
    f"""{_HIER}, mm AS (SELECT min(acctbal) mn, max(acctbal) mx FROM ord),
xx AS (SELECT key, coalesce(rv.lo, mn)::DOUBLE AS lo, coalesce(rv.hi, mx)::DOUBLE AS hi FROM it JOIN {_RANGE_VALUES} USING (acctbal), mm),
y AS (SELECT key, {_SIM_F} / (hi - lo) AS p, {_SIM_F} / 2500.0 AS r FROM xx)
SELECT it.key, 0 AS pattern, {q9('CASE WHEN coalesce(p, 0) = 0 OR r = 0 THEN 0 ELSE 2 * (p * r) / (p + r) END')} AS similarity FROM it LEFT JOIN y ON it.key = y.key""",
)
def int6(spark, d):
    true = G.region_table(spark, [{"acctbal": [[(">=", 2500), ("<=", 5000)]]}])
    found = _hier_itemsets(spark, d)
    bounds = T.min_max(orders_cls(spark, d), ["acctbal"])
    return G.itemset_similarity(found, true, bounds).select("key", "pattern", r9("similarity").alias("similarity"))


_EDGE_SQL = "e AS (SELECT o_orderpriority AS prio, list_sort(list(DISTINCT floor(o_totalprice / 100000))) AS edges FROM orders GROUP BY o_orderpriority)"


@query(
    "int7_edges_to_intervals",
    f"""WITH {_EDGE_SQL} SELECT prio, 'all' AS kind, edges[i] AS lo, edges[i + 1] AS hi FROM e, generate_series(1, 20) s(i) WHERE i < len(edges)
UNION ALL SELECT prio, 'pairs', edges[2 * i - 1], edges[2 * i] FROM e, generate_series(1, 20) s(i) WHERE 2 * i <= len(edges)""",
)
def int7(spark, d):
    bucket = F.floor(F.col("o_totalprice") / 100000).cast("double")
    e = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("prio")).agg(
        F.array_sort(F.collect_set(bucket)).alias("edges")
    )
    all_ = e.select("prio", F.lit("all").alias("kind"), F.explode(V.consecutive(F.col("edges"))).alias("i"))
    pairs = e.select("prio", F.lit("pairs").alias("kind"), F.explode(V.edge_pairs(F.col("edges"))).alias("i"))
    return all_.unionByName(pairs).select("prio", "kind", "i.lo", "i.hi")


# ------------------------------------------------------------------- reports

_ABBR = {"seg=": "s:", "NATION_": "N", "MIDDLE EAST": "ME"}
_ABBR_SQL = "replace(replace(replace(key, 'seg=', 's:'), 'NATION_', 'N'), 'MIDDLE EAST', 'ME')"
_D = sql_with_metric(SQL_IT_UP, ["fpr"])


@query("fmt1_itemset_text", f"{SQL_IT_UP} SELECT {_ABBR_SQL} AS itemset, support_count FROM it")
def fmt1(spark, d):
    return mined_orders_up(spark, d).select(P.itemset_text(F.col("itemset"), _ABBR).alias("itemset"), "support_count")


@query(
    "fmt2_printable_table",
    f"""{_D} SELECT {_ABBR_SQL} AS itemset, round_even(support, 2) AS sup, round_even(fpr, 3) AS fpr, CASE WHEN abs(d_fpr) < 5e-4 THEN 0.0 ELSE round_even(d_fpr, 3) END AS "Δ_fpr", support_count FROM d""",
)
def fmt2(spark, d):
    scored = M.with_divergence(mined_orders_up(spark, d), ["d_fpr"]).select(
        "itemset", "key", "support", "fpr", "d_fpr", "support_count"
    )
    out = P.printable(scored, _ABBR)
    return out.withColumn("Δ_fpr", F.when(F.abs("Δ_fpr") < 5e-4, F.lit(0.0)).otherwise(F.col("Δ_fpr")))


@query(
    "fmt3_setting_text",
    """SELECT name, CASE WHEN left(s, 2) IN ('q_', 'u_') THEN s ELSE replace(s, '_', ' ') END AS text, n FROM (
SELECT name, replace(replace(name, 'error', 'err'), 'click', 'q_click') AS s, n FROM (SELECT event_type || '_base' AS name, count(*)::BIGINT AS n FROM events GROUP BY event_type))""",
)
def fmt3(spark, d):
    names = table(spark, d, "events").groupBy(F.concat("event_type", F.lit("_base")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.select("name", P.setting_text(F.col("name"), {"error": "err", "click": "q_click"}).alias("text"), "n")
