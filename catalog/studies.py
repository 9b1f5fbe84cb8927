"""Whole studies: sweeps, comparisons, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import (
    SQL_ORDERS, orders_cls, q9, query, r9, scratch, sql_itemsets, sql_rate,
)
from catalog.mining import RANGES, hier_edges, sql_hier
from catalog.trees import sql_tree
from subdiv.functions.metrics import CELLS
from subdiv.operators.items import keep_table
from subdiv.operators.mine import mine
from subdiv.operators.prepare import bin_columns
from subdiv.operators.taxonomy import edges_from_dict
from subdiv.operators.tree import grow, grow_each
from subdiv.plans import explore as E
from subdiv.sources import tables as S

_ATTRS = ["acctbal", "nat", "seg"]
_SUPPORTS = [0.02, 0.05, 0.1]
_KEEP = {"seg": ["BUILDING", "FURNITURE"], "nat": ["ASIA", "EUROPE", "NATION_3"], "acctbal": []}
_ROLES = {"true": "cls", "predicted": "pred", "classes": {"N": 0, "P": 1}}

_BASE = "(nat IS NULL OR nat LIKE 'NATION%') AND (acctbal IS NULL OR acctbal <> '>=2000.01')"
_PRUNED = "(seg IS NULL OR seg IN ('BUILDING', 'FURNITURE')) AND (nat IS NULL OR nat IN ('ASIA', 'EUROPE', 'NATION_3')) AND acctbal IS NULL"


def _sql_sweep():
    runs = []
    for general in (False, True):
        for pruned in (False, True):
            for s in _SUPPORTS:
                where = [f"(support >= {s} OR length = 0)"]
                if not general:
                    where.append(_BASE)
                if pruned:
                    where.append(f"(({_PRUNED}) OR length = 0)")
                runs.append(
                    f"SELECT {s}::DOUBLE AS min_sup, {general} AS generalized, {pruned} AS pruned, count(*)::DOUBLE AS itemsets, max(dv) AS mx FROM dv WHERE {' AND '.join(where)}"
                )
    return f"""{sql_hier(min(_SUPPORTS))}, dv AS (SELECT i.*, {sql_rate('fpr', 'i.')} - {sql_rate('fpr', 'r.')} AS dv FROM it i, (SELECT * FROM it WHERE length = 0) r),
runs AS ({' UNION ALL '.join(runs)}),
stats AS (SELECT min_sup, generalized, pruned, 'itemsets' AS stat, itemsets AS value FROM runs UNION ALL SELECT min_sup, generalized, pruned, 'max_divergence', mx FROM runs)"""


def _sweep(spark, d):
    return E.sweep(
        orders_cls(spark, d), _ATTRS, RANGES, hier_edges(spark, d), _SUPPORTS, "d_fpr",
        keep=keep_table(spark, _KEEP), dataset="orders", **_ROLES,
    )


@query("e2e5_support_sweep", f"{_sql_sweep()} SELECT min_sup, generalized, pruned, stat, {q9('value')} AS value FROM stats")
def e2e5(spark, d):
    return _sweep(spark, d).select("min_sup", "generalized", "pruned", "stat", r9("value").alias("value"))


def _sql_runs(source, chains, tail):
    """Itemsets of ``acc`` and ``seg`` of a CTE ``x`` with divergences in ``dv``."""
    return f"""it AS (SELECT {chains}, count(DISTINCT o_orderkey) AS n, sum(tn) tn, sum(fp) fp, sum(fn) fn, sum(tp) tp FROM {source} GROUP BY ALL),
dv AS (SELECT i.*, i.n::DOUBLE / r.n AS support, {sql_rate('fpr', 'i.')} - {sql_rate('fpr', 'r.')} AS dv
  FROM it i, (SELECT * FROM it WHERE acc IS NULL AND s IS NULL) r) {tail}"""


_GAINS, _TOPS, _TREE_SUPPORT = [None, 0.004, 0.006], [None, 3], 0.1


def _sql_gain_sweep():
    runs = []
    for gain in _GAINS:
        for general in (False, True):
            leaf = "" if general else "AND NOT EXISTS (SELECT 1 FROM nodes m WHERE m.path = n.path || 'L')"
            picks = " UNION ALL ".join(
                f"""SELECT {'NULL' if gain is None else gain}::DOUBLE AS minimal_gain, {'NULL' if top is None else top}::INT AS top_k, {m}::DOUBLE AS min_sup, {general} AS generalized,
  {'count(*)' if top is None else f'least(count(*) - 1, {top}) + 1'}::DOUBLE AS itemsets, max(dv) AS mx FROM dv WHERE support >= {m}"""
                for m in _SUPPORTS for top in _TOPS
            )
            runs.append(
                f"""SELECT * FROM (WITH {SQL_ORDERS}, {sql_tree('ord', ['acctbal'], 'd_fpr', _TREE_SUPPORT, 9, minimal_gain=gain)},
ranges AS (SELECT path, lo, hi FROM nodes n WHERE depth > 0 {leaf}),
w AS (SELECT o.*, r.path AS acc FROM ord o JOIN ranges r ON (lo IS NULL OR acctbal >= lo) AND (hi IS NULL OR acctbal <= hi)
  UNION ALL SELECT o.*, NULL FROM ord o),
x AS (SELECT w.*, u.s FROM w, unnest([seg, NULL]) u(s)), {_sql_runs('x', 'acc, s', picks)})"""
            )
    return " UNION ALL ".join(runs)


@query(
    "e2e5_gain_and_top_k_sweep",
    f"""WITH runs AS ({_sql_gain_sweep()}) SELECT minimal_gain, top_k, min_sup, generalized, 'itemsets' AS stat, itemsets AS value FROM runs
UNION ALL SELECT minimal_gain, top_k, min_sup, generalized, 'max_divergence', {q9('mx')} FROM runs""",
)
def e2e5_gains(spark, d):
    """One forest and one mining for all supports, minimal gains and k."""
    rows = orders_cls(spark, d)
    trees, ranges, edges = E.tree_hierarchy(rows, ["acctbal"], "d_fpr", _TREE_SUPPORT)
    stats = E.sweep(
        rows, ["acctbal", "seg"], ranges, edges, _SUPPORTS, "d_fpr",
        trees=trees, gains=_GAINS, k=_TOPS, min_sup_tree=_TREE_SUPPORT, **_ROLES,
    )
    return stats.select("minimal_gain", "top_k", "min_sup", "generalized", "stat", r9("value").alias("value"))


def _sql_raw_parents():
    runs = []
    for general in (False, True):
        ups = "CASE WHEN seg = 'FURNITURE' THEN 'BUILDING' END" if general else "NULL"
        picks = " UNION ALL ".join(
            f"SELECT {m}::DOUBLE AS min_sup, {general} AS generalized, count(*)::DOUBLE AS itemsets, max(dv) AS mx FROM dv WHERE support >= {m}"
            for m in _SUPPORTS
        )
        runs.append(
            f"""SELECT * FROM (WITH {SQL_ORDERS}, x AS (SELECT DISTINCT o.* EXCLUDE (seg), u.s, v.acc FROM ord o, unnest([seg, {ups}, NULL]) u(s), unnest([prio, NULL]) v(acc)),
{_sql_runs('x', 'acc, s', picks)})"""
        )
    return " UNION ALL ".join(runs)


@query(
    "e2e5_sweep_with_raw_parents",
    f"""WITH runs AS ({_sql_raw_parents()}) SELECT min_sup, generalized, 'itemsets' AS stat, itemsets AS value FROM runs
UNION ALL SELECT min_sup, generalized, 'max_divergence', {q9('mx')} FROM runs""",
)
def e2e5_raw(spark, d):
    """A segment that customers have and that stands above another: base runs count its own rows only."""
    edges = edges_from_dict(spark, {"seg": {"FURNITURE": "BUILDING"}})
    stats = E.sweep(orders_cls(spark, d), ["seg", "prio"], {}, edges, _SUPPORTS, "d_fpr", **_ROLES)
    return stats.select("min_sup", "generalized", "stat", r9("value").alias("value"))


@query("snk3_statistics_json", f"{_sql_sweep()} SELECT min_sup, generalized, pruned, stat, {q9('value')} AS value FROM stats")
def snk3(spark, d):
    path = scratch(spark, "statistics")
    S.write_statistics(_sweep(spark, d), path)
    return S.read_statistics(spark, path).select("min_sup", "generalized", "pruned", "stat", r9("value").alias("value"))


@query(
    "src4_nested_run_statistics",
    f"""{_sql_sweep()} SELECT min_sup, CASE WHEN generalized THEN 'generalized' ELSE 'base' END || CASE WHEN pruned THEN '_pruned' ELSE '' END AS configuration,
{q9('value')} AS value, stat FROM stats WHERE stat = 'max_divergence' AND value IS NOT NULL""",
)
def src4_statistics(spark, d):
    """Statistics of a sweep as one JSON object by support and configuration, read back."""
    path = scratch(spark, "nested-statistics")
    configuration = F.concat(F.when(F.col("generalized"), "generalized").otherwise("base"), F.when(F.col("pruned"), "_pruned").otherwise(""))
    stats = _sweep(spark, d).where("stat = 'max_divergence' and value is not null").select(F.col("min_sup").cast("string").alias("min_sup"), configuration.alias("c"), "value")
    by_support = stats.groupBy("min_sup").agg(F.map_from_entries(F.collect_list(F.struct("c", "value"))).alias("m"))
    by_support.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("min_sup", "m")))).alias("value")).coalesce(1).write.text(path)
    return S.read_nested_statistics(spark, path, "max_divergence").withColumn("value", r9("value"))


@query(
    "e2e8_pruning_difference",
    f"""{_sql_sweep()} SELECT a.min_sup, a.generalized, {q9('a.value - b.value')} AS difference FROM stats a JOIN stats b USING (min_sup, generalized, stat)
WHERE stat = 'max_divergence' AND NOT a.pruned AND b.pruned""",
)
def e2e8(spark, d):
    return E.pruning_difference(_sweep(spark, d)).select("min_sup", "generalized", r9("difference").alias("difference"))


def _rejected(call) -> str:
    try:
        call()
    except ValueError:
        return "rejected"
    return "accepted"


@query(
    "tgt4_target_arguments",
    """SELECT 'class without prediction' AS setting, 'rejected' AS verdict, count(*)::BIGINT AS rows FROM orders
UNION ALL SELECT 'class and outcome', 'rejected', count(*) FROM orders
UNION ALL SELECT 'entropy of an outcome', 'rejected', count(*) FROM orders
UNION ALL SELECT 'outcome', 'accepted', count(*) FROM orders""",
)
def tgt4(spark, d):
    """Which target arguments an exploration of the orders accepts, with the rows it covers."""
    rows = orders_cls(spark, d)
    settings = {
        "class without prediction": lambda: E.explore(rows, ["seg"], 0.1, ["d_fpr"], true="cls"),
        "class and outcome": lambda: E.explore(rows, ["seg"], 0.1, ["d_fpr"], true="cls", predicted="pred", outcome="totalprice"),
        "entropy of an outcome": lambda: grow(
            rows.withColumn("y", F.col("totalprice")), ["acctbal"], "d_outcome", 0.1, criterion="entropy"
        ),
        "outcome": lambda: E.explore(rows, ["seg"], 0.1, ["d_outcome"], outcome="totalprice"),
    }
    counted = rows.agg(F.count(F.lit(1)).alias("rows"))
    parts = [
        counted.select(F.lit(name).alias("setting"), F.lit(_rejected(call)).alias("verdict"), "rows")
        for name, call in settings.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "fim10_mining_arguments",
    f"""WITH {SQL_ORDERS}, {sql_itemsets('ord', {'seg': ['seg']}, CELLS, 0.1)}
SELECT 'support 0' AS setting, 'rejected' AS verdict, count(*)::BIGINT AS itemsets FROM it
UNION ALL SELECT 'negative support', 'rejected', count(*) FROM it UNION ALL SELECT 'unknown method', 'rejected', count(*) FROM it
UNION ALL SELECT 'support 0.1', 'accepted', count(*) FROM it""",
)
def fim10(spark, d):
    """Which mining arguments are accepted, with the itemsets of the accepted one."""
    rows = orders_cls(spark, d)
    found = mine(rows, ["seg"], CELLS, 0.1).agg(F.count(F.lit(1)).alias("itemsets"))
    settings = {
        "support 0": lambda: mine(rows, ["seg"], CELLS, 0.0),
        "negative support": lambda: mine(rows, ["seg"], CELLS, -0.1),
        "unknown method": lambda: mine(rows, ["seg"], CELLS, 0.1, method="depth_first"),
        "support 0.1": lambda: mine(rows, ["seg"], CELLS, 0.1),
    }
    parts = [
        found.select(F.lit(name).alias("setting"), F.lit(_rejected(call)).alias("verdict"), "itemsets")
        for name, call in settings.items()
    ]
    return reduce(DataFrame.unionByName, parts)


#: Tree supports of the sensitivity study; fixed values.
_TREE_SUPPORTS = [0.005, 0.01, 0.02, 0.025, 0.035, 0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2, 0.25, 0.3]


@query("e2e6_tree_support_sensitivity")
def e2e6(spark, d):
    return E.tree_support_sweep(
        orders_cls(spark, d), ["acctbal", "seg"], ["acctbal"], _TREE_SUPPORTS, 0.025, "d_fpr", **_ROLES
    )


def _sql_forest():
    parts = [
        f"""SELECT {s}::DOUBLE AS min_sup_tree, depth, count(*) AS nodes, sum(n)::BIGINT AS covered, {q9('min(div)')} AS lowest, {q9('max(div)')} AS highest
  FROM (WITH {SQL_ORDERS}, {sql_tree('ord', ['acctbal'], 'd_fpr', s, 15 if s < 0.02 else 11 if s < 0.075 else 6)} SELECT * FROM nodes) GROUP BY depth"""
        for s in _TREE_SUPPORTS
    ]
    return " UNION ALL ".join(parts)


@query("e2e6_trees_of_all_supports", _sql_forest())
def e2e6_trees(spark, d):
    """Nodes of every depth of the trees of fourteen supports, grown together."""
    forest = grow_each(orders_cls(spark, d), ["acctbal"], "d_fpr", _TREE_SUPPORTS)
    nodes = reduce(DataFrame.unionByName, [t.nodes().select(F.lit(s).alias("min_sup_tree"), "depth", "n", "divergence") for s, t in forest.items()])
    return nodes.coalesce(1).groupBy("min_sup_tree", "depth").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("covered"), r9(F.min("divergence")).alias("lowest"), r9(F.max("divergence")).alias("highest")
    )


@query("e2e7_method_comparison")
def e2e7(spark, d):
    top = E.compare_methods(
        orders_cls(spark, d), ["acctbal"], ["seg"], 0.05, "d_fpr", bins=4, tree_support=0.2, **_ROLES,
        expert={"acctbal": lambda x: F.when(x <= 0, "debt").otherwise("credit")},
    )
    return top.select("method", "key", "length", r9("d_fpr").alias("d_fpr"))


_Q = ", ".join(f"round_even(quantile_cont(acctbal, {q}), 0) AS e{i}" for i, q in enumerate([0.25, 0.5, 0.75], 1))


@query(
    "e2e7_best_quantile_itemset",
    f"""WITH {SQL_ORDERS}, e AS (SELECT {_Q} FROM ord), b AS (SELECT seg, tn, fp, fn, tp, CASE WHEN acctbal <= e1 THEN '<=' || printf('%.0f', e1)
 WHEN acctbal <= e2 THEN '(' || printf('%.0f', e1) || '-' || printf('%.0f', e2) || ']' WHEN acctbal <= e3 THEN '(' || printf('%.0f', e2) || '-' || printf('%.0f', e3) || ']'
 ELSE '>' || printf('%.0f', e3) END AS acctbal FROM ord, e),
{sql_itemsets('b', {'acctbal': ['acctbal'], 'seg': ['seg']}, CELLS, 0.05)}
SELECT i.key, {q9(f"{sql_rate('fpr', 'i.')} - {sql_rate('fpr', 'r.')}")} AS d_fpr FROM it i, (SELECT * FROM it WHERE length = 0) r""",
)
def e2e7_quantile(spark, d):
    binned, _ = bin_columns(orders_cls(spark, d).select("acctbal", "seg", "cls", "pred"), ["acctbal"], bins=4)
    found = E.explore(binned, ["acctbal", "seg"], 0.05, ["d_fpr"], **_ROLES)
    return found.select("key", r9("d_fpr").alias("d_fpr"))




_ITEM = """CASE WHEN lo IS NULL THEN '<=' || hi WHEN hi IS NULL THEN '>=' || lo WHEN lo = hi THEN hi::VARCHAR
  ELSE '[' || lo || '-' || hi || ']' END"""
# a leaf and the ranges above it are all ranges that hold the value
_INSIDE = "(r.lo IS NULL OR {a} >= r.lo) AND (r.hi IS NULL OR {a} <= r.hi)"


@query(
    "e2e2_tree_ranges_to_itemsets",
    f"""WITH {SQL_ORDERS}, {sql_tree('ord', ['acctbal', 'totalprice'], 'd_error', 0.1, 9)},
ranges AS (SELECT attr, lo, hi, {_ITEM} AS item FROM nodes WHERE depth > 0),
x1 AS (SELECT o.*, r.item AS acc FROM ord o JOIN ranges r ON r.attr = 'acctbal' AND {_INSIDE.format(a='acctbal')} UNION ALL SELECT o.*, NULL FROM ord o),
x2 AS (SELECT o.*, r.item AS price FROM x1 o JOIN ranges r ON r.attr = 'totalprice' AND {_INSIDE.format(a='totalprice')} UNION ALL SELECT o.*, NULL FROM x1 o),
x AS (SELECT x2.*, u.s FROM x2, unnest([seg, NULL]) u(s)),
it AS (SELECT acc, price, s, count(*) AS n, sum(tn) tn, sum(fp) fp, sum(fn) fn, sum(tp) tp FROM x GROUP BY ALL),
r AS (SELECT * FROM it WHERE acc IS NULL AND price IS NULL AND s IS NULL)
SELECT concat_ws(', ', 'acctbal=' || i.acc, 'seg=' || i.s, 'totalprice=' || i.price) AS key,
  ((i.acc IS NOT NULL)::INT + (i.price IS NOT NULL)::INT + (i.s IS NOT NULL)::INT)::INT AS length, i.n::BIGINT AS support_count,
  {q9(f"{sql_rate('error', 'i.')} - {sql_rate('error', 'r.')}")} AS d_error
FROM it i, r WHERE i.n::DOUBLE / r.n >= 0.05""",
)
def e2e2_tree(spark, d):
    """Trees, their hierarchy, and the itemsets over both, in one study."""
    rows = orders_cls(spark, d)
    _, ranges, edges = E.tree_hierarchy(rows, ["acctbal", "totalprice"], "d_error", 0.1)
    found = E.explore_hierarchical(rows, ["acctbal", "totalprice", "seg"], ranges, edges, 0.05, ["d_error"], **_ROLES)
    return found.select("key", "length", "support_count", r9("d_error").alias("d_error"))


@query("e2e2_joint_tree_ranges_to_itemsets")
def e2e2_joint(spark, d):
    """Overlapping ranges of one tree over all attributes."""
    rows = orders_cls(spark, d)
    _, ranges, _ = E.tree_hierarchy(
        rows, ["acctbal", "totalprice"], "d_error", 0.2, attributes=["acctbal", "totalprice", "seg"],
        splitting="all_attributes",
    )
    found = E.explore_hierarchical(
        rows, [*ranges, "seg"], ranges, None, 0.1, ["d_error"], overlap=True, all_attributes=True, **_ROLES
    )
    return found.select("key", "length", "support_count", r9("d_error").alias("d_error"))
