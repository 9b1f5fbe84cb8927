"""Ranges, taxonomies and admission of items."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from catalog.base import (
    SQL_ORDERS, SUP, nation_edges, nation_region, orders_cls, q9, query, r9, sql_itemsets, sql_rate, table,
)
from catalog.mining import RANGES, _ACC, hier_edges
from subdiv.functions.metrics import CELLS
from subdiv.operators import items as I
from subdiv.operators import taxonomy as X
from subdiv.operators.mine import mine
from subdiv.session import small_table

GAPS = {
    "acctbal": {
        "<=0.0": {"rels": ["<="], "vals": [0.0]},
        "[1000.0-3000.0]": {"rels": [">=", "<="], "vals": [1000.0, 3000.0]},
        ">=5000.0": {"rels": [">="], "vals": [5000.0]},
    }
}
_KEY = "o_orderkey"


@query("itm1_leaf_ranges", f"WITH {SQL_ORDERS} SELECT o_orderkey, {_ACC} AS acctbal FROM ord")
def itm1(spark, d):
    return I.discretize_ranges(orders_cls(spark, d).select(_KEY, "acctbal"), RANGES)


@query(
    "itm1_gap_values_to_the_left",
    f"""WITH {SQL_ORDERS} SELECT o_orderkey, CASE WHEN acctbal <= 0 THEN '<=0.0' WHEN acctbal < 1000 THEN '<=0.0' WHEN acctbal < 5000 THEN '[1000.0-3000.0]' ELSE '>=5000.0' END AS acctbal FROM ord""",
)
def itm1_gap(spark, d):
    return I.discretize_ranges(orders_cls(spark, d).select(_KEY, "acctbal"), GAPS, unmatched="closest_left")


_MANY = {"price": {}}
_EDGES = list(range(0, 500000, 10000))
for _lo in _EDGES:
    _MANY["price"][f"[{_lo}-{_lo + 9999}]"] = {"rels": [">=", "<="], "vals": [float(_lo), _lo + 9999.99]}


@query(
    "itm1_many_ranges",
    "SELECT o_orderkey, '[' || (floor(o_totalprice / 10000)::BIGINT * 10000) || '-' || (floor(o_totalprice / 10000)::BIGINT * 10000 + 9999) || ']' AS price FROM orders",
)
def itm1_many(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return I.discretize_ranges(o, _MANY)


_OVER = {
    "acctbal": {
        "<=2000": {"rels": ["<="], "vals": [2000.0]},
        ">=1000": {"rels": [">="], "vals": [1000.0]},
    }
}


@query(
    "itm2_overlapping_ranges",
    f"""WITH {SQL_ORDERS} SELECT o_orderkey, concat_ws('|', CASE WHEN acctbal <= 2000 THEN '<=2000' END, CASE WHEN acctbal >= 1000 THEN '>=1000' END) AS ranges,
(acctbal <= 2000)::INT AS low, (acctbal >= 1000)::INT AS high FROM ord""",
)
def itm2(spark, d):
    rows = orders_cls(spark, d).select(_KEY, "acctbal")
    arrays = I.discretize_overlapping(rows, _OVER).select(_KEY, F.array_join("acctbal", "|").alias("ranges"))
    flags = I.range_flags(rows, _OVER).select(
        _KEY, F.col("`acctbal=<=2000`").alias("low"), F.col("`acctbal=>=1000`").alias("high")
    )
    return arrays.join(flags, _KEY)


@query("itm3_ranges_in_column_order", f"WITH {SQL_ORDERS} SELECT o_orderkey, seg, {_ACC} AS acctbal, nat FROM ord")
def itm3(spark, d):
    return I.discretize_ranges(orders_cls(spark, d).select(_KEY, "seg", "acctbal", "nat"), RANGES)


@query(
    "itm4_items",
    f"WITH {SQL_ORDERS} SELECT o_orderkey, 'seg' AS attr, 'seg=' || seg AS item FROM ord UNION ALL SELECT o_orderkey, 'nat', 'nat=' || nat FROM ord",
)
def itm4(spark, d):
    rows = I.itemize(orders_cls(spark, d).select(_KEY, "seg", "nat"), ["seg", "nat"])
    return rows.select(_KEY, F.explode("items").alias("i")).select(_KEY, "i.attr", "i.item")


@query(
    "itm4_one_hot_counts",
    f"WITH {SQL_ORDERS} SELECT 'seg=' || seg AS item, count(*)::BIGINT AS n FROM ord GROUP BY seg UNION ALL SELECT 'prio=' || prio, count(*) FROM ord GROUP BY prio",
)
def itm4_matrix(spark, d):
    matrix = I.one_hot(orders_cls(spark, d).select("seg", "prio"), ["seg", "prio"])
    sums = matrix.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in matrix.columns])
    pairs = [F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").alias("n")) for c in matrix.columns]
    return sums.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


_SQL_EDGES = """e AS (SELECT DISTINCT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT DISTINCT r_name, 'WORLD' FROM region JOIN nation ON n_regionkey = r_regionkey)"""


@query(
    "itm5_taxonomy_levels",
    f"WITH {_SQL_EDGES} SELECT 'nat' AS attr, child, parent, CASE WHEN parent = 'WORLD' THEN 2 ELSE 1 END AS level FROM e",
)
def itm5(spark, d):
    return X.levels(nation_edges(spark, d))


@query(
    "itm6_taxonomy_closure",
    f"""WITH RECURSIVE {_SQL_EDGES}, c AS (SELECT child AS leaf, parent AS item FROM e UNION SELECT c.leaf, e.parent FROM c JOIN e ON e.child = c.item)
SELECT 'nat' AS attr, leaf, item FROM c""",
)
def itm6(spark, d):
    return X.closure(nation_edges(spark, d))


@query(
    "itm6_closure_of_present_values",
    f"""WITH RECURSIVE {_SQL_EDGES}, p AS (SELECT DISTINCT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000),
c AS (SELECT child AS leaf, parent AS item FROM e JOIN p ON child = n_name UNION SELECT c.leaf, e.parent FROM c JOIN e ON e.child = c.item)
SELECT 'nat' AS attr, leaf, item FROM c""",
)
def itm6_present(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000")
    names = s.join(nation_region(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
    leaves = names.select(F.lit("nat").alias("attr"), F.col("n_name").alias("leaf"))
    return X.closure(nation_edges(spark, d), leaves)


@query(
    "itm7_rows_with_generalized_items",
    f"WITH {SQL_ORDERS} SELECT o_orderkey, seg, unnest([nat, reg, 'WORLD']) AS nat FROM ord",
)
def itm7(spark, d):
    closed = X.closure(nation_edges(spark, d))
    rows = I.extend_items(orders_cls(spark, d).select(_KEY, "seg", "nat"), closed, "nat")
    return rows.select(_KEY, "seg", F.explode("nat").alias("nat"))


@query(
    "itm8_one_item_per_attribute",
    f"""WITH {SQL_ORDERS}, {sql_itemsets('ord', {'nat': ['nat', 'reg', "'WORLD'"], 'seg': ['seg']}, CELLS, SUP)}
SELECT key, (nat IS NOT NULL)::INT AS nat_items, (seg IS NOT NULL)::INT AS seg_items FROM it""",
)
def itm8(spark, d):
    closed = X.closure(nation_edges(spark, d))
    found = mine(orders_cls(spark, d), ["seg", "nat"], CELLS, SUP, closure=closed, method="level_wise")
    count = lambda a: F.size(F.filter("itemset", lambda i: i.startswith(f"{a}=")))
    return found.select("key", count("nat").alias("nat_items"), count("seg").alias("seg_items"))


_KEEP_PRIO = ["1-URGENT", "2-HIGH"]


@query(
    "itm9_preserved_values",
    f"""WITH {SQL_ORDERS}, o2 AS (SELECT seg, CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN prio END AS prio, tn, fp, fn, tp FROM ord)
SELECT concat_ws(', ', 'prio=' || p, 'seg=' || s) AS key, count(*) AS n FROM (SELECT DISTINCT rid, up.v AS p, us.v AS s
FROM (SELECT *, row_number() OVER () AS rid FROM o2), unnest([prio, NULL]) up(v), unnest([seg, NULL]) us(v)) GROUP BY p, s
HAVING count(*)::DOUBLE / (SELECT count(*) FROM ord) >= {SUP}""",
)
def itm9(spark, d):
    rows = I.preserve_values(orders_cls(spark, d), {"prio": _KEEP_PRIO})
    return mine(rows, ["seg", "prio"], CELLS, SUP).select("key", F.col("support_count").alias("n"))


@query(
    "itm10_admitted_items",
    f"""WITH {SQL_ORDERS}, {sql_itemsets('ord', {'nat': ['nat', 'reg', "'WORLD'"], 'seg': ['seg'], 'prio': ['prio']}, CELLS, SUP)}
SELECT key, support_count FROM it WHERE (prio IS NULL OR prio IN ('1-URGENT', '2-HIGH')) AND (nat IS NULL OR nat IN ('ASIA', 'NATION_3'))""",
)
def itm10(spark, d):
    keep = I.keep_table(spark, {"prio": _KEEP_PRIO, "nat": ["ASIA", "NATION_3"]})
    closed = X.closure(nation_edges(spark, d))
    found = mine(orders_cls(spark, d), ["seg", "prio", "nat"], CELLS, SUP, closure=closed, keep=keep)
    return found.select("key", "support_count")


@query(
    "itm10_admitted_item_counts",
    f"""WITH {SQL_ORDERS} SELECT 'seg' AS attr, seg AS item, count(*)::BIGINT AS n FROM ord GROUP BY seg
UNION ALL SELECT 'prio', prio, count(*) FROM ord WHERE prio IN ('1-URGENT', '2-HIGH') GROUP BY prio""",
)
def itm10_counts(spark, d):
    keep = I.keep_table(spark, {"prio": _KEEP_PRIO})
    return I.admitted_only(orders_cls(spark, d), ["seg", "prio"], keep)


def _sql_single(attrs, metric):
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS attr, {a} AS item, sum(tn) tn, sum(fp) fp, sum(fn) fn, sum(tp) tp FROM ord GROUP BY {a}" for a in attrs
    )
    return f"""WITH {SQL_ORDERS}, s AS ({parts}), r AS (SELECT sum(tn) tn, sum(fp) fp, sum(fn) fn, sum(tp) tp FROM ord),
d AS (SELECT attr, item, {sql_rate(metric, 's.')} - {sql_rate(metric, 'r.')} AS d FROM s, r)
SELECT attr, item, {q9('d')} AS d_{metric} FROM d WHERE d > 0"""


@query("itm11_divergent_categories", _sql_single(["seg", "prio", "nat"], "fpr"))
def itm11(spark, d):
    found = I.divergent_values(orders_cls(spark, d), ["seg", "prio", "nat"], "d_fpr", CELLS)
    return found.select("attr", "item", r9("d_fpr").alias("d_fpr"))


@query(
    "itm11_divergent_categories_outcome",
    f"""WITH s AS (SELECT event_type AS item, sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS m FROM events GROUP BY event_type),
r AS (SELECT sum(value::DECIMAL(18,2))::DOUBLE / count(*) AS m FROM events)
SELECT 'etype' AS attr, item, {q9('s.m - r.m')} AS d_outcome FROM s, r WHERE s.m - r.m > 0""",
)
def itm11_outcome(spark, d):
    from catalog.base import events_outcome

    found = I.divergent_values(events_outcome(spark, d), ["etype"], "d_outcome", ["y", "y2"])
    return found.select("attr", "item", r9("d_outcome").alias("d_outcome"))


@query(
    "itm13_taxonomy_from_wide_table",
    """SELECT DISTINCT 'nat' AS attr, CASE WHEN n_name LIKE '%NATION_1%' THEN 'ONES' ELSE n_name END AS child, r AS parent
FROM (SELECT n_name, CASE WHEN n_name LIKE '%NATION_1%' THEN 'AMERICA' ELSE r_name END AS r FROM nation JOIN region ON n_regionkey = r_regionkey)
UNION SELECT DISTINCT 'nat', CASE WHEN n_name LIKE '%NATION_1%' THEN 'AMERICA' ELSE r_name END, 'WORLD' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT 'nat', 'ATLANTIS', 'WORLD'""",
)
def itm13(spark, d):
    """Nations whose name contains NATION_1 collapse to one child of AMERICA."""
    nr = nation_region(spark, d)
    region = F.when(F.col("n_name").contains("NATION_1"), "AMERICA").otherwise(F.col("r_name"))
    wide = nr.select("n_name", region.alias("region"), F.lit(None).cast("string").alias("blank"), F.lit("WORLD").alias("world"))
    return X.from_wide(wide, "nat", ["n_name", "region", "blank", "world"], collapse={"NATION_1": "ONES"}, extra={"ATLANTIS": "WORLD"})


@query(
    "itm14_taxonomy_from_prefix",
    "SELECT DISTINCT 'o_orderpriority' AS attr, o_orderpriority AS child, split_part(o_orderpriority, '-', 1) AS parent FROM orders WHERE contains(o_orderpriority, '-')",
)
def itm14(spark, d):
    return X.from_prefix(table(spark, d, "orders"), "o_orderpriority")


_SLASH = """s AS (SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN n_name || '/X' WHEN s_nationkey % 5 = 1 THEN 'UNKNOWN ' || s_nationkey ELSE n_name END AS nat
FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _suppliers(spark, d):
    s = table(spark, d, "supplier").join(nation_region(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_nationkey")
    name = (
        F.when(k % 5 == 0, F.concat("n_name", F.lit("/X")))
        .when(k % 5 == 1, F.concat(F.lit("UNKNOWN "), k.cast("string")))
        .otherwise(F.col("n_name"))
    )
    return s.select("s_suppkey", name.alias("nat"))


@query(
    "itm15_unmatched_values",
    f"""WITH {_SLASH}, un AS (SELECT nat, count(*) n FROM s WHERE nat NOT IN (SELECT n_name FROM nation) GROUP BY nat)
SELECT 'edge' AS kind, nat AS value, NULL::BIGINT AS n FROM un WHERE contains(nat, '/')
UNION ALL SELECT 'deleted', nat, n::BIGINT FROM un WHERE NOT contains(nat, '/')
UNION ALL SELECT 'kept', 'rows', count(*)::BIGINT FROM s WHERE nat NOT LIKE 'UNKNOWN%'""",
)
def itm15(spark, d):
    edges = nation_edges(spark, d)
    more, rows, deleted = X.unmatched_values(_suppliers(spark, d), "nat", edges, slash_parent="WORLD")
    added = more.join(edges, ["attr", "child", "parent"], "left_anti")
    none = F.lit(None).cast("bigint")
    return (
        added.select(F.lit("edge").alias("kind"), F.col("child").alias("value"), none.alias("n"))
        .unionByName(deleted.select(F.lit("deleted").alias("kind"), "value", "n"))
        .unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("kind"), F.lit("rows").alias("value"), "n"))
    )


@query(
    "itm16_merged_hierarchy",
    f"""WITH {_SQL_EDGES} SELECT 'nat' AS attr, child, parent FROM e
UNION ALL VALUES ('acctbal', '[2000.01-6000.0]', '>=2000.01'), ('acctbal', '>=6000.01', '>=2000.01')""",
)
def itm16(spark, d):
    """The external taxonomy replaces the tree's own edges of ``nat``."""
    own = small_table(
        spark, pa.schema([("attr", pa.string()), ("child", pa.string()), ("parent", pa.string())]), [("nat", "a", "b")]
    )
    return X.merge(hier_edges(spark, d).where("attr = 'acctbal'").unionByName(own), nation_edges(spark, d))
