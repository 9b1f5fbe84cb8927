"""Divergence trees and their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    SQL_EVENTS, SQL_LINES, SQL_ORDERS, events_outcome, lineitem_cls, orders_cls, q9, query, r9, table,
)
from subdiv.functions import criteria as C
from subdiv.functions.metrics import CELLS
from subdiv.operators import tree as T
from subdiv.operators.histogram import range_blocks, running_sums, value_histogram

# ------------------------------------------------------------------ SQL side

_NUM = {"d_fpr": ("fp", "fp + tn"), "d_error": ("fp + fn", "tp + tn + fp + fn"), "d_accuracy": ("tp + tn", "tp + tn + fp + fn"), "d_fnr": ("fn", "fn + tp"), "d_outcome": ("y", "1")}


def _entropy(p):
    return f"(CASE WHEN {p} = 0 THEN 0 ELSE -{p} * log2({p}) END + CASE WHEN 1 - {p} = 0 THEN 0 ELSE -(1 - {p}) * log2(1 - {p}) END)"


def _sql_value(criterion, p, parent, base):
    if criterion == "entropy":
        return _entropy(p)
    if criterion == "divergence_criterion":
        return f"abs({p} - {parent})"
    if criterion.endswith("abs"):
        return f"abs({p} - {base})"
    return f"(({p} - {base}) * ({p} - {base}))"


def _sql_split(criterion):
    if criterion in ("entropy", "divergence_criterion"):
        return "(ld / (ld + rd)) * lval + (rd / (ld + rd)) * rval"
    if "sum" in criterion:
        return "(ln / total) * lval + (rn / total) * rval"
    return "greatest((ln / total) * lval, (rn / total) * rval)"


def _sql_gain(criterion):
    if criterion == "entropy":
        return "(nn / total) * (pval - ln / (ln + rn) * lval - rn / (ln + rn) * rval)"
    if criterion == "divergence_criterion":
        return "(nn / total) * split"
    return "(nn / total) * (greatest(abs(ldiv), abs(rdiv)) - abs(div))"


def sql_tree(source, attrs, metric, support, depth, criterion="divergence_criterion", minimal_gain=None, joint=False,
             value=None):
    """CTEs up to ``nodes``: all nodes of trees with at most ``depth`` levels.

    Separate trees: a node is an interval of one attribute.  Joint tree: rows
    carry the path of their node.
    """
    num, den = _NUM[metric]
    value = value or {a: f"{a}::DOUBLE" for a in attrs}
    order = "split ASC" if criterion == "entropy" else "split DESC"
    gain_rule = f" AND gain > {minimal_gain}" if minimal_gain is not None else ""
    ranks = ", ".join(f"('{a}', {i})" for i, a in enumerate(attrs))
    picks = " UNION ALL ".join(
        f"SELECT '{a}' AS attr, {value[a]} AS v, rid, ({num})::DOUBLE AS num, ({den})::DOUBLE AS den FROM src" for a in attrs
    )
    out = [
        f"src AS (SELECT *, row_number() OVER () AS rid FROM {source})",
        f"base AS (SELECT count(*)::DOUBLE AS total, sum({num})::DOUBLE / sum({den})::DOUBLE AS p0 FROM src)",
        f"ranks(attr, pos) AS (VALUES {ranks})",
        f"cell AS (SELECT * FROM ({picks}) WHERE v IS NOT NULL)",
    ]
    if joint:
        out.append("at0 AS (SELECT rid, '' AS path FROM src)")
        roots = f"SELECT '*' AS tree, '' AS path, 0 AS depth, NULL::VARCHAR AS attr, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::DOUBLE AS lo_cut, total AS n, 0.0::DOUBLE AS div, p0 AS p, {_entropy('p0') if criterion == 'entropy' else '0.0::DOUBLE'} AS val, NULL::DOUBLE AS psplit FROM base"
    else:
        roots = f"SELECT attr AS tree, '' AS path, 0 AS depth, NULL::VARCHAR AS attr, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::DOUBLE AS lo_cut, total AS n, 0.0::DOUBLE AS div, p0 AS p, {_entropy('p0') if criterion == 'entropy' else '0.0::DOUBLE'} AS val, NULL::DOUBLE AS psplit FROM base, ranks"
    out.append(f"n0 AS ({roots})")
    for k in range(depth):
        if joint:
            hist = f"SELECT '*' AS tree, c.attr, a.path, c.v, count(*)::DOUBLE AS n, sum(num) AS num, sum(den) AS den FROM cell c JOIN at{k} a USING (rid) GROUP BY c.attr, a.path, c.v"
        else:
            hist = f"SELECT c.attr AS tree, c.attr, m.path, c.v, count(*)::DOUBLE AS n, sum(num) AS num, sum(den) AS den FROM cell c JOIN n{k} m ON m.tree = c.attr AND (m.lo IS NULL OR c.v >= m.lo) AND (m.hi IS NULL OR c.v <= m.hi) GROUP BY c.attr, m.path, c.v"
        out.append(f"h{k} AS ({hist})")
        w = "OVER (PARTITION BY tree, attr, path ORDER BY v ROWS UNBOUNDED PRECEDING)"
        all_ = "OVER (PARTITION BY tree, attr, path)"
        out.append(
            f"""c{k} AS (SELECT tree, attr, path, v AS v1, lead(v) OVER (PARTITION BY tree, attr, path ORDER BY v) AS v2,
  sum(n) {w} AS ln, sum(num) {w} AS lnum, sum(den) {w} AS ld, sum(n) {all_} AS tn_, sum(num) {all_} AS tnum, sum(den) {all_} AS td FROM h{k})"""
        )
        out.append(
            f"""s{k} AS (SELECT c.tree, c.attr, c.path, v1, v2, ln, tn_ - ln AS rn, ld, td - ld AS rd, total, p0, m.n AS nn, m.div, m.val AS pval, m.psplit,
  lnum / nullif(ld, 0) AS lp, (tnum - lnum) / nullif(td - ld, 0) AS rp, m.div + p0 AS parent
  FROM c{k} c JOIN n{k} m ON m.tree = c.tree AND m.path = c.path, base
  WHERE v2 IS NOT NULL AND ln / total >= {support} AND (tn_ - ln) / total >= {support})"""
        )
        out.append(
            f"""e{k} AS (SELECT *, {_sql_value(criterion, 'lp', 'parent', 'p0')} AS lval, {_sql_value(criterion, 'rp', 'parent', 'p0')} AS rval,
  lp - p0 AS ldiv, rp - p0 AS rdiv FROM s{k} WHERE lp IS NOT NULL AND rp IS NOT NULL)"""
        )
        out.append(
            f"""f{k} AS (SELECT e.*, {_sql_split(criterion)} AS split, pos FROM e{k} e JOIN ranks USING (attr))"""
        )
        out.append(
            f"""b{k} AS (SELECT *, {_sql_gain(criterion)} AS gain FROM (SELECT * FROM f{k} WHERE split IS DISTINCT FROM psplit
  QUALIFY row_number() OVER (PARTITION BY tree, path ORDER BY {order}, pos, v1) = 1) WHERE NOT (ldiv = div AND rdiv = div)),
g{k} AS (SELECT * FROM b{k} WHERE true{gain_rule})"""
        )
        lo_old = "m.lo" if not joint else "NULL"
        hi_old = "m.hi" if not joint else "NULL"
        out.append(
            f"""n{k + 1} AS (
  SELECT g.tree, g.path || 'L' AS path, {k + 1} AS depth, g.attr, {lo_old} AS lo, v1 AS hi, NULL::DOUBLE AS lo_cut, ln AS n, ldiv AS div, lp AS p, lval AS val, split AS psplit FROM g{k} g JOIN n{k} m ON m.tree = g.tree AND m.path = g.path
  UNION ALL
  SELECT g.tree, g.path || 'R', {k + 1}, g.attr, v2, {hi_old}, v1, rn, rdiv, rp, rval, split FROM g{k} g JOIN n{k} m ON m.tree = g.tree AND m.path = g.path)"""
        )
        if joint:
            out.append(
                f"""at{k + 1} AS (SELECT a.rid, a.path || CASE WHEN c.v <= g.v1 THEN 'L' ELSE 'R' END AS path
  FROM at{k} a JOIN g{k} g ON g.path = a.path JOIN cell c ON c.rid = a.rid AND c.attr = g.attr)"""
            )
    union = " UNION ALL ".join(
        f"SELECT m.*, {'b.split' if k < depth else 'NULL::DOUBLE'} AS split, {'b.gain' if k < depth else 'NULL::DOUBLE'} AS gain FROM n{k} m"
        + (f" LEFT JOIN g{k} b ON b.tree = m.tree AND b.path = m.path" if k < depth else "")
        for k in range(depth + 1)
    )
    out.append(f"nodes AS ({union})")
    return ", ".join(out)


_NODE_SQL = f"""SELECT tree, depth, attr, {q9('lo')} AS lo, {q9('hi')} AS hi, n::BIGINT AS n, {q9('p')} AS metric,
{q9('div')} AS divergence, {q9('split')} AS split_criterion, {q9('gain')} AS gain FROM nodes"""


def _nodes(trees):
    return trees.nodes().select(
        "tree", F.col("depth"), "attr", r9("lo").alias("lo"), r9("hi").alias("hi"), "n", r9("metric").alias("metric"),
        r9("divergence").alias("divergence"), r9("split_criterion").alias("split_criterion"), r9("gain").alias("gain"),
    )


LINE_ATTRS = ["quantity", "discount", "price"]
_S = 0.3  # no node below the second level can be cut again
_FULL = sql_tree("line", LINE_ATTRS, "d_fpr", _S, 2)


def _line_trees(spark, d, metric="d_fpr", support=_S, **options):
    return T.grow(lineitem_cls(spark, d), LINE_ATTRS, metric, support, **options)


# ------------------------------------------------------------- node statistics


def _statistics_query(metric):
    num, den = _NUM[metric]

    @query(
        f"tre1_node_statistic_{metric}",
        f"WITH {SQL_LINES} SELECT quantity, count(*)::BIGINT AS n, {q9(f'sum({num})::DOUBLE / nullif(sum({den}), 0)')} AS metric FROM line GROUP BY quantity",
    )
    def run(spark, d):
        rows = lineitem_cls(spark, d)
        hist = value_histogram(rows, ["quantity"], CELLS)
        up, down = C.NODE_METRICS[metric]
        total = lambda cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
        return hist.select(
            F.col("v").alias("quantity"), "n", r9(F.try_divide(total(up), total(down))).alias("metric")
        )


for _m in C.NODE_METRICS:
    _statistics_query(_m)


@query(
    "tre2_node_statistic_outcome",
    f"WITH {SQL_EVENTS} SELECT k, count(*)::BIGINT AS n, {q9('sum(y)::DOUBLE / count(*)')} AS metric FROM ev GROUP BY k",
)
def tre2(spark, d):
    hist = value_histogram(events_outcome(spark, d), ["k"], ["y"])
    return hist.select(F.col("v").alias("k"), "n", r9(F.col("y").cast("double") / F.col("n")).alias("metric"))


_UNPIVOT = " UNION ALL ".join(f"SELECT '{a}' AS attr, {a} AS v, tn, fp FROM line" for a in LINE_ATTRS)


@query(
    "tre3_value_histogram",
    f"""WITH {SQL_LINES}, u AS ({_UNPIVOT}), h AS (SELECT attr, v, count(*) AS n, sum(fp) AS fp, sum(fp + tn) AS den FROM u GROUP BY attr, v)
SELECT attr, v, n::BIGINT AS n, (sum(n) OVER w)::BIGINT AS n_le, (sum(fp) OVER w)::BIGINT AS fp_le, lead(v) OVER (PARTITION BY attr ORDER BY v) AS next_v
FROM h WINDOW w AS (PARTITION BY attr ORDER BY v ROWS UNBOUNDED PRECEDING)""",
)
def tre3(spark, d):
    names = F.array(*[F.lit(a) for a in LINE_ATTRS])
    hist = value_histogram(lineitem_cls(spark, d), LINE_ATTRS, CELLS)
    cumulated = running_sums(range_blocks(hist, ["a"]), ["a"], ["n", "fp"])
    return cumulated.select(
        F.element_at(names, F.col("a") + 1).alias("attr"), "v", "n", "n_le", "fp_le", "next_v",
    )


# -------------------------------------------------------------------- cuts


def _criterion_query(name, criterion):
    for metric in ("d_fpr", "d_error"):
        sql = f"WITH {SQL_LINES}, {sql_tree('line', LINE_ATTRS, metric, _S, 2, criterion)} {_NODE_SQL}"

        def run(spark, d, metric=metric):
            return _nodes(_line_trees(spark, d, metric, criterion=criterion))

        query(f"{name}_{criterion}_{metric}", sql)(run)


for _n, _c in [
    ("tre6", "divergence_criterion"), ("tre7", "entropy"), ("tre8", "weighted_sum_abs"), ("tre8", "weighted_sum_pow"),
    ("tre9", "weighted_max_abs"), ("tre9", "weighted_max_pow"),
]:
    _criterion_query(_n, _c)


@query(
    "tre4_best_numeric_cut",
    f"""WITH {SQL_LINES}, {sql_tree('line', LINE_ATTRS, 'd_fpr', 0.05, 1)} SELECT attr, v1 AS cut_low, v2 AS cut_high,
ln::BIGINT AS rows_low, rn::BIGINT AS rows_high, {q9('split')} AS split_criterion FROM g0""",
)
def tre4(spark, d):
    n = _line_trees(spark, d, support=0.05, max_depth=1).nodes()
    low = n.where("rel = '<='").select("attr", "parent", F.col("hi").alias("cut_low"), F.col("n").alias("rows_low"))
    high = n.where("rel = '>='").select("parent", F.col("lo").alias("cut_high"), F.col("n").alias("rows_high"))
    root = n.where("attr is null").select(F.col("node").alias("parent"), r9("split_criterion").alias("split_criterion"))
    return low.join(high, "parent").join(root, "parent").drop("parent")


_DISC = ["ptype", "brand2"]


def _line_discrete(spark, d):
    # the 25 brands fold to five groups, as a text attribute is cut only with few values
    rows = lineitem_cls(spark, d)
    number = F.regexp_extract("brand", r"(\d+)", 1).cast("int")
    return rows.withColumn("brand2", F.concat(F.lit("G"), (number % 5).cast("string")))


@query(
    "tre5_best_discrete_cut",
    f"""WITH {SQL_LINES}, l2 AS (SELECT *, 'G' || (CAST(regexp_extract(brand, '(\\d+)', 1) AS INT) % 5) AS brand2 FROM line),
base AS (SELECT count(*)::DOUBLE total, sum(fp)::DOUBLE / sum(fp + tn) AS p0, sum(fp)::DOUBLE AS tf, sum(fp + tn)::DOUBLE AS td FROM l2),
h AS (SELECT 0 AS pos, 'ptype' AS attr, ptype AS s, count(*)::DOUBLE n, sum(fp)::DOUBLE f, sum(fp + tn)::DOUBLE dd FROM l2 GROUP BY ptype
 UNION ALL SELECT 1, 'brand2', brand2, count(*), sum(fp), sum(fp + tn) FROM l2 GROUP BY brand2),
s AS (SELECT *, f / dd AS lp, (tf - f) / (td - dd) AS rp FROM h, base WHERE n / total >= 0.05 AND (total - n) / total >= 0.05),
b AS (SELECT *, (dd / td) * abs(lp - p0) + ((td - dd) / td) * abs(rp - p0) AS split FROM s
  QUALIFY row_number() OVER (ORDER BY (dd / td) * abs(lp - p0) + ((td - dd) / td) * abs(rp - p0) DESC, pos, s) = 1)
SELECT attr, '=' || s AS item, n::BIGINT AS n, {q9('lp - p0')} AS divergence, {q9('split')} AS split_criterion FROM b
UNION ALL SELECT attr, '!=' || s, (total - n)::BIGINT, {q9('rp - p0')}, {q9('split')} FROM b""",
)
def tre5(spark, d):
    t = T.grow(_line_discrete(spark, d), _DISC, "d_fpr", 0.05, splitting="all_attributes", max_depth=1)
    n = t.nodes()
    root = n.where("attr is null").select(F.col("node").alias("parent"), r9("split_criterion").alias("split_criterion"))
    return n.where("attr is not null").select("attr", "item", "n", r9("divergence").alias("divergence"), "parent").join(
        root, "parent"
    ).drop("parent")


@query("tre10_stop_without_change", f"WITH {SQL_LINES}, {sql_tree('line', ['tax'], 'd_accuracy', 0.2, 4)} {_NODE_SQL}")
def tre10(spark, d):
    return _nodes(T.grow(lineitem_cls(spark, d), ["tax"], "d_accuracy", 0.2))


def _gain_query(criterion, gain):
    sql = f"WITH {SQL_LINES}, {sql_tree('line', LINE_ATTRS, 'd_fpr', 0.2, 4, criterion, gain)} {_NODE_SQL}"

    @query(f"tre11_minimal_gain_{criterion}", sql)
    def run(spark, d):
        return _nodes(_line_trees(spark, d, support=0.2, criterion=criterion, minimal_gain=gain))


_gain_query("divergence_criterion", 0.002)
_gain_query("entropy", 0.001)
_gain_query("weighted_sum_abs", 0.001)


@query("tre12_grown_tree", f"WITH {SQL_LINES}, {sql_tree('line', LINE_ATTRS, 'd_fpr', 0.12, 8)} {_NODE_SQL}")
def tre12(spark, d):
    return _nodes(_line_trees(spark, d, support=0.12))


@query(
    "tre13_one_tree_per_attribute",
    f"WITH {SQL_ORDERS}, {sql_tree('ord', ['acctbal', 'totalprice'], 'd_fnr', 0.2, 4)} {_NODE_SQL}",
)
def tre13(spark, d):
    return _nodes(T.grow(orders_cls(spark, d), ["acctbal", "totalprice"], "d_fnr", 0.2))


@query(
    "tre13_outcome_tree",
    f"WITH {SQL_EVENTS}, {sql_tree('ev', ['k'], 'd_outcome', 0.2, 4)} {_NODE_SQL}",
)
def tre13_outcome(spark, d):
    return _nodes(T.grow(events_outcome(spark, d), ["k"], "d_outcome", 0.2))


_JOINT = sql_tree("line", LINE_ATTRS, "d_fpr", 0.1, 9, joint=True)


@query(
    "tre14_one_tree_over_all_attributes",
    f"""WITH {SQL_LINES}, {_JOINT} SELECT depth, attr, n::BIGINT AS n, {q9('p')} AS metric, {q9('div')} AS divergence,
{q9('split')} AS split_criterion FROM nodes""",
)
def tre14(spark, d):
    t = T.grow(lineitem_cls(spark, d), LINE_ATTRS, "d_fpr", 0.1, splitting="all_attributes")
    return t.nodes().select(
        "depth", "attr", "n", r9("metric").alias("metric"), r9("divergence").alias("divergence"),
        r9("split_criterion").alias("split_criterion"),
    )


@query(
    "tre14_text_cut_by_order",
    f"""WITH {SQL_LINES}, base AS (SELECT count(*)::DOUBLE total, sum(fp)::DOUBLE / sum(fp + tn) AS p0, sum(fp)::DOUBLE AS tf, sum(fp + tn)::DOUBLE AS td FROM line),
h AS (SELECT brand AS s, count(*)::DOUBLE n, sum(fp)::DOUBLE f, sum(fp + tn)::DOUBLE dd FROM line GROUP BY brand),
c AS (SELECT s, lead(s) OVER (ORDER BY s) AS s2, sum(n) OVER w AS ln, sum(f) OVER w AS lf, sum(dd) OVER w AS ld FROM h WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, lf / ld AS lp, (tf - lf) / (td - ld) AS rp FROM c, base WHERE s2 IS NOT NULL AND ln / total >= 0.05 AND (total - ln) / total >= 0.05),
b AS (SELECT *, (ld / td) * abs(lp - p0) + ((td - ld) / td) * abs(rp - p0) AS split FROM k
  QUALIFY row_number() OVER (ORDER BY (ld / td) * abs(lp - p0) + ((td - ld) / td) * abs(rp - p0) DESC, s) = 1)
SELECT '<=' || s AS item, ln::BIGINT AS n, {q9('lp - p0')} AS divergence FROM b
UNION ALL SELECT '>=' || s2, (total - ln)::BIGINT, {q9('rp - p0')} FROM b""",
)
def tre14_text(spark, d):
    t = T.grow(lineitem_cls(spark, d), ["brand"], "d_fpr", 0.05, splitting="all_attributes", max_depth=1)
    return t.nodes().where("attr is not null").select("item", "n", r9("divergence").alias("divergence"))


# -------------------------------------------------------------------- names

_SQL_PARTS = """prt0 AS (SELECT p_size, CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS cls,
  CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN 1 ELSE 0 END AS pred FROM part JOIN lineitem ON l_partkey = p_partkey)"""


def _parts(spark, d):
    from subdiv.functions.cells import with_cells

    p = table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    rows = p.select(
        F.col("p_size").alias("size"),
        (F.col("p_retailprice") > 1000).cast("int").alias("cls"),
        F.col("p_type").isin("ECONOMY", "PROMO", "SMALL").cast("int").alias("pred"),
    )
    return with_cells(rows, "cls", "pred", {"N": 0, "P": 1})


from catalog.base import SQL_CELLS  # noqa: E402

_PRT = f"{_SQL_PARTS}, prt AS (SELECT *, {SQL_CELLS} FROM prt0)"
_PTREE = f"WITH {_PRT}, {sql_tree('prt', ['size'], 'd_error', 0.15, 5, value={'size': 'p_size::DOUBLE'})}"
_NAME = """CASE WHEN lo IS NULL THEN '<=' || hi::BIGINT WHEN hi IS NULL THEN '>=' || lo::BIGINT
  WHEN lo = hi THEN (lo::BIGINT)::VARCHAR ELSE '[' || lo::BIGINT || '-' || hi::BIGINT || ']' END"""
_NAMED = f"""{_PTREE}, nm AS (SELECT *, CASE WHEN attr IS NOT NULL THEN {_NAME} END AS item FROM nodes),
named AS (SELECT m.*, p.item AS parent_item FROM nm m LEFT JOIN nm p ON p.path = left(m.path, len(m.path) - 1) AND m.path <> ''
  AND p.attr IS NOT NULL)"""


def _part_trees(spark, d):
    return T.grow(_parts(spark, d), ["size"], "d_error", 0.15)


@query("tre15_node_names", f"{_NAMED} SELECT item, parent_item, n::BIGINT AS n FROM named WHERE attr IS NOT NULL")
def tre15(spark, d):
    return _part_trees(spark, d).nodes().where("attr is not null").select("item", "parent_item", "n")


_OPEN = f"""{_PTREE}, lows AS (SELECT m.path, max(CASE WHEN a.lo_cut IS NOT NULL THEN a.lo_cut END) AS gt FROM nodes m
  JOIN nodes a ON starts_with(m.path, a.path) WHERE m.attr IS NOT NULL GROUP BY m.path)
SELECT CASE WHEN gt IS NULL THEN '<=' || hi::BIGINT WHEN hi IS NULL THEN '>' || gt::BIGINT
  ELSE '[' || gt::BIGINT || '-' || hi::BIGINT || ']' END AS item, n::BIGINT AS n FROM nodes JOIN lows USING (path)"""


@query("tre16_open_lower_bounds", _OPEN)
def tre16(spark, d):
    return _part_trees(spark, d).nodes(open_lower=True).where("attr is not null").select("item", "n")


@query(
    "tre17_tree_tables",
    f"""{_NAMED} SELECT item, parent_item, (depth - 1)::INT AS level, (split IS NOT NULL) AS has_child FROM named WHERE attr IS NOT NULL""",
)
def tre17(spark, d):
    return _part_trees(spark, d).hierarchy_table().select("item", "parent_item", "level", "has_child")


@query(
    "tre17_raw_paths",
    f"""{_PTREE}, conditions AS (SELECT m.path, string_agg('size' || CASE WHEN right(a.path, 1) = 'L' THEN '<=' || a.hi::BIGINT ELSE '>=' || a.lo::BIGINT END, ' ' ORDER BY a.depth) AS t
  FROM nodes m JOIN nodes a ON a.depth > 0 AND a.path = left(m.path, a.depth) GROUP BY m.path),
inside AS (SELECT m.path, count(*)::DOUBLE AS n, {', '.join(f'sum({c})::BIGINT AS {c}' for c in CELLS)}
  FROM nodes m JOIN prt ON (m.lo IS NULL OR p_size >= m.lo) AND (m.hi IS NULL OR p_size <= m.hi) GROUP BY m.path)
SELECT tree, coalesce(t, '') AS path, {q9('i.n / total')} AS support, {q9('div')} AS divergence, {', '.join(f'i.{c}' for c in CELLS)}
FROM nodes m JOIN inside i USING (path) LEFT JOIN conditions USING (path), base""",
)
def tre17_raw(spark, d):
    raw = _part_trees(spark, d).raw_table()
    return raw.select("tree", F.array_join("path", " ").alias("path"), r9("support").alias("support"), r9("divergence").alias("divergence"), *CELLS)


@query(
    "tre18_generalization_edges",
    f"{_NAMED} SELECT DISTINCT 'size' AS attr, item AS child, parent_item AS parent FROM named WHERE parent_item IS NOT NULL",
)
def tre18(spark, d):
    return _part_trees(spark, d).generalization()


_BOUNDS = "coalesce(lo, (SELECT min(p_size) FROM prt0))::DOUBLE AS lo, coalesce(hi, (SELECT max(p_size) FROM prt0))::DOUBLE AS hi"


@query(
    "tre18_leaf_ranges",
    f"{_NAMED} SELECT DISTINCT item, {_BOUNDS} FROM named WHERE attr IS NOT NULL AND item NOT IN (SELECT parent_item FROM named WHERE parent_item IS NOT NULL)",
)
def tre18_leaves(spark, d):
    return _part_trees(spark, d).discretization_table().select("item", "lo", "hi")


@query("tre19_all_ranges", f"{_NAMED} SELECT DISTINCT item, {_BOUNDS} FROM named WHERE attr IS NOT NULL")
def tre19(spark, d):
    return _part_trees(spark, d).discretization_table("all").select("item", "lo", "hi")


_ITEM = """CASE WHEN lo IS NULL THEN '<=' || hi WHEN hi IS NULL THEN '>=' || lo WHEN lo = hi THEN hi::VARCHAR
  ELSE '[' || lo || '-' || hi || ']' END"""


@query(
    "tre20_conditioned_ranges",
    f"""WITH {SQL_LINES}, {_JOINT},
spans AS (SELECT m.path, c.attr, max(c.lo) AS lo, min(c.hi) AS hi, min(c.depth) AS first
  FROM nodes m JOIN nodes c ON c.depth > 0 AND c.path = left(m.path, c.depth) GROUP BY m.path, c.attr),
called AS (SELECT *, {_ITEM} AS item FROM spans),
mine AS (SELECT c.* FROM nodes m JOIN called c ON c.path = m.path AND c.attr = m.attr),
cut AS (SELECT DISTINCT m.attr, c.item FROM mine m JOIN called c ON c.path = left(m.path, len(m.path) - 1) AND c.attr = m.attr),
above AS (SELECT m.path, string_agg(c.attr || '=' || c.item, ' & ' ORDER BY c.first) AS parent_items
  FROM mine m JOIN called c ON c.path = left(m.path, len(m.path) - 1) GROUP BY m.path)
SELECT attr, item, concat_ws(' ', CASE WHEN lo = hi THEN '=' WHEN lo IS NOT NULL THEN '>=' END, CASE WHEN hi IS NOT NULL AND lo IS DISTINCT FROM hi THEN '<=' END) AS rels,
  concat_ws(' ', lo, CASE WHEN lo IS DISTINCT FROM hi THEN hi END) AS vals, coalesce(parent_items, '') AS parent_items
FROM mine LEFT JOIN above USING (path) ANTI JOIN cut USING (attr, item)""",
)
def tre20(spark, d):
    ranges = T.grow(lineitem_cls(spark, d), LINE_ATTRS, "d_fpr", 0.1, splitting="all_attributes").conditioned()
    texts = {c: F.array_join(c, " & " if c == "parent_items" else " ") for c in ("rels", "vals", "parent_items")}
    return ranges.withColumns(texts)


@query(
    "tre21_range_intervals_of_tree_leaves",
    f"{_NAMED} SELECT DISTINCT item, {_BOUNDS} FROM named WHERE attr IS NOT NULL AND split IS NULL",
)
def tre21(spark, d):
    return _part_trees(spark, d).discretization_table("leaves").select("item", "lo", "hi")


@query(
    "tre22_min_max",
    f"WITH {SQL_LINES} " + " UNION ALL ".join(f"SELECT '{a}' AS attr, min({a}) AS min, max({a}) AS max FROM line" for a in LINE_ATTRS),
)
def tre22(spark, d):
    return T.min_max(lineitem_cls(spark, d), LINE_ATTRS)


@query(
    "tre23_node_counts",
    f"""WITH {SQL_LINES}, {_FULL} SELECT tree, count(*) FILTER (WHERE attr IS NOT NULL AND split IS NOT NULL)::BIGINT AS internal_nodes,
count(*) FILTER (WHERE attr IS NOT NULL AND split IS NULL)::BIGINT AS leaf_nodes FROM nodes GROUP BY tree""",
)
def tre23(spark, d):
    return _line_trees(spark, d).node_counts()


@query("tre24_divergent_items", f"{_NAMED} SELECT DISTINCT 'size' AS attr, item FROM named WHERE attr IS NOT NULL AND div > 0")
def tre24(spark, d):
    return _part_trees(spark, d).divergent_items().where("item is not null")


# ------------------------------------------------------------- other scores

_PAIR = f"""WITH {SQL_LINES}, r AS (SELECT sum(fp)::DOUBLE AS n0, sum(fp + tn)::DOUBLE AS d0 FROM line),
h AS (SELECT quantity AS v, count(*)::DOUBLE n, sum(fp)::DOUBLE f, sum(fp + tn)::DOUBLE dd FROM line GROUP BY quantity),
c AS (SELECT v, sum(n) OVER w AS n1, sum(f) OVER w AS f1, sum(dd) OVER w AS d1 FROM h WINDOW w AS (ORDER BY v)),
p AS (SELECT v, n1 / (SELECT count(*) FROM line) AS s1, 1 - n1 / (SELECT count(*) FROM line) AS s2, f1, d1, n0 - f1 AS f2, d0 - d1 AS d2, n0, d0,
  n0 / d0 AS q, f1 / d1 AS p1, (n0 - f1) / (d0 - d1) AS p2 FROM c, r WHERE v < (SELECT max(v) FROM h))"""


def _kl(p, q):
    def term(a, b):
        return f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0 ELSE -({a}) * ln(({b}) / ({a})) END"

    return f"({term(p, q)} + {term(f'(1 - {p})', f'(1 - {q})')})"


def _kld(w, p, q):
    def term(a, b):
        return f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0 ELSE -ln(({a}) / ({b})) END"

    return f"({w}) * ({term(p, q)} + {term(f'(1 - {p})', f'(1 - {q})')})"


_QP = "((n0 + 1) / (d0 + 1))"
_WKL = "s{i} * CASE WHEN p{i} = 0 THEN 0 ELSE abs(log2(p{i} / q)) END"
_RATIO1 = "(p1 / q)"


@query(
    "tre25_other_split_scores",
    f"""{_PAIR} SELECT v, {q9('abs(p1 - q) + abs(p2 - q)')} AS sum_abs, {q9('(p1 - q) * (p1 - q) + (p2 - q) * (p2 - q)')} AS sum_pow,
{q9('(p1 - q + p2 - q) * (p1 - q + p2 - q)')} AS pow_sum, {q9('greatest(abs(p1 - q), abs(p2 - q))')} AS max_abs,
{q9(_WKL.format(i=1) + ' + ' + _WKL.format(i=2))} AS weighted_kl,
{q9(f"(d1 / (d1 + d2)) * {_kl('p1', 'q')} + (d2 / (d1 + d2)) * {_kl('p2', 'q')}")} AS kl,
{q9(_kld('(d1 + 1) / (d0 + 1)', '((f1 + 1) / (d1 + 1))', _QP) + ' + ' + _kld('(d2 + 1) / (d0 + 1)', '((f2 + 1) / (d2 + 1))', _QP))} AS kl_derived,
{q9('log2(p2 / q)')} AS log_ratio, {q9(f'CASE WHEN {_RATIO1} = 0 THEN 0 WHEN {_RATIO1} < 1 THEN log2(2 - {_RATIO1}) ELSE log2({_RATIO1}) END')} AS log_ratio_capped FROM p""",
)
def tre25(spark, d):
    rows = lineitem_cls(spark, d)
    hist = value_histogram(rows, ["quantity"], CELLS)
    whole = rows.agg(
        F.struct(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum("fp").cast("double").alias("f"),
            F.sum(F.col("fp") + F.col("tn")).cast("double").alias("d"),
        ).alias("w")
    ).scalar()
    c = running_sums(range_blocks(hist, ["a"]), ["a"], ["n", "fp", "tn"]).where("next_v is not null").withColumns(
        {
            "f1": F.col("fp_le").cast("double"), "d1": (F.col("fp_le") + F.col("tn_le")).cast("double"),
            "s1": F.col("n_le") / whole["n"], "n0": whole["f"], "d0": whole["d"],
        }
    )
    c = c.withColumns(
        {
            "f2": F.col("n0") - F.col("f1"), "d2": F.col("d0") - F.col("d1"), "s2": 1 - F.col("s1"),
            "q": F.col("n0") / F.col("d0"), "p1": F.col("f1") / F.col("d1"),
        }
    ).withColumn("p2", F.col("f2") / F.col("d2"))
    p1, p2, q, a, b = F.col("p1"), F.col("p2"), F.col("q"), F.col("p1") - F.col("q"), F.col("p2") - F.col("q")
    f1, d1, f2, d2 = F.col("f1"), F.col("d1"), F.col("f2"), F.col("d2")
    return c.select(
        "v",
        r9(C.sum_abs(a, b)).alias("sum_abs"), r9(C.sum_pow(a, b)).alias("sum_pow"), r9(C.pow_sum(a, b)).alias("pow_sum"),
        r9(C.max_abs(a, b)).alias("max_abs"),
        r9(C.weighted_log_ratio_sum(p1, p2, F.col("s1"), F.col("s2"), q)).alias("weighted_kl"),
        r9(C.kl_split(f1, d1, f2, d2, q)).alias("kl"),
        r9(C.kl_derived_split(f1, d1, f2, d2, F.col("n0"), F.col("d0"))).alias("kl_derived"),
        r9(C.log_ratio(p2, q)).alias("log_ratio"), r9(C.log_ratio_capped(p1, q)).alias("log_ratio_capped"),
    )


@query("e2e4_tree_discretization", f"WITH {SQL_LINES}, {sql_tree('line', LINE_ATTRS, 'd_error', 0.2, 4)} {_NODE_SQL}")
def e2e4(spark, d):
    from subdiv.plans.explore import tree_hierarchy

    trees, _, _ = tree_hierarchy(lineitem_cls(spark, d), LINE_ATTRS, "d_error", 0.2)
    return _nodes(trees)


@query(
    "fmt4_condition_text",
    f"""{_PTREE} SELECT CASE WHEN attr IS NULL THEN 'root' WHEN right(path, 1) = 'L' THEN 'size<=' || hi::BIGINT ELSE 'size>=' || lo::BIGINT END AS condition FROM nodes""",
)
def fmt4(spark, d):
    return _part_trees(spark, d).condition_text().select("condition")


