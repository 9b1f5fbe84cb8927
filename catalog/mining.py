"""Itemset mining, metrics and end-to-end exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    ORDER_CHAINS_UP, SQL_EVENTS, SQL_IT, SQL_IT_UP, SQL_LABELS, SQL_LINES, SQL_ORDERS, SUP, SUP_UP,
    events_outcome, hour_edges, labels_cls, lineitem_cls, mined_orders, nation_edges, orders_cls,
    q9, query, r9, sql_cells_bigint, sql_itemsets, sql_rate, sql_with_metric,
)
from subdiv.functions import metrics as M
from subdiv.functions.metrics import CELLS
from subdiv.operators import items as item_ops
from subdiv.operators import taxonomy
from subdiv.operators.mine import mine, mine_top_k, top_k
from subdiv.operators.select import top
from subdiv.plans import explore as E
from subdiv.sources.tables import spill

COLS = ["key", "length", "support", "support_count"]
ATTRS = ["seg", "prio", "nat"]


def _cells(df):
    return df.select("key", "length", r9("support").alias("support"), "support_count", *CELLS)


_SELECT_CELLS = f"SELECT key, length, {q9('support')} AS support, support_count, {sql_cells_bigint()}"


# ------------------------------------------------------------------- mining


@query("fim1_itemsets_with_cells", f"{SQL_IT} {_SELECT_CELLS} FROM it")
def fim1(spark, d):
    return _cells(mine(orders_cls(spark, d), ATTRS, CELLS, SUP))


@query("fim2_itemsets_level_wise", f"{SQL_IT} {_SELECT_CELLS} FROM it")
def fim2(spark, d):
    return _cells(mine(orders_cls(spark, d), ATTRS, CELLS, SUP, method="level_wise"))


@query("fim3_generalized_itemsets", f"{SQL_IT_UP} {_SELECT_CELLS} FROM it")
def fim3(spark, d):
    closed = taxonomy.closure(nation_edges(spark, d))
    return _cells(mine(orders_cls(spark, d), ATTRS, CELLS, SUP_UP, closure=closed))


@query("fim3_generalized_itemsets_level_wise", f"{SQL_IT_UP} {_SELECT_CELLS} FROM it")
def fim3_level(spark, d):
    closed = taxonomy.closure(nation_edges(spark, d))
    return _cells(mine(orders_cls(spark, d), ATTRS, CELLS, SUP_UP, closure=closed, method="level_wise"))


_LINE_CHAINS = {a: [a] for a in ["status", "brand", "ptype"]}


@query(
    "fim1_itemsets_lineitem",
    f"WITH {SQL_LINES}, {sql_itemsets('line', _LINE_CHAINS, CELLS, 0.005)} {_SELECT_CELLS} FROM it",
)
def fim1_lines(spark, d):
    return _cells(mine(lineitem_cls(spark, d), ["status", "brand", "ptype"], CELLS, 0.005))


_EVENT_CHAINS = {"etype": ["etype"], "hr": ["hr", "part"]}
_SQL_EV_IT = f"WITH {SQL_EVENTS}, {sql_itemsets('ev', _EVENT_CHAINS, ['y', 'y2'], 0.005)}"


@query(
    "fim4_outcome_sums",
    f"{_SQL_EV_IT} SELECT key, length, {q9('support')} AS support, support_count, y::DOUBLE AS y, y2::DOUBLE AS y2 FROM it",
)
def fim4(spark, d):
    closed = taxonomy.closure(hour_edges(spark))
    found = mine(events_outcome(spark, d), ["etype", "hr"], ["y", "y2"], 0.005, closure=closed)
    return found.select(
        "key", "length", r9("support").alias("support"), "support_count",
        F.col("y").cast("double").alias("y"), F.col("y2").cast("double").alias("y2"),
    )


@query(
    "fim5_max_length",
    f"WITH {SQL_ORDERS}, {sql_itemsets('ord', ORDER_CHAINS_UP, CELLS, SUP_UP, max_len=2)} {_SELECT_CELLS} FROM it",
)
def fim5(spark, d):
    closed = taxonomy.closure(nation_edges(spark, d))
    return _cells(mine(orders_cls(spark, d), ATTRS, CELLS, SUP_UP, closure=closed, max_len=2, method="level_wise"))


_OVERLAP = {
    "acctbal": {
        "<=2000": {"rels": ["<="], "vals": [2000.0]},
        ">=1000": {"rels": [">="], "vals": [1000.0]},
        "[0-6000]": {"rels": [">=", "<="], "vals": [0.0, 6000.0]},
    }
}
_FLAGS = ["acctbal <= 2000", "acctbal >= 1000", "acctbal >= 0 AND acctbal <= 6000"]
_LABELS = ["<=2000", ">=1000", "[0-6000]"]


def _sql_overlap() -> str:
    """Every conjunction of the three ranges and the segment."""
    unn = ", ".join(f"unnest([CASE WHEN {f} THEN '{n}' END, NULL]) o{i}(v)" for i, (f, n) in enumerate(zip(_FLAGS, _LABELS)))
    guard = " AND ".join(f"(({f}) OR o{i}.v IS NULL)" for i, f in enumerate(_FLAGS))
    # a range that does not hold gives NULL twice, so rows are made distinct per order
    return f"""WITH {SQL_ORDERS}, x AS (SELECT DISTINCT o_orderkey, o0.v AS a, o1.v AS b, o2.v AS c, us.v AS seg,
  tn, fp, fn, tp FROM ord, {unn}, unnest([seg, NULL]) us(v) WHERE {guard}),
g AS (SELECT a, b, c, seg, count(*) AS n, sum(tn) tn, sum(fp) fp, sum(fn) fn, sum(tp) tp FROM x GROUP BY a, b, c, seg)
SELECT concat_ws(', ', 'acctbal=' || a, 'acctbal=' || b, 'acctbal=' || c, 'seg=' || seg) AS key,
  ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (seg IS NOT NULL)::INT)::INT AS length,
  {q9('n::DOUBLE / (SELECT count(*) FROM ord)')} AS support, n::BIGINT AS support_count, {sql_cells_bigint()}
FROM g WHERE n::DOUBLE / (SELECT count(*) FROM ord) >= 0.02"""


@query("fim6_overlapping_ranges", _sql_overlap())
def fim6(spark, d):
    rows = item_ops.discretize_overlapping(orders_cls(spark, d), _OVERLAP)
    return _cells(mine(rows, ["acctbal", "seg"], CELLS, 0.02, overlap=True))


@query(
    "fim7_top_k_itemsets",
    f"""{sql_with_metric(SQL_IT, ['fpr'])}
(SELECT key, length, support_count, {q9('d_fpr')} AS d_fpr FROM d WHERE length > 0
  ORDER BY d_fpr DESC, support DESC, length, key LIMIT 25)
UNION ALL SELECT key, length, support_count, {q9('d_fpr')} FROM d WHERE length = 0""",
)
def fim7(spark, d):
    scored = M.with_divergence(mined_orders(spark, d), ["d_fpr"], significance=False)
    return top_k(scored, "d_fpr", 25).select("key", "length", "support_count", r9("d_fpr").alias("d_fpr"))


@query(
    "fim7_top_k_while_mining",
    f"""{sql_with_metric(SQL_IT_UP, ['fpr'])}
(SELECT key, length, support_count, {q9('d_fpr')} AS d_fpr FROM d WHERE length > 0
  ORDER BY d.d_fpr DESC, support DESC, length, key LIMIT 10)
UNION ALL SELECT key, length, support_count, {q9('d_fpr')} FROM d WHERE length = 0""",
)
def fim7_while(spark, d):
    """The best ten over a taxonomy; itemsets that cannot lead to one are not grown."""
    closed = taxonomy.closure(nation_edges(spark, d))
    found = mine_top_k(orders_cls(spark, d), ATTRS, CELLS, SUP_UP, "d_fpr", 10, closure=closed, method="level_wise")
    scored = M.with_divergence(found, ["d_fpr"], significance=False)
    return scored.select("key", "length", "support_count", r9("d_fpr").alias("d_fpr"))


@query(
    "fim7_top_k_outcome",
    f"""{_SQL_EV_IT}, w AS (SELECT y::DOUBLE / support_count AS mean FROM it WHERE length = 0),
d AS (SELECT it.*, y::DOUBLE / support_count - w.mean AS d_outcome FROM it, w)
(SELECT key, length, support_count, {q9('d_outcome')} AS d_outcome FROM d WHERE length > 0
  ORDER BY d.d_outcome DESC, support DESC, length, key LIMIT 10)
UNION ALL SELECT key, length, support_count, {q9('d_outcome')} FROM d WHERE length = 0""",
)
def fim7_outcome(spark, d):
    closed = taxonomy.closure(hour_edges(spark))
    found = mine_top_k(
        events_outcome(spark, d), ["etype", "hr"], ["y", "y2"], 0.005, "d_outcome", 10, closure=closed, method="level_wise"
    )
    return M.with_outcome_divergence(found).select("key", "length", "support_count", r9("d_outcome").alias("d_outcome"))


@query("fim8_support_columns", f"{SQL_IT} SELECT key, length, {q9('support')} AS support, support_count FROM it")
def fim8(spark, d):
    return mined_orders(spark, d).select("key", "length", r9("support").alias("support"), "support_count")


_HOT = ["seg", "prio"]


@query(
    "fim9_one_hot_input",
    f"WITH {SQL_ORDERS}, {sql_itemsets('ord', {a: [a] for a in _HOT}, CELLS, SUP)} {_SELECT_CELLS} FROM it",
)
def fim9(spark, d):
    matrix = item_ops.one_hot(orders_cls(spark, d).select(*_HOT, *CELLS), _HOT)
    columns = [c for c in matrix.columns if "=" in c]
    arrays, attrs = item_ops.from_one_hot(matrix, columns)
    return _cells(mine(arrays, attrs, CELLS, SUP))


@query("snk2_spilled_itemsets", f"{SQL_IT} {_SELECT_CELLS} FROM it")
def snk2(spark, d):
    return _cells(spill(mined_orders(spark, d)))


# ------------------------------------------------------------------ metrics


def _metric_query(number, name):
    extra_sql, extra = "", []
    if name == "posr":
        extra_sql, extra = ", (tp + fn)::BIGINT AS \"P\"", ["P"]
    if name == "negr":
        extra_sql, extra = ", (tn + fp)::BIGINT AS \"N\"", ["N"]
    sql = f"{sql_with_metric(SQL_IT, [name])} SELECT key, {q9('\"for\"' if name == 'for' else name)} AS \"{name}\", {q9('d_' + name)} AS d_{name}{extra_sql} FROM d"

    @query(f"met{number}_{name}", sql.replace(" AS for,", ' AS "for",'))
    def run(spark, d):
        scored = M.with_divergence(mined_orders(spark, d), [f"d_{name}"], significance=False)
        return scored.select("key", r9(name).alias(name), r9(f"d_{name}").alias(f"d_{name}"), *extra)


for _i, _name in enumerate(
    ["fpr", "fnr", "accuracy", "error", "ppv", "tpr", "tnr", "npv", "fdr", "for", "posr", "negr"], start=1
):
    _metric_query(_i, _name)

_R = f"(SELECT * FROM it WHERE length = 0) r"
_N = "r.support_count"


@query(
    "met13_absolute_divergence",
    f"""{SQL_IT} SELECT i.key, {q9(f"abs({sql_rate('fpr','i.')} - {sql_rate('fpr','r.')})")} AS d_fpr_abs,
{q9(f"abs({sql_rate('fnr','i.')} - {sql_rate('fnr','r.')})")} AS d_fnr_abs,
{q9(f"abs({sql_rate('accuracy','i.')} - {sql_rate('accuracy','r.')})")} AS d_accuracy_abs FROM it i, {_R}""",
)
def met13(spark, d):
    names = ["d_fpr_abs", "d_fnr_abs", "d_accuracy_abs"]
    scored = M.with_divergence(mined_orders(spark, d), names, significance=False)
    return scored.select("key", *[r9(n).alias(n) for n in names])


@query(
    "met14_weighted_divergence",
    f"""{SQL_IT} SELECT i.key,
{q9(f"(i.tn + i.fp)::DOUBLE / {_N} * ({sql_rate('fpr','i.')} - {sql_rate('fpr','r.')})")} AS d_fpr_w,
{q9(f"(i.tp + i.fn)::DOUBLE / {_N} * ({sql_rate('fnr','i.')} - {sql_rate('fnr','r.')})")} AS d_fnr_w,
{q9(f"i.support * ({sql_rate('accuracy','i.')} - {sql_rate('accuracy','r.')})")} AS d_accuracy_w FROM it i, {_R}""",
)
def met14(spark, d):
    names = ["d_fpr_w", "d_fnr_w", "d_accuracy_w"]
    return M.with_divergence(mined_orders(spark, d), names).select("key", *[r9(n).alias(n) for n in names])


_FAIR = {
    "SPsf": f"i.support * abs((r.tp + r.fp)::DOUBLE / {_N} - (i.tp + i.fp)::DOUBLE / i.support_count)",
    "FPsf": f"(i.tn + i.fp)::DOUBLE / {_N} * abs(r.fp::DOUBLE / (r.fp + r.tn) - i.fp::DOUBLE / nullif(i.fp + i.tn, 0))",
    "FNsf": f"(i.tp + i.fn)::DOUBLE / {_N} * abs(r.fn::DOUBLE / (r.fn + r.tp) - i.fn::DOUBLE / nullif(i.fn + i.tp, 0))",
    "ACsf": f"i.support * abs((r.tp + r.tn)::DOUBLE / {_N} - {sql_rate('accuracy', 'i.')})",
}


def _fairness_query(number, name):
    @query(f"met{number}_{name.lower()}", f"{SQL_IT} SELECT i.key, {q9(_FAIR[name])} AS {name} FROM it i, {_R}")
    def run(spark, d):
        return M.with_divergence(mined_orders(spark, d), [name]).select("key", r9(name).alias(name))


for _i, _name in enumerate(_FAIR, start=15):
    _fairness_query(_i, _name)

_SQL_OUT = f"""{_SQL_EV_IT}, o AS (SELECT *, y::DOUBLE / support_count AS outcome,
  y2::DOUBLE / support_count - (y::DOUBLE / support_count) * (y::DOUBLE / support_count) AS var FROM it),
p AS (SELECT i.*, i.outcome - r.outcome AS d_outcome, i.outcome / r.outcome AS ratio,
  abs(i.outcome - r.outcome) / sqrt(greatest(i.var / i.support_count, 0) + greatest(r.var / r.support_count, 0)) AS welch,
  abs(i.outcome - r.outcome) / sqrt(greatest(i.var, 0) + greatest(r.var, 0)) AS plain
  FROM o i, (SELECT * FROM o WHERE length = 0) r)"""


def _events_mined(spark, d):
    closed = taxonomy.closure(hour_edges(spark))
    return mine(events_outcome(spark, d), ["etype", "hr"], ["y", "y2"], 0.005, closure=closed)


@query("met19_outcome", f"{_SQL_OUT} SELECT key, {q9('outcome')} AS outcome, {q9('d_outcome')} AS d_outcome FROM p")
def met19(spark, d):
    scored = M.with_outcome_divergence(_events_mined(spark, d))
    return scored.select("key", r9("outcome").alias("outcome"), r9("d_outcome").alias("d_outcome"))


def _sql_beta(metric, p):
    good, bad = M.BETA_CELLS[metric]
    a = "(1.0 + " + " + ".join(p + c for c in good) + ")::DOUBLE"
    b = "(1.0 + " + " + ".join(p + c for c in bad) + ")::DOUBLE"
    mean = f"({a} / ({a} + {b}))"
    var = f"(({a} * {b}) / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"
    return mean, var


def _sql_t(metric):
    mi, vi = _sql_beta(metric, "i.")
    mr, vr = _sql_beta(metric, "r.")
    return f"abs({mi} - {mr}) / sqrt({vi} + {vr})"


_T_METRICS = [m for m in M.BETA_CELLS if not m.endswith("_abs")]


@query(
    "met20_beta_t_values",
    f"""{SQL_IT} SELECT i.key, {', '.join(f'{q9(_sql_t(m))} AS t_value_{m[2:]}' for m in _T_METRICS)} FROM it i, {_R}""",
)
def met20(spark, d):
    scored = M.with_divergence(mined_orders(spark, d), _T_METRICS)
    return scored.select("key", *[r9(f"t_value_{m[2:]}").alias(f"t_value_{m[2:]}") for m in _T_METRICS])


@query(
    "met20_beta_moments",
    f"""{SQL_IT} SELECT i.key, {q9(_sql_beta('d_error', 'i.')[0])} AS mean_beta, {q9(_sql_beta('d_error', 'i.')[1])} AS var_beta,
{q9('sqrt' + _sql_beta('d_error', 'i.')[1])} AS std_beta FROM it i""",
)
def met20_moments(spark, d):
    return mined_orders(spark, d).select(
        "key",
        r9(M.beta_mean("d_error")).alias("mean_beta"),
        r9(M.beta_variance("d_error")).alias("var_beta"),
        r9(M.beta_std("d_error")).alias("std_beta"),
    )


@query("met21_welch_t_value", f"{_SQL_OUT} SELECT key, {q9('welch')} AS welch, {q9('plain')} AS plain FROM p")
def met21(spark, d):
    mined = _events_mined(spark, d)
    welch = M.with_outcome_divergence(mined).select("key", r9("t_value_outcome").alias("welch"))
    plain = M.with_outcome_divergence(mined, "plain").select("key", r9("t_value_outcome").alias("plain"))
    return welch.join(plain, "key")


@query(
    "met22_divergence_of_given_cells",
    f"""WITH {SQL_LINES}, c AS (SELECT status, count(*) n, sum(tn) tn, sum(fp) fp, sum(fn) fn, sum(tp) tp FROM line GROUP BY status),
r AS (SELECT sum(tn) tn, sum(fp) fp, sum(fn) fn, sum(tp) tp FROM line)
SELECT i.status AS key, {q9(f"{sql_rate('error','i.')} - {sql_rate('error','r.')}")} AS d_error,
{q9(f"{sql_rate('npv','i.')} - {sql_rate('npv','r.')}")} AS d_npv FROM c i, r
UNION ALL SELECT '', 0.0, 0.0""",
)
def met22(spark, d):
    """A table of cells made elsewhere: one row per line status and one for the whole table."""
    rows = lineitem_cls(spark, d)
    given = (
        rows.rollup("status")
        .agg(F.count(F.lit(1)).alias("support_count"), *[F.sum(c).alias(c) for c in CELLS])
        .select(
            F.coalesce("status", F.lit("")).alias("key"),
            F.when(F.col("status").isNull(), 0).otherwise(1).alias("length"),
            "support_count", *CELLS,
        )
    )
    scored = M.with_divergence(given, ["d_error", "d_npv"], significance=False)
    return scored.select("key", r9("d_error").alias("d_error"), r9("d_npv").alias("d_npv"))


@query(
    "met23_mean_ratio",
    f"{_SQL_OUT} SELECT key, {q9('ratio')} AS ratio, {q9('support * ln(ratio)')} AS wlogr FROM p",
)
def met23(spark, d):
    scored = M.with_mean_ratio(M.with_outcome_divergence(_events_mined(spark, d)))
    return scored.select("key", r9("ratio").alias("ratio"), r9("wlogr").alias("wlogr"))


@query("met24_root_row", f"{SQL_IT} SELECT support_count, {sql_cells_bigint()} FROM it WHERE length = 0")
def met24(spark, d):
    return mined_orders(spark, d).where("length = 0").select("support_count", *CELLS)


# --------------------------------------------------------------- exploration


@query(
    "e2e1_divergence_exploration",
    f"""{sql_with_metric(SQL_IT, ['fpr', 'fnr', 'error'])} SELECT d.key, d.length, {q9('d.support')} AS support,
{q9('d_fpr')} AS d_fpr, {q9('d_fnr')} AS d_fnr, {q9('d_error')} AS d_error, t.t AS t_value_fpr, true AS viz
FROM d JOIN (SELECT i.key, {q9(_sql_t('d_fpr'))} AS t FROM it i, {_R}) t ON d.key = t.key""",
)
def e2e1(spark, d):
    found = E.explore(
        orders_cls(spark, d), ATTRS, SUP, ["d_fpr", "d_fnr", "d_error"], true="cls", predicted="pred",
        classes={"N": 0, "P": 1}, mark="viz",
    )
    return found.select(
        "key", "length", r9("support").alias("support"), r9("d_fpr").alias("d_fpr"), r9("d_fnr").alias("d_fnr"),
        r9("d_error").alias("d_error"), r9("t_value_fpr").alias("t_value_fpr"), "viz",
    )


@query(
    "e2e1_flagship_top_fpr",
    f"""{sql_with_metric(SQL_IT, ['fpr'])} SELECT key, length, {q9('support')} AS support, support_count,
{q9('fpr')} AS fpr, {q9('d_fpr')} AS d_fpr FROM d ORDER BY d.d_fpr DESC, d.fpr DESC, key LIMIT 10""",
)
def flagship(spark, d):
    scored = M.with_divergence(mined_orders(spark, d), ["d_fpr"])
    return top(scored, "d_fpr", 10).select(
        "key", "length", r9("support").alias("support"), "support_count",
        r9("fpr").alias("fpr"), r9("d_fpr").alias("d_fpr"),
    )


RANGES = {
    "acctbal": {
        "<=2000.0": {"rels": ["<="], "vals": [2000.0]},
        "[2000.01-6000.0]": {"rels": [">=", "<="], "vals": [2000.01, 6000.0]},
        ">=6000.01": {"rels": [">="], "vals": [6000.01]},
    }
}
RANGE_EDGES = {"acctbal": {"[2000.01-6000.0]": ">=2000.01", ">=6000.01": ">=2000.01"}}
_ACC = """CASE WHEN acctbal <= 2000.0 THEN '<=2000.0' WHEN acctbal >= 2000.01 AND acctbal <= 6000.0 THEN '[2000.01-6000.0]'
  WHEN acctbal >= 6000.01 THEN '>=6000.01' END"""
_ACC_UP = "CASE WHEN acctbal >= 2000.01 THEN '>=2000.01' END"
SQL_HIER = f"""WITH {SQL_ORDERS}, oh AS (SELECT * EXCLUDE (acctbal), {_ACC} AS acc, coalesce({_ACC_UP}, {_ACC}) AS acc_up FROM ord),
oh2 AS (SELECT *, acc AS acctbal FROM oh)"""


def sql_hier(support, generalize=True, source="oh2"):
    chains = {
        "acctbal": ["acctbal", "CASE WHEN acc_up <> acctbal THEN acc_up END"] if generalize else ["acctbal"],
        "nat": ["nat", "reg", "'WORLD'"] if generalize else ["nat"],
        "seg": ["seg"],
    }
    # a value without an ancestor gives NULL twice; such duplicates are dropped per order
    cols = sorted(chains)
    unnests = ", ".join(f"unnest([{', '.join(chains[a])}, NULL]) u_{a}(v)" for a in cols)
    picks = ", ".join(f"u_{a}.v AS {a}" for a in cols)
    key = ", ".join(f"'{a}=' || {a}" for a in cols)
    length = " + ".join(f"({a} IS NOT NULL)::INT" for a in cols)
    total = f"(SELECT count(*) FROM {source})"
    return f"""{SQL_HIER}, x AS (SELECT DISTINCT o_orderkey, {picks}, tn, fp, fn, tp FROM {source}, {unnests}),
g AS (SELECT {', '.join(cols)}, count(*) n, sum(tn) tn, sum(fp) fp, sum(fn) fn, sum(tp) tp FROM x GROUP BY {', '.join(cols)}),
it AS (SELECT {', '.join(cols)}, concat_ws(', ', {key}) AS key, ({length})::INT AS length, n::DOUBLE / {total} AS support,
  n::BIGINT AS support_count, tn, fp, fn, tp FROM g WHERE n::DOUBLE / {total} >= {support} OR ({length}) = 0)"""


def hier_edges(spark, d):
    return taxonomy.merge(taxonomy.edges_from_dict(spark, RANGE_EDGES), nation_edges(spark, d))


@query(
    "e2e2_hierarchical_exploration",
    f"""{sql_with_metric(sql_hier(0.02), ['fpr', 'accuracy'])} SELECT key, length, support_count, {q9('d_fpr')} AS d_fpr,
{q9('d_accuracy')} AS d_accuracy FROM d""",
)
def e2e2(spark, d):
    found = E.explore_hierarchical(
        orders_cls(spark, d), ["acctbal", "nat", "seg"], RANGES, hier_edges(spark, d), 0.02, ["d_fpr", "d_accuracy"],
        true="cls", predicted="pred", classes={"N": 0, "P": 1},
    )
    return found.select("key", "length", "support_count", r9("d_fpr").alias("d_fpr"), r9("d_accuracy").alias("d_accuracy"))


@query(
    "itm12_generalize_continuous_only",
    f"""{SQL_HIER}, x AS (SELECT DISTINCT o_orderkey, ua.v AS acctbal, un.v AS nat, tn, fp, fn, tp FROM oh2,
  unnest([acctbal, CASE WHEN acc_up <> acctbal THEN acc_up END, NULL]) ua(v), unnest([nat, NULL]) un(v))
SELECT concat_ws(', ', 'acctbal=' || acctbal, 'nat=' || nat) AS key, count(*) AS support_count FROM x GROUP BY acctbal, nat
HAVING count(*)::DOUBLE / (SELECT count(*) FROM ord) >= 0.02""",
)
def itm12(spark, d):
    found = E.explore_hierarchical(
        orders_cls(spark, d), ["acctbal", "nat"], RANGES, hier_edges(spark, d), 0.02, ["d_fpr"],
        true="cls", predicted="pred", classes={"N": 0, "P": 1}, continuous_only=["acctbal"],
    )
    return found.select("key", "support_count")


@query(
    "e2e3_outcome_exploration",
    f"""{_SQL_OUT} SELECT key, length, support_count, {q9('d_outcome')} AS d_outcome, {q9('welch')} AS t_value_outcome FROM p""",
)
def e2e3(spark, d):
    found = E.explore(
        events_outcome(spark, d).drop("y", "y2"), ["etype", "hr"], 0.005, ["d_outcome"], outcome="amount",
        closure=taxonomy.closure(hour_edges(spark)),
    )
    return found.select(
        "key", "length", "support_count", r9("d_outcome").alias("d_outcome"),
        r9("t_value_outcome").alias("t_value_outcome"),
    )


@query(
    "e2e1_labels_error",
    f"""{sql_with_metric(f"WITH {SQL_LABELS}, {sql_itemsets('lab', {'lang': ['lang'], 'source': ['source']}, CELLS, 0.02)}", ['error'])}
SELECT key, length, support_count, {q9('d_error')} AS d_error FROM d""",
)
def e2e1_labels(spark, d):
    found = E.explore(
        labels_cls(spark, d), ["lang", "source"], 0.02, ["d_error"], true="cls", predicted="pred",
        classes={"N": 0, "P": 1},
    )
    return found.select("key", "length", "support_count", r9("d_error").alias("d_error"))


