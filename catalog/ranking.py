"""Queries on itemset tables: selection, marginals, Shapley values, corrections, lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    SQL_IT, SQL_IT_UP, mined_orders_up, orders_cls, q9, query, r9, sql_marginals, sql_subsets,
    sql_with_metric,
)
from catalog.mining import _sql_beta, _sql_t
from subdiv.functions import metrics as M
from subdiv.operators import corrective as R
from subdiv.operators import lattice as L
from subdiv.operators import select as S
from subdiv.operators import shapley as H

ATTRS = ["nat", "prio", "seg"]
_D = sql_with_metric(SQL_IT_UP, ["fpr"])
_M = f"{_D}, {sql_marginals('d', 'd_fpr', ATTRS)}"


def _scored(spark, d, metric="d_fpr"):
    return M.with_divergence(mined_orders_up(spark, d), [metric])


def _marginals(spark, d):
    return S.marginals(_scored(spark, d), "d_fpr")


def _plain(df, metric="d_fpr"):
    return df.select("key", "length", r9(metric).alias(metric))


_PLAIN = f"SELECT key, length, {q9('d_fpr')} AS d_fpr"


@query("sel1_sorted_divergence", f"{_D} {_PLAIN}, {q9('fpr')} AS fpr FROM d ORDER BY d.d_fpr DESC, d.fpr DESC, key")
def sel1(spark, d):
    return S.ranked(_scored(spark, d), "d_fpr").select("key", "length", r9("d_fpr").alias("d_fpr"), r9("fpr").alias("fpr"))


@query("sel1_sorted_absolute", f"{_D} {_PLAIN} FROM d ORDER BY abs(d.d_fpr) DESC, key")
def sel1_abs(spark, d):
    return _plain(S.ranked(_scored(spark, d), "d_fpr", absolute=True))


@query("sel2_top_k", f"{_D} {_PLAIN} FROM d ORDER BY d.d_fpr DESC, d.fpr DESC, key LIMIT 15")
def sel2(spark, d):
    return _plain(S.top(_scored(spark, d), "d_fpr", 15))


@query("sel2_top_k_absolute", f"{_D} {_PLAIN} FROM d ORDER BY abs(d.d_fpr) DESC, key LIMIT 15")
def sel2_abs(spark, d):
    return _plain(S.top(_scored(spark, d), "d_fpr", 15, absolute=True))


@query("sel3_above_threshold", f"{_D} {_PLAIN} FROM d WHERE abs(d.d_fpr) >= 0.03")
def sel3(spark, d):
    return _plain(S.above(_scored(spark, d), "d_fpr", 0.03, absolute=True))


@query("sel3_strictly_above", f"{_D} {_PLAIN} FROM d WHERE d.d_fpr > 0")
def sel3_strict(spark, d):
    return _plain(S.above(_scored(spark, d), "d_fpr", 0.0, strict=True))


@query("sel4_above_threshold_top_k", f"{_D} {_PLAIN} FROM d WHERE d.d_fpr >= 0.02 ORDER BY d.d_fpr DESC, d.fpr DESC, key LIMIT 7")
def sel4(spark, d):
    return _plain(S.above_top(_scored(spark, d), "d_fpr", 0.02, 7))


_WANTED = [["seg=BUILDING"], ["seg=BUILDING", "nat=ASIA"], ["prio=5-LOW"], []]


@query(
    "sel5_point_lookup",
    f"{_D} {_PLAIN}, t AS t_value_fpr FROM (SELECT d.*, t.t FROM d JOIN (SELECT i.key AS k, {q9(_sql_t('d_fpr'))} AS t FROM it i, (SELECT * FROM it WHERE length = 0) r) t ON k = key) "
    "WHERE key IN ('seg=BUILDING', 'nat=ASIA, seg=BUILDING', 'prio=5-LOW', '')",
)
def sel5(spark, d):
    found = S.lookup(_scored(spark, d), _WANTED)
    return found.select("key", "length", r9("d_fpr").alias("d_fpr"), r9("t_value_fpr").alias("t_value_fpr"))


@query(
    "sel6_by_length",
    f"{_D} SELECT length, count(*)::BIGINT AS itemsets, {q9('min(d_fpr)')} AS min, {q9('max(d_fpr)')} AS max FROM d GROUP BY length",
)
def sel6(spark, d):
    return S.by_length(_scored(spark, d), "d_fpr").select("length", "itemsets", r9("min").alias("min"), r9("max").alias("max"))


def _m9(df):
    return df.select(
        "item", "s_key", "si_key", r9("v_i").alias("v_i"), r9("v_s").alias("v_s"), r9("v_si").alias("v_si"), r9("delta").alias("delta")
    )


_M9 = f"SELECT item, s_key, si_key, {q9('v_i')} AS v_i, {q9('v_s')} AS v_s, {q9('v_si')} AS v_si, {q9('delta')} AS delta"


@query("sel7_marginals", f"{_M} {_M9} FROM m")
def sel7(spark, d):
    return _m9(_marginals(spark, d))


@query("sel8_not_redundant", f"{_M} {_PLAIN} FROM d WHERE key NOT IN (SELECT si_key FROM m WHERE abs(delta) <= 0.01)")
def sel8(spark, d):
    return _plain(S.not_redundant(_scored(spark, d), "d_fpr", 0.01))


@query("sel8_not_redundant_exact", f"{_M} {_PLAIN} FROM d WHERE key NOT IN (SELECT si_key FROM m WHERE abs(delta) <= 0)")
def sel8_exact(spark, d):
    return _plain(S.not_redundant(_scored(spark, d), "d_fpr", 0.0))


@query("sel9_redundant_marginals", f"{_M} {_M9} FROM m WHERE abs(delta) <= 0.005")
def sel9(spark, d):
    return _m9(S.redundant_marginals(_scored(spark, d), "d_fpr", 0.005))


@query(
    "sel10_minimal_itemsets",
    f"{_D}, {sql_subsets('d', ATTRS)} {_PLAIN} FROM d WHERE key NOT IN (SELECT u.key FROM sub u JOIN d a ON a.key = u.key "
    "JOIN d b ON b.key = u.subset_key WHERE u.subset_length < u.length AND a.d_fpr IS NOT DISTINCT FROM b.d_fpr)",
)
def sel10(spark, d):
    return _plain(S.minimal(_scored(spark, d), "d_fpr"))


@query(
    "sel11_strongest_marginals",
    f"""{_M}, lo AS (SELECT item, min(delta) x FROM m WHERE delta < 0 GROUP BY item), hi AS (SELECT item, max(delta) x FROM m WHERE delta > 0 GROUP BY item)
SELECT 'negative' AS sign, m.item, s_key, {q9('delta')} AS delta FROM m JOIN lo ON lo.item = m.item AND delta = x
UNION ALL SELECT 'positive', m.item, s_key, {q9('delta')} FROM m JOIN hi ON hi.item = m.item AND delta = x""",
)
def sel11(spark, d):
    m = _marginals(spark, d)
    low, high = S.strongest_negative(m), S.strongest_positive(m)
    both = low.withColumn("sign", F.lit("negative")).unionByName(high.withColumn("sign", F.lit("positive")))
    return both.select("sign", "item", "s_key", r9("delta").alias("delta"))


_STATS = f"""{_M}, st AS (SELECT item, avg(delta) AS mean, stddev_samp(delta) AS std, count(*)::BIGINT AS count, min(delta) AS lo, max(delta) AS hi,
avg(delta * delta) AS mse, sum(delta * delta) AS sse FROM m GROUP BY item)"""


@query(
    "sel12_marginal_statistics",
    f"""{_STATS} SELECT item, {q9('mean')} AS mean, {q9('std')} AS std, count, {q9('lo')} AS delta_min, {q9('hi')} AS delta_max, {q9('mse')} AS mse, {q9('sse')} AS sse,
(SELECT min(s_key) FROM m WHERE m.item = st.item AND delta = lo) AS s_min, (SELECT count(*) FROM m WHERE m.item = st.item AND delta = lo)::BIGINT AS count_min,
(SELECT min(s_key) FROM m WHERE m.item = st.item AND delta = hi) AS s_max, (SELECT count(*) FROM m WHERE m.item = st.item AND delta = hi)::BIGINT AS count_max,
{q9('CASE WHEN abs(lo) > abs(hi) THEN lo ELSE hi END')} AS delta_abs_max FROM st""",
)
def sel12(spark, d):
    stats = S.sort_statistics(S.marginal_statistics(_marginals(spark, d)))
    rounded = ["mean", "std", "delta_min", "delta_max", "mse", "sse", "delta_abs_max"]
    return stats.select("item", "count", "s_min", "count_min", "s_max", "count_max", *[r9(c).alias(c) for c in rounded])


@query("sel13_immediate_supersets", f"{_M} SELECT s_key, string_agg(si_key, ' | ' ORDER BY si_key) AS supersets FROM m_w GROUP BY s_key")
def sel13(spark, d):
    return S.supersets(_scored(spark, d), "d_fpr").select("s_key", F.array_join("supersets", " | ").alias("supersets"))


@query("sel14_run_summary", f"{_D} SELECT {q9('max(d_fpr)')} AS max_divergence, count(*)::BIGINT AS itemsets FROM d")
def sel14(spark, d):
    out = S.run_summary(_scored(spark, d), "d_fpr")
    return out.select(r9("max_divergence").alias("max_divergence"), "itemsets")


@query(
    "sel15_itemsets_with_item",
    f"{_D} SELECT 'with' AS kind, key, {q9('d_fpr')} AS d_fpr FROM d WHERE seg = 'BUILDING' UNION ALL SELECT 'single', key, {q9('d_fpr')} FROM d WHERE key IN ('seg=BUILDING', 'nat=ASIA')",
)
def sel15(spark, d):
    scored = _scored(spark, d)
    a = S.containing(scored, "seg=BUILDING").withColumn("kind", F.lit("with"))
    b = S.singles_of(scored, ["seg=BUILDING", "nat=ASIA"]).withColumn("kind", F.lit("single"))
    return a.unionByName(b).select("kind", "key", r9("d_fpr").alias("d_fpr"))


_SLICES = [{"seg": "BUILDING"}, {"seg": "BUILDING", "prio": "5-LOW"}, {"nat": "NATION_3", "prio": None}, {"seg": "MACHINERY", "prio": "1-URGENT"}]


@query(
    "sel16_slice_error_rates",
    f"""{SQL_IT} SELECT slice, rows, errors, {q9('errors::DOUBLE / rows')} AS error_rate FROM (
SELECT s.i AS slice, count(*)::BIGINT AS rows, sum((cls <> pred)::INT)::BIGINT AS errors FROM ord,
 (VALUES (0, 'BUILDING', NULL, NULL), (1, 'BUILDING', '5-LOW', NULL), (2, NULL, NULL, 'NATION_3'), (3, 'MACHINERY', '1-URGENT', NULL)) s(i, a, b, c)
WHERE (a IS NULL OR seg = a) AND (b IS NULL OR prio = b) AND (c IS NULL OR nat = c) GROUP BY s.i)""",
)
def sel16(spark, d):
    out = S.slice_error_rates(orders_cls(spark, d), _SLICES, "cls", "pred")
    return out.select("slice", "rows", "errors", r9("error_rate").alias("error_rate"))


@query(
    "sel17_best_setting",
    f"""{_D} SELECT length, key, {q9('best')} AS d_fpr FROM (SELECT length, arg_min(key, (-d_fpr, key)) AS key, max(d_fpr) AS best FROM
(SELECT length, key, d_fpr FROM d) GROUP BY length)""".replace("(-d_fpr, key)", "{'a': -d_fpr, 'b': key}"),
)
def sel17(spark, d):
    out = S.best_setting(_scored(spark, d), ["length"], "key", "d_fpr")
    return out.select("length", "key", r9("d_fpr").alias("d_fpr"))


@query(
    "sel7_missing_subsets",
    f"{_M}, kept AS (SELECT key FROM d WHERE d_fpr > -0.05) SELECT count(*)::BIGINT AS missing FROM m_w "
    "WHERE si_key IN (SELECT key FROM kept) AND s_key NOT IN (SELECT key FROM kept)",
)
def sel7_missing(spark, d):
    """Marginals that a thresholded table cannot answer."""
    return S.missing_subsets(S.above(_scored(spark, d), "d_fpr", -0.05, strict=True), "d_fpr")


# ------------------------------------------------------------------ Shapley

_W = "(CASE WHEN inside THEN factorial(sl - 1) * factorial(n - sl) ELSE factorial(sl) * factorial(n - sl - 1) END)::DOUBLE / factorial(n)"


def _sql_local(source="d", metric="d_fpr"):
    rows = " UNION ALL ".join(
        f"SELECT u.key, '{a}=' || u.{a} AS item, u.length AS n, u.subset_length AS sl, v.{metric} AS v, "
        f"contains(', ' || u.subset_key || ', ', ', {a}=' || u.{a} || ', ') AS inside "
        f"FROM sub u JOIN {source} v ON v.key = u.subset_key WHERE u.{a} IS NOT NULL"
        for a in ATTRS
    )
    return f"""{sql_subsets(source, ATTRS)}, sr AS ({rows}),
sh AS (SELECT key, item, sum(CASE WHEN inside THEN {_W} * v ELSE -({_W}) * v END) AS shapley FROM sr GROUP BY key, item)"""


@query("shp1_local_shapley", f"{_D}, {_sql_local()} SELECT key, item, {q9('shapley')} AS shapley FROM sh")
def shp1(spark, d):
    return H.local_shapley(_scored(spark, d), "d_fpr").select("key", "item", r9("shapley").alias("shapley"))


_A = "(SELECT count(*) FROM (SELECT DISTINCT split_part(item, '=', 1) FROM m))"
_CARD = """card AS (SELECT split_part(key, '=', 1) AS attr, count(*)::DOUBLE AS c FROM d WHERE length = 1 GROUP BY 1)"""


def _sql_global():
    prod = " * ".join(f"coalesce((SELECT c FROM card WHERE attr = '{a}' AND x.{a} IS NOT NULL), 1)" for a in ATTRS)
    return f"""{_M}, {_CARD}, gl AS (SELECT m.item AS key, sum(m.delta * factorial(s_length) * factorial(3 - s_length - 1) / (factorial(3) * ({prod}))) AS shapley
FROM m JOIN d x ON x.key = m.si_key GROUP BY m.item)"""


@query("shp2_global_shapley", f"{_sql_global()} SELECT key, {q9('shapley')} AS shapley FROM gl")
def shp2(spark, d):
    return H.global_shapley(_scored(spark, d), "d_fpr").select("key", r9("shapley").alias("shapley"))


_PAIR_TARGETS = [["nat=ASIA", "seg=BUILDING"], ["nat=ASIA", "prio=5-LOW"]]


@query(
    "shp3_global_shapley_of_itemsets",
    f"""{_D}, {_CARD}, k AS (SELECT key, nat, prio, seg, d_fpr, length, 'nat=ASIA, seg=BUILDING' AS t, CASE WHEN prio IS NULL THEN '' ELSE 'prio=' || prio END AS j FROM d WHERE nat = 'ASIA' AND seg = 'BUILDING'
 UNION ALL SELECT key, nat, prio, seg, d_fpr, length, 'nat=ASIA, prio=5-LOW', CASE WHEN seg IS NULL THEN '' ELSE 'seg=' || seg END FROM d WHERE nat = 'ASIA' AND prio = '5-LOW')
SELECT t AS key, {q9('''sum((k.d_fpr - j.d_fpr) * factorial(k.length - 2) * factorial(3 - (k.length - 2) - 2) / (factorial(3) *
 (SELECT c FROM card WHERE attr = 'nat') * CASE WHEN k.prio IS NULL THEN 1 ELSE (SELECT c FROM card WHERE attr = 'prio') END * CASE WHEN k.seg IS NULL THEN 1 ELSE (SELECT c FROM card WHERE attr = 'seg') END))''')} AS shapley
FROM k JOIN d j ON j.key = k.j GROUP BY t""",
)
def shp3(spark, d):
    return H.global_shapley(_scored(spark, d), "d_fpr", _PAIR_TARGETS).select("key", r9("shapley").alias("shapley"))


@query(
    "shp4_mean_over_supersets",
    f"""{_M}, ns AS (SELECT count(*) AS n FROM d WHERE length = 1) SELECT item AS key,
round(sum(delta * CASE s_length WHEN 0 THEN 1.0 / n WHEN 1 THEN 1.0 / (n * (n - 1)) ELSE 2.0 / (n * (n - 1) * (n - 2)) END), 9) + 0.0 AS shapley FROM m, ns GROUP BY item""",
)
def shp4(spark, d):
    scored = _scored(spark, d)
    n = scored.where("length = 1").count()
    return H.mean_shapley(S.marginals(scored, "d_fpr"), n).select("key", (F.round("shapley", 9) + 0.0).alias("shapley"))


@query("shp5_normalized_shapley", f"{_sql_global()} SELECT key, {q9('shapley / (SELECT max(abs(shapley)) FROM gl)')} AS shapley FROM gl")
def shp5(spark, d):
    found = H.global_shapley(_scored(spark, d), "d_fpr")
    return H.normalized(found).select("key", r9("shapley").alias("shapley"))


@query(
    "shp6_compared_shapley",
    f"""{sql_with_metric(SQL_IT_UP, ['fpr', 'error'])}, {_sql_local('d', 'd_fpr')}, sr2 AS (SELECT r.key, r.item, r.n, r.sl, r.inside, d.d_error AS v FROM
 ({' UNION ALL '.join(f"SELECT u.key, '{a}=' || u.{a} AS item, u.length AS n, u.subset_length AS sl, u.subset_key, contains(', ' || u.subset_key || ', ', ', {a}=' || u.{a} || ', ') AS inside FROM sub u WHERE u.{a} IS NOT NULL" for a in ATTRS)}) r JOIN d ON d.key = r.subset_key),
sh2 AS (SELECT key, item, sum(CASE WHEN inside THEN {_W} * v ELSE -({_W}) * v END) AS shapley FROM sr2 GROUP BY key, item)
SELECT a.item, {q9('a.shapley')} AS first, {q9('b.shapley')} AS second FROM sh a JOIN sh2 b ON a.key = b.key AND a.item = b.item WHERE a.key = 'nat=ASIA, seg=BUILDING'""",
)
def shp6(spark, d):
    scored = M.with_divergence(mined_orders_up(spark, d), ["d_fpr", "d_error"])
    target = [["seg=BUILDING", "nat=ASIA"]]
    both = H.compare(H.local_shapley(scored, "d_fpr", target), H.local_shapley(scored, "d_error", target), "second")
    return both.select("item", r9("first").alias("first"), r9("second").alias("second"))


# --------------------------------------------------------------- corrections

_C = f"{_M}, c AS (SELECT *, abs(v_si) - abs(v_s) AS cc, v_si * v_si - v_s * v_s AS cs FROM m WHERE abs(v_si) - abs(v_s) < 0)"


@query(
    "cor1_corrective_items",
    f"{_C} SELECT item, s_key, si_key, {q9('cc')} AS corr_coef, {q9('cs')} AS corr_coef_sq FROM c",
)
def cor1(spark, d):
    out = R.corrective_items(_marginals(spark, d))
    return out.select("item", "s_key", "si_key", r9("corr_coef").alias("corr_coef"), r9("corr_coef_sq").alias("corr_coef_sq"))


@query(
    "cor2_strongest_corrections",
    f"{_C} SELECT c.item, s_key, {q9('cc')} AS corr_coef FROM c JOIN (SELECT item, min(cc) AS x FROM c GROUP BY item) b ON b.item = c.item AND cc = x",
)
def cor2(spark, d):
    out = R.strongest(R.corrective_items(_marginals(spark, d)))
    return out.select("item", "s_key", r9("corr_coef").alias("corr_coef"))


@query(
    "cor3_correction_statistics",
    f"""{_C}, s AS (SELECT item, avg(cc) mean, stddev_samp(cc) std, count(*) n, min(cc) lo, max(cc) hi, avg(delta * delta) mse, sum(delta * delta) sse FROM c GROUP BY item),
t AS (SELECT item, count(*) tot FROM m GROUP BY item)
SELECT s.item, (SELECT min(s_key) FROM c WHERE c.item = s.item AND cc = lo) AS s_min, {q9('lo')} AS corr_coef_min,
(SELECT min(s_key) FROM c WHERE c.item = s.item AND cc = hi) AS s_max, {q9('hi')} AS corr_coef_max, {q9('mean')} AS mean, {q9('std')} AS std,
n::BIGINT AS count, tot::BIGINT AS tot, {q9('n::DOUBLE / tot')} AS share, {q9('mse')} AS mse, {q9('sse')} AS sse FROM s JOIN t USING (item)""",
)
def cor3(spark, d):
    m = _marginals(spark, d)
    out = R.statistics(R.corrective_items(m), m)
    rounded = ["corr_coef_min", "corr_coef_max", "mean", "std", "share", "mse", "sse"]
    return out.select("item", "s_min", "s_max", "count", "tot", *[r9(c).alias(c) for c in rounded])


def _sql_cor4():
    ma, va = _sql_beta("d_fpr", "a.")
    mb, vb = _sql_beta("d_fpr", "b.")
    return f"""{_C}, ct AS (SELECT c.*, abs({ma} - {mb}) / sqrt({va} + {vb}) AS tc, {_sql_t('d_fpr').replace('i.', 'b.')} AS tsi, abs(v_s) - abs(v_si) AS factor
FROM c JOIN it a ON a.key = c.s_key JOIN it b ON b.key = c.si_key, (SELECT * FROM it WHERE length = 0) r)"""


def _cor4(spark, d):
    scored = _scored(spark, d)
    return R.significance(R.corrective_items(S.marginals(scored, "d_fpr")), scored, "d_fpr")


@query(
    "cor4_correction_t_values",
    f"{_sql_cor4()} SELECT item, s_key, {q9('tc')} AS t_value_corr, {q9('tsi')} AS t_value_si, {q9('factor')} AS corr_factor FROM ct",
)
def cor4(spark, d):
    return _cor4(spark, d).select(
        "item", "s_key", r9("t_value_corr").alias("t_value_corr"), r9("t_value_si").alias("t_value_si"),
        r9("corr_factor").alias("corr_factor"),
    )


@query("cor5_significant_corrections", f"{_sql_cor4()} SELECT item, s_key, {q9('tc')} AS t_value_corr, (v_s > 0) AS positive FROM ct WHERE tc > 2")
def cor5(spark, d):
    rows = _cor4(spark, d)
    positive = R.significant(rows, positive_only=True).select("item", "s_key", F.lit(True).alias("positive"))
    out = R.significant(rows).join(positive, ["item", "s_key"], "left")
    return out.select("item", "s_key", r9("t_value_corr").alias("t_value_corr"), F.coalesce("positive", F.lit(False)).alias("positive"))


@query(
    "cor6_corrected_itemsets",
    f"{_sql_cor4()} SELECT si_key AS key, {q9('min(cc)')} AS corr_coef FROM ct WHERE tc > 1 GROUP BY si_key",
)
def cor6(spark, d):
    out = R.corrected_itemsets(_scored(spark, d), R.significant(_cor4(spark, d), at_least=1.0))
    return out.select("key", r9("corr_coef").alias("corr_coef"))


# ------------------------------------------------------------------ lattices

_TARGETS = [["nat=ASIA", "prio=1-URGENT", "seg=BUILDING"], ["nat=WORLD", "prio=5-LOW", "seg=MACHINERY"]]
_LAT = f"""{_D}, {sql_subsets('d', ATTRS)}, nodes AS (SELECT u.key AS lattice, v.key, v.nat, v.prio, v.seg, v.length, v.d_fpr AS value, round_even(v.d_fpr, 4) AS rounded
FROM sub u JOIN d v ON v.key = u.subset_key WHERE u.key IN ('nat=ASIA, prio=1-URGENT, seg=BUILDING', 'nat=WORLD, prio=5-LOW, seg=MACHINERY')),
edges AS (SELECT a.lattice, a.key AS parent, b.key AS child, b.value < a.value AS lower FROM nodes a JOIN nodes b ON a.lattice = b.lattice AND b.length = a.length + 1
 AND (a.nat IS NULL OR a.nat = b.nat) AND (a.prio IS NULL OR a.prio = b.prio) AND (a.seg IS NULL OR a.seg = b.seg))"""


def _lattice(spark, d):
    return L.nodes(_scored(spark, d), "d_fpr", _TARGETS)


@query("lat1_lattice_nodes", f"{_LAT} SELECT lattice, key, {q9('rounded')} AS rounded FROM nodes")
def lat1(spark, d):
    return _lattice(spark, d).select("lattice", "key", r9("rounded").alias("rounded"))


@query("lat1_lattice_edges", f"{_LAT} SELECT lattice, parent, child, lower FROM edges")
def lat1_edges(spark, d):
    return L.edges(_lattice(spark, d))


@query("lat2_lower_nodes", f"{_LAT} SELECT DISTINCT lattice, child AS key FROM edges WHERE lower")
def lat2(spark, d):
    return L.lower_nodes(L.edges(_lattice(spark, d)))


_SUBSET = "a.lattice = b.lattice AND (b.nat IS NULL OR b.nat = a.nat) AND (b.prio IS NULL OR b.prio = a.prio) AND (b.seg IS NULL OR b.seg = a.seg)"


@query(
    "lat3_node_groups",
    f"""{_LAT}, hi AS (SELECT * FROM nodes WHERE abs(rounded) >= 0.01), lo AS (SELECT * FROM nodes WHERE abs(rounded) < 0.01),
solid AS (SELECT * FROM hi b WHERE NOT EXISTS (SELECT 1 FROM lo a WHERE {_SUBSET})),
small AS (SELECT * FROM solid a WHERE NOT EXISTS (SELECT 1 FROM solid b WHERE b.key <> a.key AND {_SUBSET})),
low AS (SELECT DISTINCT lattice, child AS key FROM edges WHERE lower),
found AS (SELECT lattice, key, 'greater' AS "group" FROM hi UNION ALL SELECT lattice, key, 'all_greater' FROM small UNION ALL SELECT lattice, key, 'lower' FROM low)
SELECT * FROM found UNION ALL SELECT lattice, key, 'normal' FROM nodes WHERE (lattice, key) NOT IN (SELECT (lattice, key) FROM found)""",
)
def lat3(spark, d):
    n = _lattice(spark, d)
    return L.groups(n, 0.01, L.lower_nodes(L.edges(n)))


