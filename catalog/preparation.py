"""Sources, sinks and table preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import (
    SQL_LABELS, SQL_ORDERS, labels_cls, lineitem_cls, nation_edges, nation_region, orders_cls, q9, query, r9,
    scratch, table,
)
from subdiv.functions.cells import class_map, log_loss, with_cells, with_outcome
from subdiv.functions.metrics import CELLS
from subdiv.operators import prepare as P
from subdiv.operators import taxonomy
from subdiv.sources import tables as S

# ----------------------------------------------------------- sources, sinks

_CUST = "c_custkey bigint, c_mktsegment string, c_acctbal double"


@query("src1_csv_scan", "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def src1(spark, d):
    """Customers through a semicolon file whose missing values read ``?``."""
    path = scratch(spark, "customer-csv")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    text = F.when(F.col("c_mktsegment") == "BUILDING", "?").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    c.withColumn("c_mktsegment", text).write.option("sep", ";").option("ignoreLeadingWhiteSpace", False).csv(path)
    return S.read_csv(spark, path, _CUST, header=False, sep=";", na="?")


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
           "pages", "benchmark", "labels", "conversations"]


@query(
    "src2_available_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS rows FROM {t}" for t in _TABLES),
)
def src2(spark, d):
    paths = [f"{d.rstrip('/')}/{t}.parquet" for t in _TABLES]
    S.require(spark, *paths)
    counts = [
        spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("name"), "rows")
        for t, p in zip(_TABLES, paths)
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "src3_country_table",
    """SELECT c_custkey::INT AS id, c_name AS country, n_name AS region1, r_name AS continent
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def src3(spark, d):
    """A taxonomy file in the layout of the country table: customer, nation, region."""
    path = scratch(spark, "countries")
    rows = table(spark, d, "customer").join(nation_region(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("string")
    S_rows = rows.select("c_custkey", "c_name", none.alias("iso3"), none.alias("m49"), "n_name", none.alias("r2"), "r_name")
    S_rows.write.csv(path)
    return S.read_country_table(spark, path).select("id", "country", "region1", "continent")


@query(
    "src4_taxonomy_json",
    """SELECT DISTINCT 'nat' AS attr, n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT DISTINCT 'nat', r_name, 'WORLD' FROM region JOIN nation ON n_regionkey = r_regionkey""",
)
def src4(spark, d):
    path = scratch(spark, "taxonomy")
    taxonomy.write_json(nation_edges(spark, d), path)
    return taxonomy.edges_from_json(spark, path, lines=True)


@query("snk1_csv_sink", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def snk1(spark, d):
    path = scratch(spark, "orders-csv")
    S.write_csv(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return S.read_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


# ------------------------------------------------------------------ recodes

_STATUS = {"F": "done", "O": "open"}


@query(
    "prp1_recode",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus,
'P' || regexp_extract(o_orderpriority, '^[0-9]') AS prio FROM orders""",
)
def prp1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    long = {n: f"P{n[0]}" for n in names} | {f"unused {i}": "x" for i in range(100)}
    out = P.recode(P.recode(o, "o_orderstatus", _STATUS), "o_orderpriority", long, to="prio")
    return out.drop("o_orderpriority")


@query(
    "prp2_filters",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderpriority NOT IN ('5-LOW', '3-MEDIUM')",
)
def prp2(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 1000")
    return P.exclude(P.drop_nulls(o, ["o_orderstatus"]), "o_orderpriority", ["5-LOW", "3-MEDIUM"]).select(
        "o_orderkey", "o_totalprice"
    )


@query("prp3_null_to_text", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NaN' ELSE o_orderstatus END AS status FROM orders")
def prp3(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return P.fill_text(o, ["status"])


@query("prp4_rename_drop_select", "SELECT o_totalprice AS price, o_orderkey FROM orders")
def prp4(spark, d):
    return P.reshape(table(spark, d, "orders"), {"o_totalprice": "price"}, ["o_orderdate"], ["price", "o_orderkey"])


@query(
    "prp5_stack",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
)
def prp5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return P.stack(o.where("o_orderstatus = 'F'").select("o_orderstatus", "o_orderkey"), o.where("o_orderstatus <> 'F'"))


@query(
    "prp6_days_between",
    """SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INT AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def prp6(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", P.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days")
    )


@query(
    "prp7_label_threshold",
    """SELECT p_partkey, CASE WHEN p_size >= 8 THEN 'High' ELSE 'Low' END AS size_class,
CASE WHEN p_size >= 5 THEN 'Medium-High' ELSE 'Low' END AS size_class2, CASE WHEN p_size > 5 THEN 'good' ELSE 'bad' END AS quality FROM part""",
)
def prp7(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        P.threshold_label(size, 8, "High", "Low").alias("size_class"),
        P.threshold_label(size, 5, "Medium-High", "Low").alias("size_class2"),
        P.above_label(size, 5, "good", "bad").alias("quality"),
    )


@query(
    "prp8_expert_bins",
    """SELECT p_partkey, CASE WHEN x <= 0 THEN '0' WHEN x BETWEEN 1 AND 3 THEN '[1,3]' ELSE '>3' END AS prior,
CASE WHEN y <= 7 THEN '<week' WHEN y > 8 AND y <= 93 THEN '1w-3M' ELSE '>3Months' END AS stay,
CASE WHEN p_size < 25 THEN '<25' WHEN p_size < 45 THEN '[25-45]' ELSE '>45' END AS age
FROM (SELECT *, p_size % 6 AS x, p_size * 3.0 / 2 AS y FROM part)""",
)
def prp8(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        P.prior_count_bin(size % 6).alias("prior"),
        P.stay_length_bin(size * 3.0 / 2).alias("stay"),
        P.age_bin(size).alias("age"),
    )


@query(
    "prp9_edge_bins",
    """SELECT p_partkey, CASE WHEN p_size <= 10 THEN '<=10' ELSE '>10' END AS one,
CASE WHEN p_size <= 10 THEN '<=10' WHEN p_size < 20 THEN '(10-20)' ELSE '>=20' END AS two,
CASE WHEN p_size <= 10 THEN '<=10' WHEN p_size < 20 THEN '(10-20)' WHEN p_size < 30 THEN '[20-30)' ELSE '>=30' END AS three FROM part""",
)
def prp9(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", P.edge_bin(size, [10]).alias("one"), P.edge_bin(size, [10, 20]).alias("two"),
        P.edge_bin(size, [10, 20, 30]).alias("three"),
    )


@query(
    "prp10_zero_low_high",
    """WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) AS med FROM customer WHERE c_acctbal > 0)
SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN '0' WHEN c_acctbal <= med THEN 'Low' ELSE 'High' END AS balance FROM customer, m""",
)
def prp10(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    return P.zero_low_high(c, ["balance"])


# --------------------------------------------------------------------- bins


def _sql_bins(col, src, bins, digits, key):
    inner = ", ".join(f"round_even(quantile_cont({col}, {i}.0 / {bins}), {digits}) AS e{i}" for i in range(1, bins))
    whens = [f"WHEN {col} <= e1 THEN '<=' || printf('%.{digits}f', e1)"]
    for i in range(2, bins):
        whens.append(
            f"WHEN {col} <= e{i} THEN '(' || printf('%.{digits}f', e{i - 1}) || '-' || printf('%.{digits}f', e{i}) || ']'"
        )
    last = f"ELSE '>' || printf('%.{digits}f', e{bins - 1}) END"
    return f"SELECT {key}, CASE {' '.join(whens)} {last} AS {col} FROM {src}, (SELECT {inner} FROM {src})"


@query("prp11_quantile_bins", _sql_bins("o_totalprice", "orders", 4, 0, "o_orderkey, o_orderstatus"))
def prp11(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return P.bin_columns(o, ["o_totalprice"], bins=4)[0]


@query(
    "prp12_uniform_bins",
    """WITH e AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
f AS (SELECT round_even(lo + (hi - lo) * 1 / 3, 1) AS e1, round_even(lo + (hi - lo) * 2 / 3, 1) AS e2 FROM e)
SELECT o_orderkey, CASE WHEN o_totalprice <= e1 THEN '<=' || printf('%.1f', e1) WHEN o_totalprice <= e2 THEN '(' || printf('%.1f', e1) || '-' || printf('%.1f', e2) || ']'
ELSE '>' || printf('%.1f', e2) END AS o_totalprice FROM orders, f""",
)
def prp12(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return P.bin_columns(o, ["o_totalprice"], bins=3, strategy="uniform", round_v=1)[0]


@query(
    "prp13_adaptive_bins",
    """WITH g AS (SELECT b, i, round_even(CASE b WHEN 3 THEN quantile_cont(t, [1.0/3, 2.0/3])[i] WHEN 4 THEN quantile_cont(t, [0.25, 0.5, 0.75])[i]
  WHEN 5 THEN quantile_cont(t, [0.2, 0.4, 0.6, 0.8])[i] WHEN 6 THEN quantile_cont(t, [1.0/6, 2.0/6, 3.0/6, 4.0/6, 5.0/6])[i]
  ELSE quantile_cont(t, [1.0/7, 2.0/7, 3.0/7, 4.0/7, 5.0/7, 6.0/7])[i] END, 0) AS e
  FROM (SELECT list(t) AS l FROM (SELECT floor(l_tax * 100 / 3) + l_quantity / 100 AS t FROM lineitem)) q,
  (SELECT floor(l_tax * 100 / 3) + l_quantity / 100 AS t FROM lineitem), (VALUES (3), (4), (5), (6), (7)) v(b), generate_series(1, 6) s(i)
  WHERE i < b GROUP BY b, i),
n AS (SELECT b, count(DISTINCT e) + 1 AS bins, list_sort(list(DISTINCT e)) AS edges FROM g GROUP BY b),
c AS (SELECT edges FROM n ORDER BY (bins <> 3), b LIMIT 1)
SELECT 't' AS attr, u.pos::INT AS pos, edges[u.pos] AS edge FROM c, (SELECT unnest(range(1, len(edges) + 1)) AS pos FROM c) u""",
)
def prp13(spark, d):
    t = (F.floor(F.col("l_tax") * 100 / 3) + F.col("l_quantity") / 100).alias("t")
    found = P.bin_edges(table(spark, d, "lineitem").select(t), ["t"], bins=3, adaptive=True)
    rows = [(a, i + 1, float(e)) for a, f in found.items() for i, e in enumerate(f["edges"])]
    return spark.createDataFrame(rows, "attr string, pos int, edge double")


@query(
    "prp14_bin_edges",
    """SELECT 'o_totalprice' AS attr, u.pos::INT AS pos, u.edge FROM (SELECT unnest([min(o_totalprice), round_even(quantile_cont(o_totalprice, 0.25), 0), round_even(quantile_cont(o_totalprice, 0.5), 0),
round_even(quantile_cont(o_totalprice, 0.75), 0), max(o_totalprice)]) AS edge, unnest([1, 2, 3, 4, 5]) AS pos FROM orders) u""",
)
def prp14(spark, d):
    o = table(spark, d, "orders").select("o_totalprice")
    edges = P.bin_columns(o, ["o_totalprice"], bins=4)[1]
    return edges.select("attr", F.posexplode("edges").alias("pos", "edge")).withColumn("pos", F.col("pos") + 1)


@query(
    "prp15_discretize",
    f"""WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) FILTER (WHERE c_acctbal > 0) AS med FROM customer),
q AS ({_sql_bins('o_totalprice', 'orders', 4, 0, 'o_orderkey')})
SELECT o.o_orderkey, CASE WHEN o_custkey % 50 < 25 THEN '<25' WHEN o_custkey % 50 < 45 THEN '[25-45]' ELSE '>45' END AS age,
CASE WHEN c_acctbal <= 0 THEN '0' WHEN c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.5) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0) THEN 'Low' ELSE 'High' END AS gain,
q.o_totalprice AS price FROM orders o JOIN customer ON o_custkey = c_custkey JOIN q ON q.o_orderkey = o.o_orderkey, m""",
)
def prp15(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("age"), F.col("c_acctbal").alias("gain"),
        F.col("o_totalprice").alias("price"),
    )
    return P.discretize(rows, 4, ["price"], expert={"age": P.age_bin}, zero_split=["gain"])


@query(
    "prp16_bin_count_check",
    f"WITH q AS ({_sql_bins('o_totalprice', 'orders', 5, 0, 'o_orderkey')}) SELECT 'o_totalprice' AS attr, count(DISTINCT o_totalprice)::BIGINT AS bins FROM q",
)
def prp16(spark, d):
    binned = P.bin_columns(table(spark, d, "orders").select("o_totalprice"), bins=5)[0]
    P.check_bin_counts(binned, 5, ["o_totalprice"])
    return P.bin_counts(binned, ["o_totalprice"])


@query(
    "prp17_continuous_attributes",
    "SELECT x.attr, x.total FROM (SELECT sum(quantity) q, sum(discount) di, sum(tax) t, sum(price) p FROM (SELECT l_quantity AS quantity, (l_discount * 100)::BIGINT AS discount, (l_tax * 100)::BIGINT AS tax, (l_extendedprice * 100)::BIGINT AS price FROM lineitem JOIN part ON l_partkey = p_partkey)) s, (VALUES ('quantity', 1), ('discount', 2), ('tax', 3), ('price', 4)) v(attr, i), LATERAL (SELECT v.attr, CASE i WHEN 1 THEN q::BIGINT WHEN 2 THEN di::BIGINT WHEN 3 THEN t::BIGINT ELSE p::BIGINT END AS total) x",
)
def prp17(spark, d):
    """Sums of the columns found to be continuous (in cents where they have fractions)."""
    rows = lineitem_cls(spark, d)
    found = P.continuous_attributes(rows, exclude=("cls", "pred", *CELLS))
    scale = {"quantity": 1}
    sums = rows.agg(*[F.sum(F.round(F.col(c) * scale.get(c, 100)).cast("bigint")).alias(c) for c in found])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).alias("total")) for c in found])).alias("x")).select("x.*")


@query(
    "prp18_dataset_profile",
    """SELECT 'orders' AS dataset, count(*)::BIGINT AS instances, 5::BIGINT AS attributes, 3::BIGINT AS numerical, 2::BIGINT AS nominal FROM orders
UNION ALL SELECT 'part', count(*), 5, 3, 2 FROM part""",
)
def prp18(spark, d):
    return P.stack(
        P.profile(table(spark, d, "orders"), "orders", ["o_orderstatus"]),
        P.profile(table(spark, d, "part"), "part", ["p_type"]),
    )


_FEATURES = ["lang", "source", "n_chars"]


def _labelled(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", *_FEATURES), "doc_id")


@query("prp19_out_of_fold_predictions")
def prp19(spark, d):
    scored = P.out_of_fold(_labelled(spark, d), "quality", _FEATURES, "doc_id", folds=10, trees=100)
    return with_cells(scored, "quality", "predicted", {"N": 0, "P": 1}).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in CELLS]
    )


@query(
    "prp19_stratified_folds",
    """SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) - 1) % 10)::INT AS fold
FROM labels JOIN documents USING (doc_id)""",
)
def prp19_folds(spark, d):
    return P.folds_of(_labelled(spark, d), "quality", "doc_id").select("doc_id", "quality", "fold")


_SQL_HELD_OUT = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS place, count(*) OVER () AS n
FROM labels JOIN documents USING (doc_id))"""


@query("prp19_held_out_rows", f"{_SQL_HELD_OUT} SELECT doc_id, TRUE AS scored FROM r WHERE place <= ceil(n * 0.3::DOUBLE)")
def prp19_test(spark, d):
    """Rows that a forest scores in the mode ``test``: three tenths of the table."""
    scored = P.out_of_fold(_labelled(spark, d), "quality", _FEATURES, "doc_id", trees=20, validation="test", probability="share")
    right = F.col("predicted").isin(0, 1) & F.col("share").between(0.0, 1.0)
    return scored.select("doc_id", right.alias("scored"))


@query("prp19_learned_rows", "SELECT doc_id, TRUE AS scored FROM labels JOIN documents USING (doc_id)")
def prp19_all(spark, d):
    """Rows that a forest scores in the mode ``all``: those it learned from."""
    scored = P.out_of_fold(_labelled(spark, d), "quality", _FEATURES, "doc_id", trees=20, validation="all", probability="share")
    return scored.select("doc_id", (F.col("predicted").isin(0, 1) & F.col("share").between(0.0, 1.0)).alias("scored"))


# ------------------------------------------------------------------ targets


@query(
    "tgt1_confusion_cells",
    f"WITH {SQL_ORDERS} SELECT o_orderkey, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp FROM ord",
)
def tgt1(spark, d):
    return orders_cls(spark, d).select("o_orderkey", *CELLS)


@query(
    "tgt2_inferred_classes",
    "SELECT 'A' AS n_label, 'R' AS p_label, count(*) FILTER (WHERE l_returnflag = 'A')::BIGINT AS n_rows, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS p_rows FROM lineitem WHERE l_returnflag <> 'N'",
)
def tgt2(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'N'")
    found = class_map(rows, "l_returnflag")
    return rows.agg(
        F.count_if(F.col("l_returnflag") == found["N"]).alias("n_rows"),
        F.count_if(F.col("l_returnflag") == found["P"]).alias("p_rows"),
    ).select(F.lit(found["N"]).alias("n_label"), F.lit(found["P"]).alias("p_label"), "n_rows", "p_rows")


@query("tgt3_outcome_columns", f"SELECT event_id, {q9('value::DECIMAL(18,2)')} AS y, {q9('value::DECIMAL(18,2) * value::DECIMAL(18,2)')} AS y2 FROM events")
def tgt3(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").cast("decimal(18,2)").alias("value"))
    return with_outcome(e, "value").select("event_id", r9("y").alias("y"), r9("y2").alias("y2"))


@query(
    "tgt5_log_loss",
    f"""WITH {SQL_LABELS}, p AS (SELECT *, least(greatest(n_chars::DOUBLE / (SELECT max(n_chars) FROM lab), 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS p FROM lab)
SELECT lang, source, cls, {q9('-(cls * ln(p) + (1 - cls) * ln(1 - p))')} AS loss FROM p""",
)
def tgt5(spark, d):
    rows = labels_cls(spark, d)
    largest = rows.agg(F.max("n_chars").alias("m")).scalar()
    return rows.select("lang", "source", "cls", r9(log_loss(F.col("cls"), F.col("n_chars") / largest)).alias("loss"))


@query(
    "tgt6_effect_size",
    f"""WITH o AS (SELECT avg(value) mu, stddev_pop(value) s, count(*)::DOUBLE n FROM events),
e AS (SELECT event_type AS slice, count(*)::DOUBLE k, sum(value) total, avg(value) m, stddev_pop(value) sd FROM events GROUP BY event_type),
x AS (SELECT *, (mu * n - total) / (n - k) AS rest, greatest((s * s * (n - 1) - sd * sd * (k - 1)) / (n - k - 1), 0) AS rv FROM e, o)
SELECT slice, k::BIGINT AS n, round((m - rest) / sqrt((sd + sqrt(rv)) / 2), 7) AS effect_size FROM x""",
)
def tgt6(spark, d):
    out = P.effect_size(table(spark, d, "events"), "event_type", "value")
    return out.withColumn("effect_size", F.round("effect_size", 7))


