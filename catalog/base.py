"""Registry, fixtures on the driver tables, and SQL text shared by the queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.functions.cells import with_cells, with_outcome
from subdiv.functions.metrics import CELLS
from subdiv.operators import taxonomy
from subdiv.operators.mine import mine
from subdiv.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MINED: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its oracle."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/subdiv/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ rounding


def r9(col: Column | str) -> Column:
    """Nine digits, without negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.abs(c) < 5e-10, F.lit(0.0)).otherwise(F.round(c.cast("double"), 9))


def q9(expr: str) -> str:
    return f"CASE WHEN abs({expr}) < 5e-10 THEN 0.0 ELSE round(({expr})::DOUBLE, 9) END"


# ------------------------------------------------------------------ fixtures


def orders_cls(spark, sf_dir) -> DataFrame:
    """Orders with customer segment, priority and nation; class and prediction as cells."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nr = nation_region(spark, sf_dir)
    rows = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(nr, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "o_orderkey",
            F.col("c_mktsegment").alias("seg"),
            F.col("o_orderpriority").alias("prio"),
            F.col("n_name").alias("nat"),
            F.col("r_name").alias("reg"),
            F.col("c_acctbal").alias("acctbal"),
            F.col("o_totalprice").alias("totalprice"),
            (F.col("o_orderstatus") == "F").cast("int").alias("cls"),
            (F.col("o_totalprice") > 200000).cast("int").alias("pred"),
        )
    )
    return with_cells(rows, "cls", "pred", {"N": 0, "P": 1})


def nation_region(spark, sf_dir) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def nation_edges(spark, sf_dir) -> DataFrame:
    """Nation, region, world as taxonomy edges of the attribute ``nat``."""
    nr = nation_region(spark, sf_dir)
    up = nr.select(F.lit("nat").alias("attr"), F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    top = nr.select(F.lit("nat").alias("attr"), F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"))
    return up.unionByName(top).distinct()


def lineitem_cls(spark, sf_dir) -> DataFrame:
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_linestatus").alias("status"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("ptype"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_returnflag") == "R").cast("int").alias("cls"),
            ((F.col("l_extendedprice") * (1 - F.col("l_discount")) > 60000) & (F.col("l_quantity") > 10))
            .cast("int")
            .alias("pred"),
        )
    )
    return with_cells(rows, "cls", "pred", {"N": 0, "P": 1})


def labels_cls(spark, sf_dir) -> DataFrame:
    rows = (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
        .select("lang", "source", "n_chars", F.col("quality").alias("cls"), (1 - F.col("toxic")).alias("pred"))
    )
    return with_cells(rows, "cls", "pred", {"N": 0, "P": 1})


def events_outcome(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_type").alias("etype"),
        F.date_format("ts", "HH").alias("hr"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
    )
    return with_outcome(rows, "amount")


DAY_PARTS = {"night": range(0, 6), "morning": range(6, 12), "afternoon": range(12, 18), "evening": range(18, 24)}


def hour_edges(spark) -> DataFrame:
    return taxonomy.edges_from_dict(spark, {"hr": {f"{h:02d}": p for p, hours in DAY_PARTS.items() for h in hours}})


SQL_CELLS = """CASE WHEN cls = pred AND cls = 0 THEN 1 ELSE 0 END AS tn,
  CASE WHEN cls <> pred AND cls = 0 THEN 1 ELSE 0 END AS fp,
  CASE WHEN cls <> pred AND cls = 1 THEN 1 ELSE 0 END AS fn,
  CASE WHEN cls = pred AND cls = 1 THEN 1 ELSE 0 END AS tp"""

SQL_ORDERS = f"""ord0 AS (
  SELECT o_orderkey, c_mktsegment AS seg, o_orderpriority AS prio, n_name AS nat, r_name AS reg,
    c_acctbal AS acctbal, o_totalprice AS totalprice,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS cls,
    CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS pred
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
ord AS (SELECT *, {SQL_CELLS} FROM ord0)"""

SQL_LINES = f"""line0 AS (
  SELECT l_linestatus AS status, p_brand AS brand, p_type AS ptype, l_quantity AS quantity,
    l_discount AS discount, l_tax AS tax, l_extendedprice AS price,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS cls,
    CASE WHEN l_extendedprice * (1 - l_discount) > 60000 AND l_quantity > 10 THEN 1 ELSE 0 END AS pred
  FROM lineitem JOIN part ON l_partkey = p_partkey),
line AS (SELECT *, {SQL_CELLS} FROM line0)"""

SQL_LABELS = f"""lab0 AS (
  SELECT lang, source, n_chars, quality AS cls, 1 - toxic AS pred FROM labels JOIN documents USING (doc_id)),
lab AS (SELECT *, {SQL_CELLS} FROM lab0)"""

SQL_EVENTS = """ev0 AS (
  SELECT event_type AS etype, strftime(ts, '%H') AS hr,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(value AS DECIMAL(18,2)) AS y FROM events),
ev AS (SELECT *, y * y AS y2, CASE WHEN hr < '06' THEN 'night' WHEN hr < '12' THEN 'morning'
    WHEN hr < '18' THEN 'afternoon' ELSE 'evening' END AS part FROM ev0)"""


def sql_itemsets(source: str, attrs: dict[str, list[str]], sums: list[str], support: float, name: str = "it",
                 max_len: int | None = None) -> str:
    """CTEs ``name``: itemsets of ``source`` over attributes given as their item chains."""
    cols = sorted(attrs)
    unnests = ", ".join(f"unnest([{', '.join(attrs[a])}, NULL]) u_{a}(v)" for a in cols)
    picks = ", ".join(f"u_{a}.v AS {a}" for a in cols)
    agg = ", ".join(f"sum({s}) AS {s}" for s in sums)
    key = ", ".join(f"'{a}=' || {a}" for a in cols)
    length = " + ".join(f"({a} IS NOT NULL)::INT" for a in cols)
    limit = f" AND {length} <= {max_len}" if max_len is not None else ""
    out = ", ".join(sums)
    return f"""{name}_x AS (SELECT {picks}, {', '.join(sums)} FROM {source}, {unnests}),
{name}_g AS (SELECT {', '.join(cols)}, count(*) AS n, {agg} FROM {name}_x GROUP BY {', '.join(cols)}
  HAVING (count(*)::DOUBLE / (SELECT count(*) FROM {source}) >= {support}{limit}) OR ({length}) = 0),
{name} AS (SELECT {', '.join(cols)}, concat_ws(', ', {key}) AS key, ({length})::INT AS length,
  n::DOUBLE / (SELECT count(*) FROM {source}) AS support, n::BIGINT AS support_count, {out} FROM {name}_g)"""


def sql_cells_bigint(prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}::BIGINT AS {c}" for c in CELLS)


ORDER_CHAINS = {"seg": ["seg"], "prio": ["prio"], "nat": ["nat"]}
ORDER_CHAINS_UP = {"seg": ["seg"], "prio": ["prio"], "nat": ["nat", "reg", "'WORLD'"]}
SUP = 0.02
SUP_UP = 0.01

SQL_IT = f"WITH {SQL_ORDERS}, {sql_itemsets('ord', ORDER_CHAINS, CELLS, SUP)}"
SQL_IT_UP = f"WITH {SQL_ORDERS}, {sql_itemsets('ord', ORDER_CHAINS_UP, CELLS, SUP_UP)}"


def mined_orders(spark, sf_dir) -> DataFrame:
    """Itemsets of the orders fixture without taxonomy; mined once per session and folder."""
    return _once(
        spark, sf_dir, "orders", lambda: mine(orders_cls(spark, sf_dir), ["seg", "prio", "nat"], CELLS, SUP)
    )


def mined_orders_up(spark, sf_dir) -> DataFrame:
    """The same with nation, region and world as items."""

    def run():
        closed = taxonomy.closure(nation_edges(spark, sf_dir))
        return mine(orders_cls(spark, sf_dir), ["seg", "prio", "nat"], CELLS, SUP_UP, closure=closed)

    return _once(spark, sf_dir, "orders_up", run)


def _once(spark, sf_dir, name, run):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MINED:
        _MINED[key] = run()
    return _MINED[key]


def forget() -> None:
    """Drop shared itemset tables, so that a following query mines for itself."""
    _MINED.clear()


# --------------------------------------------------------------- SQL metrics

SQL_RATES = {
    "fpr": ("{p}fp", "({p}fp + {p}tn)"),
    "fnr": ("{p}fn", "({p}tp + {p}fn)"),
    "accuracy": ("({p}tp + {p}tn)", "({p}tp + {p}tn + {p}fp + {p}fn)"),
    "ppv": ("{p}tp", "({p}tp + {p}fp)"),
    "tpr": ("{p}tp", "({p}tp + {p}fn)"),
    "tnr": ("{p}tn", "({p}tn + {p}fp)"),
    "npv": ("{p}tn", "({p}tn + {p}fn)"),
    "fdr": ("{p}fp", "({p}fp + {p}tp)"),
    "for": ("{p}fn", "({p}fn + {p}tn)"),
    "posr": ("({p}tp + {p}fn)", "({p}tp + {p}tn + {p}fp + {p}fn)"),
    "negr": ("({p}tn + {p}fp)", "({p}tp + {p}tn + {p}fp + {p}fn)"),
}


def sql_rate(name: str, prefix: str = "") -> str:
    if name == "error":
        return f"(1 - {sql_rate('accuracy', prefix)})"
    num, den = (x.format(p=prefix) for x in SQL_RATES[name])
    return f"coalesce({num}::DOUBLE / nullif({den}, 0), 0)"


def sql_with_metric(head: str, rates: list[str], it: str = "it", name: str = "d") -> str:
    """CTE ``name``: itemsets with the rates and their divergences."""
    cols = ", ".join(f"{sql_rate(r, 'i.')} AS {r}, {sql_rate(r, 'i.')} - {sql_rate(r, 'r.')} AS d_{r}" for r in rates)
    return f"""{head}, {name} AS (SELECT i.*, {cols} FROM {it} i, (SELECT * FROM {it} WHERE length = 0) r)"""


def sql_marginals(source: str, metric: str, attrs: list[str], name: str = "m") -> str:
    """CTE ``name``: item, s_key, si_key, s_length, v_i, v_s, v_si, delta."""
    parts = []
    for a in attrs:
        rest = ", ".join(f"'{b}=' || {b}" for b in sorted(attrs) if b != a)
        parts.append(
            f"SELECT '{a}=' || {a} AS item, concat_ws(', ', {rest}) AS s_key, key AS si_key, "
            f"length - 1 AS s_length, {metric} AS v_si FROM {source} WHERE {a} IS NOT NULL"
        )
    return f"""{name}_w AS ({' UNION ALL '.join(parts)}),
{name} AS (SELECT w.item, w.s_key, w.si_key, w.s_length, i.{metric} AS v_i, s.{metric} AS v_s, w.v_si,
  w.v_si - s.{metric} AS delta
  FROM {name}_w w JOIN {source} s ON s.key = w.s_key JOIN {source} i ON i.length = 1 AND i.key = w.item)"""


def sql_subsets(source: str, attrs: list[str], name: str = "sub") -> str:
    """CTE ``name``: every itemset key with each of its subsets' keys and lengths."""
    cols = sorted(attrs)
    unnests = ", ".join(f"unnest([true, false]) k_{a}(b)" for a in cols)
    valid = " AND ".join(f"({a} IS NOT NULL OR NOT k_{a}.b)" for a in cols)
    key = ", ".join(f"CASE WHEN k_{a}.b THEN '{a}=' || {a} END" for a in cols)
    length = " + ".join(f"k_{a}.b::INT" for a in cols)
    return f"""{name} AS (SELECT key, length, concat_ws(', ', {key}) AS subset_key, {length} AS subset_length,
  {', '.join(cols)} FROM {source}, {unnests} WHERE {valid})"""
