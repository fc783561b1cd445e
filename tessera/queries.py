"""Queries of the relational, text, graph, vector, version and command operators, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fulltext as ft
from tessera.functions import scalar as s
from tessera.functions import user
from tessera.operators import dml, graph, metrics, vector
from tessera.operators import relational as rel
from tessera.plans import explain, nql, shards, statements, stats
from tessera.sources.database import Database
from tessera.sources.files import load, write
from tessera.sources.shared import shared_dir
from tessera.sources.storage import ParquetStorage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class _Tables:
    """Tables by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self._folder, name)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[_Tables], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, folder: f(_Tables(spark, folder))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r2(c: Column | str) -> Column:
    return s.rounded(F.col(c) if isinstance(c, str) else c, 2)



def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


# flagship


@query("""WITH g AS (SELECT n_name, c_mktsegment, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY ALL HAVING sum(l_extendedprice * (1 - l_discount)) > 1000),
r AS (SELECT *, rank() OVER (PARTITION BY c_mktsegment ORDER BY revenue DESC) AS place FROM g)
SELECT n_name, c_mktsegment, round(revenue * 100) / 100 AS revenue, place FROM r WHERE place <= 3""")
def flagship(t):
    lines = t.lineitem.where(F.col("l_shipdate") >= F.lit("1994-01-01").cast("timestamp_ntz"))
    joined = lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    grouped = joined.groupBy("n_name", "c_mktsegment").agg(F.sum(revenue()).alias("revenue")).where("revenue > 1000")
    ranked = grouped.withColumn("place", F.rank().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("revenue"))).cast("long")).where("place <= 3")
    return ranked.withColumn("revenue", r2("revenue"))


# scans, filters, projection, order

for _name, _where, _filter in (
    ("filter_compare", "o_totalprice > 100000 AND o_orderstatus <> 'F'", lambda: (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") != "F")),
    ("filter_and_or", "(o_orderstatus = 'O' OR o_orderpriority = '1-URGENT') AND o_totalprice <= 50000", lambda: ((F.col("o_orderstatus") == "O") | (F.col("o_orderpriority") == "1-URGENT")) & (F.col("o_totalprice") <= 50000)),
    ("filter_in", "o_orderpriority IN ('1-URGENT', '2-HIGH')", lambda: F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
    ("filter_between", "o_totalprice BETWEEN 1000 AND 20000", lambda: F.col("o_totalprice").between(1000, 20000)),
    ("filter_like", "o_orderpriority LIKE '%-H%'", lambda: F.col("o_orderpriority").like("%-H%")),
    ("filter_not", "NOT (o_orderstatus = 'F')", lambda: ~(F.col("o_orderstatus") == "F")),
    ("point_lookup", "o_orderkey = 42", lambda: F.col("o_orderkey") == 42),
    ("btree_range", "o_orderkey >= 100 AND o_orderkey <= 250", lambda: F.col("o_orderkey").between(100, 250)),
):
    _QUERIES[_name] = lambda spark, folder, f=_filter: load(spark, folder, "orders").where(f()).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    _SQL[_name] = f"SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE {_where}"


@query("SELECT * FROM region")
def scan_region(t):
    return t.region


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NULL AS gone FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NOT NULL")
def filter_null(t):
    return t.orders.where(F.nullif("o_orderpriority", F.lit("5-LOW")).isNotNull()).select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).isNull().alias("gone"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) / 100 AS charge, l_linenumber % 2 AS odd FROM lineitem")
def project_arith(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r2(revenue() * (1 + F.col("l_tax"))).alias("charge"), (F.col("l_linenumber") % 2).alias("odd"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def order_limit_offset(t):
    return rel.ordered(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)], 10, 5)


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_segments(t):
    return t.customer.select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def fn_json_path(t):
    return t.events.where(s.json_exists(F.col("props"), "k")).select("event_id", s.json_path(F.col("props"), "k").alias("k"))


# joins


def _sides(t):
    return t.orders.select("o_orderkey", "o_custkey"), t.lineitem.select(F.nullif(F.col("l_orderkey"), F.col("l_suppkey")).alias("l_orderkey"), "l_partkey", "l_linenumber")


_LEFT = "(SELECT o_orderkey AS o_o_orderkey, o_custkey AS o_o_custkey FROM orders)"
_RIGHT = "(SELECT nullif(l_orderkey, l_suppkey) AS l_l_orderkey, l_partkey AS l_l_partkey, l_linenumber AS l_l_linenumber FROM lineitem)"
for _how in ("inner", "left", "right", "full"):
    _QUERIES[f"join_{_how}"] = lambda spark, folder, how=_how: rel.join(*_sides(_Tables(spark, folder)), [("o_orderkey", "l_orderkey")], how, prefixes=("o", "l"))
    _SQL[f"join_{_how}"] = f"SELECT * FROM {_LEFT} {_how.upper()} JOIN {_RIGHT} ON o_o_orderkey IS NOT DISTINCT FROM l_l_orderkey"
for _how in ("hash", "merge", "broadcast", "nested_loop"):
    _QUERIES[f"join_by_{_how}"] = lambda spark, folder, how=_how: rel.join(load(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), load(spark, folder, "nation"), [("s_nationkey", "n_nationkey")], strategy=how)
    _SQL[f"join_by_{_how}"] = "SELECT s_suppkey, s_nationkey, n_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return rel.join(t.region.select("r_name"), t.nation.select("n_name"), [], "cross")


@query("SELECT n_name, count(*) AS n, round(sum(l_extendedprice) * 100) / 100 AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY n_name")
def join_multi(t):
    j = t.lineitem.join(t.part.where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), r2(F.sum("l_extendedprice")).alias("total"))


@query("WITH a AS (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer), b AS (SELECT n_name, nullif(n_nationkey, 7) AS k2 FROM nation) SELECT c_custkey, k, n_name, k2 FROM a JOIN b ON k IS NOT DISTINCT FROM k2")
def join_null_safe(t):
    a = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return rel.join(a, t.nation.select("n_name", F.nullif("n_nationkey", F.lit(7)).alias("k2")), [("k", "k2")])


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_semi(t):
    return rel.join(t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey"), [("o_orderkey", "l_orderkey")], "semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(t):
    return rel.join(t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey"), [("o_orderkey", "l_orderkey")], "anti")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal BETWEEN s_acctbal - 100 AND s_acctbal + 100")
def join_theta_range(t):
    sides = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return rel.band_join(*sides, [("s_nationkey", "c_nationkey")], ("s_acctbal", "c_acctbal"), 100).select("s_suppkey", "c_custkey")


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
def join_using(t):
    return rel.join_using(t.nation.select(F.col("n_regionkey").alias("k"), "n_name"), t.region.select(F.col("r_regionkey").alias("k"), "r_name"), ["k"])


@query("SELECT a.event_id, a.user_id, (SELECT arg_max(b.value, b.ts) FROM events AS b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts) AS seen FROM events AS a WHERE a.event_type = 'purchase'")
def join_asof(t):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return rel.asof_join(left, t.events.where("event_type = 'view'").select("user_id", "ts", "value"), ["user_id"], "ts", "value", "seen").drop("ts")


# aggregates


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity) * 100) / 100 AS qty, round(avg(l_extendedprice) * 100) / 100 AS price, min(l_discount) AS least, max(l_tax) AS most FROM lineitem GROUP BY ALL")
def agg_basic(t):
    out = rel.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], [("n", "count", None), ("qty", "sum", "l_quantity"), ("price", "avg", "l_extendedprice"), ("least", "min", "l_discount"), ("most", "max", "l_tax")])
    return out.withColumns({"qty": r2("qty"), "price": r2("price")})


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS buyers, round(sum(o_totalprice) * 100) / 100 AS total FROM orders WHERE o_totalprice > 1000")
def agg_global(t):
    out = rel.aggregate(t.orders.where("o_totalprice > 1000"), [], [("n", "count", None), ("buyers", "count_distinct", "o_custkey"), ("total", "sum", "o_totalprice")])
    return out.withColumn("total", r2("total"))


@query("SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_orderpriority) AS least FROM orders WHERE o_orderkey < 0")
def agg_empty(t):
    return rel.aggregate(t.orders.where("o_orderkey < 0"), [], [("n", "count", None), ("total", "sum", "o_totalprice"), ("least", "min", "o_orderpriority")])


@query("SELECT nullif(o_orderstatus, 'F') AS status, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def agg_group_multi(t):
    return rel.aggregate(t.orders.withColumn("status", F.nullif("o_orderstatus", F.lit("F"))), ["status", "o_orderpriority"], [("n", "count", None)])


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(t):
    return rel.aggregate(t.orders, ["o_custkey"], [("n", "count", None)], F.col("n") > 12)


@query("SELECT l_returnflag, round(stddev_samp(l_quantity) * 10000) / 10000 AS spread FROM lineitem GROUP BY l_returnflag")
def agg_stddev(t):
    return rel.aggregate(t.lineitem, ["l_returnflag"], [("spread", "stddev", "l_quantity")]).withColumn("spread", s.rounded(F.col("spread"), 4))


@query("SELECT c_nationkey, min(c_name) AS first, max(c_mktsegment) AS last FROM customer GROUP BY c_nationkey")
def agg_string_minmax(t):
    return rel.aggregate(t.customer, ["c_nationkey"], [("first", "min", "c_name"), ("last", "max", "c_mktsegment")])


for _kind in ("rollup", "cube"):
    _QUERIES[f"agg_{_kind}"] = lambda spark, folder, kind=_kind: getattr(load(spark, folder, "orders"), kind)("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    _SQL[f"agg_{_kind}"] = f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY {_kind.upper()} (o_orderstatus, o_orderpriority)"


@query("WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_type, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v) * 10000) / 10000 AS avg, max(CASE WHEN i = least(floor(c * 0.95), c - 1) THEN v END) AS p95, max(CASE WHEN i = least(floor(c * 0.99), c - 1) THEN v END) AS p99 FROM r GROUP BY event_type")
def metric_stats_p95_p99(t):
    return metrics.metric_stats(t.events, "event_type", "value").withColumn("avg", s.rounded(F.col("avg"), 4))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def topn_slowest(t):
    return metrics.top(t.events.select("event_id", "value"), "value", 10, "event_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 1")
def slowest_query(t):
    return metrics.slowest(t.events, "event_id", "value")


@query("SELECT user_id, CASE WHEN count(*) FILTER (value > 50) = 0 THEN 0.0 ELSE round(count(*) FILTER (event_type = 'error' AND value > 50) / count(*) FILTER (value > 50) * 10000) / 10000 END AS rate FROM events GROUP BY user_id")
def ratio_safe_div(t):
    high = F.col("value") > 50
    return t.events.groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & high).alias("bad"), F.count_if(high).alias("n")).select("user_id", s.rounded(rel.safe_ratio(F.col("bad"), F.col("n")), 4).alias("rate"))


@query("SELECT event_id, ts, value FROM events WHERE value > 90 ORDER BY ts DESC LIMIT 100")
def slow_log(t):
    return metrics.slow_log(t.events.select("event_id", "ts", "value"), "value", 90, 100, "ts")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 48 HOUR")
def retention(t):
    return metrics.retained(t.events, "ts", "2024-01-30 00:00:00", 48).select("event_id")


@query("SELECT event_type, round(sum(value) * 100) / 100 AS total, arg_max(value, ts) AS current FROM events GROUP BY event_type")
def counters_gauges(t):
    return metrics.counters(t.events, "event_type", "value").join(metrics.gauges(t.events, "event_type", "value", "ts"), "event_type").withColumn("total", r2("total"))


@query("SELECT event_id, CASE WHEN value > 90 OR value * 90 > 8000 THEN 'unhealthy' WHEN value > 70 OR value * 90 > 6000 THEN 'degraded' ELSE 'healthy' END AS state FROM events")
def health_state(t):
    return t.events.select("event_id", metrics.health(F.col("value"), F.col("value") * 90).alias("state"))


# windows

_W = "PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST"
_ORDER = [("o_orderdate", True), ("o_orderkey", True)]
for _name, _call, _sql, _extra in (
    ("win_row_number", "row_number", "row_number()", {}),
    ("win_rank", "rank", "rank()", {}),
    ("win_dense_rank", "dense_rank", "dense_rank()", {}),
    ("win_lag", "lag", "lag(o_totalprice)", {"column": "o_totalprice"}),
    ("win_lag2", "lag", "lag(o_totalprice, 2)", {"column": "o_totalprice", "offset": 2}),
    ("win_lead", "lead", "lead(o_totalprice)", {"column": "o_totalprice"}),
    ("win_first_value", "first_value", "first_value(o_totalprice)", {"column": "o_totalprice"}),
    ("win_ntile", "ntile", "ntile(4)", {"offset": 4}),
    ("win_percent_rank", "percent_rank", "percent_rank()", {}),
):
    _kind = {"lag": "double", "lead": "double", "first_value": "double", "percent_rank": "double"}.get(_call, "long")
    _QUERIES[_name] = lambda spark, folder, call=_call, extra=_extra, kind=_kind: rel.window(load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "v", call, ["o_custkey"], _ORDER, **extra).select("o_orderkey", F.col("v").cast(kind).alias("v"))
    _SQL[_name] = f"SELECT o_orderkey, {_sql} OVER ({_W}) AS v FROM orders"


@query("SELECT o_orderkey, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders")
def win_last_value(t):
    return rel.window(t.orders, "v", "last_value", ["o_custkey"], _ORDER, column="o_totalprice").select("o_orderkey", "v")


@query("SELECT o_orderkey, CAST(1 AS BIGINT) AS v FROM orders")
def win_rank_no_order(t):
    return rel.window(t.orders, "v", "rank", ["o_custkey"]).select("o_orderkey", F.col("v").cast("long").alias("v"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) * 100) / 100 AS v FROM orders")
def win_sum_range(t):
    return rel.window(t.orders, "v", "sum", ["o_custkey"], [("o_orderdate", True)], column="o_totalprice").select("o_orderkey", r2("v").alias("v"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) * 100) / 100 AS v FROM orders")
def win_avg_rows_frame(t):
    return rel.window(t.orders, "v", "avg", ["o_custkey"], _ORDER, column="o_totalprice", frame=("rows", -2, 0)).select("o_orderkey", r2("v").alias("v"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS v FROM orders")
def win_count_partition(t):
    return rel.window(t.orders, "v", "count", ["o_custkey"]).select("o_orderkey", "v")


# sets, subqueries, common table expressions


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return rel.union([t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return rel.union([t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))], distinct=True)


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT l_partkey FROM lineitem")
def intersect_ids(t):
    return rel.intersect(t.orders.select(F.col("o_custkey").alias("k")), t.lineitem.select(F.col("l_partkey").alias("k")))


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def except_ids(t):
    return rel.difference(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")))


def _sql_query(name: str, text: str, tables: str, duck: str | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(text, **{x: load(spark, folder, x) for x in tables.split()})

    _QUERIES[name] = run
    plain = duck or text
    for x in tables.split():
        plain = plain.replace("{" + x + "}", x)
    _SQL[name] = plain


_sql_query("sub_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM {orders})", "orders")
_sql_query("sub_correlated", "SELECT o_orderkey FROM {orders} AS a WHERE o_totalprice = (SELECT max(b.o_totalprice) FROM {orders} AS b WHERE b.o_custkey = a.o_custkey)", "orders")
_sql_query("sub_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer orders")
_sql_query("sub_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)", "customer orders")
_sql_query("sub_in", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)", "supplier nation")
_sql_query("sub_derived", "SELECT k, count(*) AS n FROM (SELECT o_custkey % 10 AS k FROM {orders} WHERE o_orderstatus = 'O') AS d GROUP BY k", "orders")
_sql_query("cte_simple", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 10) SELECT c_name, n FROM top JOIN {customer} ON c_custkey = o_custkey", "orders customer")
_sql_query("cte_recursive", "WITH RECURSIVE walk(n, total) AS (SELECT n_nationkey, CAST(n_nationkey AS BIGINT) FROM {nation} WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, total + n_nationkey FROM walk JOIN {nation} ON n_nationkey = n + 1) SELECT n, total FROM walk", "nation")


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) * 100) / 100 AS above FROM orders")
def sub_scalar_column(t):
    mean = rel.scalar(t.orders.agg(F.avg("o_totalprice")))
    return t.orders.select("o_orderkey", r2(F.col("o_totalprice") - mean).alias("above"))


# scalar functions


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, CAST(strlen(c_mktsegment) AS INTEGER) AS bytes, substring(c_name, 3, 5) AS part, c_name || '/' || c_mktsegment AS joined, trim(' ' || c_name || ' ') AS bare FROM customer")
def fn_string(t):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select("c_custkey", s.upper(n).alias("up"), s.lower(n).alias("low"), s.length(m).alias("bytes"), s.substring(n, 3, 5).alias("part"), s.concat(n, F.lit("/"), m).alias("joined"), s.trim(F.concat(F.lit(" \t"), n, F.lit("\n "))).alias("bare"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal * 10) / 10 AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(power(c_acctbal, 2.0) * 100) / 100 AS p, round(sqrt(abs(c_acctbal)) * 10000) / 10000 AS q FROM customer")
def fn_math(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", s.absolute(b).alias("a"), s.rounded(b, 1).alias("r"), s.ceil(b).alias("c"), s.floor(b).alias("f"), r2(s.power(b, 2)).alias("p"), s.rounded(s.sqrt(s.absolute(b)), 4).alias("q"))


@query("SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS plus_days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS plus_month, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 YEAR AS DATE) AS plus_years, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS since FROM orders")
def fn_date(t):
    d = F.col("o_orderdate")
    made = {"plus_days": s.date_add(d, 10, "day"), "plus_month": s.date_add(d, 1, "month"), "plus_years": s.date_add(d, 2, "year"), "since": s.date_diff(s.date(d), F.lit("1992-01-01").cast("date"))}
    return t.orders.select("o_orderkey", *[c.alias(k) for k, c in (s.date_parts(d) | made).items()])


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS f, CAST(p_size AS VARCHAR) AS v, p_size <> 0 AS b FROM part")
def fn_cast(t):
    return t.part.select("p_partkey", s.cast(F.col("p_retailprice"), "INTEGER").alias("i"), s.cast(F.col("p_size"), "FLOAT").alias("f"), s.cast(F.col("p_size"), "VARCHAR").alias("v"), s.cast(F.col("p_size"), "BOOLEAN").alias("b"))


# full text

_TOKENS = r"""tok AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS position, term FROM (SELECT doc_id, i, regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '\s+'), 1) AS i FROM documents)) WHERE strlen(term) > 1)"""
_STOP = "'the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'is', 'are'"


@query(f"WITH {_TOKENS} SELECT doc_id, position, term FROM tok")
def ft_tokens(t):
    return ft.tokens(t.documents)


@query(f"WITH {_TOKENS} SELECT doc_id, position, regexp_replace(regexp_replace(regexp_replace(term, 's+$', ''), '(ed)+$', ''), '(ing)+$', '') AS term FROM tok WHERE term NOT IN ({_STOP})")
def ft_stems(t):
    return ft.tokens(t.documents, stop=True, stemmed=True)


@query(f"WITH {_TOKENS} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(position AS VARCHAR), ' ' ORDER BY position) AS positions FROM tok GROUP BY ALL")
def ft_postings(t):
    return ft.postings(t.documents).withColumn("positions", F.array_join("positions", " "))


@query(f"WITH {_TOKENS} SELECT doc_id FROM tok WHERE term IN ('the', 'and', 'with') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def ft_search_and(t):
    return ft.search_all(t.documents, ["the", "and", "with"])


@query(f"WITH {_TOKENS} SELECT DISTINCT doc_id FROM tok WHERE term IN ('der', 'les')")
def ft_search_or(t):
    return ft.search_any(t.documents, ["der", "les"])


@query(f"WITH {_TOKENS}, n AS (SELECT term, count(DISTINCT doc_id) AS n FROM tok GROUP BY term) SELECT term, n, round(ln(((SELECT count(*) FROM documents) - n + 0.5) / (n + 0.5) + 1) * 1000000) / 1000000 AS idf FROM n")
def ft_idf(t):
    n = ft.tokens(t.documents).groupBy("term").agg(F.count_distinct("doc_id").alias("n"))
    return n.crossJoin(t.documents.agg(F.count("*").alias("total"))).select("term", "n", s.rounded(ft.idf(F.col("n"), F.col("total")), 6).alias("idf"))


@query(f"""WITH {_TOKENS}, len AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ('the', 'and', 'der') GROUP BY ALL), df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
sc AS (SELECT doc_id, sum(2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * len.n / (SELECT avg(n) FROM len))) * ln(((SELECT count(*) FROM documents) - df.n + 0.5) / (df.n + 0.5) + 1)) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id) GROUP BY doc_id)
SELECT doc_id, round(score * 1000000) / 1000000 AS score FROM sc ORDER BY 2 DESC, 1 LIMIT 20""")
def ft_bm25_topk(t):
    return ft.bm25(t.documents, ["the", "and", "der"]).select("doc_id", s.rounded(F.col("score"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


# vectors

_NEAR = "round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query(f"SELECT b.vec_id, {_NEAR} AS distance FROM embeddings AS a, embeddings AS b WHERE a.vec_id = 0 ORDER BY 2, 1 LIMIT 5")
def vec_knn(t):
    query = t.embeddings.where("vec_id = 0").select("embedding").first()
    return vector.knn(t.embeddings, query["embedding"], 5) if query else t.embeddings.select("vec_id", F.lit(0.0).alias("distance")).limit(0)


def _asked(t) -> DataFrame:
    """The stated queries: every row whose identifier is divisible by 50."""
    return t.embeddings.where("vec_id % 50 = 0")


@query(f"SELECT a.vec_id AS query, b.vec_id, {_NEAR} AS distance FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND 1 - {_NEAR} >= 0.5")
def vec_threshold(t):
    return vector.within(t.embeddings, _asked(t), 0.5)


@query(f"SELECT query, vec_id, distance, place FROM (SELECT a.vec_id AS query, b.vec_id, {_NEAR} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_NEAR}, b.vec_id) AS place FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE place <= 5")
def vec_topk(t):
    return vector.knn_of(t.embeddings, _asked(t), 5)


@query("SELECT true AS good, count(*) AS rows FROM embeddings")
def vec_index_recall(t):
    """An index holds every row, and its search finds at least 0.9 of what brute force finds."""
    index = vector.InvertedLists(t.embeddings, 16)
    exact, found = vector.knn_of(t.embeddings, _asked(t), 5), index.search(_asked(t), 5, probes=12)
    hits = exact.join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left").agg((F.count("hit") >= 0.9 * F.count("*")).alias("good"))
    return hits.crossJoin(index.rows.agg(F.count("*").alias("rows")))


@query("SELECT CAST(0 AS BIGINT) AS wrong, count(*) AS rows FROM embeddings")
def vec_dimension(t):
    return t.embeddings.agg(F.count("*").alias("rows")).crossJoin(vector.wrong_dimension(t.embeddings, 64).agg(F.count("*").alias("wrong")))


# graphs: each nation's customers buy most from two nations

_EDGES = "g AS MATERIALIZED (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), edges AS MATERIALIZED (SELECT src, dst FROM g QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) <= 2)"


def _edges(t) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    trade = j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    return rel.window(trade, "place", "row_number", ["src"], [("n", False), ("dst", True)]).where("place <= 2").select("src", "dst")


@query(f"WITH {_EDGES} SELECT dst FROM edges WHERE src = 3")
def graph_neighbors(t):
    return graph.neighbours(_edges(t), 3)


@query(f"WITH {_EDGES} SELECT src, count(*) AS degree FROM edges GROUP BY src")
def graph_degree(t):
    return graph.degrees(_edges(t))


_WALKS = f"WITH RECURSIVE {_EDGES}, w AS (SELECT n_nationkey AS start, n_nationkey AS node, CAST(0 AS BIGINT) AS hops FROM nation UNION SELECT start, dst, hops + 1 FROM w JOIN edges ON node = src WHERE hops < 3)"


@query(f"{_WALKS} SELECT start, node, min(hops) AS hops FROM w GROUP BY ALL")
def graph_khop(t):
    return graph.reach(_edges(t), t.nation.select(F.col("n_nationkey").alias("id")), 3)


@query(f"WITH RECURSIVE {_EDGES}, w AS (SELECT [1] AS path UNION ALL SELECT list_append(path, dst) FROM w JOIN edges ON path[-1] = src WHERE len(path) <= 6 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS BIGINT) AS hops FROM w WHERE path[-1] = 7 ORDER BY len(path), w.path LIMIT 1")
def graph_shortest_path(t):
    return graph.shortest_path(_edges(t), 1, 7, 6).withColumn("path", F.array_join("path", ">"))


@query(f"WITH RECURSIVE {_EDGES}, w AS (SELECT src AS start, dst AS node FROM edges UNION SELECT start, dst FROM w JOIN edges ON node = src) SELECT DISTINCT start AS id FROM w WHERE start = node")
def graph_cycle(t):
    return graph.on_cycles(_edges(t))


# changes, versions, constraints


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (100, 'it''s'), (101, NULL)) AS v(a, b)")
def dml_insert_result(t):
    return dml.insert(t.region, dml.parse_values("(100, 'it''s'), (101, NULL)"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update_result(t):
    return dml.update(t.customer, {"c_mktsegment": "DEBT"}, F.col("c_acctbal") < 0).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def dml_delete_result(t):
    return dml.delete(t.orders, F.nullif("o_orderstatus", F.lit("P")) == "F").select("o_orderkey")


_VERSIONS = "v AS (SELECT user_id AS row_id, event_id AS version_id, event_id % 97 AS tx_id, event_type <> 'error' AS committed, CASE WHEN value < 10 THEN event_id END AS deleted_tx, value FROM events)"


def _versions(t) -> DataFrame:
    return t.events.select(F.col("user_id").alias("row_id"), F.col("event_id").alias("version_id"), (F.col("event_id") % 97).alias("tx_id"), (F.col("event_type") != "error").alias("committed"), F.when(F.col("value") < 10, F.col("event_id")).alias("deleted_tx"), "value")


for _name, _where, _read in (
    ("mvcc_visible", "committed AND tx_id <= 50 AND deleted_tx IS NULL", lambda v: dml.visible(v, 50)),
    ("mvcc_own_writes", "tx_id = 13 AND deleted_tx IS NULL", lambda v: dml.own_writes(v, 13)),
    ("mvcc_read_uncommitted", "true", lambda v: dml.read_at(v, 40, "read_uncommitted")),
    ("mvcc_isolation", "tx_id < 40 AND deleted_tx IS NULL", lambda v: dml.read_at(v, 40, "serializable")),
):
    _QUERIES[_name] = lambda spark, folder, f=_read: f(_versions(_Tables(spark, folder))).select("row_id", "version_id", "value")
    _SQL[_name] = f"WITH {_VERSIONS} SELECT row_id, version_id, value FROM v WHERE {_where} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY version_id DESC) = 1"


@query("SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def constraint_pk(t):
    return dml.primary_key_violations(t.lineitem, "l_orderkey")


@query("SELECT o_custkey, o_orderdate, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def constraint_unique(t):
    return dml.unique_violations(t.orders, ["o_custkey", "o_orderdate"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def constraint_fk(t):
    return dml.foreign_key_violations(t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal >= 0)")
def constraint_check(t):
    return dml.check_violations(t.customer, F.col("c_acctbal") >= 0).select("c_custkey")


@query("WITH a AS (SELECT user_id, list(DISTINCT event_type) AS l FROM events GROUP BY user_id) SELECT user_id, list_has_any(l, ['error', 'purchase']) AS meets FROM a")
def conflict_sets(t):
    rows = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("l"))
    return rows.select("user_id", dml.conflicts(F.col("l"), F.array(F.lit("error"), F.lit("purchase"))).alias("meets"))


# statistics and sharding


@query("SELECT CAST(sum(CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, count(DISTINCT nullif(c_mktsegment, 'BUILDING')) AS ndv, min(nullif(c_mktsegment, 'BUILDING')) AS min, max(nullif(c_mktsegment, 'BUILDING')) AS max, round(avg(length(nullif(c_mktsegment, 'BUILDING'))) * 10000) / 10000 AS avg_len FROM customer")
def col_stats(t):
    df = t.customer.select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("m"))
    return stats.column_stats(df, "m").withColumn("avg_len", s.rounded(F.col("avg_len"), 4))


_HIST = "SELECT floor(o_totalprice / 50000) * 50000 AS lower, floor(o_totalprice / 50000) * 50000 + 50000 AS upper, count(*) AS rows, count(DISTINCT o_totalprice) AS ndv FROM orders GROUP BY ALL"


@query(f"WITH h AS ({_HIST}) SELECT *, round(rows / ndv * 10000) / 10000 AS density FROM h")
def histogram(t):
    return stats.histogram(t.orders, "o_totalprice", 50000).withColumn("density", s.rounded(F.col("density"), 4))


@query(f"WITH h AS ({_HIST}) SELECT CAST(floor(rows / greatest(ndv, 1)) AS BIGINT) AS estimate FROM h WHERE lower <= 120000 AND upper >= 120000 ORDER BY lower LIMIT 1")
def histogram_estimate(t):
    return stats.cardinality(stats.histogram(t.orders, "o_totalprice", 50000), 120000)


@query("SELECT * FROM (SELECT 'c_custkey' AS \"column\", count(DISTINCT c_custkey) AS ndv FROM customer UNION ALL SELECT 'c_name' AS \"column\", count(DISTINCT c_name) AS ndv FROM customer UNION ALL SELECT 'c_mktsegment' AS \"column\", count(DISTINCT c_mktsegment) AS ndv FROM customer UNION ALL SELECT 'c_nationkey' AS \"column\", count(DISTINCT c_nationkey) AS ndv FROM customer) WHERE ndv > (SELECT count(*) FROM customer) / 10")
def index_suggestion(t):
    return stats.suggest_indexes(t.customer, ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])


@query("SELECT count(*) AS members, CAST(0 AS BIGINT) AS missed, true AS few_false FROM part WHERE p_size <= 25")
def bloom_membership(t):
    """What the filter itself says of all parts: no member is missed, few others pass."""
    keys = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("k"))
    items = keys.count()
    passed = stats.bloom_members(t.part, "p_partkey", stats.bloom_filter(keys, "k", items), items).select(F.col("p_partkey").alias("v"))
    tested = t.part.select("p_partkey", (F.col("p_size") <= 25).alias("member")).join(passed, F.col("p_partkey") == F.col("v"), "left")
    others, wrong = F.count_if(~F.col("member")), F.count_if(~F.col("member") & F.col("v").isNotNull())
    return tested.agg(F.count_if("member").alias("members"), F.count_if(F.col("member") & F.col("v").isNull()).alias("missed"), (wrong <= 0.05 * others).alias("few_false"))


_RING = stats.ring(["node-a", "node-b", "node-c"], 16)
_PLACES = ", ".join(f"({h}, '{n}')" for h, n in _RING)


@query(f"""WITH k AS (SELECT c_custkey, c_name, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, b: (h * 33 + b) % 4294967296) AS h FROM customer), r AS (SELECT * FROM (VALUES {_PLACES}) AS v(place, node))
SELECT c_custkey, h, coalesce((SELECT arg_min(node, place) FROM r WHERE place >= h), (SELECT arg_min(node, place) FROM r)) AS node FROM k""")
def shard_ring(t):
    return t.customer.select("c_custkey", stats.djb2(F.col("c_name")).alias("h")).select("c_custkey", "h", stats.node_at(F.col("h"), _RING).alias("node"))


@query("SELECT c_custkey, c_custkey >= 10 AND c_custkey < 100 AS inside, c_custkey < 50 AS below FROM customer")
def shard_range(t):
    return t.customer.select("c_custkey", stats.in_range(F.col("c_custkey"), 10, 100).alias("inside"), stats.in_range(F.col("c_custkey"), None, 50).alias("below"))


@query("SELECT p_partkey, strlen(p_type) % 7 AS shard FROM part")
def shard_len_mod(t):
    return t.part.select("p_partkey", stats.shard_by_length(F.col("p_type"), 7).alias("shard"))


# time windows


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def time_tumbling(t):
    return metrics.tumbling(t.events, "ts", "1 hour", ["event_type"], F.count("*").alias("n"))


@query("WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i AS window_start FROM events, range(0, 2) AS r(i)) SELECT window_start, count(*) AS n FROM e GROUP BY ALL")
def time_sliding(t):
    return t.events.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 7200 SECOND THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM b GROUP BY user_id, g")
def time_session(t):
    return metrics.sessions(t.events, "user_id", "ts", 7200)


# commands


def _command(t, tables: tuple[str, ...], command: dict) -> DataFrame:
    db = Database(t.spark)
    for name in tables:
        db.register(name, getattr(t, name))
    return nql.execute(db, command)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'O' OR o_orderpriority LIKE '1%') AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 3")
def nql_select(t):
    built = nql.SelectBuilder("orders").columns("o_orderkey", "o_totalprice").or_({"field": "o_orderstatus", "eq": "O"}, {"field": "o_orderpriority", "like": "1%"}).where("o_totalprice", "gte", 1000)
    return _command(t, ("orders",), built.order_by("o_totalprice", desc=True).order_by("o_orderkey").limit(20).offset(3).build())


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND NOT event_type IN ('view', 'click') AND value <= 80")
def nql_where_tree(t):
    return _command(t, ("events",), {"op": "select", "from": "events", "columns": ["event_id"], "where": {"and": [{"field": "props.k", "exists": True}, {"not": {"field": "event_type", "in": ["view", "click"]}}, {"field": "value", "lte": 80}]}})


@query("SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS most FROM customer GROUP BY c_nationkey HAVING count(*) > 50")
def nql_aggregate_having(t):
    return _command(t, ("customer",), {"op": "select", "from": "customer", "aggregate": [{"func": "count", "as": "n"}, {"func": "max", "field": "c_acctbal", "as": "most"}], "group_by": ["c_nationkey"], "having": {"field": "n", "gt": 50}})


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def nql_window(t):
    order = [{"field": "c_acctbal", "desc": True}, {"field": "c_custkey"}]
    out = _command(t, ("customer",), {"op": "select", "from": "customer", "columns": ["c_custkey"], "aggregate": [{"func": "row_number", "as": "place"}], "order_by": order})
    return out.withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_TOKENS} SELECT doc_id FROM documents JOIN (SELECT doc_id FROM tok WHERE term IN ('the', 'and') GROUP BY doc_id HAVING count(DISTINCT term) = 2) USING (doc_id) WHERE lang = 'en'")
def nql_search(t):
    return _command(t, ("documents",), {"op": "search", "from": "documents", "query": {"field": "lang", "eq": "en"}, "fulltext": {"field": "text", "match": "the and"}}).select("doc_id")


# grouping sets, frames, arrays, casts


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def agg_grouping_sets(t):
    return rel.grouping_sets(t.orders, [["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], []], F.count("*").alias("n"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) * 100) / 100 AS v FROM orders")
def win_rows_following(t):
    return rel.window(t.orders, "v", "sum", ["o_custkey"], _ORDER, column="o_totalprice", frame=("rows", -1, 2)).select("o_orderkey", r2("v").alias("v"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 10 FOLLOWING) AS v FROM orders")
def win_range_values(t):
    return rel.window(t.orders, "v", "count", ["o_orderpriority"], [("o_custkey", True)], frame=("range", -5, 10)).select("o_orderkey", "v")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS v FROM orders")
def win_global_row_number(t):
    return rel.window(t.orders.select("o_orderkey", "o_totalprice"), "v", "row_number", [], [("o_totalprice", False), ("o_orderkey", True)]).select("o_orderkey", "v")


@query("WITH a AS (SELECT user_id, list(event_type ORDER BY event_type) AS l FROM events GROUP BY user_id) SELECT user_id, len(l) AS n, array_to_string(list_sort(list_distinct(l)), ',') AS kinds, list_contains(l, 'error') AS failed, list_has_any(l, ['view', 'click']) AS looked FROM a")
def fn_array(t):
    a = t.events.groupBy("user_id").agg(F.collect_list("event_type").alias("l"))
    l = F.col("l")  # noqa: E741
    return a.select("user_id", s.array_size(l).cast("long").alias("n"), s.array_joined(s.array_sorted(s.array_distinct(l)), ",").alias("kinds"), s.array_has(l, "error").alias("failed"), s.array_meets(l, ["view", "click"]).alias("looked"))


@query("WITH a AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds, round(max(v) FILTER (event_type = 'view') * 100) / 100 AS viewed FROM a GROUP BY user_id")
def fn_map(t):
    a = t.events.groupBy("user_id", "event_type").agg(F.sum("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    m = F.col("m")
    return a.select("user_id", s.array_joined(s.array_sorted(s.map_keys(m)), ",").alias("kinds"), r2(s.map_get(m, "view")).alias("viewed"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, lower(event_type) IN ('true', '1', 'yes') AS b, event_id <> 0 AS n FROM events")
def fn_cast_text(t):
    k = s.json_path(F.col("props"), "k")
    return t.events.select("event_id", s.cast(k, "INTEGER").alias("i"), s.cast(F.col("event_type"), "BOOLEAN").alias("b"), s.cast(F.col("event_id"), "BOOLEAN").alias("n"))


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def udf_scalar(t):
    twice = user.scalar(t.spark, "tessera_twice", lambda x: x * 2, "double")
    return t.customer.select("c_custkey", twice("c_acctbal").alias("twice"))


@query("SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_nationkey")
def udf_aggregate(t):
    spread = user.aggregate(t.spark, "tessera_spread", lambda x: float(x.max() - x.min()), "double")
    return t.customer.groupBy("c_nationkey").agg(spread("c_acctbal").alias("spread"))


class _Digits:
    def eval(self, n: int):  # noqa: ANN201
        for d in str(n):
            yield (int(d),)


@query("SELECT c_custkey, CAST(unnest(string_split(CAST(c_custkey AS VARCHAR), '')) AS INTEGER) AS d FROM customer")
def udf_table(t):
    user.table(t.spark, "tessera_digits", _Digits, "d int")
    return t.spark.sql("SELECT c_custkey, d FROM {c}, LATERAL tessera_digits(c_custkey)", c=t.customer.select("c_custkey"))


# an index of postings


def _index(t) -> ft.Index:
    return ft.Index.build(t.documents, f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}")


@query(_SQL["ft_bm25_topk"])
def ft_index_bm25(t):
    return _index(t).bm25(["the", "and", "der"]).select("doc_id", s.rounded(F.col("score"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(_SQL["ft_search_and"])
def ft_index_and(t):
    return _index(t).search(["the", "and", "with"])


@query(_SQL["ft_search_or"])
def ft_index_or(t):
    return _index(t).search(["der", "les"], every=False)


# stores


def _kept(t) -> Database:
    db = Database(t.spark)
    db.create_table("customers", [{"name": "c_custkey", "type": "integer"}, {"name": "c_nationkey", "type": "integer", "nullable": False}, {"name": "c_acctbal", "type": "double", "default": 0.0}, {"name": "c_mktsegment", "type": "string"}])
    db.insert("customers", t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal", "c_mktsegment"))
    return db


@query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN CAST(1 AS BIGINT) ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey = 5 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey <> 5 THEN c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT 1000000, 2, 7.5, 'NEW'")
def table_upsert(t):
    db = _kept(t)
    db.insert("customers", [{"c_custkey": 5, "c_nationkey": 1}, {"c_custkey": 1000000, "c_nationkey": 2, "c_acctbal": 7.5, "c_mktsegment": "NEW"}])
    return db.table("customers")


@query("SELECT * FROM (VALUES ('c_custkey', 'bigint', false, true), ('c_nationkey', 'bigint', false, false), ('c_acctbal', 'double', true, false), ('c_mktsegment', 'string', true, false)) AS v(name, type, nullable, primary_key)")
def table_metadata(t):
    db = Database(t.spark)
    db.create_table("customers", [{"name": "c_custkey", "type": "integer"}, {"name": "c_nationkey", "type": "integer", "nullable": False}, {"name": "c_acctbal", "type": "double"}, {"name": "c_mktsegment", "type": "string"}])
    return t.spark.createDataFrame(db.describe("customers"), "name string, type string, nullable boolean, primary_key boolean")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE NOT c_nationkey IN (3, 4)")
def nql_dml(t):
    db = _kept(t)
    nql.execute(db, {"op": "update", "table": "customers", "set": {"c_mktsegment": "DEBT"}, "where": {"field": "c_acctbal", "lt": 0}})
    nql.execute(db, {"op": "delete", "from": "customers", "where": {"field": "c_nationkey", "in": [3, 4]}})
    return db.table("customers").select("c_custkey", "c_mktsegment")


@query("SELECT count(*) + 1 AS rows, round(sum(c_acctbal) + 10, 2) AS total FROM customer")
def nql_transaction(t):
    db = _kept(t)
    row = [{"c_custkey": -1, "c_nationkey": 0, "c_acctbal": 10.0}]
    nql.execute(db, {"op": "transaction", "isolation": "serializable", "commands": [{"op": "insert", "into": "customers", "values": row}]})
    undone = {"op": "transaction", "commands": [{"op": "delete", "from": "customers"}, {"op": "insert", "into": "nothing", "values": row}]}
    assert not nql.envelope(db, undone)["success"]
    return db.table("customers").agg(F.count("*").alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT 'nation:' || n_nationkey AS key, to_json(struct_pack(name := n_name)) AS value FROM nation WHERE n_nationkey BETWEEN 10 AND 19 OR n_nationkey = 1")
def kv_scan(t):
    db = Database(t.spark)
    db.put("kv", {f"nation:{r.n_nationkey}": {"name": r.n_name} for r in t.nation.collect()} | {"region:1": None})
    return db.scan("kv", "nation:1").withColumn("value", F.regexp_replace("value", '": "', '":"'))


@query("SELECT 'n' || n_nationkey AS doc_id, n_name AS name, CAST(CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS BIGINT) AS version FROM nation WHERE n_nationkey <> 24")
def doc_crud(t):
    db, rows = Database(t.spark), t.nation.collect()
    db.create_collection("nations")
    db.put_documents("nations", {f"n{r.n_nationkey}": {"name": "?" if r.n_regionkey == 1 else r.n_name} for r in rows})
    db.put_documents("nations", {f"n{r.n_nationkey}": {"name": r.n_name} for r in rows if r.n_regionkey == 1})
    db.delete_document("nations", "n24")
    return db.documents("nations").select("doc_id", nql.field(db.documents("nations"), "name").alias("name"), "version")


@query("SELECT 'n1' AS doc_id, CAST(1 AS BIGINT) AS version, 'first' AS name UNION ALL SELECT 'n1', 2, n_name FROM nation WHERE n_nationkey = 1")
def doc_versions(t):
    db = Database(t.spark)
    db.create_collection("nations")
    for name in ("first", t.nation.where("n_nationkey = 1").first().n_name):
        db.put_documents("nations", {"n1": {"name": name}})
    both = db.document("nations", "n1", 1).unionByName(db.document("nations", "n1", 2))
    return both.select("doc_id", "version", F.try_variant_get("data", "$.name", "string").alias("name"))


@query("SELECT 'd' || n_nationkey AS doc_id FROM nation WHERE n_nationkey > 5 AND (n_nationkey % 3 = 1 OR n_regionkey = 2)")
def nql_document_paths(t):
    db = Database(t.spark)
    db.create_collection("nations")
    made = {f"d{r.n_nationkey}": {"n": r.n_nationkey, "tags": [f"t{r.n_nationkey % 3}", "all"], "in": {"region": r.n_regionkey}} for r in t.nation.collect()}
    db.put_documents("nations", made | {"x": {"n": "text", "tags": "t1"}, "y": {"tags": None}})
    tree = {"and": [{"field": "n", "gt": 5}, {"or": [{"field": "tags", "in": ["t1", "none"]}, {"field": "in.region", "eq": 2}]}]}
    return nql.execute(db, {"op": "search", "collection": "nations", "query": tree}).select("doc_id")


@query(f"WITH {_EDGES} SELECT CAST(e.src AS VARCHAR) AS src, CAST(e.dst AS VARCHAR) AS dst, n_name AS label FROM edges AS e JOIN nation ON n_nationkey = e.dst WHERE e.src < 10")
def graph_store(t):
    db = Database(t.spark)
    db.create_graph("trade")
    names = [(str(r.n_nationkey), r.n_name, {}) for r in t.nation.collect()]
    db.add_nodes("trade", [(i, "?", p) for i, _, p in names])
    db.add_nodes("trade", names)
    db.add_edges("trade", [(str(r.src), str(r.dst), "buys", {}) for r in _edges(t).collect()])
    return db.edges("trade").where("cast(src as int) < 10").join(db.nodes("trade"), F.col("dst") == F.col("id")).select("src", "dst", "label")


@query(f"SELECT CAST(b.vec_id AS VARCHAR) AS id, {_NEAR} AS distance FROM embeddings AS a, embeddings AS b WHERE a.vec_id = 0 ORDER BY 2, b.vec_id LIMIT 5")
def vector_store(t):
    db, rows = Database(t.spark), t.embeddings.orderBy("vec_id").collect()
    db.create_vectors("v", len(rows[0].embedding))
    db.add_vectors("v", [(str(r.vec_id), r.embedding, {}) for r in rows])
    return nql.execute(db, {"op": "vector_search", "collection": "v", "vector": rows[0].embedding})


@query("SELECT CAST(1 AS BIGINT) AS tables, CAST(1 AS BIGINT) AS collections, CAST(1 AS BIGINT) AS graphs, CAST(1 AS BIGINT) AS vector_collections")
def engine_summary(t):
    db = Database(t.spark)
    db.register("nation", t.nation)
    db.create_collection("c")
    db.create_graph("g")
    db.create_vectors("v", 2)
    return db.summary().select(*[F.col(c).cast("long").alias(c) for c in ("tables", "collections", "graphs", "vector_collections")])


@query("WITH s AS (SELECT o_custkey AS key, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') SELECT key, value FROM s WHERE n = 1 AND o_orderstatus <> 'F'")
def log_replay(t):
    log = t.orders.select(F.col("o_orderkey").alias("lsn"), F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.when(F.col("o_orderstatus") == "P", "Active").otherwise("Committed").alias("status"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("operation"))
    return dml.replay(log).select("key", "value")


@query("SELECT s_suppkey, s_name FROM supplier")
def storage_segments(t):
    store = ParquetStorage(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")
    rows = {str(r.s_suppkey): r.s_name for r in t.supplier.collect()}
    store.put(dict.fromkeys(rows, "old"))
    store.flush()
    store.put(rows | {"gone": "x"})
    store.flush()
    store.delete("gone")
    store.compact()
    return store.scan().select(F.col("key").cast("long").alias("s_suppkey"), F.col("value").alias("s_name"))


@query("SELECT 'csv' AS kind, n_nationkey, n_name FROM nation UNION ALL SELECT 'json', n_nationkey, n_name FROM nation UNION ALL SELECT 'orc', n_nationkey, n_name FROM nation UNION ALL SELECT 'parquet', n_nationkey, n_name FROM nation")
def file_formats(t):
    out = []
    for kind in ("csv", "json", "orc", "parquet"):
        path = f"{shared_dir(t.spark)}/{kind}-{uuid.uuid4().hex}"
        write(t.nation.select("n_nationkey", "n_name"), path, kind)
        out.append(t.spark.read.format(kind).schema("n_nationkey int, n_name string").load(path).select(F.lit(kind).alias("kind"), "n_nationkey", "n_name"))
    return rel.union(out)


# statements, plans, shards, estimates

_STATEMENTS = (
    ("SELECT a FROM t JOIN u ON t.x = u.x", "select", "t,u"), ("INSERT INTO t VALUES (1)", "insert", "t"), ("UPDATE t SET a = 1", "update", "t"), ("DELETE FROM t WHERE a = 1", "delete", "t"),
    ("CREATE TABLE t (a INT)", "create_table", "t"), ("DROP TABLE t", "drop_table", "t"), ("CREATE INDEX i ON t (a)", "create_index", "t"), ("SHOW TABLES", "other", ""),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{k}', '{x}')" for a, k, x in _STATEMENTS) + ") AS v(text, kind, tables)")
def statement_kinds(t):
    found = [(text, statements.classify(t.spark, text)) for text, _, _ in _STATEMENTS]
    return t.spark.createDataFrame([(text, f.kind, ",".join(f.tables)) for text, f in found], "text string, kind string, tables string")


@query("SELECT true AS scans, true AS joins, true AS cheaper")
def explain_plan(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").count()
    ops = [r.operator for r in explain.nodes(j).collect()]
    less = explain.cost(t.orders.select("o_orderkey")) < explain.cost(j)
    return t.spark.createDataFrame([(any("Scan" in o for o in ops), any("Join" in o for o in ops), less)], "scans boolean, joins boolean, cheaper boolean")


@query("SELECT CASE WHEN c_custkey < 100 THEN 'a' WHEN c_custkey < 1000 THEN 'b' ELSE 'c' END AS shard, CASE WHEN c_custkey < 1000 THEN 'n1' ELSE 'n2' END AS node, count(*) AS rows FROM customer GROUP BY ALL UNION ALL SELECT 'c', 'n2', 0 WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey >= 1000)")
def shard_rows(t):
    manager = shards.Shards([shards.Shard("a", "n1", None, 100), shards.Shard("b", "n1", 100, 1000), shards.Shard("c", "n2", 1000)])
    return manager.rows(t.customer, "c_custkey")


@query("SELECT CAST(1.0 / count(DISTINCT c_mktsegment) AS DOUBLE) AS eq, CAST(ceil(count(*) * (1.0 / count(DISTINCT c_mktsegment)) * 0.33) AS BIGINT) AS rows FROM customer")
def selectivity_estimate(t):
    found = stats.column_stats(t.customer, "c_mktsegment").first()
    eq = stats.selectivity("eq", ndv=found.ndv)
    return t.spark.createDataFrame([(eq, stats.output_rows(t.customer.count(), [eq, stats.selectivity("range")]))], "eq double, rows long")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
