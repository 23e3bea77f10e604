"""Queries on the star schema, an extension of the engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stoagraph.operators import relational as R
from stoagraph.session import table


def _revenue():
    return F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))


def rel_pricing(spark, d):
    l = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(_revenue(), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


def rel_shipping_priority(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    out = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("l_orderkey", "o_orderdate").agg(F.round(_revenue(), 2).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "l_orderkey").limit(10)


def rel_region_revenue(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name").agg(F.round(_revenue(), 2).alias("revenue"))


def rel_rollup(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return o.rollup("year", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def rel_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def rel_no_urgent_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def rel_top_parts(spark, d):
    return R.top_per_key(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)


def rel_running(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"), F.dense_rank().over(w).alias("nth"))


def rel_set_ops(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("op", F.lit("both")).unionByName(a.subtract(b).withColumn("op", F.lit("customers only"))).unionByName(a.union(b).distinct().withColumn("op", F.lit("any")))


def rel_pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))


def rel_asof(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    left, right = e.filter("event_type = 'purchase'").select("event_id", "ts", "user_id"), e.filter("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    return R.asof_join(left, right, "user_id", "ts", "event_id").select("event_id", "r_event_id", F.col("r_value").alias("r_value"))


def rel_range(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    bands = spark.range(0, 40).select((F.col("id") * 50).cast("double").alias("low"), (F.col("id") * 50 + 60).cast("double").alias("high"))
    return R.range_join(p, bands, "p_retailprice", "low", "high", 50.0).groupBy("low").agg(F.count(F.lit(1)).alias("n"))


def rel_json_props(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.countDistinct("user_id").alias("n_users"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("rel_")}

_REV = "l_extendedprice * (1 - l_discount)"
SQL = {
    "rel_pricing": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({_REV}), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "rel_shipping_priority": f"SELECT l_orderkey, o_orderdate, round(sum({_REV}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1, 2 ORDER BY revenue DESC, 1 LIMIT 10",
    "rel_region_revenue": f"SELECT r_name, n_name, round(sum({_REV}), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "rel_rollup": "SELECT year, o_orderpriority, count(*) AS n, grouping_id(year, o_orderpriority) AS level FROM (SELECT *, CAST(year(o_orderdate) AS INT) AS year FROM orders) GROUP BY ROLLUP (year, o_orderpriority)",
    "rel_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rel_no_urgent_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1",
    "rel_top_parts": "SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3",
    "rel_running": "SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER w AS before, dense_rank() OVER w AS nth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "rel_set_ops": """SELECT k, 'both' AS op FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT k, 'customers only' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT k, 'any' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""",
    "rel_pivot": """SELECT l_linestatus, nullif(count(*) FILTER (l_returnflag = 'A'), 0) AS "A", nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS "N", nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS "R" FROM lineitem GROUP BY 1""",
    "rel_asof": """SELECT event_id, r_event_id, r_value FROM (SELECT p.event_id, v.event_id AS r_event_id, v.value AS r_value, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id::VARCHAR DESC) AS k
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts <= p.ts) WHERE k = 1""",
    "rel_range": "SELECT low, count(*) AS n FROM part JOIN (SELECT (i * 50)::DOUBLE AS low, (i * 50 + 60)::DOUBLE AS high FROM range(40) t(i)) ON p_retailprice >= low AND p_retailprice < high GROUP BY 1",
    "rel_json_props": "SELECT event_type, CAST(sum(json_extract_string(props, '$.k')::INT) AS BIGINT) AS sum_k, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
}
