"""The usual relational plans over the star schema, and windows over events: extensions, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import events as streams
from .catalogue import query, table


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query(
    "open_orders_top",
    """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""",
)
def open_orders_top(spark, sf_dir):
    """A report of ten: the limit is the feature."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    met = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = met.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return revenue.orderBy(F.desc("revenue"), "o_orderkey").limit(10).select("o_orderkey", "revenue", "o_orderdate")


@query(
    "supplier_volume_by_region",
    """SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice), 2) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def supplier_volume_by_region(spark, sf_dir):
    """Lines are summed by supplier before any join, so the joins see suppliers, not lines."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum("l_extendedprice").alias("volume"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return by.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "n_name").agg(F.sum("lines").alias("lines"), F.round(F.sum("volume"), 2).alias("volume"))


@query(
    "customers_without_open_orders",
    "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY 1",
)
def customers_without_open_orders(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


@query(
    "order_gaps",
    "SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)::INT AS days FROM orders",
)
def order_gaps(spark, sf_dir):
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_diff("o_orderdate", before).alias("days"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return streams.windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))
