"""Queries of tables kept by bucket and of graphs as files: written, changed in part and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import buckets as B
from ..sources import graph_files as G
from ..sources.tables import table as t
from .graph_queries import scratch, written
from .registry import query


@query("s12_bucket_table", """
WITH o AS (SELECT o_orderkey, o_orderdate, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, o_totalprice FROM orders),
b AS (SELECT *, CAST(floor(day / 30) AS INT) AS bucket FROM o)
SELECT bucket, count(*) AS n, round(sum(CASE WHEN bucket % 3 = 0 THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM b
WHERE (bucket + 1) * 30 > date_diff('day', DATE '1970-01-01', DATE '1998-01-01') - 24 * 30 AND o_orderdate < TIMESTAMP '1997-11-15' AND NOT (bucket % 3 = 0 AND o_orderkey % 2 = 0) GROUP BY bucket""")
def s12_table(spark, d):
    """Orders by month; each third month is replaced by half its orders at twice the price, those two years old are dropped, and what lies before
    mid-November 1997 is read."""
    path = scratch(spark, "months")
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    B.write_by_time(orders, path, "o_orderdate")
    changed = orders.where((B.time_bucket(F.col("o_orderdate")) % 3 == 0) & (F.col("o_orderkey") % 2 != 0)).withColumn("o_totalprice", 2 * F.col("o_totalprice"))
    B.write_by_time(changed, path, "o_orderdate")
    B.drop_old(spark, path, "1998-01-01", 24)
    kept = B.read_between(spark, path, "o_orderdate", "1970-01-01", "1997-11-15")
    return kept.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s08_upsert_table", """
WITH u AS (SELECT c_custkey AS id, c_acctbal AS v, TIMESTAMP '1990-01-01' AS wrote, 0 AS k FROM customer UNION ALL SELECT o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END, o_orderdate, o_orderkey FROM orders)
SELECT id, v, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY wrote DESC, k DESC) AS n FROM u WHERE v IS NOT NULL) WHERE n = 1""")
def s08_table(spark, d):
    """Customers, then three batches of orders out of order, the first one twice: of each customer the value last written. Orders of low priority have no value."""
    path = scratch(spark, "upserts")
    moment = lambda at, k: F.struct(at.cast("timestamp_ntz").alias("wrote"), k.cast("long").alias("k")).alias("at")
    first = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), moment(F.lit("1990-01-01"), F.lit(0)))
    orders = t(spark, d, "orders")
    later = orders.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("v"), moment(F.col("o_orderdate"), F.col("o_orderkey")))
    for batch in (first, *(later.where(F.col("at.k") % 3 == i) for i in (2, 0, 1, 2))):
        B.upsert(path, batch, ["id"], "at", "v", written(spark), 16)
    return spark.read.parquet(path).select("id", "v", "at.k")


GRAPH_SQL = """
SELECT 'node' AS kind, 'nation-' || n_nationkey AS a, NULL AS b, 'Nation' AS label, n_name AS name, NULL AS weight FROM nation
UNION ALL SELECT 'node', 'customer-' || c_custkey, NULL, 'Customer', CASE WHEN c_custkey % 7 <> 0 THEN '<' || c_name || ' & "Co">' END, NULL FROM customer
UNION ALL SELECT 'edge', 'customer-' || c_custkey, 'nation-' || c_nationkey, 'LIVES_IN', NULL, CASE WHEN c_acctbal > 0 THEN c_acctbal END FROM customer"""


def customers(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nations and customers as nodes, a seventh of them without a name, and where they live as edges, some without a weight."""
    c = t(spark, d, "customer")
    own = F.concat(F.lit("customer-"), "c_custkey")
    nations = t(spark, d, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name"))
    nodes = nations.union(c.select(own, F.lit("Customer"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("<"), "c_name", F.lit(' & "Co">')))))
    return nodes, c.select(own.alias("src"), F.concat(F.lit("nation-"), "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("rel_type"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("weight"))


def listed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    none = F.lit(None)
    rows = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), none.cast("string").alias("b"), F.col("type").alias("label"), "name", none.cast("double").alias("weight"))
    return rows.union(edges.select(F.lit("edge"), "src", "dst", "rel_type", none.cast("string"), "weight"))


@query("s07_graphml", GRAPH_SQL)
def s07_graphml(spark, d):
    path = scratch(spark, "graphml")
    G.write_graphml(*customers(spark, d), path)
    return listed(*G.read_graphml(spark, path))


@query("s07_node_link", GRAPH_SQL)
def s07_node_link(spark, d):
    path = scratch(spark, "node-link")
    G.write_node_link(*customers(spark, d), path)
    return listed(*G.read_node_link(spark, path))
