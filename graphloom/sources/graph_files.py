"""Graphs as files (S07): GraphML elements and node-link records, each a folder that many tasks write, and back.

nodes (id, type, name) and edges (src, dst, rel_type, weight); id, src and dst are strings. Attributes that are null are left out and
come back as null; so do, from GraphML, empty texts, which XML doesn't tell from missing ones. White space at the ends of a
GraphML text stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE, EDGE = ["type", "name"], ["rel_type", "weight"]
DATA = "data array<struct<_key: string, _VALUE: string>>"
XML = {"nullValue": "", "ignoreSurroundingSpaces": "false"}


def attributes(columns: list[str]) -> Column:
    """<data key="column">value</data> for each column that isn't null."""
    held = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("_key"), F.col(c).cast("string").alias("_VALUE"))) for c in columns]
    return F.array_compact(F.array(*held)).alias("data")


def attribute(name: str, kind: str = "string") -> Column:
    return F.get(F.filter("data", lambda x: x["_key"] == name), F.lit(0))["_VALUE"].cast(kind).alias(name)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> None:
    """path/nodes and path/edges: each file is a <graph> with <node id> or <edge source target> elements and their <data>."""
    root = f'graph edgedefault="{"directed" if directed else "undirected"}"'
    for name, rows in (("node", nodes.select(F.col("id").alias("_id"), attributes(NODE))), ("edge", edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), attributes(EDGE)))):
        rows.write.format("xml").option("rootTag", root).option("rowTag", name).option("arrayElementName", "data").save(f"{path}/{name}s")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    read = lambda name, ids: spark.read.format("xml").options(**XML).option("rowTag", name).schema(f"{ids}, {DATA}").load(f"{path}/{name}s")
    nodes, edges = read("node", "_id string"), read("edge", "_source string, _target string")
    return nodes.select(F.col("_id").alias("id"), *map(attribute, NODE)), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attribute("rel_type"), attribute("weight", "double"))


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """path/nodes and path/links: a JSON record a line, as the arrays of a node-link document have them."""
    nodes.select("id", F.col("type").alias("node_type"), "name").write.json(f"{path}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel_type").alias("relation"), "weight").write.json(f"{path}/links")


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.schema("id string, node_type string, name string").json(f"{path}/nodes")
    links = spark.read.schema("source string, target string, relation string, weight double").json(f"{path}/links")
    return nodes.withColumnRenamed("node_type", "type"), links.toDF("src", "dst", "rel_type", "weight")
