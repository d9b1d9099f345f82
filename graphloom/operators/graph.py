"""Graph construction and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


TASK_ROWS = 1_000_000  # that a task sorts or counts at once


def pair_tasks(mentions: DataFrame) -> tuple[int, int]:
    """Of mentions (chunk, entity): how many tasks their rows and how many the pairs within a chunk are dealt out to."""
    fewest = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.col("n").cast("double")
    rows, pairs = mentions.groupBy("chunk").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(n), F.lit(0.0)), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()
    return max(fewest, int(rows // TASK_ROWS) + 1), max(fewest, int(pairs // TASK_ROWS) + 1)


def row_tasks(rows: DataFrame) -> int:
    """How many tasks the rows are dealt out to."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS + 1)


def cooccurrence_edges(mentions: DataFrame, least: int = 1) -> DataFrame:
    """J07. mentions (chunk, entity) -> a, b (a < b), n: chunks that hold both. Triangle join on the chunk; the number of tasks grows with
    the rows and pairs, so that what one of them holds doesn't."""
    own, paired = pair_tasks(mentions)
    m = mentions.select("chunk", "entity").repartition(own, "chunk").distinct()
    pairs = m.toDF("chunk", "a").join(m.toDF("chunk", "b"), "chunk").where("a < b")
    return pairs.select("a", "b").repartition(paired, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def relationship_edges(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """J08. rels (source, target, rel_type, confidence), entities (id, name) -> src, dst, rel_type, confidence; the best of each."""
    key = entities.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("id"))
    both = rels.withColumn("s", F.lower("source")).withColumn("t", F.lower("target")).join(key.toDF("s", "src"), "s").join(key.toDF("t", "dst"), "t")
    return both.groupBy("src", "dst", F.upper("rel_type").alias("rel_type")).agg(F.max("confidence").alias("confidence"))


def similar_edges(pairs: DataFrame) -> DataFrame:
    """J09. Both directions of each pair (a, b, score)."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").union(pairs.select("b", "a", "score")).distinct()


def topic_edges(items: DataFrame) -> DataFrame:
    """J10. items (id, topic, subtopics) -> src, dst, rel_type: subtopic PART_OF topic, entity BELONGS_TO first subtopic, else topic."""
    part = items.select(F.explode("subtopics").alias("src"), F.col("topic").alias("dst"), F.lit("PART_OF").alias("rel_type"))
    belongs = items.select(F.col("id").cast("string").alias("src"), F.coalesce(F.get("subtopics", F.lit(0)), "topic").alias("dst"), F.lit("BELONGS_TO").alias("rel_type"))
    return part.union(belongs).distinct()


def related(edges: DataFrame, k: int) -> DataFrame:
    """J11. The k strongest out-neighbours of every node: edges (src, dst, rel_type, weight)."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "rel_type"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def neighborhood(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """J12. nodes (id, topic), edges (src, dst, rel_type), taken either way -> the distinct edges around the nodes, with those to topics. Edges
    are dealt out to `tasks`, if given, before they meet the nodes and before repeats are found."""
    own = nodes.select("id")
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    around = dealt(edges, "src").join(own.toDF("src"), "src", "left_semi").unionByName(dealt(edges, "dst").join(own.toDF("dst"), "dst", "left_semi"))
    topics = nodes.where("topic IS NOT NULL").select(F.col("id").cast("string").alias("src"), F.col("topic").alias("dst"), F.lit("BELONGS_TO").alias("rel_type"))
    around = around.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "rel_type").unionByName(topics)
    return dealt(around, "src", "dst").distinct()


def reconcile(entities: DataFrame, nodes: DataFrame, points: DataFrame) -> DataFrame:
    """J16. id, status of what is out of step: missing_node, missing_point, orphan_node, orphan_point."""
    flag = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    all3 = flag(entities, "e").join(flag(nodes, "n"), "id", "full_outer").join(flag(points, "p"), "id", "full_outer")
    status = F.array_compact(F.array(F.when(F.col("e") & F.col("n").isNull(), "missing_node"), F.when(F.col("e") & F.col("p").isNull(), "missing_point"), F.when(F.col("e").isNull() & F.col("n"), "orphan_node"), F.when(F.col("e").isNull() & F.col("p"), "orphan_point")))
    return all3.select("id", F.explode(status).alias("status"))


def consistency(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """J17. One row: total, missing, stale (the description differs), rate of consistent ones."""
    joined = entities.select("id", "description").join(nodes.select("id", F.col("description").alias("d"), F.lit(1).alias("there")), "id", "left")
    missing, stale = F.count_if(F.col("there").isNull()), F.count_if(F.col("there").isNotNull() & ~F.col("description").eqNullSafe(F.col("d")))
    return joined.agg(F.count("*").alias("total"), missing.alias("missing"), stale.alias("stale")).withColumn("rate", F.round(F.try_divide(F.col("total") - F.col("missing") - F.col("stale"), F.col("total")), 6))


def isolated(entities: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """J18. Entities without a content link (id) and without an edge (src, dst)."""
    return entities.join(links.select("id"), "id", "left_anti").join(edges.select(F.col("src").alias("id")).union(edges.select("dst")), "id", "left_anti")


def merge_nodes(edges: DataFrame, leaders: DataFrame, tasks: int | None = None) -> DataFrame:
    """J20. Edges with members replaced by their leader, without self-edges and repeats; weight is the sum. Edges are dealt out to `tasks`,
    if given, before they are summed."""
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    moved = edges.join(leaders.toDF("src", "ls"), "src", "left").join(leaders.toDF("dst", "ld"), "dst", "left")
    moved = moved.select(F.coalesce("ls", "src").alias("src"), F.coalesce("ld", "dst").alias("dst"), "weight").where("src <> dst")
    return dealt(moved, "src", "dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A01. kind, label, n: nodes and edges by type and in all (label null)."""
    n = nodes.rollup("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("type").alias("label"), "n")
    e = edges.rollup("rel_type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.col("rel_type").alias("label"), "n")
    return n.union(e)


def density(n_nodes: Column, n_edges: Column) -> Column:
    """A01. m / (n (n - 1)), 0 for at most one node."""
    return F.when(n_nodes > 1, n_edges / (n_nodes * (n_nodes - 1))).otherwise(0.0)


def upsert_by_key(target: DataFrame, updates: DataFrame, key: list[str], order: str) -> DataFrame:
    """S08. Last write wins; applying the same updates again changes nothing."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return target.unionByName(updates).withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def delete_keys(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """S09."""
    return df.join(gone.select(*key).distinct(), key, "left_anti")


def append_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """S13."""
    return existing.unionByName(new.join(existing.select(*key).distinct(), key, "left_anti").dropDuplicates(key))
