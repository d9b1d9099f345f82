"""Resolution of whole batches (J05 with order among the new entities) and the golden set that scores it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import names_align, normalize_name
from .resolve import cosine_of, ngram_vector, resolve, similar_texts

GOLDEN = "existing_entities array<struct<id string, name string, type string, description string>>, pairs array<struct<id string, category string, query struct<name string, type string, description string>, expected struct<decision string, canonical_id string>>>"
Materialize = Callable[[DataFrame], DataFrame]


def load_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S16. The existing entities (id, name, type, description) and the pairs (id, category, name, type, description, decision,
    canonical_id) of a golden set, one JSON object. Pairs are refused if their decision is unknown, if a NEW one names an entity, or
    if another one names none that exists."""
    raw = spark.read.schema(GOLDEN).json(path, multiLine=True)
    existing = raw.select(F.inline("existing_entities"))
    pairs = raw.select(F.explode("pairs").alias("p")).select("p.id", "p.category", "p.query.*", "p.expected.*")
    is_new = F.col("decision") == "NEW"
    sound = F.coalesce(F.col("decision").isin("MERGE", "SIMILAR", "NEW"), F.lit(False)) & (is_new == F.col("canonical_id").isNull())
    unknown = pairs.where("canonical_id IS NOT NULL").join(existing.select(F.col("id").alias("canonical_id")), "canonical_id", "left_anti")
    wrong = pairs.where(~sound).select("id").union(unknown.select("id")).distinct()
    if not wrong.isEmpty():
        raise ValueError(f"unsound golden pairs: {', '.join(sorted(r[0] or '' for r in wrong.limit(20).collect()))}")
    return existing, pairs


def golden_decisions(pairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """What A03 scores: category, expected, actual, expected_id, actual_id. resolved: as resolve() gives it for the pairs' names."""
    got = resolved.select(F.col("query_id").alias("id"), F.col("decision").alias("actual"), F.col("base_id").alias("actual_id"))
    return pairs.withColumnsRenamed({"decision": "expected", "canonical_id": "expected_id"}).join(got, "id", "left").select("category", "expected", "actual", "expected_id", "actual_id")


def lead_or_follow(nodes: DataFrame, edges: DataFrame, materialize: Materialize) -> DataFrame:
    """nodes (a, key), edges (later, earlier) -> a, key, leads: in the order of a, a node follows if a node before it leads that has its key or
    an edge to it; else it leads. Nodes of a key aren't paired: what counts is its first leader and its first open node.

    Each round decides all nodes that have nothing open before them, at least the first open one; `materialize` cuts the lineage."""
    state = materialize(nodes.withColumn("leads", F.lit(None).cast("boolean")))
    while True:
        first = lambda where: F.min(F.when(where, F.col("a")))
        by_key = state.groupBy("key").agg(first(F.col("leads")).alias("key_lead"), first(F.col("leads").isNull()).alias("key_open"))
        seen = edges.join(state.select(F.col("a").alias("earlier"), "leads"), "earlier")
        by_edge = seen.groupBy(F.col("later").alias("a")).agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("led"), F.bool_or(F.col("leads").isNull()).alias("open"))
        both = state.join(by_key, "key").join(by_edge, "a", "left")
        led = F.coalesce("led", F.lit(False)) | F.coalesce(F.col("key_lead") < F.col("a"), F.lit(False))
        waits = F.coalesce("open", F.lit(False)) | F.coalesce(F.col("key_open") < F.col("a"), F.lit(False))
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(led, F.lit(False)).when(~waits, F.lit(True))
        state = materialize(both.select("a", "key", leads.alias("leads")))
        if state.where("leads IS NULL").isEmpty():
            return state


def resolve_batch(new: DataFrame, existing: DataFrame, materialize: Materialize, edges: DataFrame | None = None, merge: float = 0.92, similar: float = 0.85, candidate: float = 0.60) -> DataFrame:
    """J05, with later entities seeing earlier ones of the same batch: query_id, decision, target (existing, batch), target_id, score of
    each new entity (id, name, type, description) in the order of id.

    What resolve() merges into existing entities makes no node. The others go through the batch: an entity merges into the node
    that an earlier one of its normalized name has made, else into the earlier node of highest score (ties: the first) that reaches
    `merge`, or `similar` with names that align; else it makes a node, SIMILAR to an existing entity or, failing that, to the
    earlier node of highest score from `similar` on, or NEW. Names without ASCII letters and digits are compared lower-cased. Scores
    compare entities as they came, not as merged.

    Equal names never meet in pairs: their key has one node at most. Scores are found once for different texts, in blocks.
    """
    against = materialize(resolve(new, existing, edges, merge, similar, candidate))
    text = F.concat_ws(" ", "name", "type", "description")
    key = F.coalesce(F.nullif(normalize_name(F.col("name")), F.lit("")), F.lower("name"))
    rest = new.join(against.where("decision <> 'MERGE'").select(F.col("query_id").alias("id")), "id", "left_semi").select("id", "name", key.alias("key"), text.alias("text"))
    rest = materialize(rest.withColumn("a", F.min("id").over(Window.partitionBy("text"))))  # copies of a text: they never lead, their first one may
    nodes = rest.where("id = a").select("a", "key", "name", "text")
    grams = materialize(ngram_vector(nodes, "a"))
    other = grams.withColumnRenamed("a", "b")
    near = materialize(similar_texts(nodes.select("a", "text"), nodes.select(F.col("a").alias("b"), "text"), similar).where("a > b"))
    names = nodes.select("a", "key", "name")
    named = near.join(names, "a").join(names.select(F.col("a").alias("b"), F.col("key").alias("key_b"), F.col("name").alias("name_b")), "b").where("key <> key_b")
    merges = (F.col("score") >= merge) | names_align(F.col("name"), F.col("name_b"))
    linked = materialize(named.select("a", "b", "score", merges.alias("merges")))
    state = materialize(lead_or_follow(names.select("a", "key"), linked.where("merges").select(F.col("a").alias("later"), F.col("b").alias("earlier")), materialize))
    leaders = state.where("leads").join(names.select("a", "name"), "a").select(F.col("a").alias("node"), "key", F.col("name").alias("node_name"))
    # a text's neighbours that lead, whichever of the two came first: a copy may come after a node that its first one came before
    both = linked.union(linked.select("b", "a", "score", "merges")).join(leaders.select(F.col("node").alias("b")), "b", "left_semi")
    met = rest.select("id", "a").join(both, "a").where("b < id")
    best = lambda where: F.min(F.when(where, F.struct((-F.col("score")).alias("less"), F.col("b").alias("node"))))
    by_score = met.groupBy("id").agg(best(F.col("merges")).alias("merged"), best(~F.col("merges")).alias("alike"))
    own = rest.join(leaders, "key", "left").join(by_score, "id", "left").join(against.select(F.col("query_id").alias("id"), "decision", "base_id", F.col("score").alias("base_score")), "id")
    by_name = F.coalesce(F.col("node") < F.col("id"), F.lit(False))
    makes = F.coalesce(F.col("node") == F.col("id"), F.lit(False))
    similar_old = F.col("decision") == "SIMILAR"
    rows = own.select(
        "id", "a",
        F.when(by_name | ~makes, "MERGE").when(similar_old | F.col("alike").isNotNull(), "SIMILAR").otherwise("NEW").alias("decision"),
        F.when(by_name | ~makes, "batch").when(similar_old, "existing").when(F.col("alike").isNotNull(), "batch").alias("target"),
        F.when(by_name, F.col("node")).when(~makes, F.col("merged.node")).when(similar_old, F.col("base_id")).otherwise(F.col("alike.node")).alias("target_id"),
        F.when(by_name & (F.lower("name") == F.lower("node_name")), 1.0).when(by_name, F.lit(None)).when(~makes, -F.col("merged.less")).when(similar_old, F.col("base_score")).otherwise(-F.col("alike.less")).alias("score"),
    )
    rows = materialize(rows)
    aliases = rows.where("decision = 'MERGE' AND score IS NULL")  # merged by name only: their score is yet to find
    pairs = aliases.select("a", F.col("target_id").alias("b")).distinct()
    scores = cosine_of(pairs, grams, other, 0.0).withColumnsRenamed({"b": "target_id", "score": "alias_score"})
    rows = rows.join(scores, ["a", "target_id"], "left").withColumn("score", F.coalesce("score", "alias_score"))
    old = against.where("decision = 'MERGE'").select("query_id", "decision", F.lit("existing").alias("target"), F.col("base_id").alias("target_id"), "score")
    return old.unionByName(rows.select(F.col("id").alias("query_id"), "decision", "target", "target_id", F.round("score", 4).alias("score")))
