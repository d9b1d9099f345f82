"""Queries of sections J, A, W, K, U, R and X over part, orders, lineitem, embeddings and events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.patterns import WEIGHTS
from ..operators import graph as G
from ..operators import resolve as R
from ..operators import scores as S
from ..operators import search as Q
from ..operators import windows as W
from ..sources.tables import extract_main_text, table as t
from ..streaming import jobs as X
from .registry import query
from .text_queries import NORMAL_SQL, WORDS_SQL


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset, a temporary one in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession):
    def write(df: DataFrame) -> DataFrame:
        path = scratch(spark, "rounds")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def parts(spark, d, where: str = "true") -> DataFrame:
    """Parts as entities: id, name, type, description."""
    return t(spark, d, "part").where(where).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_type").alias("description"))


@query("j01_exact_name_join", "SELECT a.p_partkey AS query_id, b.p_partkey AS base_id FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) WHERE a.p_partkey % 100 = 0")
def j01(spark, d):
    return R.exact_name_join(parts(spark, d, "p_partkey % 100 = 0"), parts(spark, d))


@query("j02_alias_join", f"SELECT a.c_custkey AS query_id, b.c_custkey AS base_id FROM customer a JOIN customer b ON {NORMAL_SQL.format(c='a.c_name')} = {NORMAL_SQL.format(c='b.c_name')}")
def j02(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.alias_join(c, c)


KNN_SQL = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
knn AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, list_cosine_similarity(a.e, b.e) AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS rank
        FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND list_cosine_similarity(a.e, b.e) >= 0.2)
"""


@query("j03_knn_join", f"WITH {KNN_SQL} SELECT query_id, base_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM knn WHERE rank <= 10")
def j03(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    found = R.knn_join(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "base_id"), 11, 0.2, on=["label"])
    others = found.where("query_id <> base_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id"))
    return others.withColumn("rank", rank).where("rank <= 10").select("query_id", "base_id", F.round("score", 4).alias("score"), "rank")


@query("j04_names_align", f"""
WITH s AS (SELECT s_suppkey, {NORMAL_SQL.format(c='s_name')} AS k FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM s a JOIN s b ON a.s_suppkey < b.s_suppkey
WHERE a.k = b.k OR levenshtein(a.k, b.k) <= 2 OR (least(length(a.k), length(b.k)) >= 3 AND (starts_with(a.k, b.k) OR starts_with(b.k, a.k)))""")
def j04(spark, d):
    return R.aligned_pairs(t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("j05_resolve")
def j05(spark, d):
    """Every hundredth part against all others, with the pairs of part and supplier as the graph's edges."""
    edges = t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return R.resolve(parts(spark, d, "p_partkey % 100 = 0"), parts(spark, d, "p_partkey % 100 <> 0"), edges)


@query("j06_graph_similarity")
def j06(spark, d):
    edges = t(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    new = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.substring_index("p_name", " ", 1).alias("name"))
    return R.graph_similarity(new, parts(spark, d).withColumn("description", F.col("name")), edges)


def mentioned(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("entity"))


@query("j07_cooccurrence", "SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2")
def j07(spark, d):
    return G.cooccurrence_edges(mentioned(spark, d))


RELS = "SELECT c_name AS source, n_name AS target, 'lives_in' AS rel_type, c_acctbal AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query("j08_relationship_edges", f"WITH r AS ({RELS}) SELECT c_custkey AS src, 1000000 + n_nationkey AS dst, 'LIVES_IN' AS rel_type, max(confidence) AS confidence FROM r JOIN customer ON lower(source) = lower(c_name) JOIN nation ON lower(target) = lower(n_name) GROUP BY 1, 2")
def j08(spark, d):
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    rels = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source"), F.col("n_name").alias("target"), F.lit("lives_in").alias("rel_type"), F.col("c_acctbal").alias("confidence"))
    entities = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).union(n.select((F.col("n_nationkey") + 1000000).cast("long"), "n_name"))
    return G.relationship_edges(rels, entities)


@query("j09_similar_edges", f"WITH {KNN_SQL}, p AS (SELECT query_id AS a, base_id AS b FROM knn WHERE rank <= 5) SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p")
def j09(spark, d):
    pairs = j03(spark, d).where("rank <= 5").select(F.col("query_id").alias("a"), F.col("base_id").alias("b"), F.lit(1.0).alias("score"))
    return G.similar_edges(pairs).select("src", "dst")


@query("j10_topic_edges", """
SELECT DISTINCT n_name AS src, r_name AS dst, 'PART_OF' AS rel_type FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT CAST(c_custkey AS VARCHAR), n_name, 'BELONGS_TO' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def j10(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = n.select(F.lit(None).cast("string").alias("id"), F.col("r_name").alias("topic"), F.array("n_name").alias("subtopics"))
    own = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("id"), F.col("r_name").alias("topic"), F.array("n_name").alias("subtopics"))
    return G.topic_edges(items.union(own)).where("src IS NOT NULL")


COOC_SQL = "e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2)"


def both_ways(spark, d) -> DataFrame:
    e = j07(spark, d)
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CO_OCCURS").alias("rel_type"), F.col("n").alias("weight")).union(e.select("b", "a", F.lit("CO_OCCURS"), "n"))


@query("j11_related", f"WITH {COOC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM e) SELECT src, dst, weight, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def j11(spark, d):
    return G.related(both_ways(spark, d), 5).select("src", "dst", "weight", "rank")


@query("j12_neighborhood", f"""
WITH {COOC_SQL}, n AS (SELECT p_partkey AS id, p_brand AS topic FROM part WHERE p_size < 10)
SELECT CAST(id AS VARCHAR) AS src, topic AS dst, 'BELONGS_TO' AS rel_type FROM n
UNION SELECT CAST(least(n.id, e.dst) AS VARCHAR), CAST(greatest(n.id, e.dst) AS VARCHAR), 'CO_OCCURS' FROM n JOIN e ON n.id = e.src""")
def j12(spark, d):
    nodes = t(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("topic"))
    edges = j07(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CO_OCCURS").alias("rel_type"))
    return G.neighborhood(nodes, edges, G.pair_tasks(mentioned(spark, d))[1])


@query("j13_node_detail", f"WITH {COOC_SQL}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM e) SELECT p_partkey AS id, p_name AS name, dst FROM part LEFT JOIN r ON p_partkey = src AND rank <= 20 WHERE p_size = 1")
def j13(spark, d):
    nodes = t(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("src"), F.col("p_name").alias("name"))
    return nodes.join(G.related(both_ways(spark, d), 20), "src", "left").select(F.col("src").alias("id"), "name", "dst")


@query("j14_content_entities", "SELECT o_orderkey, p_partkey, p_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT'")
def j14(spark, d):
    o, li, p = (t(spark, d, x) for x in ("orders", "lineitem", "part"))
    return o.where("o_orderpriority = '1-URGENT'").join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("o_orderkey", "p_partkey", "p_name")


@query("j15_latest_steps", """
WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_custkey, l_orderkey, l_linenumber FROM l JOIN lineitem ON o_orderkey = l_orderkey WHERE n = 1""")
def j15(spark, d):
    latest = t(spark, d, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where("n = 1")
    return latest.join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber")


@query("j16_reconcile", """
WITH e AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 7 <> 0), n AS (SELECT DISTINCT o_custkey AS id FROM orders), p AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0)
SELECT id, 'missing_node' AS status FROM e WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'missing_point' FROM e WHERE id NOT IN (SELECT id FROM p)
UNION ALL SELECT id, 'orphan_node' FROM n WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT id, 'orphan_point' FROM p WHERE id NOT IN (SELECT id FROM e)""")
def j16(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return G.reconcile(c.where("id % 7 <> 0"), t(spark, d, "orders").select(F.col("o_custkey").alias("id")), c.where("id % 5 <> 0"))


@query("j17_consistency", "SELECT count(*) AS total, count(*) FILTER (b.s_suppkey IS NULL) AS missing, count(*) FILTER (b.s_suppkey IS NOT NULL AND a.p_brand <> 'Brand#' || (10 + b.s_suppkey % 40)) AS stale, round((count(*) - count(*) FILTER (b.s_suppkey IS NULL) - count(*) FILTER (b.s_suppkey IS NOT NULL AND a.p_brand <> 'Brand#' || (10 + b.s_suppkey % 40))) / count(*), 6) AS rate FROM part a LEFT JOIN supplier b ON a.p_partkey = b.s_suppkey")
def j17(spark, d):
    e = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("description"))
    return G.consistency(e, t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), 10 + F.col("s_suppkey") % 40).alias("description")))


@query("j18_isolated", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j18(spark, d):
    o = t(spark, d, "orders")
    edges = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"))
    return G.isolated(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), edges)


def part_words(spark, d) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("tokens"))


JACCARD_SQL = """
w AS (SELECT p_partkey AS id, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS s FROM part),
c AS (SELECT s, min(id) AS class_id, count(*) AS members FROM w GROUP BY s),
j AS (SELECT a.class_id AS a, b.class_id AS b, a.members AS members_a, b.members AS members_b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS jaccard FROM c a JOIN c b ON a.class_id < b.class_id)
"""


@query("j19_u05_jaccard_pairs", f"WITH {JACCARD_SQL} SELECT a, b, members_a, members_b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.7")
def j19(spark, d):
    """Pairs of different sets of words, each by its smallest id, and how many parts have them; j19_word_classes has the members."""
    classes = R.word_classes(part_words(spark, d))
    pairs = R.jaccard_pairs(classes.select(F.col("class_id").alias("id"), "tokens"), 0.7)
    size = classes.select("class_id", "members")
    return pairs.join(size.toDF("a", "members_a"), "a").join(size.toDF("b", "members_b"), "b").select("a", "b", "members_a", "members_b", F.round("jaccard", 6).alias("jaccard"))


@query("j19_word_classes", f"WITH {JACCARD_SQL} SELECT w.id, c.class_id FROM w JOIN c USING (s)")
def j19_classes(spark, d):
    sets = part_words(spark, d).withColumn("tokens", F.array_sort("tokens"))
    return sets.join(R.word_classes(sets).select("tokens", "class_id"), "tokens").select("id", "class_id")


@query("j19_jaccard_clusters")
def j19_clusters(spark, d):
    """id, leader of every part: classes of equal words elect leaders, as members join their first one's leader."""
    classes = R.word_classes(part_words(spark, d)).select(F.col("class_id").alias("id"), "tokens")
    leaders = R.elect_leaders(classes, R.jaccard_pairs(classes, 0.7), written(spark)).select(F.col("id").alias("class_id"), "leader")
    return j19_classes(spark, d).join(leaders, "class_id").select("id", "leader")


#: Sets of words of documents by class, and the pairs of classes as DuckDB finds them: all with all.
TEXT_SETS_SQL = """
w AS MATERIALIZED (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> ''))) AS s FROM documents),
c AS MATERIALIZED (SELECT s, min(id) AS class_id, count(*) AS members FROM w GROUP BY s),
j AS MATERIALIZED (SELECT * FROM (SELECT a.class_id AS a, b.class_id AS b, len(list_intersect(a.s, b.s)) AS common, len(a.s) + len(b.s) AS summed FROM c a JOIN c b ON a.class_id < b.class_id
  AND least(len(a.s), len(b.s)) >= 0.9 * greatest(len(a.s), len(b.s)) AND len(a.s) > 0) WHERE common / (summed - common) >= 0.9)
"""


def document_classes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Of each document the class of its set of words, and the classes. Words stand as 64-bit hashes,
    so two words of one hash would count as one; a set's key is the SHA-256 of these, as a whole set would be a long key."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    tokens = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))
    sets = t(spark, d, "documents").select(F.col("doc_id").alias("id"), tokens.alias("tokens")).withColumn("key", F.sha2(F.array_join(F.col("tokens").cast("array<string>"), " "), 256))
    classes = written(spark)(sets.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("members"), F.min_by("tokens", "id").alias("tokens")))
    return sets.select("id", "key"), classes


@query("j19_document_pairs", f"WITH {TEXT_SETS_SQL} SELECT j.a, j.b, x.members AS members_a, y.members AS members_b, round(common / (summed - common), 6) AS jaccard FROM j JOIN c x ON x.class_id = j.a JOIN c y ON y.class_id = j.b")
def j19_documents(spark, d):
    """Pairs of different sets of words of documents of Jaccard 0.9 and more, each by its smallest document, and how many documents have them."""
    _, classes = document_classes(spark, d)
    pairs = R.jaccard_pairs(classes.select(F.col("class_id").alias("id"), "tokens"), 0.9)
    size = classes.select("class_id", "members")
    return pairs.join(size.toDF("a", "members_a"), "a").join(size.toDF("b", "members_b"), "b").select("a", "b", "members_a", "members_b", F.round("jaccard", 6).alias("jaccard"))


@query("j19_document_clusters", f"""
WITH RECURSIVE {TEXT_SETS_SQL},
o AS MATERIALIZED (SELECT class_id AS id, row_number() OVER (ORDER BY class_id) AS n, (SELECT list(a ORDER BY a) FROM j WHERE b = class_id) AS before FROM c),
walk(n, id, leader, leaders) AS (
  SELECT n, id, id, [id] FROM o WHERE n = 1
  UNION ALL SELECT o.n, o.id, coalesce(list_min(list_intersect(coalesce(o.before, []), w.leaders)), o.id), CASE WHEN list_has_any(coalesce(o.before, []), w.leaders) THEN w.leaders ELSE list_append(w.leaders, o.id) END FROM walk w JOIN o ON o.n = w.n + 1)
SELECT w.id, walk.leader, CAST(count(*) OVER (PARTITION BY walk.leader) AS BIGINT) AS members FROM w JOIN c USING (s) JOIN walk ON walk.id = c.class_id""")
def j19_document_clusters(spark, d):
    """Every document with the leader of its cluster and the cluster's size: in order of ids a class joins the first leader it resembles or leads itself."""
    members, classes = document_classes(spark, d)
    nodes = classes.select(F.col("class_id").alias("id"), "tokens")
    leaders = written(spark)(R.elect_leaders(nodes, R.jaccard_pairs(nodes, 0.9), written(spark)).select(F.col("id").alias("class_id"), "leader").join(classes.select("class_id", "key", "members"), "class_id"))
    sizes = leaders.groupBy("leader").agg(F.sum("members").alias("members"))
    return members.join(leaders.select("key", "leader"), "key").join(sizes, "leader").select("id", "leader", "members")


@query("j20_merge_nodes", f"WITH {COOC_SQL}, m AS (SELECT src - src % 10 AS src, dst - dst % 10 AS dst, weight FROM e) SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM m WHERE src <> dst GROUP BY 1, 2")
def j20(spark, d):
    leaders = t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("leader"))
    return G.merge_nodes(both_ways(spark, d).select("src", "dst", "weight"), leaders, 2 * G.pair_tasks(mentioned(spark, d))[1])


NAMED_SQL = "x AS (SELECT DISTINCT l_orderkey AS doc_id, lower(p_brand) AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 10), y AS (SELECT DISTINCT l_orderkey AS doc_id, lower(p_brand) AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount < 0.08), m AS (SELECT doc_id, name, x.doc_id IS NOT NULL AS expected, y.doc_id IS NOT NULL AS actual FROM x FULL JOIN y USING (doc_id, name))"


def named(spark, d) -> DataFrame:
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    tasks = G.row_tasks(lines)
    rows = lines.repartition(tasks, "l_partkey").join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).withColumnsRenamed({"l_orderkey": "doc_id", "p_brand": "name"})
    return S.entity_match(rows.where("l_quantity > 10"), rows.where("l_discount < 0.08"), 2 * tasks)


@query("j21_entity_match", f"WITH {NAMED_SQL.replace('x.doc_id IS NOT NULL', 'coalesce(x.e, false)').replace('y.doc_id IS NOT NULL', 'coalesce(y.e, false)').replace('AS name FROM', 'AS name, true AS e FROM')} SELECT * FROM m")
def j21_match(spark, d):
    return named(spark, d)


@query("j21_a04_extraction", f"""
WITH {NAMED_SQL.replace('x.doc_id IS NOT NULL', 'coalesce(x.e, false)').replace('y.doc_id IS NOT NULL', 'coalesce(y.e, false)').replace('AS name FROM', 'AS name, true AS e FROM')},
p AS (SELECT doc_id, coalesce(count(*) FILTER (expected AND actual) / nullif(count(*) FILTER (actual), 0), 0) AS precision, coalesce(count(*) FILTER (expected AND actual) / nullif(count(*) FILTER (expected), 0), 0) AS recall FROM m GROUP BY doc_id),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM p)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f UNION ALL SELECT 'all', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM f""")
def j21(spark, d):
    return S.extraction_prf(named(spark, d)).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("all")))


@query("a01_graph_stats", "SELECT 'node' AS kind, p_brand AS label, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'node', NULL, count(*) FROM part UNION ALL SELECT 'edge', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'edge', NULL, count(*) FROM lineitem")
def a01(spark, d):
    return G.graph_stats(t(spark, d, "part").select(F.col("p_brand").alias("type")), t(spark, d, "lineitem").select(F.col("l_returnflag").alias("rel_type")))


@query("a02_table_stats", " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in ("documents", "pages", "events", "part", "labels")))
def a02(spark, d):
    rows = [t(spark, d, x).select(F.lit(x).alias("name")).groupBy("name").agg(F.count("*").alias("n")) for x in ("documents", "pages", "events", "part", "labels")]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@query("a03_resolution_score", """
WITH d AS (SELECT lang AS category, quality = 1 AS e, toxic = 1 OR doc_id % 3 = 0 AS a, doc_id AS e_id, doc_id - doc_id % 2 AS a_id FROM documents JOIN labels USING (doc_id)),
x AS (SELECT category, count(*) AS n, round(avg(CASE WHEN e = a THEN 1.0 ELSE 0.0 END), 6) AS decision_accuracy, round(avg(CASE WHEN e = a AND (NOT e OR e_id = a_id) THEN 1.0 ELSE 0.0 END), 6) AS entity_accuracy,
      coalesce(count(*) FILTER (e AND a AND e_id = a_id) / nullif(count(*) FILTER (a), 0), 0) AS p, coalesce(count(*) FILTER (e AND a AND e_id = a_id) / nullif(count(*) FILTER (e), 0), 0) AS r FROM d GROUP BY GROUPING SETS ((category), ()))
SELECT category, n, decision_accuracy, entity_accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM x""")
def a03(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    expected, actual = F.col("quality") == 1, (F.col("toxic") == 1) | (F.col("doc_id") % 3 == 0)
    name = lambda c: F.when(c, "MERGE").otherwise("NEW")
    return S.resolution_score(rows.select(F.col("lang").alias("category"), name(expected).alias("expected"), name(actual).alias("actual"), F.when(expected, F.col("doc_id")).alias("expected_id"), F.when(actual, F.col("doc_id") - F.col("doc_id") % 2).alias("actual_id")))


@query("a05_run_metrics", "SELECT coalesce(CAST(user_id AS VARCHAR), 'all') AS run, count(*) AS n, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS precision, round(count(*) FILTER (value > 50) / count(*), 6) AS hallucination_rate, round(1 - count(*) FILTER (value < 5) / count(*), 6) AS summary_quality FROM events GROUP BY ROLLUP (user_id)")
def a05(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("run"), (F.col("event_type") != "error").alias("is_valid"), (F.col("value") > 50).alias("is_hallucinated"), (F.col("value") < 5).alias("is_garbled"))
    return S.run_metrics(e).withColumn("run", F.coalesce(F.col("run").cast("string"), F.lit("all")))


@query("a06_merge_entities", """
WITH u AS (SELECT p_brand AS id, p_partkey AS ord, p_name AS description, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'https://example.com/' || p_size END AS url, p_type AS tool, p_retailprice AS confidence, CASE WHEN p_size < 25 THEN 'unknown' ELSE p_type END AS content_type FROM part),
t AS (SELECT id, description, min(ord) AS o FROM u GROUP BY 1, 2), tt AS (SELECT id, string_agg(description, ' | ' ORDER BY o) AS description FROM t GROUP BY id),
w AS (SELECT id, url, min(ord) AS o FROM u GROUP BY id, CASE WHEN url = '' THEN CAST(ord AS VARCHAR) ELSE url END, url), ww AS (SELECT id, string_agg(url, ',' ORDER BY o) AS urls FROM w GROUP BY id),
x AS (SELECT id, lower(tool) AS k, arg_min(tool, ord) AS tool, min(ord) AS o FROM u GROUP BY 1, 2), xx AS (SELECT id, string_agg(tool, ',' ORDER BY o) AS tools FROM x GROUP BY id)
SELECT u.id, tt.description, urls, tools, max(confidence) AS confidence, count(*) AS version, coalesce(arg_max(content_type, ord) FILTER (content_type <> 'unknown'), 'unknown') AS content_type
FROM u JOIN tt ON u.id = tt.id JOIN ww ON u.id = ww.id JOIN xx ON u.id = xx.id GROUP BY u.id, tt.description, urls, tools""")
def a06(spark, d):
    url = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("https://example.com/"), "p_size"))
    updates = t(spark, d, "part").select(
        F.col("p_brand").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("description"), F.array(F.struct(F.col("p_name").alias("title"), url.alias("url"))).alias("web_info"),
        F.array("p_type").alias("tools"), F.array("p_type").alias("tags"), F.col("p_retailprice").alias("confidence"), F.when(F.col("p_size") < 25, "unknown").otherwise(F.col("p_type")).alias("content_type"),
    )
    return S.merge_entities(updates).select("id", "description", F.array_join("web_info.url", ",").alias("urls"), F.array_join("tools", ",").alias("tools"), "confidence", "version", "content_type")


@query("a07_relationship_upsert", "SELECT l_partkey, l_suppkey, l_returnflag, max(l_discount) AS confidence, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1, 2, 3")
def a07(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.max("l_discount").alias("confidence"), F.min("l_orderkey").alias("first_order"))


@query("a08_entity_update", "SELECT c_custkey, greatest(c_acctbal, coalesce(o.m, c_acctbal)) AS confidence, 1 + coalesce(o.n, 0) AS version FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def a08(spark, d):
    o = t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("m"), F.count("*").alias("n"))
    return t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.greatest("c_acctbal", F.coalesce("m", "c_acctbal")).alias("confidence"), (F.lit(1) + F.coalesce("n", F.lit(0))).alias("version"))


@query("a09_usage_summary", """
WITH c AS (SELECT role AS task, CASE WHEN conv_id % 2 = 0 THEN 'primary' ELSE 'fallback' END AS route, length(text) // 4 AS tokens FROM conversations)
SELECT task, route, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens / 1000 * CASE route WHEN 'primary' THEN 0.15 ELSE 0.6 END), 6) AS cost, CAST(sum(tokens) // count(*) AS BIGINT) AS average FROM c GROUP BY CUBE (task, route)""")
def a09(spark, d):
    calls = t(spark, d, "conversations").select(F.col("role").alias("task"), F.when(F.col("conv_id") % 2 == 0, "primary").otherwise("fallback").alias("route"), T.est_tokens(F.col("text")).alias("tokens"))
    return S.usage_summary(calls, {"primary": 0.15, "fallback": 0.6})


@query("a10_report_metadata", "SELECT source, count(DISTINCT lang) AS topics, count(*) AS items, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def a10(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("topics"), F.count("*").alias("items"), F.sum("n_chars").alias("chars"))


@query("a11_group_by_topic", "SELECT p_brand AS topic, coalesce(CASE WHEN p_size % 3 > 0 THEN nullif(split_part(p_type, ' ', 1), '') END, 'general') AS subtopic, count(*) AS n FROM part GROUP BY 1, 2")
def a11(spark, d):
    subtopic = F.coalesce(F.when(F.col("p_size") % 3 > 0, F.nullif(F.get(F.split("p_type", " "), F.lit(0)), F.lit(""))), F.lit("general"))
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("topic"), subtopic.alias("subtopic")).agg(F.count("*").alias("n"))


@query("a12_a13_batch_stats", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS completed, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS rate FROM events GROUP BY user_id")
def a12(spark, d):
    ok = F.count_if(F.col("event_type") != "error")
    return t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), ok.alias("completed"), F.round(F.try_divide(ok, F.count("*")), 6).alias("rate"))


@query("a13_job_rollup", "SELECT user_id, event_type AS state, count(*) AS n FROM events GROUP BY 1, 2")
def a13(spark, d):
    return t(spark, d, "events").groupBy("user_id", F.col("event_type").alias("state")).agg(F.count("*").alias("n"))


@query("a14_cleanup_flags", """
WITH f AS (SELECT c_custkey, c_acctbal / 10000 > 0 AND c_acctbal / 10000 < 0.3 AS low, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1997-01-01') AS stale, c_custkey NOT IN (SELECT o_custkey FROM orders) AS alone FROM customer)
SELECT 'low_confidence' AS flag, count(*) FILTER (low) AS flagged, count(*) FILTER (low) AS matching FROM f
UNION ALL SELECT 'stale', count(*) FILTER (stale AND NOT low), count(*) FILTER (stale) FROM f UNION ALL SELECT 'isolated', count(*) FILTER (alone AND NOT low AND NOT stale), count(*) FILTER (alone) FROM f""")
def a14(spark, d):
    last = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last"))
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("confidence")).join(last, "id", "left")
    fresh = F.coalesce(F.col("last") >= F.expr("timestamp_ntz'1997-01-01'"), F.lit(False))
    found = S.cleanup_flags(rows.select("id", "confidence", (~fresh).alias("stale"), F.col("last").isNull().alias("isolated")))
    every = spark.createDataFrame([("low_confidence",), ("stale",), ("isolated",)], "flag string")
    return every.join(found, "flag", "left").fillna(0, ["flagged", "matching"])


@query("a15_ocr_rollup", """
WITH s AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS ord FROM conversations),
f AS (SELECT conv_id, turn, coalesce(string_agg(word, ' ' ORDER BY ord) FILTER (length(word) >= 3 AND trim(word) <> ''), '') AS text, coalesce(avg(length(word) * 10) FILTER (length(word) >= 3 AND trim(word) <> ''), 0) AS c FROM s GROUP BY 1, 2)
SELECT conv_id AS video, count(*) AS frames, count(*) FILTER (text <> '') AS frames_with_text, round(coalesce(avg(c) FILTER (text <> ''), 0), 4) AS confidence, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (text <> ''), '')) AS text_md5 FROM f GROUP BY conv_id""")
def a15(spark, d):
    words = t(spark, d, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").alias("frame"), F.posexplode(F.split("text", " ")).alias("ord", "word"))
    return S.ocr_rollup(words.withColumn("confidence", (F.length("word") * 10).cast("double"))).withColumn("text_md5", F.md5("text")).drop("text")


@query("a16_type_histogram", "SELECT p_type, count(*) AS n FROM part WHERE p_type NOT LIKE 'PROMO%' GROUP BY p_type")
def a16(spark, d):
    return t(spark, d, "part").where(~F.col("p_type").startswith("PROMO")).groupBy("p_type").agg(F.count("*").alias("n"))


@query("a17_review_queue", "SELECT (SELECT count(*) FROM part WHERE p_size >= 10) AS described, (SELECT count(*) FROM part WHERE p_size < 10) AS undescribed, count(*) FILTER (l_discount >= 0.08) AS strong, count(*) FILTER (l_discount < 0.05) AS weak FROM lineitem")
def a17(spark, d):
    nodes = t(spark, d, "part").select(F.when(F.col("p_size") >= 10, F.col("p_name")).alias("description"))
    own = nodes.agg(F.count("description").alias("described"), F.count_if(F.col("description").isNull()).alias("undescribed"))
    return own.join(t(spark, d, "lineitem").agg(F.count_if(F.col("l_discount") >= 0.08).alias("strong"), F.count_if(F.col("l_discount") < 0.05).alias("weak")), F.lit(True))


@query("a18_source_summary", "WITH m AS (SELECT max(o_orderdate) AS at FROM orders) SELECT count(DISTINCT o_custkey) AS sources, CAST(sum(n) AS BIGINT) AS entities, count(DISTINCT o_custkey) FILTER (o_orderdate >= m.at - INTERVAL 7 DAY) AS recent FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey, m")
def a18(spark, d):
    o, n = t(spark, d, "orders"), t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = o.join(n, F.col("o_orderkey") == F.col("l_orderkey")).join(o.agg(F.max("o_orderdate").alias("as_of")), F.lit(True))
    recent = F.when(F.col("o_orderdate") >= F.col("as_of") - F.expr("INTERVAL 7 DAY"), F.col("o_custkey"))
    return rows.agg(F.count_distinct("o_custkey").alias("sources"), F.sum("n").alias("entities"), F.count_distinct(recent).alias("recent"))


@query("a19_meaningful_stats", "WITH n AS (SELECT p_partkey, p_brand FROM part WHERE p_size > 10) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM n) AND l_suppkey IN (SELECT p_partkey FROM n)) AS edges, (SELECT count(DISTINCT p_brand) FROM n) AS types")
def a19(spark, d):
    n = t(spark, d, "part").where("p_size > 10")
    keys = n.select("p_partkey")
    edges = t(spark, d, "lineitem").join(keys, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(keys, F.col("l_suppkey") == F.col("p_partkey"), "left_semi").agg(F.count("*").alias("edges"))
    return n.agg(F.count("*").alias("nodes"), F.count_distinct("p_brand").alias("types")).join(edges, F.lit(True)).select("nodes", "edges", "types")


@query("w01_w02_keep_best", "WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) SELECT p_brand, p_partkey FROM r WHERE n = 1")
def w01(spark, d):
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t(spark, d, "part").withColumn("n", rank).where("n = 1").select("p_brand", "p_partkey")


@query("w03_fit_context", "WITH r AS (SELECT conv_id, turn, sum(length(role) // 4 + length(text) // 4 + 20) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM r WHERE used <= 200")
def w03(spark, d):
    hits = t(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("name"), F.col("text").alias("description"))
    return Q.fit_context(hits, 200).select(F.col("query_id").alias("conv_id"), F.col("rank").alias("turn"), "used")


@query("w04_w05_diversity", "WITH h AS (SELECT o_custkey, o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders WHERE o_totalprice / 500000 >= 0.3) SELECT o_custkey, o_orderkey, n = 1 AS boosted FROM h")
def w04(spark, d):
    hits = t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), (F.col("o_totalprice") / 500000).alias("base")).withColumn("score", F.col("base"))
    return Q.diversity_boost(hits).select(F.col("query_id").alias("o_custkey"), F.col("id").alias("o_orderkey"), (F.col("score") > F.col("base")).alias("boosted"))


@query("w06_retain_recent", "WITH r AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_id, user_id FROM r WHERE n <= 50 OR rn <= 10")
def w06(spark, d):
    return W.retain_recent(t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id")


@query("w10_valid_at", "WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_until FROM orders) SELECT o_custkey, o_orderkey FROM v WHERE valid_from <= TIMESTAMP '1996-06-30' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1996-06-30')")
def w10(spark, d):
    until = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    v = t(spark, d, "orders").withColumn("valid_from", F.col("o_orderdate")).withColumn("valid_until", until)
    return W.valid_at(v, F.lit("1996-06-30").cast("timestamp_ntz")).select("o_custkey", "o_orderkey")


@query("w05_type_diversity", "SELECT o_custkey AS query_id, least(1.0, count(DISTINCT o_orderpriority) / 5) AS diversity FROM orders GROUP BY o_custkey")
def w05(spark, d):
    return S.type_diversity(t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("type")))


@query("w12_fixed_interval", """
WITH e AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS t FROM events), s AS (SELECT *, CAST(floor(t / 21600 + 0.5) AS BIGINT) AS step FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, step ORDER BY abs(t - step * 21600), t) AS n FROM s) SELECT user_id, step, t AS "at" FROM r WHERE n = 1""")
def w12(spark, d):
    return W.fixed_interval(t(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at")), "user_id", "at", 21600.0)


@query("w13_version_history", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS version FROM events")
def w13(spark, d):
    return W.version_history(t(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "version")


@query("k01_top_k", "WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) SELECT l_orderkey, l_linenumber FROM r WHERE n <= 3")
def k01(spark, d):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    return t(spark, d, "lineitem").withColumn("n", rank).where("n <= 3").select("l_orderkey", "l_linenumber")


@query("k02_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders) > 60 AS has_more FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def k02(spark, d):
    return S.page(t(spark, d, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 40).select("o_orderkey", "total", "has_more")


@query("k03_k04_k06_listing", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 100")
def k03(spark, d):
    return t(spark, d, "orders").orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@query("u03_u04_sets", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'absent', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u03(spark, d):
    o = t(spark, d, "orders")
    both = o.where("o_orderstatus = 'O'").select("o_custkey").intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))
    absent = t(spark, d, "customer").select("c_custkey").subtract(o.select("o_custkey"))
    return both.agg(F.lit("both").alias("kind"), F.count("*").alias("n")).union(absent.agg(F.lit("absent"), F.count("*")))


@query("s08_upsert", "WITH u AS (SELECT o_custkey AS id, o_totalprice AS v, o_orderdate AS wrote, o_orderkey AS k FROM orders UNION ALL SELECT c_custkey, c_acctbal, TIMESTAMP '1990-01-01', 0 FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY wrote DESC, k DESC) AS n FROM u) SELECT id, v FROM r WHERE n = 1")
def s08(spark, d):
    target = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.struct(F.lit("1990-01-01").cast("timestamp_ntz").alias("at"), F.lit(0).cast("long").alias("k")).alias("o"))
    updates = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"), F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("k")).alias("o"))
    return G.upsert_by_key(target, updates, ["id"], "o").select("id", "v")


@query("s09_s13_delete_append", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def s09(spark, d):
    gone = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    left = G.delete_keys(t(spark, d, "customer").select("c_custkey"), gone, ["c_custkey"])
    return G.append_new(left, gone, ["c_custkey"])


def ask(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries (every hundredth vector with its part's name), documents (parts with a vector), degrees. Parts are never broadcast: they grow with
    the input, and the driver would hold them."""
    v = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    queries = v.where("vec_id % 100 = 0").join(t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name").hint("merge"), F.col("k") == F.col("vec_id") + 1).select(F.col("vec_id").alias("query_id"), F.col("p_name").alias("query"), "v")
    docs = v.join(t(spark, d, "part").hint("merge"), F.col("p_partkey") == F.col("vec_id") + 1).select(F.col("vec_id").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("body"), "v", F.col("p_brand").alias("type"))
    degrees = t(spark, d, "lineitem").groupBy((F.col("l_partkey") - 1).alias("id")).agg(F.least(F.lit(5), F.count("*")).alias("degree"))
    return queries, docs, degrees


def ask_whole(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ask(), of all vectors and all parts: a document has a vector, a body or both, and those whose id 100 divides ask."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    part = t(spark, d, "part").select((F.col("p_partkey") - 1).alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("body"), F.col("p_brand").alias("type"), F.col("p_name").alias("query"))
    every = v.join(part, "id", "full_outer")
    queries = every.where("id % 100 = 0").select(F.col("id").alias("query_id"), "query", "v")
    return queries, every.drop("query"), ask(spark, d)[2]


@query("r01_vector_search", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), k AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS n FROM v a JOIN v b ON true WHERE a.vec_id % 100 = 0 AND list_cosine_similarity(a.e, b.e) >= 0.3) SELECT query_id, id, round(s, 4) AS score FROM k WHERE n <= 40")
def r01(spark, d):
    v = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    found = R.knn_join(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "base_id"), 40, 0.3)
    return found.select("query_id", F.col("base_id").alias("id"), F.round("score", 4).alias("score"))


TOKENS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> ''))"
ASK_SQL = f"""
docs AS (SELECT vec_id AS id, p_name || ' ' || p_type AS body FROM embeddings JOIN part ON p_partkey = vec_id + 1),
queries AS (SELECT vec_id AS query_id, p_name AS query FROM embeddings JOIN part ON p_partkey = vec_id + 1 WHERE vec_id % 100 = 0),
post AS (SELECT id, unnest({TOKENS_SQL.format(c='body')}) AS token FROM docs), asked AS (SELECT query_id, unnest({TOKENS_SQL.format(c='query')}) AS token FROM queries),
df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
hits AS (SELECT query_id, id, sum(1.0::DOUBLE / df) AS s FROM asked JOIN post USING (token) JOIN df USING (token) GROUP BY 1, 2),
full_hits AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS n FROM hits)
"""


@query("r02_fulltext_search", f"WITH {ASK_SQL} SELECT query_id, id, CAST(1.0 AS DOUBLE) AS score FROM full_hits WHERE n <= 40")
def r02(spark, d):
    queries, docs, _ = ask(spark, d)
    return Q.fulltext_search(queries, docs, 40)


@query("r03_contains_search", "SELECT n_nationkey AS query_id, c_custkey AS id FROM nation JOIN customer ON contains(lower(c_name), CAST(n_nationkey AS VARCHAR))")
def r03(spark, d):
    queries = t(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_nationkey").cast("string").alias("query"))
    return Q.contains_search(queries, t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body")))


WEIGHT_SQL = "CASE WHEN {w} <= 2 THEN {a} ELSE {b} END"
HYBRID_SQL = f"""{ASK_SQL},
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings JOIN part ON p_partkey = vec_id + 1),
near AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS vector, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS n
         FROM v a JOIN v b ON true WHERE a.vec_id % 100 = 0 AND list_cosine_similarity(a.e, b.e) >= 0.3),
both_hits AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.id, y.id) AS id, coalesce(vector, 0.0) AS vector, CASE WHEN y.id IS NULL THEN 0.0 ELSE 1.0 END AS fulltext
         FROM (SELECT * FROM near WHERE n <= 40) x FULL JOIN (SELECT * FROM full_hits WHERE n <= 40) y ON x.query_id = y.query_id AND x.id = y.id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vector, 6) DESC, fulltext DESC, id) AS ord FROM both_hits),
deg AS (SELECT l_partkey - 1 AS id, least(5, count(*)) AS degree FROM lineitem GROUP BY 1),
w AS (SELECT query_id, CASE WHEN {WORDS_SQL.format(c='query')} <= 2 THEN 0 ELSE 1 END AS c FROM queries),
s AS (SELECT o.query_id, o.id, vector, fulltext, CASE WHEN ord <= 20 THEN coalesce(least(0.3, 0.05 * degree), 0.0) ELSE 0.0 END AS graph, c FROM o LEFT JOIN deg ON o.id = deg.id JOIN w ON o.query_id = w.query_id),
f AS (SELECT query_id, id, vector, fulltext, graph, round(CASE WHEN c = 0 THEN {WEIGHTS['lookup'][0]} * vector + {WEIGHTS['lookup'][1]} * fulltext + {WEIGHTS['lookup'][2]} * graph ELSE {WEIGHTS['balanced'][0]} * vector + {WEIGHTS['balanced'][1]} * fulltext + {WEIGHTS['balanced'][2]} * graph END, 6) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
"""


@query("r04_r05_hybrid_search", f"WITH {HYBRID_SQL} SELECT query_id, id, round(vector, 4)::DOUBLE AS vector, fulltext::DOUBLE AS fulltext, round(graph, 4)::DOUBLE AS graph, round(score, 4)::DOUBLE AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def r05(spark, d):
    queries, docs, degrees = ask(spark, d)
    return Q.hybrid_search(queries, docs, degrees).select("query_id", "id", F.round("vector", 4).alias("vector"), "fulltext", F.round("graph", 4).alias("graph"), F.round("score", 4).alias("score"), "rank")


@query("r06_retrieve_context")
def r06(spark, d):
    queries, docs, degrees = ask_whole(spark, d)
    about = docs.select("id", F.coalesce("type", F.lit("unknown")).alias("type"), F.col("body").alias("description"))
    hits = Q.hybrid_search(queries, docs, degrees).join(about, "id").withColumn("name", F.col("type"))
    return Q.retrieve_context(hits.drop("rank"), 0.3, 20, 200).select("query_id", "id", "rank", "used")


@query("r07_search_with_fallback")
def r07(spark, d):
    """Queries, documents and hits are written once, as each is used several times."""
    write, (queries, docs, degrees) = written(spark), ask(spark, d)
    queries, docs = write(queries), write(docs)
    hits = write(Q.hybrid_search(queries, docs, degrees, 5, 0.99).select("query_id", "id"))
    return Q.search_with_fallback(hits, queries.withColumn("query", F.substring_index("query", " ", 1)), docs)


def events(spark, d) -> DataFrame:
    return X.read_events(spark, d)


@query("x01_project_outbox", """
WITH e AS (SELECT event_id, ts, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events),
m AS (SELECT *, CASE event_type WHEN 'signup' THEN 'entity' WHEN 'view' THEN 'chunk' WHEN 'purchase' THEN 'relationship' WHEN 'error' THEN 'failed' ELSE CASE k % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'relationship' ELSE 'content' END END AS grp, event_type = 'click' AS deleted,
      CASE WHEN event_type = 'signup' OR event_type = 'click' AND k % 3 <> 1 THEN CAST(user_id AS VARCHAR) WHEN event_type = 'error' THEN CAST(event_id AS VARCHAR) ELSE user_id || '-' || k END AS id FROM e),
g AS (SELECT grp, id, max(row(ts, event_id)) AS gone_at FROM m WHERE deleted GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY ts DESC, event_id DESC) AS n FROM m WHERE grp <> 'content')
SELECT l.grp, l.id, l.event_id FROM l WHERE n = 1 AND NOT deleted
AND NOT EXISTS (SELECT 1 FROM g WHERE l.grp = 'relationship' AND g.grp = 'entity' AND g.id = CAST(l.user_id AS VARCHAR) AND g.gone_at > row(l.ts, l.event_id))
AND NOT EXISTS (SELECT 1 FROM g WHERE l.grp = 'relationship' AND g.grp = 'entity' AND g.id = CAST(l.k AS VARCHAR) AND g.gone_at > row(l.ts, l.event_id))
AND NOT EXISTS (SELECT 1 FROM g WHERE l.grp = 'chunk' AND g.grp = 'content' AND g.id = CAST(l.user_id AS VARCHAR) AND g.gone_at > row(l.ts, l.event_id))""")
def x01(spark, d):
    """The event log as outbox events of all kinds: signups make entities, purchases relationships, views chunks, clicks delete."""
    state, kind, k = scratch(spark, "outbox"), F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    e = X.in_slices(t(spark, d, "events"), scratch(spark, "log")).withColumn("k", k)
    deletes = F.when(F.col("k") % 3 == 0, "entity.delete").when(F.col("k") % 3 == 1, "relationship.delete").otherwise("content.delete")
    kinds = F.when(kind == "signup", "entity.upsert").when(kind == "view", "chunk.upsert").when(kind == "purchase", "relationship.upsert").when(kind == "click", deletes).otherwise(kind)
    user, pair = F.col("user_id").cast("string"), F.concat_ws("-", "user_id", "k")
    e = e.select("event_id", "ts", kinds.alias("kind"), user.alias("a"), F.col("k").cast("string").alias("b"), pair.alias("pair"))
    whole = F.col("kind").isin("entity.upsert", "entity.delete", "content.delete")
    e = e.select("event_id", "ts", "kind", F.when(whole, F.col("a")).otherwise(F.col("pair")).alias("id"), "a", F.when(F.col("kind").startswith("relationship"), F.col("b")).alias("b"))
    X.project_outbox(e, state, f"{state}-checkpoint")
    return X.projection(X.outbox_state(spark, state))


@query("x02_retry_state", """
WITH e AS (SELECT *, user_id * 10 + day(ts) // 6 AS job FROM events), r AS (SELECT job, event_type = 'error' AS failed, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM e), s AS (SELECT job, count(*) FILTER (failed) AS attempts, arg_max(failed, n) AS last_failed FROM r GROUP BY 1)
SELECT job, attempts, CASE WHEN attempts >= 3 THEN 'dead' WHEN last_failed THEN 'pending' ELSE 'done' END AS status FROM s""")
def x02(spark, d):
    """A user's six days are a job."""
    jobs = t(spark, d, "events").withColumn("job", F.expr("user_id * 10 + day(ts) div 6"))
    return W.retry_state(jobs, "job", ["ts", "event_id"], F.col("event_type") == "error").select("job", "attempts", "status")


@query("x03_publish_events", "SELECT 'entity-' || p_partkey AS aggregate_id, 'entity.upsert' AS event_type FROM part UNION ALL SELECT DISTINCT l_partkey || '-' || l_suppkey, 'relationship.upsert' FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def x03(spark, d):
    part = t(spark, d, "part").select(T.node_id(F.col("p_partkey")).alias("aggregate_id"), F.lit("entity.upsert").alias("event_type"), F.to_json(F.struct("p_name", "p_type")).alias("payload"))
    li = t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    known = li.join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    rels = known.select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("aggregate_id"), F.lit("relationship.upsert").alias("event_type"), F.to_json(F.struct("l_partkey", "l_suppkey")).alias("payload"))
    return part.unionByName(rels).select("aggregate_id", "event_type")


@query("x04_rate_limit")
def x04(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    return W.rate_limit(e, "user_id", "t", "event_id", 3, 86400.0)


@query("x05_stale_jobs", "WITH h AS (SELECT user_id, max(ts) AS beat FROM events GROUP BY 1) SELECT user_id FROM h WHERE beat < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 600 SECOND")
def x05(spark, d):
    beat = t(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("beat"))
    return beat.where(F.col("beat") < F.expr("timestamp_ntz'2024-01-30 12:00:00' - INTERVAL 600 SECOND")).select("user_id")


@query("x06_retention", "SELECT 'history' AS kind, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY UNION ALL SELECT 'events', count(*) FROM events WHERE event_type IN ('error', 'purchase') AND ts < TIMESTAMP '2024-01-31' - INTERVAL 15 DAY")
def x06(spark, d):
    old = t(spark, d, "orders").where("o_orderdate < timestamp_ntz'1998-01-01' - INTERVAL 90 DAY").agg(F.lit("history").alias("kind"), F.count("*").alias("n"))
    return old.union(t(spark, d, "events").where("event_type IN ('error', 'purchase') AND ts < timestamp_ntz'2024-01-31' - INTERVAL 15 DAY").agg(F.lit("events"), F.count("*")))


@query("x07_dedup_stream", "SELECT event_id, user_id, CAST(1 AS BIGINT) AS n FROM events")
def x07(spark, d):
    """Each event comes twice, the second time an hour later; one of the two is kept."""
    path, given = scratch(spark, "dedup"), events(spark, d).select("event_id", "user_id", "ts")
    twice = given.union(given.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    kept = X.run_to_table(X.dedup_stream(twice, ["event_id"]).select("event_id", "user_id"), path, f"{path}-checkpoint")
    return kept.groupBy("event_id", "user_id").agg(F.count("*").alias("n"))


@query("x08_event_windows", """
WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT start, event_type, n FROM w, m WHERE start + INTERVAL 1 DAY <= mark""")
def x08(spark, d):
    path = scratch(spark, "windows")
    out = X.run_to_table(X.event_windows(events(spark, d)), path, f"{path}-checkpoint")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of stored pages with their pages and characters of main text: pages, normalized, extracted, aggregated."""

    pages = t(spark, d, "pages")
    text = extract_main_text(pages).select("page_id", F.length("text").alias("n_chars"))
    host = F.try_parse_url(T.normalize_url(F.col("url")), F.lit("HOST"))
    return pages.join(text, "page_id").groupBy(host.alias("host")).agg(F.count_distinct(T.content_hash(F.col("url"))).alias("pages"), F.sum("n_chars").alias("n_chars"))


query("flagship_host_counts")(flagship)
