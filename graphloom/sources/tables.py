"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.assembly import key_info
from ..functions.patterns import VIDEO_URL
from ..functions.text import keyword_category, words

#: Pairs of tags whose content is no text, and where a page's body is looked for, in order.
DROPPED = "script|style|nav|footer|header|aside"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S01. url, html, n_chars, n_words."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", "html", F.length("html").alias("n_chars"), F.size(words(F.col("html"))).alias("n_words"))


def extract_main_text(pages: DataFrame, least: int = 100) -> DataFrame:
    """S02. page_id, url, title, text by tag rules: dropped elements, then the first of main, article, a content div, else all."""
    bare = F.regexp_replace("html", rf"(?is)<({DROPPED})\b[^>]*>.*?</\1\s*>", " ")
    inner = lambda p: F.nullif(F.regexp_extract("bare", p, 1), F.lit(""))
    body = F.coalesce(inner(r"(?is)<main\b[^>]*>(.*?)</main\s*>"), inner(r"(?is)<article\b[^>]*>(.*?)</article\s*>"), inner(r"(?is)<div\b[^>]*class=\"[^\"]*(?:content|main|post)[^\"]*\"[^>]*>(.*?)</div\s*>"), F.col("bare"))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), F.lit("")), F.try_parse_url("url", F.lit("HOST")))
    text = F.regexp_replace(F.regexp_replace("body", r"(?s)<[^>]*>", " "), r"\s+", " ")
    for code, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(char))
    out = pages.withColumn("bare", bare).withColumn("body", body).select("page_id", "url", title.alias("title"), F.trim(text).alias("text"))
    return out.where(F.length("text") >= least)


def first_acceptable(df: DataFrame, candidates: list[str], least: int = 100) -> DataFrame:
    """S03. strategy and text: the first candidate column of over `least` characters."""
    made = F.coalesce(*[F.when(F.length(c) > least, F.struct(F.lit(c).alias("strategy"), F.col(c).alias("text"))) for c in candidates])
    return df.withColumn("__s", made).select(*[c for c in df.columns if c not in candidates], "__s.strategy", "__s.text")


def load_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """S04. type, term of a JSON file {"entity_patterns": {type: [term, ...]}}."""
    raw = spark.read.schema("entity_patterns map<string,array<string>>").json(path, multiLine=True)
    return raw.select(F.explode("entity_patterns").alias("type", "terms")).select("type", F.explode("terms").alias("term"))


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """S04. topic, label, subtopic."""
    raw = spark.read.schema("topics map<string,struct<label:string,subtopics:array<string>>>").json(path, multiLine=True)
    return raw.select(F.explode("topics").alias("topic", "t")).select("topic", "t.label", F.explode_outer("t.subtopics").alias("subtopic"))


def json_report(items: DataFrame) -> DataFrame:
    """S05. source, n_items, report (JSON): items (source, name, topic, url)."""
    listed = F.array_sort(F.collect_list(F.struct("name", "topic", "url")))
    return items.groupBy("source").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("url")).alias("websites"), listed.alias("items")).select("source", "n_items", F.to_json(F.struct("websites", "items")).alias("report"))


def markdown_report(items: DataFrame) -> DataFrame:
    """S06. source, report: a title and the items by topic, in order."""
    topics = items.groupBy("source", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda n: F.concat(F.lit("- "), n)), "\n").alias("lines"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("topic", "lines"))), lambda t: F.concat(F.lit("## "), t["topic"], F.lit("\n"), t["lines"]))
    return topics.groupBy("source").agg(F.concat(F.lit("# "), F.first("source"), F.lit("\n\n"), F.array_join(parts, "\n\n")).alias("report"))


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """S07. line: CREATE statements of nodes (id, type, name), MATCH ones of edges (src, dst, rel_type)."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = nodes.select(F.concat(F.lit("CREATE (:"), "type", F.lit(" {id: "), quoted("id"), F.lit(", name: "), quoted("name"), F.lit("});")).alias("line"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), quoted("src"), F.lit("}), (b {id: "), quoted("dst"), F.lit("}) CREATE (a)-[:"), "rel_type", F.lit("]->(b);")).alias("line"))
    return n.union(e)


def bucketed(df: DataFrame, at: str, days: int = 30) -> DataFrame:
    """S12. All columns and bucket: the number of the `days`-day span since 1970, to partition by on writing."""
    return df.withColumn("bucket", F.floor(F.datediff(F.col(at).cast("date"), F.lit("1970-01-01").cast("date")) / days))


def drop_old_buckets(df: DataFrame, as_of: str, keep_months: int = 6, days: int = 30) -> DataFrame:
    """S12. Rows of buckets that end after as_of less keep_months x 30 days."""
    return df.where((F.col("bucket") + 1) * days > F.datediff(F.lit(as_of).cast("date"), F.lit("1970-01-01").cast("date")) - keep_months * 30)


def concat_parts(df: DataFrame, group: str, order: list[str], text: str = "text") -> DataFrame:
    """S14. group, text: the parts that aren't blank, in order."""
    kept = df.where(F.trim(text) != "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text])
    return kept.groupBy(group).agg(F.array_join(parts, "\n\n").alias(text))


def chunk_graph(chunks: DataFrame, sources: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S17. Nodes and edges of sources (source), chunks (chunk_id, source, text) and mentions (entity, chunk_id, evidence)."""
    nodes = sources.select(F.concat(F.lit("source-"), "source").alias("id"), F.lit("Source").alias("label"), F.col("source").alias("text")).union(chunks.select(F.concat(F.lit("chunk-"), F.col("chunk_id").cast("string")), F.lit("Chunk"), F.substring("text", 1, 1000)))
    own = chunks.select(F.concat(F.lit("chunk-"), F.col("chunk_id").cast("string")).alias("src"), F.concat(F.lit("source-"), "source").alias("dst"), F.lit("EXTRACTED_FROM").alias("rel_type"), F.lit("").alias("evidence"))
    held = mentions.select(F.concat(F.lit("entity-"), "entity").alias("src"), F.concat(F.lit("chunk-"), F.col("chunk_id").cast("string")).alias("dst"), F.lit("EXTRACTED_FROM").alias("rel_type"), F.substring("evidence", 1, 500).alias("evidence"))
    return nodes, own.union(held)


def ocr_entry(frames: DataFrame, group: str, order: list[str], as_of: str, text: str = "text") -> DataFrame:
    """S15. One row a video of what its frames show: address, theme, topic, category, preview, counts, addresses and tools; frames without text
    are left out, and so are videos without any."""
    key, full = F.col(group).cast("string"), F.col(text)
    whole = concat_parts(frames, group, order, text).withColumn("info", key_info(full))
    title = F.col("info.title")
    return whole.select(
        F.col(group).alias("video_id"),
        F.concat(F.lit(VIDEO_URL), key).alias("url"),
        F.when(title != "", F.substring(title, 1, 100)).otherwise(key).alias("theme"),
        title.alias("topic"),
        keyword_category(full).alias("category"),
        F.substring(full, 1, 500).alias("preview"),
        "info.word_count",
        "info.urls",
        "info.tools",
        F.lit("ocr_frame_extraction").alias("origin"),
        F.lit(as_of).alias("processed_at"),
    )
