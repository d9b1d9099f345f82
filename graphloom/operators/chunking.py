"""Documents to chunks (C01-C05): all folds and windows of Catalyst, within one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chunk_headers(docs: DataFrame, least: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """C01. key, piece (from 0), header_path, text: sections at Markdown headers, with the open ancestors' titles; short ones go."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    level = F.length(F.regexp_extract("content", r"^(#{1,6})\s+\S", 1))
    title = F.trim(F.regexp_replace("content", r"^#{1,6}\s+", ""))
    by_line = Window.partitionBy(key).orderBy("line")
    lines = lines.withColumn("level", level).withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(by_line))
    heads = lines.where("level > 0").select(key, "section", "level", title.alias("title"))
    # a header is open below a later one if it has a lower level than all headers since
    earlier = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    held = F.collect_list(F.struct("level", "title")).over(earlier)
    empty = F.expr("cast(array() as array<struct<level:int,title:string>>)")
    path = F.aggregate(held, empty, lambda acc, h: F.concat(F.filter(acc, lambda a: a["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title")))))
    heads = heads.select(key, "section", F.array_join(F.transform(path, lambda h: h["title"]), " > ").alias("header_path"))
    bodies = lines.groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("text"))
    whole = bodies.join(heads, [key, "section"], "left").withColumn("text", F.trim("text")).where(F.length("text") >= least)
    return whole.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("section")) - 1).alias("piece"), F.coalesce("header_path", F.lit("")).alias("header_path"), "text")


def split_large(pieces: DataFrame, tokens: int = 512, key: str = "doc_id") -> DataFrame:
    """C02. Paragraphs packed greedily up to the limit: key, piece, part, text."""
    cost = lambda s: F.floor(F.length(s) / 4)
    start = F.expr("cast(struct(array() as done, '' as open) as struct<done:array<string>,open:string>)")

    def step(acc, p):
        fits = (acc["open"] == "") | (cost(acc["open"]) + cost(p) <= tokens)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    packed = F.aggregate(F.split("text", r"\n\n+"), start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    keep = [c for c in pieces.columns if c not in ("text",)]
    return pieces.select(*keep, F.posexplode(packed).alias("part", "text"))


def add_overlap(pieces: DataFrame, key: str = "doc_id", order: str = "piece") -> DataFrame:
    """C03. Each piece after one of several paragraphs begins with the last paragraph before it."""
    by = Window.partitionBy(key).orderBy(order)
    paragraphs = F.split("text", r"\n\n+")
    many = F.max(F.size(paragraphs)).over(by.rowsBetween(Window.unboundedPreceding, -1)) > 1
    last = F.lag(F.element_at(paragraphs, -1)).over(by)
    return pieces.withColumn("text", F.when(F.coalesce(many, F.lit(False)), F.concat(last, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text")))


def contextualize(pieces: DataFrame, title: str = "title", key: str = "doc_id", order: str = "piece") -> DataFrame:
    """C04. chunk_index, tokens and the text; the first three chunks begin with title and section."""
    index = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    headed = F.concat(F.lit("[Title: "), F.col(title), F.lit("]\n"), F.when(F.col("header_path") == "", "").otherwise(F.concat(F.lit("[Section: "), F.col("header_path"), F.lit("]\n"))), F.col("text"))
    out = pieces.withColumn("chunk_index", index)
    out = out.withColumn("text", F.when(F.col("chunk_index") < 3, headed).otherwise(F.col("text")))
    return out.withColumn("tokens", F.floor(F.length("text") / 4)).select(key, "chunk_index", "header_path", "text", "tokens")


def marker_sections(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """C05. key, position, kind, number and text of each section that begins with a marker like [Caption] or [Carousel Image 2]:."""
    parts = docs.select(key, F.posexplode(F.split(text, r"(?=\[(?:Carousel Image \d+|Caption|Audio Transcript|English Transcript|Hindi Translation|Video Content|Video Frame OCR)\])")).alias("position", "part"))
    pattern = r"^\[([A-Za-z ]+?)(?: (\d+))?\]:?\s*"
    kind, number = F.regexp_extract("part", pattern, 1), F.regexp_extract("part", pattern, 2)
    return parts.select(key, "position", F.when(kind == "", "text").otherwise(kind).alias("kind"), F.when(number != "", number.cast("int")).alias("number"), F.trim(F.regexp_replace("part", pattern, "")).alias("text")).where("text <> ''")
