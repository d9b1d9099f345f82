"""Search hits of entities: which are sound, which are about the entity, which are references, which is its address.

hits: entity, ord, url, title, snippet. Null texts count as empty; hits of equal ord are told apart by their url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import contains_any


def low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def authority() -> Column:
    return F.lower(F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.lit("")))


def first_hits(hits: DataFrame, most: int) -> DataFrame:
    """The first `most` hits of each entity, with their rank; Spark cuts each partition to `most` rows an entity before the shuffle."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("ord", "url"))).where(F.col("rank") <= most)


def is_sound() -> Column:
    """T24. No refused host, no refused title, a snippet of 20 characters (blanks at its ends don't count)."""
    bare = F.regexp_replace(authority(), r"^www\.", "")
    snippet = F.regexp_replace(F.coalesce("snippet", F.lit("")), r"^\s+|\s+$", "")
    return ~bare.isin(P.HIT_HOSTS) & ~low("title").rlike(f"(?i){P.HIT_TITLES}") & (F.length(snippet) >= 20)


def is_relevant() -> Column:
    """T24. No address, path or word of another field; the entity is named, or the hit is on github."""
    off = contains_any(low("url"), [*P.OFF_TOPIC_DOMAINS, *P.OFF_TOPIC_PATHS]) | contains_any(low("title"), P.OFF_TOPIC_WORDS) | contains_any(low("snippet"), P.OFF_TOPIC_WORDS)
    named = F.contains(low("title"), low("entity")) | F.contains(low("snippet"), low("entity"))
    return ~off & (named | F.contains(low("url"), F.lit("github.com")))


def relevant_hits(hits: DataFrame, most: int = 5) -> DataFrame:
    """T24. The first `most` sound and relevant hits of each entity, with their rank."""
    return first_hits(hits.where(is_sound() & is_relevant()), most)


def reference_links(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """T27. entities (name, confidence), hits -> entity, ord, title, url, snippet, origin: the hits that are references; where an entity has none,
    is at least 0.9 sure and its name looks like a site, that site, once."""
    kept = hits.where(~contains_any(low("url"), P.NO_REFERENCE_DOMAINS) & ~contains_any(low("title"), P.NO_REFERENCE_TITLES))
    kept = kept.select("entity", "ord", "title", "url", "snippet", F.lit("search").alias("origin"))
    sites = entities.where((F.col("confidence") >= 0.9) & F.col("name").rlike(P.SITE_NAME)).select(F.col("name").alias("entity")).distinct()
    bare = sites.join(kept.select("entity").distinct(), "entity", "left_anti")
    made = bare.select("entity", F.lit(None).cast(hits.schema["ord"].dataType).alias("ord"), F.col("entity").alias("title"), F.concat(F.lit("https://"), "entity").alias("url"), F.lit("Website found in video content").alias("snippet"), F.lit("ocr_extraction").alias("origin"))
    return kept.unionByName(made)


def best_url(hits: DataFrame, among: int = 5) -> DataFrame:
    """T28. entity, url: the first sound one of an entity's first `among` hits whose host holds no refused host."""
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    first = first_hits(hits, among).where(is_sound() & ~contains_any(host, P.HIT_HOSTS) & (F.coalesce("url", F.lit("")) != ""))
    return first.groupBy("entity").agg(F.min_by("url", "rank").alias("url"))


def fill_urls(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """T28. entities (name, type, url and more), with the best address where there is none or only the post's, unless the type has no site."""
    url, kind = F.coalesce("url", F.lit("")), F.coalesce("type", F.lit(""))
    wanting = ((url == "") | F.contains(url, F.lit("instagram.com"))) & (F.coalesce("name", F.lit("")) != "") & ~kind.isin(P.SITELESS_TYPES)
    found = best_url(hits).select(F.col("entity").alias("__entity"), F.col("url").alias("__url"))
    filled = F.when(wanting, F.coalesce("__url", "url")).otherwise(F.col("url"))
    return entities.join(found, F.col("name") == F.col("__entity"), "left").withColumn("url", filled).select(*[f"`{c}`" for c in entities.columns])
