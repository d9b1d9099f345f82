"""Chunks to mentions to entities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.text import any_of, clean_entity_name

WORDS = r"[^\p{L}\p{N}_]+"


def detect_entities(chunks: DataFrame, gazetteer: DataFrame, most: int = 40, longest: int = 3, max_broadcast_rows: int = 200_000) -> DataFrame:
    """D01. chunks (doc_id, chunk, text), gazetteer (term, type, confidence) -> doc_id, chunk, name, type, confidence.

    Every run of words as long as a term of the gazetteer, `longest` at most, is looked up in it by a hash join; runs are made within a
    text's row, each once, so only hits are shuffled. Per document the first `most` names stay.
    """
    terms = gazetteer.where(F.length("term") >= 3)
    n_words = F.size(F.split("term", " "))
    seen = terms.where(n_words <= longest).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(n_words)).alias("sizes")).first()  # `longest` numbers at most
    words = F.filter(F.split(F.lower("text"), WORDS), lambda x: x != "")
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, n), " "))
    runs = [F.col("words") if n == 1 else F.when(F.size("words") >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in seen["sizes"]]
    split = chunks.select("doc_id", "chunk", words.alias("words"))
    found = split.select("doc_id", "chunk", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *runs))).alias("term"))
    terms = F.broadcast(terms) if seen["n"] <= max_broadcast_rows else terms
    hits = found.join(terms, "term").groupBy("doc_id", F.col("term").alias("name")).agg(F.min("chunk").alias("chunk"), F.max(F.struct("confidence", "type")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "name"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "chunk", "name", F.col("best.type").alias("type"), F.col("best.confidence").alias("confidence"))


def guess_type(df: DataFrame, dim: DataFrame) -> DataFrame:
    """D02. Type by lower name; concept if unknown."""
    return df.join(F.broadcast(dim.select(F.lower("name").alias("__k"), F.col("type").alias("__t"))), F.lower("name") == F.col("__k"), "left").withColumn("type", F.coalesce("__t", F.lit("concept"))).drop("__k", "__t")


SOCIAL = ["instagram.com", "facebook.com", "twitter.com", "x.com", "youtube.com", "youtu.be", "tiktok.com", "linkedin.com"]


def extract_url_entities(chunks: DataFrame) -> DataFrame:
    """D03. doc_id, name (host without www.), confidence, uses: links and www. names 0.95, bare domains 0.9; social hosts go."""
    linked = F.transform(F.regexp_extract_all("text", F.lit(r"(?:https?://|www\.)([A-Za-z0-9.-]+\.[A-Za-z]{2,})")), lambda h: F.struct(F.regexp_replace(F.lower(h), r"^www\.", "").alias("name"), F.lit(0.95).alias("confidence")))
    rest = F.regexp_replace("text", r"(?:https?://|www\.)\S+", " ")
    bare = F.transform(F.regexp_extract_all(rest, F.lit(r"(?:^|[\s(])([A-Za-z][A-Za-z0-9-]*\.(?:com|org|net|io|dev|app|ai|co))\b")), lambda h: F.struct(F.lower(h).alias("name"), F.lit(0.9).alias("confidence")))
    hits = chunks.select("doc_id", F.explode(F.concat(linked, bare)).alias("hit")).select("doc_id", "hit.*").where(~F.col("name").isin(SOCIAL))
    return hits.groupBy("doc_id", "name").agg(F.max("confidence").alias("confidence"), F.count("*").alias("uses"))


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """D04. Per lower name: the first row's name and type, all chunks, contexts joined, longest context."""
    ord_ = F.struct("doc_id", "chunk")
    contexts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "chunk", "context"))), lambda x: x["context"])
    return mentions.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", ord_).alias("name"), F.min_by("type", ord_).alias("type"), F.array_sort(F.collect_set("chunk")).alias("chunks"), F.array_join(contexts, " ... ").alias("context"), F.max(F.length("context")).alias("longest")
    )


def merge_detectors(*sources: DataFrame) -> DataFrame:
    """D05, U01. Sources (name, type, confidence) in order of precedence; a model's row (the last source) raises the confidence."""
    tagged = [s.select("name", "type", "confidence", F.lit(i).alias("prec"), F.lit(i == len(sources) - 1 or i == 0).alias("raises")) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    first = F.min_by(F.struct("name", "type", "confidence"), F.struct("prec", "name"))
    merged = union.groupBy(F.lower("name").alias("key")).agg(first.alias("first"), F.max(F.when(F.col("raises"), F.col("confidence"))).alias("raised"))
    return merged.select("key", "first.name", "first.type", F.greatest("first.confidence", F.coalesce("raised", "first.confidence")).alias("confidence"))


def validate_mentions(mentions: DataFrame, captions: DataFrame, generic: list[str], least: int = 2) -> DataFrame:
    """D06. mentions (doc_id, name), captions (doc_id, caption): names that stand in the caption, not within another name; all of a document if fewer than `least` would stay."""
    names = mentions.groupBy("doc_id").agg(F.collect_list(F.struct("name")).alias("names"))
    rows = names.join(captions.select("doc_id", F.lower("caption").alias("caption")), "doc_id", "left")  # a caption meets all names of its document at once

    def checked(x: Column) -> Column:
        low = F.lower(x["name"])
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), low, F.lit(r"\E(?![\p{L}\p{N}_])"))
        sound = ~x["name"].rlike(P.EMAIL) & ~any_of(low, P.PROGRESS_MARKER) & ~low.isin(generic)
        there = F.col("caption").isNotNull()
        return F.struct(x["name"].alias("name"), F.when(~there, True).otherwise(sound & F.contains("caption", low) & F.regexp_like("caption", pattern)).alias("ok"), there.alias("there"))

    every = rows.select("doc_id", F.transform("names", checked).alias("checked")).groupBy("doc_id").agg(F.flatten(F.collect_list("checked")).alias("every"))

    def kept(x: Column) -> Column:
        within = lambda o: o["ok"] & (F.length(o["name"]) > F.length(x["name"])) & F.contains(F.lower(o["name"]), F.lower(x["name"]))
        inside = F.exists("every", lambda o: (o["name"] == x["name"]) & o["there"]) & F.exists("every", within)
        return F.struct(x["name"].alias("name"), F.coalesce(x["ok"] & ~F.coalesce(inside, F.lit(False)), F.lit(False)).alias("keep"))

    final = every.select("doc_id", F.transform("every", kept).alias("names")).withColumn("n_keep", F.size(F.filter("names", lambda x: x["keep"])))
    return final.select("doc_id", "n_keep", F.explode("names").alias("x")).where(F.col("x.keep") | (F.col("n_keep") < least)).select("doc_id", "x.name")


def validate_against_source(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """D07. mentions (doc_id, name, confidence), texts (doc_id, text, weak): found names gain 0.1, on weak transcripts others halve and must stay over 0.5."""
    rows = mentions.join(texts.withColumn("text", F.lower("text")), "doc_id", "left")  # lower case once a text, not once a name
    low = F.coalesce("text", F.lit(""))
    some_word = F.exists(F.filter(F.split(F.lower("name"), " "), lambda w: F.length(w) > 3), lambda w: F.contains(low, w))
    found = F.contains(low, F.lower("name")) | some_word
    confidence = F.when(found, F.least(F.lit(1.0), F.col("confidence") + 0.1)).when(F.coalesce("weak", F.lit(False)), F.col("confidence") * 0.5).otherwise(F.col("confidence"))
    return rows.select("doc_id", "name", F.round(confidence, 6).alias("confidence"), (F.coalesce("weak", F.lit(False)) & ~found).alias("halved")).where(~F.col("halved") | (F.col("confidence") > 0.5)).drop("halved")


@F.pandas_udf(DoubleType())
def block_ratio(a, b):
    """Matching-block ratio of two columns (difflib): verifies few survivors of a join, never a join by itself."""
    from difflib import SequenceMatcher

    import pandas as pd

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left (a), right (b) distinct strings -> a, b, ratio >= least.

    The ratio is twice the characters in matching blocks over all, and blocks hold no character more often than both strings do. So
    characters numbered by occurrence are sets that overlap in `least` of the mean length, and as in any such join two strings share
    one of the rarest few of either."""
    both = left.select(F.col("a").alias("s")).union(right.select("b")).distinct().where("s <> ''")
    at = both.select("s", F.posexplode(F.split("s", "")).alias("at", "letter")).where("letter <> ''")
    at = at.withColumn("token", F.concat("letter", F.row_number().over(Window.partitionBy("s", "letter").orderBy("at")).cast("string")))
    df = at.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("s").orderBy("df", "token"))
    rare = at.join(df, "token").withColumn("rank", rank).where(F.col("rank") <= F.length("s") - F.ceil(F.length("s") * (least / (2 - least)) - 1e-9) + 1).select("s", "token")
    bound = 2 * F.least(F.length("a"), F.length("b")) / (F.length("a") + F.length("b")) >= least
    pairs = left.join(rare.toDF("a", "token"), "a").join(right.join(rare.toDF("b", "token"), "b"), "token").where(bound).select("a", "b").distinct()
    return pairs.withColumn("ratio", block_ratio("a", "b")).where(F.col("ratio") >= least)


def fuzzy_to_known(names: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """T10. names (name), known (term, ord) -> name, term: the first known term that is close enough, unless the name equals an earlier one."""
    low = names.select(F.lower("name").alias("a")).distinct()
    close = fuzzy_pairs(low, known.select(F.col("term").alias("b")).distinct(), least).join(known, F.col("b") == F.col("term"))
    best = close.groupBy("a").agg(F.min_by(F.struct("term", "ratio"), "ord").alias("best"))
    return names.join(best, F.lower("name") == F.col("a"), "left").select("name", F.when(F.col("best.term") != F.lower("name"), F.col("best.term")).alias("term"))


def letter_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each text holds a letter, by its code modulo 64, and the texts' lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % 64
    return np.bincount(np.repeat(np.arange(len(texts)) * 64, sizes) + codes, minlength=64 * len(texts)).reshape(-1, 64), sizes


def closest_runs(rows: DataFrame, least: float) -> DataFrame:
    """rows (doc_id, asked: array of a, n; words) -> doc_id, a, ratio: the best matching-block ratio of a name with a run of its n words (3 at
    most), `least` at least. Blocks hold no letter more often than both strings do, so most runs are ruled out by counts of letters."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        for batch in batches:
            ratio = lru_cache(100_000)(lambda a, b: SequenceMatcher(None, a, b).ratio())
            at, names, ratios = [], [], []
            for i, (asked, words) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for n in {x["n"] for x in asked} & {1, 2, 3}:
                    runs = list(dict.fromkeys(words if n == 1 else (" ".join(words[j : j + n]) for j in range(len(words or []) - n + 1)))) if words else []
                    if not runs:
                        continue
                    counts, sizes = letter_counts(runs)
                    for a in {x["a"] for x in asked if x["n"] == n and x["a"]}:
                        own = letter_counts([a])[0][0]
                        used = np.flatnonzero(own)
                        bound = 2 * np.minimum(counts[:, used], own[used]).sum(axis=1) / (sizes + len(a))
                        likely = np.flatnonzero(bound >= least - 1e-9)
                        best = 0.0
                        for j in likely[np.argsort(-bound[likely], kind="stable")]:
                            if bound[j] < best - 1e-9:
                                break
                            best = max(best, ratio(a, runs[j]))
                        if best >= least:
                            at.append(i), names.append(a), ratios.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(ratios, pa.float64())], ["doc_id", "a", "ratio"])

    return rows.select("doc_id", "asked", "words").mapInArrow(search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, a string, ratio double").groupBy("doc_id", "a").agg(F.max("ratio").alias("ratio"))


def check_hallucination(mentions: DataFrame, texts: DataFrame, least: float = 0.75, aliases: DataFrame | None = None) -> DataFrame:
    """D08. mentions (doc_id, name), texts (doc_id, text), aliases (name, alias) -> doc_id, name, status (exact, alias, fuzzy, suspected),
    ratio, and the document's confidence: the share of its names that aren't suspected.

    Names that aren't found meet the runs of as many words, up to three, within the text's row."""
    rows = mentions.join(texts.select("doc_id", F.lower("text").alias("text")), "doc_id")  # lower case once a text, not once a name
    if aliases is not None:
        known = aliases.groupBy(F.lower("name").alias("k")).agg(F.collect_set(F.lower("alias")).alias("aliases"))
        rows = rows.join(known, F.lower("name") == F.col("k"), "left").drop("k")
    else:
        rows = rows.withColumn("aliases", F.lit(None).cast("array<string>"))
    by_alias = F.coalesce(F.exists("aliases", lambda x: F.contains("text", x)), F.lit(False))
    exact = rows.withColumn("is_name", F.contains("text", F.lower("name"))).withColumn("exact", F.col("is_name") | by_alias)
    low = F.lower("name")
    left = exact.where("NOT exact").groupBy("doc_id").agg(F.collect_set(F.struct(low.alias("a"), F.size(F.split(F.trim("name"), r"\s+")).alias("n"))).alias("asked"))
    words = F.filter(F.split(F.lower("text"), WORDS), lambda x: x != "")
    best = closest_runs(texts.join(left, "doc_id").select("doc_id", "asked", words.alias("words")), least)
    joined = exact.withColumn("a", low).join(best, ["doc_id", "a"], "left")
    status = F.when(F.col("is_name"), "exact").when(F.col("exact"), "alias").when(F.col("ratio").isNotNull(), "fuzzy").otherwise("suspected")
    out = joined.select("doc_id", "name", status.alias("status"), F.round(F.when(F.col("exact"), 1.0).otherwise(F.coalesce("ratio", F.lit(0.0))), 6).alias("ratio"))
    sound = F.avg((F.col("status") != "suspected").cast("double")).over(Window.partitionBy("doc_id"))
    return out.withColumn("confidence", F.round(sound, 6))


def filter_hallucinated(checked: DataFrame, least: float = 0.5) -> DataFrame:
    """D09. The names that aren't suspected, of documents whose confidence is at least `least`."""
    return checked.where((F.col("status") != "suspected") & (F.col("confidence") >= least))


def post_validate(entities: DataFrame, texts: DataFrame, least: float = 0.3) -> DataFrame:
    """D10. entities (doc_id, ord, name, confidence): clean names, the first of equals, then confidence, then presence in the text."""
    clean = entities.withColumn("clean", clean_entity_name(F.col("name"))).where("clean IS NOT NULL")
    first = clean.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", F.lower("clean")).orderBy("ord"))).where("rn = 1")
    rows = first.where(F.coalesce("confidence", F.lit(0.0)) >= least).join(texts.withColumn("text", F.lower("text")), "doc_id", "left")
    low, text = F.lower("clean"), F.coalesce("text", F.lit(""))
    word = F.exists(F.filter(F.split(low, " "), lambda w: F.length(w) > 3), lambda w: F.contains(text, w))
    return rows.where((text == "") | (F.length(low) <= 3) | F.contains(text, low) | word).select("doc_id", F.col("clean").alias("name"), "confidence")


def dedup_entities(entities: DataFrame, key: Column) -> DataFrame:
    """D11, W01. The row of highest confidence of each key, the first of equals."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "ord"))
    return entities.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def accept_relationships(rels: DataFrame, names: DataFrame) -> DataFrame:
    """D12. Both ends known without regard to case, not the same; type upper-case, confidence 0.7 unless given."""
    known = names.select(F.lower("name").alias("k")).distinct()
    both = rels.withColumn("s", F.lower("source")).withColumn("t", F.lower("target")).where("s <> t").join(known.toDF("s"), "s", "left_semi").join(known.toDF("t"), "t", "left_semi")
    return both.select("source", "target", F.upper("rel_type").alias("rel_type"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"))


def filter_search_hits(hits: DataFrame, blocked: list[str], most: int = 5) -> DataFrame:
    """T24. hits (entity, ord, url, title, snippet): no blocked host, snippet of 20 characters, about the entity or on github; first `most`."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))), r"^www\.", "")
    about = F.contains(F.lower(F.concat_ws(" ", "title", "snippet")), F.lower("entity")) | F.contains(host, F.lit("github.com"))
    kept = hits.where(~host.isin(blocked) & (F.length("snippet") >= 20) & about)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("ord"))).where(F.col("rank") <= most)


def extract_alternatives(hits: DataFrame, stop: list[str], per_hit: int = 5, per_entity: int = 8) -> DataFrame:
    """T26. hits (entity, ord, text) -> entity, name: words after alternative(s) to, vs, versus, similar to."""
    found = F.slice(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(?:alternatives? to|vs\.?|versus|similar to)\s+([A-Za-z][\w.-]+)")), F.lower)), 1, per_hit)
    names = hits.select("entity", "ord", F.posexplode(found).alias("at", "name")).where(~F.col("name").isin(stop) & (F.col("name") != F.lower("entity")))
    first = names.groupBy("entity", "name").agg(F.min(F.struct("ord", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("entity").orderBy("first", "name"))
    return first.withColumn("rank", rank).where(F.col("rank") <= per_entity).select("entity", "name", "rank")


def accept_model_entities(df: DataFrame, generic: list[str], most: int = 8) -> DataFrame:
    """T42. df (doc_id, names array): sound names, none contained in an earlier accepted one, at most `most`."""
    low = lambda x: F.lower(F.trim(x))
    sound = F.filter("names", lambda x: (F.length(low(x)) >= 2) & ~low(x).isin([*P.PLATFORMS, *generic]) & ~low(x).rlike(r"^\d") & (F.size(F.split(low(x), r"\s+")) <= 3))
    fold = F.aggregate(sound, F.expr("cast(array() as array<string>)"), lambda acc, x: F.when(F.exists(acc, lambda a: F.contains(F.lower(a), low(x)) | F.contains(low(x), F.lower(a))), acc).otherwise(F.concat(acc, F.array(F.trim(x)))))
    return df.select("doc_id", F.slice(fold, 1, most).alias("names"))
