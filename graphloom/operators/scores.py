"""Scores, merges and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def resolution_score(decisions: DataFrame) -> DataFrame:
    """A03. decisions (category, expected, actual, expected_id, actual_id) -> scores by category and, with a null category, over all.

    NEW is the negative class: precision counts the rows that were called anything else, recall those that should have been."""
    right = F.col("expected") == F.col("actual")
    same = right & F.col("expected_id").eqNullSafe(F.col("actual_id"))
    hit = (F.col("expected") != "NEW") & same
    scored = decisions.groupingSets([["category"], []], "category").agg(
        F.count("*").alias("n"),
        F.round(F.avg(right.cast("double")), 6).alias("decision_accuracy"),
        F.round(F.avg(same.cast("double")), 6).alias("entity_accuracy"),
        F.coalesce(F.try_divide(F.count_if(hit), F.count_if(F.col("actual") != "NEW")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.count_if(hit), F.count_if(F.col("expected") != "NEW")), F.lit(0.0)).alias("recall"),
    )
    scored = scored.withColumn("f1", F.round(f1(F.col("precision"), F.col("recall")), 6))
    return scored.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def entity_match(expected: DataFrame, actual: DataFrame, tasks: int | None = None) -> DataFrame:
    """J21. doc_id, name (lower, trimmed), expected, actual: which side has the name. Both sides' rows are grouped at once, documents
    dealt out to `tasks`, if given."""
    side = lambda df, *flags: df.select("doc_id", F.lower(F.trim("name")).alias("name"), *(F.lit(f).alias(c) for f, c in zip(flags, ("expected", "actual"))))
    rows = side(expected, True, False).unionByName(side(actual, False, True))
    rows = rows.repartition(tasks, "doc_id") if tasks else rows
    unlike = F.when(F.col("doc_id").isNull() | F.col("name").isNull(), F.col("expected"))  # nulls equal nothing, so sides stay apart
    return rows.groupBy("doc_id", "name", unlike.alias("unlike")).agg(F.bool_or("expected").alias("expected"), F.bool_or("actual").alias("actual")).drop("unlike")


def extraction_prf(matches: DataFrame) -> DataFrame:
    """A04. doc_id, precision, recall and f1 of each document, and with a null doc_id their means."""
    hits, n_expected, n_actual = F.count_if(F.col("expected") & F.col("actual")), F.count_if("expected"), F.count_if("actual")
    guarded = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    own = matches.groupBy("doc_id").agg(guarded(hits, n_actual).alias("precision"), guarded(hits, n_expected).alias("recall"))
    own = own.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    means = own.agg(F.lit(None).cast(matches.schema["doc_id"].dataType).alias("doc_id"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
    return own.unionByName(means).select("doc_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def run_metrics(results: DataFrame) -> DataFrame:
    """A05. results (run, is_valid, is_hallucinated, is_garbled) -> counts and ratios by run and, with a null run, of the sums."""
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0)), 6)
    return results.rollup("run").agg(F.count("*").alias("n"), share("is_valid").alias("precision"), share("is_hallucinated").alias("hallucination_rate"), F.round(1 - F.count_if("is_garbled") / F.count("*"), 6).alias("summary_quality"))


def first_of(updates: DataFrame, column: str, key: Column, blank_stays: bool = False) -> DataFrame:
    """id and the values of an array column over all updates of an id, the first of each key, in order of first sight."""
    rows = updates.select("id", "ord", F.posexplode(column).alias("at", "x")).withColumn("k", key)
    # a blank key marks what can't be told apart: such values all stay
    unlike = F.concat("k", F.lit("\0"), F.col("ord").cast("string"), F.lit("\0"), F.col("at").cast("string")) if blank_stays else F.col("k")
    rows = rows.withColumn("k", F.when(F.col("k") == "", unlike).otherwise(F.col("k"))) if blank_stays else rows
    first = rows.groupBy("id", "k").agg(F.min(F.struct("ord", "at", "x")).alias("first"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("first")), lambda s: s["x"]).alias(column))


def merge_entities(updates: DataFrame) -> DataFrame:
    """A06. updates (id, ord, description, web_info array<struct<title, url>>, tools, tags, confidence, content_type), ord unique within an
    id -> one row an id: new descriptions appended, web_info distinct by url (blank ones stay), tools by lower name, the union of
    tags, the largest confidence, a version for each update, the last content type that isn't unknown."""
    known = F.when(F.coalesce("content_type", F.lit("unknown")) != "unknown", F.col("ord"))
    texts = updates.where("description <> ''").groupBy("id", "description").agg(F.min("ord").alias("ord"))
    texts = texts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "description"))), lambda s: s["description"]), " | ").alias("description"))
    base = updates.groupBy("id").agg(F.max("confidence").alias("confidence"), F.count("*").alias("version"), F.coalesce(F.max_by("content_type", known), F.lit("unknown")).alias("content_type"))
    for part in (texts, first_of(updates, "web_info", F.coalesce(F.col("x.url"), F.lit("")), blank_stays=True), first_of(updates, "tools", F.lower("x")), first_of(updates, "tags", F.col("x"))):
        base = base.join(part, "id", "left")
    return base


def usage_summary(calls: DataFrame, prices: dict[str, float]) -> DataFrame:
    """A09. calls (task, route, tokens) -> calls, tokens, cost and the whole average, by task, by route, by both and over all."""
    price = F.coalesce(F.element_at(F.create_map(*[x for k, v in prices.items() for x in (F.lit(k), F.lit(v))]), F.col("route")), F.lit(0.0))
    priced = calls.withColumn("cost", F.col("tokens") / 1000 * price)
    return priced.cube("task", "route").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.floor(F.sum("tokens") / F.count("*")).alias("average"))


def cleanup_flags(entities: DataFrame) -> DataFrame:
    """A14. entities (id, confidence, stale, isolated) -> flag, flagged (by it, the first that holds), matching (all it holds for)."""
    low = F.coalesce((F.col("confidence") > 0) & (F.col("confidence") < 0.3), F.lit(False))
    held = [("low_confidence", low), ("stale", F.col("stale")), ("isolated", F.col("isolated"))]
    first = F.coalesce(*(F.when(c, F.lit(name)) for name, c in held))
    rows = entities.select(first.alias("first"), F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in held)))).alias("flag"))
    return rows.groupBy("flag").agg(F.count_if(F.col("first") == F.col("flag")).alias("flagged"), F.count("*").alias("matching"))


def ocr_rollup(words: DataFrame, least: float = 30) -> DataFrame:
    """A15. words (video, frame, ord, word, confidence) -> video, frames, frames_with_text, confidence, text (of its frames, a line each)."""
    sound = (F.trim("word") != "") & (F.col("confidence") >= least)
    kept = F.transform(F.array_sort(F.collect_list(F.when(sound, F.struct("ord", "word")))), lambda s: s["word"])
    frames = words.groupBy("video", "frame").agg(F.array_join(kept, " ").alias("text"), F.coalesce(F.avg(F.when(sound, F.col("confidence"))), F.lit(0.0)).alias("confidence"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("frame", "text")))), lambda s: s["text"])
    with_text = F.col("text") != ""
    return frames.groupBy("video").agg(F.count("*").alias("frames"), F.count_if(with_text).alias("frames_with_text"), F.round(F.coalesce(F.avg(F.when(with_text, F.col("confidence"))), F.lit(0.0)), 4).alias("confidence"), F.array_join(lines, "\n").alias("text"))


def type_diversity(hits: DataFrame) -> DataFrame:
    """W05. query_id, diversity: a fifth for each type among a query's hits, 1 at most."""
    return hits.groupBy("query_id").agg(F.least(F.lit(1.0), F.count_distinct("type") / 5).alias("diversity"))


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """K02. A page of the rows, with the total and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))
