"""Texts put together from what a post or a video holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import first_line, words


def blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def is_login_page(text: Column) -> Column:
    """T25. Whether the first 200 characters ask to log in."""
    head = F.substring(blank(text), 1, 200)
    return F.contains(head, F.lit(P.LOGIN_MARKERS[0])) | F.contains(head, F.lit(P.LOGIN_MARKERS[1]))


def is_feed(text: Column) -> Column:
    """T25. Whether the text looks like the feed around a post; login pages don't."""
    return ~is_login_page(text) & blank(text).rlike("(?iu)" + "|".join(f"(?:{p})" for p in P.FEED))


def has_caption(text: Column) -> Column:
    """T25."""
    return (F.length(blank(text)) > 50) & ~is_login_page(text) & ~is_feed(text)


def video_text(transcript: Column, ocr: Column) -> Column:
    """T25. What a video says and shows, each under its mark; '' if neither."""
    said = F.when(blank(transcript) != "", F.concat(F.lit("[Audio Transcript]:\n"), transcript, F.lit("\n\n")))
    shown = F.when(blank(ocr) != "", F.concat(F.lit("[Video Frame OCR]:\n"), ocr))
    return F.concat(blank(said), blank(shown))


def assemble_text(title: Column, caption: Column, uploader: Column, description: Column, video: Column) -> Column:
    """T25. struct(origin, has_caption, title, text). A sound caption comes first, with the video's text if that has over 50 characters; else
    a description of over 20, with a video's text of over 100; else such a video's text alone; else any description; else the caption as it
    is, whose has_caption is null. Null and empty inputs are alike. The length of a video's text counts its marks."""
    caption, description, video = blank(caption), blank(description), blank(video)
    by = F.when(blank(uploader) != "", uploader).otherwise("Instagram Reel")
    known = uploader.isNotNull() | (description != "")
    made = F.concat(F.lit("Title: Video by "), by, F.lit("\n\n"))
    frames = F.concat(F.lit("[Video Frame Content]:\n"), video)
    rich = F.length(video) > 100
    out = lambda origin, has, name, text: F.struct(F.lit(origin).alias("origin"), has.alias("has_caption"), name.alias("title"), text.alias("text"))
    both = F.concat(F.lit("Title: "), blank(title), F.lit("\n\n[Caption]:\n"), caption, F.lit("\n\n[Video Content]:\n"), video)
    name = F.concat(F.lit("Video by "), by)
    return (
        F.when(has_caption(caption), out("instagram_cookies", F.lit(True), blank(title), F.when(F.length(video) > 50, both).otherwise(caption)))
        .when(F.length(description) > 20, out("instagram_metadata", F.lit(True), name, F.concat(made, description, F.when(rich, F.concat(F.lit("\n\n"), frames)).otherwise(""))))
        .when(known & rich, out("instagram_video_frames", F.lit(False), name, F.concat(made, frames)))
        .when(description != "", out("instagram_metadata_fallback", F.lit(True), name, F.concat(made, description)))
        .otherwise(out("instagram_cookies", F.lit(None).cast("boolean"), F.coalesce(title, F.lit("Instagram Reel")), caption))
    )


def key_info(text: Column, most: int = 5) -> Column:
    """T22. struct(title, urls, tools, word_count, line_count): the first line of over three characters ('' if none), the first `most` addresses
    as they come, the first `most` different names of tools in order of the alphabet."""
    text = blank(text)
    named = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in P.TOOL_NAMES])
    return F.struct(
        blank(first_line(text)).alias("title"),
        F.slice(F.regexp_extract_all(text, F.lit(P.TEXT_URL), F.lit(0)), 1, most).alias("urls"),
        F.slice(F.array_sort(F.array_distinct(named)), 1, most).alias("tools"),
        F.size(words(text)).alias("word_count"),
        F.size(F.split(text, "\n")).alias("line_count"),
    )
