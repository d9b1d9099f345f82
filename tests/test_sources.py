"""Texts put together from posts and videos, and search hits: literals on which each rule fires, and odd rows."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import assembly as A
from graphloom.functions import patterns as P
from graphloom.operators import hits as H
from graphloom.plans.source_queries import FEED_PHRASES
from graphloom.sources.tables import ocr_entry

LONG = "Open the settings, choose a plan and create the first project of your own."


def test_each_feed_pattern_fires(spark):
    assert len(FEED_PHRASES) == len(P.FEED)
    rows = spark.createDataFrame([(i, f"{LONG} {p}") for i, p in enumerate(FEED_PHRASES)], "i int, text string")
    single = [F.col("text").rlike(f"(?iu){p}").alias(f"p{i}") for i, p in enumerate(P.FEED)]
    for r in rows.select("i", A.is_feed(F.col("text")).alias("feed"), *single).collect():
        assert r.feed and r[f"p{r.i}"], r
    sound = spark.createDataFrame([(LONG,), ("Log in\nviral " + LONG,), (None,), ("",), (LONG[:50],), (LONG[:51],), ("x" * 201 + "Password",)], "text string")
    assert [tuple(r) for r in sound.select(A.is_feed(F.col("text")), A.has_caption(F.col("text"))).collect()] == [(False, True), (False, False), (False, False), (False, False), (False, False), (False, True), (False, True)]


# title, caption, uploader, description, transcript, ocr -> origin, has_caption, title, text
POSTS = [
    (("T", LONG, "me", "d" * 30, None, None), ("instagram_cookies", True, "T", LONG)),
    (("T", LONG, None, None, "s" * 28, None), ("instagram_cookies", True, "T", LONG)),  # marks and text: 50 characters
    (("T", LONG, None, None, "s" * 29, None), ("instagram_cookies", True, "T", f"Title: T\n\n[Caption]:\n{LONG}\n\n[Video Content]:\n[Audio Transcript]:\n{'s' * 29}\n\n")),
    (("T", "viral " + LONG, "me", "d" * 21, None, "o" * 81), ("instagram_metadata", True, "Video by me", f"Title: Video by me\n\n{'d' * 21}")),  # 100 characters of video
    (("T", None, None, "d" * 21, None, "o" * 82), ("instagram_metadata", True, "Video by Instagram Reel", f"Title: Video by Instagram Reel\n\n{'d' * 21}\n\n[Video Frame Content]:\n[Video Frame OCR]:\n{'o' * 82}")),
    (("T", "Log in " + LONG, "me", "d" * 20, "s", "o" * 90), ("instagram_video_frames", False, "Video by me", f"Title: Video by me\n\n[Video Frame Content]:\n[Audio Transcript]:\ns\n\n[Video Frame OCR]:\n{'o' * 90}")),
    (("T", "", "me", "d" * 20, "s", ""), ("instagram_metadata_fallback", True, "Video by me", f"Title: Video by me\n\n{'d' * 20}")),
    (("T", "short", None, None, None, "o" * 90), ("instagram_cookies", None, "T", "short")),
    ((None, None, None, None, None, None), ("instagram_cookies", None, "Instagram Reel", "")),
]


@pytest.mark.parametrize("given, want", POSTS)
def test_assemble_text(spark, given, want):
    df = spark.createDataFrame([given], "title string, caption string, uploader string, description string, transcript string, ocr string")
    c = {x: F.col(x) for x in df.columns}
    made = A.assemble_text(c["title"], c["caption"], c["uploader"], c["description"], A.video_text(c["transcript"], c["ocr"]))
    assert tuple(df.select(made.alias("a")).select("a.*").first()) == want


def test_ocr_entry(spark):
    frames = [(1, 2, "use Docker, or the Notion app\nhttps://b.c/d>"), (1, 1, "ab\n  Deploy a server to the cloud  "), (1, 3, "  "), (2, 1, None), (2, 2, ""), (3, 1, "a\nb"), (None, 1, "a text without a video")]
    got = {r.video_id: r for r in ocr_entry(spark.createDataFrame(frames, "v long, o int, text string"), "v", ["o"], "2024-02-01").collect()}
    assert set(got) == {1, 3, None}
    r = got[1]
    assert (r.url, r.theme, r.topic, r.category, r.urls, r.tools, r.word_count) == (f"{P.VIDEO_URL}1", "Deploy a server to the cloud", "Deploy a server to the cloud", "system_performance_enhance", ["https://b.c/d"], ["Docker", "Notion"], 14)
    assert r.preview == "ab\n  Deploy a server to the cloud  \n\nuse Docker, or the Notion app\nhttps://b.c/d>"
    assert (got[3].theme, got[3].topic, got[3].category) == ("3", "", "other") and got[None].theme == "a text without a video"
    assert ocr_entry(spark.createDataFrame([], "v long, o int, text string"), "v", ["o"], "2024-02-01").count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "entity string, ord int, url string, title string, snippet string")


def test_relevant_hits(spark):
    say = "The Docker engineers wrote this"
    plain = "Docker keeps containers in layers"
    given = [
        ("Docker", 1, "https://www.reddit.com/r/x", "Docker", plain), ("Docker", 2, "https://a.b", "Docker: Log-in", plain), ("Docker", 3, "https://a.b", "Docker", "   too short, really  "[:22]),
        ("Docker", 4, "https://ktm.com/x", "Docker", plain), ("Docker", 5, "https://a.b/shop/1", "Docker", plain), ("Docker", 6, "https://a.b", "Docker", say), ("Docker", 7, "https://a.b", "Podman", "containers without a daemon"),
        ("Docker", 8, "https://github.com/x", "Podman", "containers without a daemon"), ("Docker", 9, "https://a.b/9", "About docker", "containers without a daemon"), ("Docker", 10, None, "Docker", plain), ("Docker", 11, "https://a.b", None, None),
    ]
    given += [("Docker", 20 + i, f"https://a.b/{i}", "Docker", plain) for i in range(4)] + [("Rust", 1, "https://r.s", "Rust", plain)]
    got = sorted(tuple(r) for r in H.relevant_hits(hits(spark, given)).select("entity", "rank", "ord").collect())
    assert got == [("Docker", 1, 8), ("Docker", 2, 9), ("Docker", 3, 10), ("Docker", 4, 20), ("Docker", 5, 21), ("Rust", 1, 1)]
    assert H.relevant_hits(hits(spark, [])).count() == 0


def test_reference_links(spark):
    e = spark.createDataFrame([("a.io", 0.9), ("a.io", 0.95), ("b.io", 0.89), ("c.xyz", 1.0), ("d.dev", 0.95), ("e.app", None), (None, 1.0), ("f.com", 0.9)], "name string, confidence double")
    given = [("a.io", 1, "https://wa.me/1", "x", "s"), ("d.dev", 1, "https://d.dev", None, None), ("d.dev", 2, "https://q.r", "Please REGISTER", "s"), ("f.com", 1, "https://f.com", "Cookie settings", "s"), ("g", 1, None, "t", "s")]
    got = {tuple(r) for r in H.reference_links(e, hits(spark, given)).collect()}
    found = "Website found in video content"
    assert got == {("d.dev", 1, None, "https://d.dev", None, "search"), ("g", 1, "t", None, "s", "search"), ("a.io", None, "a.io", "https://a.io", found, "ocr_extraction"), ("f.com", None, "f.com", "https://f.com", found, "ocr_extraction")}


def test_fill_urls(spark):
    long = "a snippet that is long enough"
    given = hits(spark, [("A", 1, "https://dev.to/x", "A", long), ("A", 2, "https://my.google.com.example", "A", long), ("A", 3, "https://a.org", "A", long), ("A", 4, "https://b.org", "A", long)] + [("B", i, "https://x.com", "B", long) for i in range(5)] + [("B", 9, "https://b.org", "B", long)])
    rows = [("A", "tool", None, 1), ("A", "tool", "", 2), ("A", "tool", "https://www.instagram.com/p", 3), ("A", "tool", "https://own", 4), ("A", "concept", None, 5), ("B", "tool", None, 6), ("", "tool", None, 7), (None, None, None, 8), ("A", None, None, 9)]
    e = spark.createDataFrame(rows, "name string, type string, url string, `the.id` int")
    got = {r["the.id"]: r["url"] for r in H.fill_urls(e, given).collect()}
    assert got == {1: "https://a.org", 2: "https://a.org", 3: "https://a.org", 4: "https://own", 5: None, 6: None, 7: None, 8: None, 9: "https://a.org"}
