"""Queries of texts put together from posts and videos, and of search hits. Each plants what its operator looks for, by number of the row, so that
every branch is taken; the oracles plant the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import assembly as A
from ..functions import patterns as P
from ..operators import hits as H
from ..sources import tables as S
from .registry import any_sql, contains_sql, list_sql, query
from .text_queries import WORDS_SQL, pick, scores, t

#: A phrase for each pattern of a feed, in its order.
FEED_PHRASES = ["name •\nFollow", "clash", "watch story", "サーブ", "free certifications", "AUTOMATIC bridge in minecraft", "YangYinYue", "follow button kon", "lakk tunoo", "lo aa gay", "Artist · song", "FYP"]


POST = f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Log in\n' || text WHEN 1 THEN text || '\n' || coalesce({pick(FEED_PHRASES, "doc_id // 5 % 14")}, '') WHEN 2 THEN source WHEN 3 THEN text END AS caption,
CASE doc_id // 2 % 4 WHEN 0 THEN text WHEN 1 THEN source WHEN 2 THEN '' END AS description, CASE WHEN doc_id % 3 > 0 THEN source END AS uploader, CASE WHEN doc_id % 11 > 0 THEN lang END AS title,
CASE doc_id // 3 % 3 WHEN 0 THEN text WHEN 1 THEN lang END AS transcript, CASE doc_id // 7 % 3 WHEN 0 THEN text WHEN 1 THEN '' END AS ocr FROM documents"""


def selected(spark, d, sql: str, table: str):
    """The rows of DuckDB's SQL over one of the given tables; only whole division is written in another way in Spark."""
    return spark.sql(sql.replace(" // ", " div ").replace(f"FROM {table}", "FROM {given}"), given=t(spark, d, table))


@query("t25_assemble_text", f"""
WITH p AS ({POST}),
v AS (SELECT doc_id, coalesce(caption, '') AS c, coalesce(description, '') AS d, uploader, title, coalesce(uploader, 'Instagram Reel') AS maker, CASE WHEN coalesce(transcript, '') <> '' THEN '[Audio Transcript]:\n' || transcript || '\n\n' ELSE '' END || CASE WHEN coalesce(ocr, '') <> '' THEN '[Video Frame OCR]:\n' || ocr ELSE '' END AS v FROM p),
l AS (SELECT *, contains(substring(c, 1, 200), 'Log in') OR contains(substring(c, 1, 200), 'Password') AS login, {any_sql('c', P.FEED)} AS feed FROM v),
k AS (SELECT *, CASE WHEN length(c) > 50 AND NOT login AND NOT feed THEN 1 WHEN length(d) > 20 THEN 2 WHEN (uploader IS NOT NULL OR d <> '') AND length(v) > 100 THEN 3 WHEN d <> '' THEN 4 ELSE 5 END AS kind FROM l)
SELECT doc_id, CASE kind WHEN 2 THEN 'instagram_metadata' WHEN 3 THEN 'instagram_video_frames' WHEN 4 THEN 'instagram_metadata_fallback' ELSE 'instagram_cookies' END AS origin,
CASE kind WHEN 3 THEN false WHEN 5 THEN NULL ELSE true END AS has_caption, CASE kind WHEN 1 THEN coalesce(title, '') WHEN 5 THEN coalesce(title, 'Instagram Reel') ELSE 'Video by ' || maker END AS title,
md5(CASE kind WHEN 1 THEN CASE WHEN length(v) > 50 THEN 'Title: ' || coalesce(title, '') || '\n\n[Caption]:\n' || c || '\n\n[Video Content]:\n' || v ELSE c END
WHEN 2 THEN 'Title: Video by ' || maker || '\n\n' || d || CASE WHEN length(v) > 100 THEN '\n\n[Video Frame Content]:\n' || v ELSE '' END
WHEN 3 THEN 'Title: Video by ' || maker || '\n\n[Video Frame Content]:\n' || v WHEN 4 THEN 'Title: Video by ' || maker || '\n\n' || d ELSE c END) AS text_md5 FROM k""")
def t25(spark, d):
    """Documents as posts: captions that are login pages, feeds, short, whole or absent; descriptions, transcripts and frames' texts of all kinds."""
    made = A.assemble_text(F.col("title"), F.col("caption"), F.col("uploader"), F.col("description"), A.video_text(F.col("transcript"), F.col("ocr")))
    return selected(spark, d, POST, "documents").select("doc_id", made.alias("a")).select("doc_id", "a.origin", "a.has_caption", "a.title", F.md5("a.text").alias("text_md5"))


FRAMES = "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN ' ' ELSE text END || CASE turn % 3 WHEN 0 THEN '\nuse Docker or the Notion app, see https://a.example/' || conv_id || '>' WHEN 1 THEN '\ntry Figma' || chr(CAST(97 + conv_id % 26 AS INT)) || '\n<http://b.example/' || turn || '>' ELSE '' END AS text FROM conversations"


@query("s15_ocr_entry", f"""
WITH f AS ({FRAMES}), w AS (SELECT conv_id, string_agg(text, '\n\n' ORDER BY turn) AS text FROM f WHERE trim(text) <> '' GROUP BY conv_id),
i AS (SELECT conv_id, text, coalesce(list_filter(list_transform(string_split(text, '\n'), lambda x: trim(x)), lambda x: length(x) > 3)[1], '') AS title FROM w)
SELECT conv_id AS video_id, '{P.VIDEO_URL}' || conv_id AS url, CASE WHEN title <> '' THEN substring(title, 1, 100) ELSE CAST(conv_id AS VARCHAR) END AS theme, title AS topic, (SELECT CASE WHEN s.n > 0 THEN s.c ELSE 'other' END FROM (SELECT list_max([{scores}]) AS s)) AS category, substring(text, 1, 500) AS preview,
{WORDS_SQL.format(c='text')} AS word_count, array_to_string(regexp_extract_all(text, '{P.TEXT_URL}')[1:5], ' ') AS urls, array_to_string(list_sort(list_distinct(list_concat({', '.join(f"regexp_extract_all(text, '{p}', 1)" for p in P.TOOL_NAMES)})))[1:5], ' ') AS tools, 'ocr_frame_extraction' AS origin, '2024-02-01' AS processed_at FROM i""")
def s15(spark, d):
    """Conversations as videos, their turns as frames: every third frame is blank, the others name tools and addresses."""
    return S.ocr_entry(selected(spark, d, FRAMES, "conversations"), "conv_id", ["turn"], "2024-02-01").withColumn("urls", F.array_join("urls", " ")).withColumn("tools", F.array_join("tools", " "))


#: Hosts and titles of hits, some of each list and some of none.
HOSTS = ["www.google.com", "docs.example.com", "github.com", "m.facebook.com", "www.ktm.com", "a.example.org/buy", "maps.google.com", "dev.to", "example.net", "www.linkedin.com", "en.wikipedia.org"]
TITLES = ["", " - Sign In", " docs", " 404", " bike review", " Cookie policy", " guide", " ad", " adverb"]
HITS = f"SELECT doc_id, 'item ' || doc_id // 12 AS entity, doc_id * 7 % 12 AS ord, 'https://' || {pick(HOSTS, f'doc_id % {len(HOSTS)}')} || '/' || doc_id AS url, CASE WHEN doc_id % 4 > 0 THEN 'Item ' || doc_id // 12 ELSE 'Other' END || {pick(TITLES, f'doc_id % {len(TITLES)}')} AS title, CASE WHEN doc_id % 13 = 0 THEN '   short     snippet   ' WHEN doc_id % 17 > 1 THEN source || ' of many words and more, in ' || lang ELSE text END AS snippet FROM documents"


def hits(spark, d):
    """Documents as search hits of items, twelve an item."""
    return selected(spark, d, HITS, "documents")


URL_HOST = "regexp_extract(lower(url), '://([^/:?#]*)', 1)"
SOUND = f"regexp_replace({URL_HOST}, '^www\\.', '') NOT IN {list_sql(P.HIT_HOSTS)} AND NOT regexp_matches(lower(title), '{P.HIT_TITLES}') AND length(trim(snippet)) >= 20"


@query("t24_relevant_hits", f"""
WITH h AS ({HITS}), k AS (SELECT entity, ord, url, row_number() OVER (PARTITION BY entity ORDER BY ord, url) AS rank FROM h WHERE {SOUND}
AND NOT {contains_sql('url', [*P.OFF_TOPIC_DOMAINS, *P.OFF_TOPIC_PATHS])} AND NOT {contains_sql('title', P.OFF_TOPIC_WORDS)} AND NOT {contains_sql('snippet', P.OFF_TOPIC_WORDS)}
AND (contains(lower(title), entity) OR contains(lower(snippet), entity) OR contains(lower(url), 'github.com')))
SELECT entity, ord, url, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3""")
def t24(spark, d):
    return H.relevant_hits(hits(spark, d), 3).select("entity", "ord", "url", "rank")


ENTITIES = f"SELECT doc_id, 'item ' || doc_id // 6 AS name, {pick(['tool', 'concept', 'unknown'], 'doc_id % 5')} AS type, {pick(['', 'https://www.instagram.com/p/1', 'https://own.example'], 'doc_id % 4')} AS url FROM documents"


@query("t28_fill_urls", f"""
WITH h AS ({HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ord, url) AS rank FROM h),
b AS (SELECT entity, arg_min(url, rank) AS found FROM r WHERE rank <= 5 AND {SOUND} AND NOT {contains_sql(URL_HOST, P.HIT_HOSTS)} GROUP BY entity),
e AS ({ENTITIES})
SELECT doc_id, name, type, CASE WHEN (coalesce(url, '') = '' OR contains(url, 'instagram.com')) AND coalesce(type, '') NOT IN {list_sql(P.SITELESS_TYPES)} THEN coalesce(found, url) ELSE url END AS url FROM e LEFT JOIN b ON name = entity""")
def t28(spark, d):
    """Two entities of each name and four of each item; half the items have no hit at all."""
    return H.fill_urls(selected(spark, d, ENTITIES, "documents"), hits(spark, d))


SITES = "SELECT page_id, 'tool-' || page_id // 4 || CASE page_id // 4 % 5 WHEN 0 THEN '.io' WHEN 1 THEN '.xyz' WHEN 2 THEN '.app' WHEN 3 THEN '' ELSE '.com' END AS name, CASE page_id // 4 % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 END AS confidence, url, html FROM pages"
LINKS = f"SELECT name AS entity, page_id AS ord, CASE WHEN page_id // 4 % 3 = 0 THEN 'https://www.' || {pick(P.NO_REFERENCE_DOMAINS, f'page_id % {len(P.NO_REFERENCE_DOMAINS)}')} || '/' || page_id ELSE url END AS url, CASE WHEN page_id // 4 % 3 = 1 AND page_id % 4 < 3 THEN 'Page: ' || {pick(['SIGN IN', 'Log in', 'Register', 'Privacy Policy', 'Terms of Service', 'Cookie', 'Advertisement'], 'page_id % 7')} ELSE 'Page of ' || name END AS title, html AS snippet FROM sites"


@query("t27_reference_links", f"""
WITH sites AS ({SITES}), h AS ({LINKS}), k AS (SELECT entity, ord, title, url, md5(snippet) AS snippet_md5, 'search' AS origin FROM h WHERE NOT {contains_sql('url', P.NO_REFERENCE_DOMAINS)} AND NOT {contains_sql('title', P.NO_REFERENCE_TITLES)})
SELECT * FROM k UNION ALL SELECT DISTINCT name, NULL, name, 'https://' || name, md5('Website found in video content'), 'ocr_extraction' FROM sites WHERE confidence >= 0.9 AND regexp_matches(name, '{P.SITE_NAME}') AND name NOT IN (SELECT entity FROM k)""")
def t27(spark, d):
    """Pages as hits of tools, four a tool: a third of the tools has hits on refused hosts only, a third refused titles but one."""
    sites = selected(spark, d, SITES, "pages")
    found = spark.sql(LINKS.replace(" // ", " div ").replace("FROM sites", "FROM {sites}"), sites=sites)
    return H.reference_links(sites.select("name", F.col("confidence").cast("double").alias("confidence")), found).select("entity", "ord", "title", "url", F.md5("snippet").alias("snippet_md5"), "origin")
