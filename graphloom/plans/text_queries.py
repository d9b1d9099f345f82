"""Queries of sections S, T, C and D over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import assembly as A
from ..functions import patterns as P
from ..functions import text as T
from ..operators import chunking as C
from ..operators import entities as D
from ..sources import tables as S
from .registry import any_sql, contains_sql, list_sql, query

t = S.table
WORDS_SQL = r"len(list_filter(regexp_split_to_array(trim({c}), '\s+'), lambda w: w <> ''))"
NORMAL_SQL = "regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
URL_PARTS = r"""
u AS (SELECT page_id, regexp_extract(trim(url), '^([a-zA-Z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS p FROM pages),
n AS (SELECT page_id, lower(p.scheme) || '://' || regexp_replace(regexp_replace(lower(p.host), '\.+$', ''), '^www\.', '')
        || regexp_replace(regexp_replace(p.path, '/+', '/', 'g'), '/+$', '') AS base,
      list_sort(list_filter(string_split(p.query, '&'), lambda x: regexp_matches(x, '^[^=]+=.+') AND lower(split_part(x, '=', 1)) NOT IN %s)) AS qs FROM u)
""" % list_sql(P.TRACKING_PARAMS)
NORMALIZED = "base || CASE WHEN len(qs) = 0 THEN '' ELSE '?' || array_to_string(qs, '&') END"


@query("s01_read_pages", f"SELECT page_id, length(html) AS n_chars, {WORDS_SQL.format(c='html')} AS n_words FROM pages")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return S.read_pages(spark, d).select("page_id", "n_chars", "n_words")


@query("s02_extract_main_text")
def s02(spark, d):
    return S.extract_main_text(t(spark, d, "pages")).select("page_id", "title", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("s03_first_acceptable", "SELECT doc_id, CASE WHEN length(trim(text)) > 4000 THEN 'long' WHEN length(text) > 100 THEN 'plain' END AS strategy FROM documents")
def s03(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.when(F.length(F.trim("text")) > 4000, F.col("text")).alias("long"), F.col("text").alias("plain"))
    return S.first_acceptable(docs, ["long", "plain"]).select("doc_id", "strategy")


@query("s05_json_report", "SELECT source, count(*) AS n_items FROM documents GROUP BY source")
def s05(spark, d):
    items = t(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("topic"), F.lit(None).cast("string").alias("url"))
    return S.json_report(items).select("source", "n_items")


@query("s06_markdown_report", """
WITH x AS (SELECT source, lang, string_agg('- ' || doc_id, chr(10) ORDER BY CAST(doc_id AS VARCHAR)) AS lines FROM documents GROUP BY source, lang)
SELECT source, '# ' || source || chr(10) || chr(10) || string_agg('## ' || lang || chr(10) || lines, chr(10) || chr(10) ORDER BY lang) AS report FROM x GROUP BY source""")
def s06(spark, d):
    return S.markdown_report(t(spark, d, "documents").select("source", F.col("lang").alias("topic"), F.col("doc_id").cast("string").alias("name")))


@query("s07_export_graph", """
SELECT 'CREATE (:' || n_name || ' {id: ''' || n_nationkey || ''', name: ''' || n_name || '''});' AS line FROM nation
UNION ALL SELECT 'MATCH (a {id: ''' || c_custkey || '''}), (b {id: ''' || c_nationkey || '''}) CREATE (a)-[:LIVES_IN]->(b);' FROM customer""")
def s07(spark, d):
    nodes = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("type"), F.col("n_name").alias("name"))
    return S.cypher_lines(nodes, t(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("rel_type")))


@query("s10_scan_by_source", "SELECT doc_id, lang FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 1000")
def s10(spark, d):
    return t(spark, d, "documents").where("source = 'src3'").orderBy("doc_id").limit(1000).select("doc_id", "lang")


@query("s11_snapshot", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def s11(spark, d):
    return t(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("s12_bucketed", "SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) // 30 AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1 HAVING (bucket + 1) * 30 > date_diff('day', DATE '1970-01-01', DATE '1998-01-01') - 180")
def s12(spark, d):
    return S.drop_old_buckets(S.bucketed(t(spark, d, "orders"), "o_orderdate"), "1998-01-01").groupBy("bucket").agg(F.count("*").alias("n"))


@query("s14_concat_parts", r"SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def s14(spark, d):
    return S.concat_parts(t(spark, d, "conversations"), "conv_id", ["turn"])


@query("s17_chunk_graph", """
WITH c AS (SELECT doc_id, source FROM documents)
SELECT 'chunk-' || doc_id AS src, 'source-' || source AS dst, 'EXTRACTED_FROM' AS rel_type FROM c
UNION ALL SELECT 'entity-' || c.doc_id || '-' || l.toxic, 'chunk-' || c.doc_id, 'EXTRACTED_FROM' FROM c JOIN labels l ON c.doc_id = l.doc_id""")
def s17(spark, d):
    docs = t(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "source", "text")
    mentions = t(spark, d, "labels").join(docs, "doc_id").select(F.concat_ws("-", "doc_id", "toxic").alias("entity"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("evidence"))
    return S.chunk_graph(chunks, docs.select("source").distinct(), mentions)[1].select("src", "dst", "rel_type")


@query("j22_provenance", "SELECT 'entity-' || d.doc_id || '-' || l.toxic AS entity, 'chunk-' || d.doc_id AS chunk, 'source-' || d.source AS source FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j22(spark, d):
    edges = s17(spark, d)
    chunk = edges.where(F.col("src").startswith("chunk-")).select(F.col("src").alias("chunk"), F.col("dst").alias("source"))
    return edges.where(F.col("src").startswith("entity-")).select(F.col("src").alias("entity"), F.col("dst").alias("chunk")).join(chunk, "chunk").select("entity", "chunk", "source")


@query("t01_normalize_url", f"WITH {URL_PARTS} SELECT page_id, {NORMALIZED} AS url FROM n")
def t01(spark, d):
    return t(spark, d, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"))


@query("t02_content_hash", f"WITH {URL_PARTS} SELECT page_id, sha256({NORMALIZED}) AS hash FROM n")
def t02(spark, d):
    return t(spark, d, "pages").select("page_id", T.content_hash(F.col("url")).alias("hash"))


def host():
    return F.regexp_extract("url", "://([^/:?#]*)", 1)


def pick(values: list[str], at: str) -> str:
    """SQL, of Spark and of DuckDB alike: the value whose place is `at`, else null."""
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def flags(name: str, table: str, key: str, columns: dict[str, tuple], planted: dict[str, str] | None = None) -> None:
    """Register one query of several columns: name -> (function that makes the Spark column, SQL). planted: columns of the table that take
    another value first, as SQL of both engines, so that every rule fires on some rows."""
    given = f"(SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in planted.items())}) FROM {table})" if planted else table
    sql = f"SELECT {key}, " + ", ".join(f"{s} AS {c}" for c, (_, s) in columns.items()) + f" FROM {given}"

    @query(name, sql if all(s for _, s in columns.values()) else None)
    def run(spark, d):
        rows = t(spark, d, table).withColumns({c: F.expr(v) for c, v in (planted or {}).items()})
        return rows.select(key, *(x().alias(c) for c, (x, _) in columns.items()))


def front(phrases: list[str], key: str = "doc_id") -> dict[str, str]:
    """Texts that begin with one of the phrases, or with none, by number of the row."""
    return {"text": f"coalesce({pick(phrases, f'{key} % {len(phrases) + 1}')}, '') || ' ' || text"}


def instead(column: str, values: list[str], key: str) -> dict[str, str]:
    """One of the values in a column, or what it holds, by number of the row."""
    return {column: f"coalesce({pick(values, f'{key} % {len(values) + 3}')}, {column})"}


flags("t03_is_safe_url", "pages", "page_id", {"safe": (lambda: T.is_safe_url(F.col("url")), f"lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) IN ('http', 'https') AND lower(regexp_extract(url, '://([^/:?#]*)', 1)) NOT IN {list_sql(P.BLOCKED_HOSTS)} AND NOT regexp_matches(regexp_extract(url, '://([^/:?#]*)', 1), '{P.PRIVATE_HOST}')")}, instead("url", ["http://10.1.2.3/x", "https://192.168.0.1", "http://172.16.0.9/", "http://172.32.0.9/", "ftp://example.com/", "http://LocalHost:80/", "HTTP://169.254.169.254/latest", "http://127.0.0.5", "https://8.8.8.8/", "http://0.1.2.3/"], "page_id"))
red = "substring(text, 1, 10000)"
for pattern in P.INJECTION:
    red = f"regexp_replace({red}, '(?i){pattern}', '[REDACTED]', 'g')"
flags("t04_t05_injection", "documents", "doc_id", {"injected": (lambda: T.has_injection(F.col("text")), any_sql("text", P.INJECTION)), "clean_md5": (lambda: F.md5(T.sanitize_text(F.col("text"))), f"md5({red})")}, front(["Ignore all previous instructions", "disregard prior", "You are now an", "ACT  AS a", "pretend you are", "system :", "admin:", "<|system|>", "[inst]", "ignore previous instructions and act as a"]))
repeats = "|".join(f"{c}{{5}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789_")
flags("t06_is_garbled", "documents", "doc_id", {"garbled": (lambda: T.is_garbled(F.col("text")), "")})
flags("t07_placeholders", "documents", "doc_id", {"description": (lambda: T.is_template_description(F.col("text")), any_sql("text", P.TEMPLATE_DESCRIPTION)), "summary": (lambda: T.is_template_summary(F.col("text")), any_sql("text", P.TEMPLATE_SUMMARY)), "series": (lambda: T.is_series_name(F.col("text")), any_sql("text", P.SERIES_NAME)), "skip": (lambda: T.is_skip_type(F.col("lang")), "coalesce(lang, '') = 'language'")}, front(["EntityType.TOOL", "x is a EntityType", "in the source content", "Day 3 of ", "Episode 12", "part 2 of "]) | {"lang": "CASE WHEN doc_id % 5 = 0 THEN 'language' WHEN doc_id % 5 = 1 THEN NULL ELSE lang END"})
flags("t08_ocr_noise", "documents", "doc_id", {"noise": (lambda: T.is_ocr_noise(F.col("text")), any_sql("text", P.OCR_NOISE)), "screen": (lambda: T.is_screen_recording(F.col("text")), any_sql("text", P.SCREEN_RECORDING))}, front(["share this", "12k views", "youtube video", "tap here", "day 3 of ", "link in bio", "check out my page", "drop a like", "new reel every", "thanks for watching", "DM us for", "comment below", "share with", "save for later", "link in the comments", "follow @me", "screencast", "mouse over", "browser tab", "url bar shows", "typing into the"]))
flags("t09_fix_misspelling", "part", "p_partkey", {"name": (lambda: T.fix_misspelling(F.col("p_name")), "CASE lower(trim(p_name)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.MISSPELLINGS.items()) + " ELSE p_name END")}, instead("p_name", [f" {k.title()}" for k in P.MISSPELLINGS], "p_partkey"))
domain = "regexp_extract(url, '://([^/:?#]*)', 1)"
known = " ".join(f"WHEN starts_with(regexp_replace(lower({domain}), '[ -]', '', 'g'), '{x.replace('.', '').replace('-', '')[:5]}') THEN '{x}'" for x in P.DOMAINS)
suspicious = f"regexp_matches({domain}, '^[a-zA-Z0-9]([a-zA-Z0-9\\-]*[a-zA-Z0-9])?(\\.[a-zA-Z]{{2,}})+$') AND {any_sql(domain, P.SUSPICIOUS_DOMAIN)}"
flags("t11_validate_domain", "pages", "page_id", {"domain": (lambda: T.validate_domain(host()), f"CASE WHEN NOT (contains({domain}, '.') AND length({domain}) > 3) THEN {domain} {known} WHEN {suspicious} THEN NULL ELSE {domain} END")})
low = "lower(trim(coalesce(p_type, '')))"
dotless = f"contains(p_type, '.') AND length(trim(p_type)) > 3 AND {suspicious} AND (CASE {known} END) IS NULL".replace(domain, "trim(p_type)")
flags("t12_validate_entity_name", "part", "p_partkey", {"reason": (lambda: T.name_reject_reason(F.col("p_type")), f"CASE WHEN length(trim(coalesce(p_type, ''))) < 2 THEN 'length' WHEN {low} IN {list_sql(P.PLATFORMS)} THEN 'platform' WHEN {low} IN {list_sql(P.GENERIC_TERMS)} THEN 'generic' WHEN regexp_matches(trim(p_type), '^[0-9]+[%+]?\\s+\\w') THEN 'numeric' WHEN {any_sql('p_type', P.OCR_NOISE)} THEN 'noise' WHEN {any_sql('p_type', P.SCREEN_RECORDING)} THEN 'screen' WHEN {dotless} THEN 'domain' END"), "name": (lambda: T.clean_entity_name(F.col("p_type")).isNotNull(), "reason IS NULL")}, instead("p_type", ["x", "", "YouTube", " Button ", "100+ websites", "20 free things", "7% more", "link in bio", "cursor on it", "shop.in", "my.shop7.com", "shop12.com", "github.in", "docker.com", "a.b", "figma 2.in"], "p_partkey"))
flags("t13_min_confidence", "events", "event_id", {"ok": (lambda: T.min_confidence(F.col("value") / 100), "coalesce(value / 100, 0) >= 0.3")})
flags("t14_transcript_quality", "conversations", "conv_id, turn".split(", ")[0], {"turn": (lambda: F.col("turn"), "turn"), "quality": (lambda: T.transcript_quality(F.col("text")), f"CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN {contains_sql('text', P.MUSIC_MARKERS)} THEN 'music_only' WHEN length(trim(text)) < 50 THEN 'short' WHEN NOT {contains_sql('text', P.ACTION_VERBS)} THEN 'no_actions' ELSE 'real_content' END")})
markers = " + ".join(f"CAST(contains(lower(text), '{m}') AS INT)" for m in P.HINGLISH_MARKERS)
flags("t15_script_language", "documents", "doc_id", {"script": (lambda: T.script_language(F.col("text")), f"CASE WHEN len(regexp_extract_all(text, '[ऀ-ॿ]')) > length(text) * 0.1 THEN 'hindi' WHEN {markers} >= 3 THEN 'hinglish' ELSE 'other' END")}, instead("text", ["यह हिन्दी में है", "a long text with one letter: ह", "kya hai yeh aur woh", "hai kya", "KYA hai aur that"], "doc_id"))
noise = "(?i)^(?:" + "|".join(P.NOISE_LINES) + ")"
flags("t16_drop_noise_lines", "documents", "doc_id", {"text_md5": (lambda: F.md5(T.drop_noise_lines(F.col("text"))), f"md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR (length(trim(x)) >= 3 AND NOT regexp_matches(trim(x), '{noise}'))), chr(10)))")})
flags("t18_isolate_post", "documents", "doc_id", {"post_md5": (lambda: F.md5(T.isolate_post(F.col("text"))), "")})
flags("t19_post_type", "pages", "page_id", {"kind": (lambda: T.post_type(F.col("url"), F.col("page_id") % 3, F.col("page_id") % 2), "CASE WHEN contains(url, '/reel/') OR contains(url, '/tv/') THEN 'reel' WHEN page_id % 3 > 1 THEN 'carousel' WHEN page_id % 2 > 0 THEN 'reel' ELSE 'carousel' END")})
flags("t20_clean_text", "documents", "doc_id", {"text_md5": (lambda: F.md5(T.clean_text(F.col("text"))), f"md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '{P.BOILERPLATE}', '', 'g'), ' '))")}, front(["two   blanks", "a\n\n\n\nb \t c", "Cookie", "PRIVACY Policy and terms of service", "subscribe to the newsletter", "   "]))
scores = ", ".join("{'n': " + " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in kws) + f", 'o': {-i}, 'c': '{c}'}}" for i, (c, kws) in enumerate(P.CATEGORY_KEYWORDS.items()))
flags("t21_keyword_category", "documents", "doc_id", {"category": (lambda: T.keyword_category(F.col("text")), f"(SELECT CASE WHEN s.n > 0 THEN s.c ELSE 'other' END FROM (SELECT list_max([{scores}]) AS s))")})
info = lambda part: A.key_info(F.col("text"))[part]
named = ", ".join(f"regexp_extract_all(text, '{p}', 1)" for p in P.TOOL_NAMES)
flags("t22_key_info", "documents", "doc_id", {"first_line": (lambda: info("title"), "coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 3)[1], '')"), "urls": (lambda: F.array_join(info("urls"), " "), f"array_to_string(regexp_extract_all(text, '{P.TEXT_URL}')[1:5], ' ')"), "tools": (lambda: F.array_join(info("tools"), " "), f"array_to_string(list_sort(list_distinct(list_concat({named})))[1:5], ' ')"), "n_words": (lambda: info("word_count"), WORDS_SQL.format(c="text")), "n_lines": (lambda: info("line_count"), "len(string_split(text, chr(10)))")}, front(["using Figma and the Notion app", "https://b.example/1 http://a.example/2> https://c.example", "a\nb\n\n", "try Docker or Docker software or use Rust", "".join(f"https://u{i}.example download Tool{c} " for i, c in enumerate("FEDCBA"))]))
status = "400 + event_id % 110"


def error(part: str):
    return T.classify_error((F.lit(400) + F.col("event_id") % 110).cast("int"), F.col("event_type"))[part]


flags("t23_classify_error", "events", "event_id", {"error_type": (lambda: error("error_type"), f"CASE WHEN {status} IN {list_sql(P.TEMPORARY_STATUS)} THEN 'temporary' WHEN {status} IN {list_sql(P.PERMANENT_STATUS)} THEN 'permanent' WHEN {status} IN {list_sql(P.AUTH_STATUS)} THEN 'auth' WHEN {any_sql('event_type', P.TEMPORARY_ERROR)} THEN 'temporary' WHEN {any_sql('event_type', P.AUTH_ERROR)} THEN 'auth' ELSE 'unknown' END"), "should_retry": (lambda: error("should_retry"), f"NOT ({status} IN {list_sql([*P.PERMANENT_STATUS, *P.AUTH_STATUS])} OR ({status} NOT IN {list_sql(P.TEMPORARY_STATUS)} AND NOT {any_sql('event_type', P.TEMPORARY_ERROR)} AND {any_sql('event_type', P.AUTH_ERROR)}))"), "retry_after": (lambda: error("retry_after"), f"CASE WHEN {status} = 429 THEN 60.0 WHEN {status} IN {list_sql(P.TEMPORARY_STATUS)} THEN 30.0 END::DOUBLE")})
flags("t29_key_points", "documents", "doc_id", {"n": (lambda: F.size(T.key_points(F.split("text", r"\."))), "least(7, len(list_distinct(list_transform(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, ' ')), lambda x: length(x) >= 10), lambda x: lower(x)))))")})
flags("t31_tags", "part", "p_partkey", {"tags": (lambda: F.array_join(T.tags(F.col("p_brand"), F.split("p_type", " "), F.lit("part"), F.col("p_name"), ["red", "blue", "green"]), ","), "array_to_string(list_sort(list_distinct(list_concat([p_brand], string_split(p_type, ' '), ['part'], list_filter(['red', 'blue', 'green'], lambda k: contains(lower(p_name), k))))), ',')")})
flags("t32_valid_subtopics", "part", "p_partkey", {"subtopics": (lambda: F.array_join(T.valid_subtopics(F.split("p_type", " "), F.array(F.lit("SMALL"), F.lit("BRASS"), F.lit("PLATED"), F.lit("STEEL"))), ","), "array_to_string(list_filter(string_split(p_type, ' '), lambda s: s IN ('SMALL', 'BRASS', 'PLATED', 'STEEL'))[1:3], ',')")})
flags("t33_fallback_category", "labels", "doc_id", {"category": (lambda: F.coalesce(F.when(F.col("toxic") == 1, "toxic"), F.lit("other")), "coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, 'other')")})
flags("t34_prompt_text", "documents", "doc_id", {"prompt_md5": (lambda: F.md5(T.prompt_text(F.col("source"), F.col("text"), F.split("text", "\n"))), "md5(substring(source, 1, 400) || chr(10) || substring(text, 1, 800) || chr(10) || array_to_string(string_split(text, chr(10))[1:5], chr(10)))")})
flags("t35_split_projects", "documents", "doc_id", {"project": (lambda: T.is_project(F.col("lang"), F.col("source"), F.col("text")), f"({any_sql('text', P.PROJECT_INDICATORS)} OR {any_sql('source', P.PROJECT_INDICATORS)})"), "note_md5": (lambda: F.md5(T.with_setup_note(F.col("text"))), f"md5(CASE WHEN coalesce(text, '') = '' OR {contains_sql('text', P.BUILD_WORDS)} THEN text ELSE regexp_replace(text, '\\.+$', '') || '. See repository for setup instructions.' END)")}, {"text": f"CASE doc_id % 4 WHEN 0 THEN source || '...' WHEN 1 THEN source ELSE coalesce({pick(['build a ', 'Create YOUR ', 'project : ', 'app: ', 'repository: ', 'see github.com/', 'install. '], 'doc_id % 9')}, '') || text END", "source": "CASE WHEN doc_id % 10 = 7 THEN 'build the ' || source ELSE source END"})
flags("t36_guide_title", "conversations", "conv_id", {"turn": (lambda: F.col("turn"), "turn"), "title": (lambda: T.guide_title(F.col("text"), F.col("role")), "CASE WHEN text IS NULL OR len(list_filter(string_split(trim(text, ' '), chr(10))[1:3], lambda x: starts_with(trim(x), '#') OR contains(lower(x), 'step') OR contains(lower(x), 'guide'))) > 0 THEN '' WHEN coalesce(role, '') = '' THEN 'Step-by-Step Guide' ELSE 'How to Use ' || role END"), "first_md5": (lambda: F.md5(T.order_sections(F.col("text"), F.col("role"))["first"]), "md5(CASE WHEN instr(lower(text), 'summary') > 0 AND instr(lower(role), 'step') > 0 AND instr(lower(role), 'step') < instr(lower(text), 'summary') THEN role ELSE text END)")})
flags("t37_slugify", "part", "p_partkey", {"slug": (lambda: T.slugify(F.col("p_name")), "regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")})
flags("t38_is_tutorial", "documents", "doc_id", {"tutorial": (lambda: T.is_tutorial(F.col("text")), f"{contains_sql('text', P.TUTORIAL_WORDS)} AND length(text) >= 100")})
flags("t39_est_tokens", "documents", "doc_id", {"tokens": (lambda: T.est_tokens(F.col("text")), "CAST(floor(length(text) / 4) AS BIGINT)")})
flags("t40_fit_dim", "embeddings", "vec_id", {"n": (lambda: F.size(T.fit_dim(F.col("embedding"), 96)), "96"), "total": (lambda: F.round(F.aggregate(T.fit_dim(F.col("embedding"), 32), F.lit(0.0), lambda s, x: s + x.cast("double")), 4), "round(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))), 4)")})
flags("t41_parse_model_response", "events", "event_id", {"k": (lambda: T.parse_model_response(F.concat(F.lit("answer: "), F.col("props")), "k int")["k"], "CAST(json_extract(props, '$.k') AS INT)")})
flags("t43_query_class", "conversations", "conv_id", {"turn": (lambda: F.col("turn"), "turn"), "kind": (lambda: T.query_class(F.col("text")), f"CASE WHEN {WORDS_SQL.format(c='text')} <= 2 AND NOT {contains_sql('text', P.QUESTION_WORDS)} THEN 'lookup' WHEN {contains_sql('text', P.SEMANTIC_WORDS)} THEN 'semantic' WHEN {contains_sql('text', P.RELATION_WORDS)} THEN 'relationship' ELSE 'balanced' END")}, instead("text", ["docker", "what now", "tools similar to that one", "all that is ABOUT it", "which parts depend on it", "modules that import the parser", "the first second third"], "(conv_id + turn)"))
flags("t44_budget", "documents", "doc_id", {"fits": (lambda: T.within_budget(F.lit("classification"), T.est_tokens(F.col("text"))), "floor(length(text) / 4) <= 2000"), "cost": (lambda: F.round(T.call_cost(T.est_tokens(F.col("text")), F.lit(500)), 6), "round(floor(length(text) / 4) / 1000 * 0.00015 + 0.5 * 0.0006, 6)")})
flags("t45_sampling_interval", "lineitem", "l_orderkey", {"l_linenumber": (lambda: F.col("l_linenumber"), "l_linenumber"), "step": (lambda: F.round(T.sampling_interval(F.col("l_quantity") * 10), 6), "round(CASE WHEN l_quantity * 10 <= 0 THEN 2.0 ELSE greatest(0.5, least(10.0, l_quantity * 10 / 30)) END, 6)::DOUBLE")})
flags("t46_node_id", "part", "p_partkey", {"node": (lambda: T.node_id(F.col("p_partkey")), "'entity-' || p_partkey"), "rel": (lambda: T.relation_type(F.split("p_type", " ")[0], ["SMALL", "LARGE"]), "CASE WHEN upper(string_split(p_type, ' ')[1]) IN ('SMALL', 'LARGE') THEN upper(string_split(p_type, ' ')[1]) ELSE 'RELATED_TO' END")})


@query("t10_fuzzy_to_known")
def t10(spark, d):
    names = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    known = spark.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys(P.MISSPELLINGS.values()))], "term string, ord int")
    return D.fuzzy_to_known(names, known)


@query("t17_clean_ocr", r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s.,:;!?@#/&''()+-]', '', 'g'), '\s+', ' ', 'g')) AS x FROM documents),
r AS (SELECT doc_id, x, row_number() OVER (PARTITION BY substring(x, 1, 50) ORDER BY doc_id) AS n FROM c WHERE length(x) > 10)
SELECT doc_id, md5(x) AS text_md5 FROM r WHERE n = 1""")
def t17(spark, d):
    rows = t(spark, d, "documents").select("doc_id", T.clean_ocr(F.col("text")).alias("x")).where("x IS NOT NULL")
    first = F.row_number().over(Window.partitionBy(F.substring("x", 1, 50)).orderBy("doc_id"))
    return rows.withColumn("n", first).where("n = 1").select("doc_id", F.md5("x").alias("text_md5"))


@query("t47_short_transcripts", "SELECT conv_id, turn FROM conversations WHERE length(trim(text, ' ')) < 50")
def t47(spark, d):
    return t(spark, d, "conversations").where(F.length(F.trim("text")) < 50).select("conv_id", "turn")


@query("t48_entity_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an') AND p_brand = 'Brand#13'")
def t48(spark, d):
    return t(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("an")) & (F.col("p_brand") == "Brand#13")).select("p_partkey")


@query("t30_duplicates_summary")
def t30(spark, d):
    points = t(spark, d, "conversations").select("conv_id", "turn", F.lower(F.col("text")).alias("point"), F.lower(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).alias("summary")).where("summary IS NOT NULL")
    inside = (F.length("point") > 20) & F.contains("summary", F.col("point"))
    bound = 2 * F.least(F.length("point"), F.length("summary")) / (F.length("point") + F.length("summary")) > 0.7
    near = points.withColumn("ratio", F.when(bound & ~inside, D.block_ratio("summary", "point")))
    return near.select("conv_id", "turn", (inside | (F.coalesce("ratio", F.lit(0.0)) > 0.7)).alias("duplicate"))


def composed(spark: SparkSession, d: str) -> DataFrame:
    """Markdown documents to chunk: each page's text lines below its header, each source's documents as one text."""
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"), F.col("source").alias("title"))


@query("c01_chunk_headers", """
SELECT doc_id, CAST(0 AS INT) AS piece, source AS header_path, md5(trim('# ' || source || chr(10) || replace(text, chr(10), chr(10) || chr(10)))) AS text_md5
FROM documents WHERE length(trim('# ' || source || chr(10) || replace(text, chr(10), chr(10) || chr(10)))) >= 100""")
def c01(spark, d):
    return C.chunk_headers(composed(spark, d)).select("doc_id", "piece", "header_path", F.md5("text").alias("text_md5"))


@query("c02_split_large")
def c02(spark, d):
    return C.split_large(C.chunk_headers(composed(spark, d))).select("doc_id", "piece", "part", F.length("text").alias("n_chars"))


@query("c03_add_overlap")
def c03(spark, d):
    parts = C.split_large(C.chunk_headers(composed(spark, d)))
    return C.add_overlap(parts, order="part").select("doc_id", "part", F.md5("text").alias("text_md5"))


@query("c04_contextualize")
def c04(spark, d):
    parts = C.add_overlap(C.split_large(C.chunk_headers(composed(spark, d))), order="part")
    titled = parts.join(t(spark, d, "documents").select("doc_id", F.col("source").alias("title")), "doc_id")
    return C.contextualize(titled, order="part").select("doc_id", "chunk_index", "tokens", F.md5("text").alias("text_md5"))


@query("c05_marker_sections", "SELECT conv_id * 1000 + turn AS doc_id, CASE role WHEN 'user' THEN 'Caption' ELSE 'Audio Transcript' END AS kind, md5(trim(text, ' ')) AS text_md5 FROM conversations WHERE trim(text) <> ''")
def c05(spark, d):
    marked = t(spark, d, "conversations").where("trim(text) <> ''").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(F.when(F.col("role") == "user", "[Caption]: ").otherwise("[Audio Transcript]: "), F.trim("text")).alias("text"))
    return C.marker_sections(marked).select("doc_id", "kind", F.md5("text").alias("text_md5"))


GAZ_SQL = """
w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''))) AS term FROM documents),
g AS (SELECT term FROM w WHERE length(term) >= 7 GROUP BY term ORDER BY count(*) DESC, term LIMIT 200),
hits AS (SELECT w.doc_id, w.term AS name FROM w JOIN g ON w.term = g.term),
top AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS rank FROM hits)
"""


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """The 200 words of seven letters or more in most documents: a gazetteer that the data has. Its 200 rows are fetched, so that the
    documents aren't counted again wherever it is used."""
    w = t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), D.WORDS))).alias("term")).where(F.length("term") >= 7)
    most = w.groupBy("term").count().orderBy(F.desc("count"), "term").limit(200).collect()
    return spark.createDataFrame([(r["term"], "word", 0.8) for r in most], "term string, type string, confidence double")


def detected(spark: SparkSession, d: str) -> DataFrame:
    return D.detect_entities(t(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk"), "text"), gazetteer(spark, d))


@query("d01_detect_entities", f"WITH {GAZ_SQL} SELECT doc_id, name FROM top WHERE rank <= 40")
def d01(spark, d):
    return detected(spark, d).select("doc_id", "name")


@query("d02_guess_type", "SELECT p_partkey, CASE WHEN lower(string_split(p_type, ' ')[1]) = 'small' THEN 'size' ELSE 'concept' END AS type FROM part")
def d02(spark, d):
    dim = spark.createDataFrame([("SMALL", "size")], "name string, type string")
    return D.guess_type(t(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("name")), dim).select("p_partkey", "type")


@query("d03_extract_url_entities", r"""
SELECT page_id AS doc_id, regexp_replace(lower(regexp_extract(url, '(?:https?://|www\.)([A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1)), '^www\.', '') AS name, CAST(0.95 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS uses FROM pages""")
def d03(spark, d):
    return D.extract_url_entities(t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")))


@query("d04_merge_mentions", f"WITH {GAZ_SQL} SELECT name AS key, count(*) AS docs, CAST(max(length(name)) AS INT) AS longest FROM top WHERE rank <= 40 GROUP BY name")
def d04(spark, d):
    mentions = detected(spark, d).withColumn("context", F.col("name"))
    return D.merge_mentions(mentions.withColumn("chunk", F.col("doc_id"))).select("key", F.size("chunks").cast("long").alias("docs"), F.col("longest").cast("int").alias("longest"))


@query("d05_merge_detectors", """
WITH p AS (SELECT DISTINCT lower(p_brand) AS key, 0.8 AS c FROM part), u AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS key, 0.95 AS c FROM part), m AS (SELECT DISTINCT lower(p_brand) AS key, 0.9 AS c FROM part WHERE p_size < 10)
SELECT key, CAST(CASE WHEN min(o) = 1 THEN 0.95 ELSE max(c) END AS DOUBLE) AS confidence FROM (SELECT key, c, 0 AS o FROM p UNION ALL SELECT key, c, 1 FROM u UNION ALL SELECT key, c, 2 FROM m) GROUP BY key""")
def d05(spark, d):
    part = t(spark, d, "part")
    made = lambda df, c, conf: df.select(F.expr(c).alias("name"), F.lit("part").alias("type"), F.lit(conf).alias("confidence")).distinct()
    return D.merge_detectors(made(part, "p_brand", 0.8), made(part, "split(p_type, ' ')[0]", 0.95), made(part.where("p_size < 10"), "p_brand", 0.9)).select("key", "confidence")


@query("d06_validate_mentions")
def d06(spark, d):
    return D.validate_mentions(detected(spark, d).select("doc_id", "name"), t(spark, d, "documents").select("doc_id", F.col("text").alias("caption")), P.GENERIC_TERMS)


SEEN = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN repeat('no ', 200) ELSE source END AS text FROM documents"


@query("d07_validate_against_source", f"""
WITH {GAZ_SQL} SELECT t.doc_id, t.name, round(CASE WHEN contains(lower(x.half), t.name) THEN 0.9 ELSE 0.8 END, 6)::DOUBLE AS confidence
FROM top t JOIN (SELECT doc_id, text AS half, length(text) < 500 AS weak FROM ({SEEN})) x ON t.doc_id = x.doc_id
WHERE rank <= 40 AND (contains(lower(x.half), t.name) OR NOT x.weak)""")
def d07(spark, d):
    """A third of the documents is seen as it is, a third as another long text, a third as a short one."""
    texts = spark.sql(SEEN.replace("FROM documents", "FROM {documents}"), documents=t(spark, d, "documents")).select("doc_id", "text", (F.length("text") < 500).alias("weak"))
    return D.validate_against_source(detected(spark, d).select("doc_id", "name", "confidence"), texts)


def claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, name as a model might give them, and the names' aliases: of the names in a document a quarter each is left as it is, comes by an
    alias, misspelt or made up; in every fifth document all that would be changed are made up."""
    terms = gazetteer(spark, d)
    found = D.detect_entities(t(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk"), "text"), terms)
    kind, made_up = F.crc32("name") % 4, F.reverse("name")
    misspelt = F.concat(F.substring("name", 1, 2), F.substring("name", 4, 999))
    name = F.when(kind == 0, F.col("name")).when(F.col("doc_id") % 5 == 0, made_up).when(kind == 1, F.concat(F.lit("alias of "), "name")).when(kind == 2, misspelt).otherwise(made_up)
    return found.select("doc_id", name.alias("name")), terms.select(F.concat(F.lit("alias of "), "term").alias("name"), F.col("term").alias("alias"))


def checked_claims(spark: SparkSession, d: str) -> DataFrame:
    names, aliases = claims(spark, d)
    return D.check_hallucination(names, t(spark, d, "documents").select("doc_id", "text"), aliases=aliases)


@query("d08_d09_hallucination")
def d08(spark, d):
    return D.filter_hallucinated(checked_claims(spark, d))


@query("d10_post_validate", f"""
WITH {GAZ_SQL} SELECT t.doc_id, t.name FROM top t JOIN documents x ON t.doc_id = x.doc_id WHERE rank <= 40 AND contains(lower(x.text), t.name)""")
def d10(spark, d):
    names = detected(spark, d).select("doc_id", F.col("name").alias("ord"), "name", "confidence")
    return D.post_validate(names, t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "name")


@query("d11_dedup_entities", f"""
WITH r AS (SELECT p_partkey, {NORMAL_SQL.format(c='p_name')} AS key, row_number() OVER (PARTITION BY {NORMAL_SQL.format(c='p_name')} ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)
SELECT key, p_partkey FROM r WHERE n = 1""")
def d11(spark, d):
    rows = t(spark, d, "part").select("p_partkey", T.normalize_name(F.col("p_name")).alias("key"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("ord"))
    return D.dedup_entities(rows, F.col("key")).select("key", "p_partkey")


@query("d12_accept_relationships", """
WITH r AS (SELECT DISTINCT p_brand AS source, p_type AS target FROM part UNION SELECT p_type, lower(p_type) FROM part), k AS (SELECT lower(p_brand) AS k FROM part WHERE p_brand NOT LIKE '%3' UNION SELECT lower(p_type) FROM part WHERE p_type NOT LIKE 'S%')
SELECT source, target, 'MADE_OF' AS rel_type, CASE WHEN target LIKE 'P%' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM r WHERE lower(source) <> lower(target) AND lower(source) IN (SELECT k FROM k) AND lower(target) IN (SELECT k FROM k)""")
def d12(spark, d):
    """Brands and the types of their parts, some of both unknown, and types that are related to themselves."""
    part = t(spark, d, "part")
    rels = part.select(F.col("p_brand").alias("source"), F.col("p_type").alias("target")).union(part.select("p_type", F.lower("p_type"))).distinct()
    names = part.where("p_brand NOT LIKE '%3'").select(F.col("p_brand").alias("name")).union(part.where("p_type NOT LIKE 'S%'").select(F.upper("p_type")))
    return D.accept_relationships(rels.withColumn("rel_type", F.lit("made_of")).withColumn("confidence", F.when(F.col("target").startswith("P"), 0.5)), names)


@query("t24_filter_search_hits", f"""
WITH h AS (SELECT d.lang AS entity, d.doc_id AS ord, d.source AS title, d.text AS snippet FROM documents d),
k AS (SELECT entity, ord, row_number() OVER (PARTITION BY entity ORDER BY ord) AS rank FROM h WHERE length(snippet) >= 20 AND contains(lower(title || ' ' || snippet), lower(entity)))
SELECT entity, ord, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5""")
def t24(spark, d):
    hits = t(spark, d, "documents").select(F.col("lang").alias("entity"), F.col("doc_id").alias("ord"), F.concat(F.lit("https://"), "source", F.lit(".example.com/")).alias("url"), F.col("source").alias("title"), F.col("text").alias("snippet"))
    return D.filter_search_hits(hits, ["facebook.com"]).select("entity", "ord", "rank")


@query("t26_extract_alternatives", r"""
WITH x AS (SELECT lang AS entity, doc_id AS ord, unnest(list_distinct(list_transform(regexp_extract_all('versus ' || text, '(?i)(?:alternatives? to|vs\.?|versus|similar to)\s+([A-Za-z][\w.-]+)', 1), lambda s: lower(s)))) AS name FROM documents),
f AS (SELECT entity, name, min(ord) AS o FROM x WHERE name NOT IN ('the') AND name <> entity GROUP BY entity, name),
r AS (SELECT entity, name, row_number() OVER (PARTITION BY entity ORDER BY o, name) AS rank FROM f) SELECT entity, name, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""")
def t26(spark, d):
    hits = t(spark, d, "documents").select(F.col("lang").alias("entity"), F.col("doc_id").alias("ord"), F.concat(F.lit("versus "), "text").alias("text"))
    return D.extract_alternatives(hits, ["the"])


@query("t28_best_url", "SELECT host, min(url) AS url FROM (SELECT url, regexp_extract(url, '://([^/:?#]*)', 1) AS host FROM pages) WHERE host NOT LIKE 'm.%' GROUP BY host")
def t28(spark, d):
    pages = t(spark, d, "pages").select("url", host().alias("host"))
    return pages.where(~F.col("host").startswith("m.")).groupBy("host").agg(F.min("url").alias("url"))


@query("t42_accept_model_entities")
def t42(spark, d):
    names = detected(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return D.accept_model_entities(names, P.GENERIC_TERMS).select("doc_id", F.array_join("names", ",").alias("names"))
