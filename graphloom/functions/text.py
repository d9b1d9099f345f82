"""Column expressions over text and URLs (T01-T48). All stay in whole-stage code; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def any_of(column: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, without regard to case; null counts as empty."""
    return F.coalesce(column, F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is computed once for a row, not for each word that a lambda compares it with."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(column: Column, words: list[str]) -> Column:
    return once(F.lower(column), lambda low: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))


def words(column: Column) -> Column:
    return F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")


def normalize_url(url: Column) -> Column:
    """T01. Scheme and host lower, no www., trailing dot or slash, doubled slashes, tracking or blank parameters, fragment; parameters sorted."""
    part = lambda name: F.coalesce(F.try_parse_url(F.trim(url), F.lit(name)), F.lit(""))
    scheme = F.when(part("PROTOCOL") == "", "https").otherwise(F.lower(part("PROTOCOL")))
    host = F.regexp_replace(F.regexp_replace(F.lower(part("AUTHORITY")), r"\.+$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(part("PATH"), "/+", "/"), "/+$", "")
    pairs = F.filter(F.split(part("QUERY"), "&"), lambda p: p.rlike("^[^=]+=.+") & ~F.lower(F.substring_index(p, "=", 1)).isin(P.TRACKING_PARAMS))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def content_hash(url: Column) -> Column:
    """T02."""
    return F.sha2(normalize_url(url), 256)


def is_safe_url(url: Column) -> Column:
    """T03. http(s) only; no blocked host and no private, loopback or link-local address."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & ~host.isin(P.BLOCKED_HOSTS) & ~host.rlike(P.PRIVATE_HOST), F.lit(False))


def has_injection(text: Column) -> Column:
    """T04."""
    return any_of(text, P.INJECTION)


def sanitize_text(text: Column, n: int = 10000) -> Column:
    """T05."""
    out = F.substring(text, 1, n)
    for p in P.INJECTION:
        out = F.regexp_replace(out, f"(?i){p}", "[REDACTED]")
    return out


def is_garbled(text: Column) -> Column:
    """T06. Short, a run of five non-ASCII characters, one word character five times, or ???."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(F.trim(text)) < 10) | text.rlike(r"[^\x00-\x7F]{5,}") | text.rlike(r"(?U)(\w)\1{4,}") | F.contains(text, F.lit("???"))


def is_template_description(text: Column) -> Column:
    """T07."""
    return any_of(text, P.TEMPLATE_DESCRIPTION)


def is_template_summary(text: Column) -> Column:
    """T07."""
    return any_of(text, P.TEMPLATE_SUMMARY)


def is_series_name(text: Column) -> Column:
    """T07."""
    return any_of(text, P.SERIES_NAME)


def is_skip_type(kind: Column) -> Column:
    """T07."""
    return F.coalesce(kind, F.lit("")) == "language"


def is_ocr_noise(text: Column) -> Column:
    """T08."""
    return any_of(text, P.OCR_NOISE)


def is_screen_recording(text: Column) -> Column:
    """T08."""
    return any_of(text, P.SCREEN_RECORDING)


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def fix_misspelling(name: Column) -> Column:
    """T09."""
    return F.coalesce(lookup(F.lower(F.trim(name)), P.MISSPELLINGS), name)


def validate_domain(name: Column) -> Column:
    """T11. Known domain that the name begins like, null for a suspicious domain, else the name."""
    flat = F.regexp_replace(F.lower(name), "[ -]", "")
    cases = F.lit(None).cast("string")
    for domain in reversed(P.DOMAINS):
        clean = domain.replace(".", "").replace("-", "")
        cases = F.when(flat.startswith(clean[:5]), domain).otherwise(cases)
    looks = name.rlike(r"^[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?(\.[a-zA-Z]{2,})+$")
    dotted = F.contains(name, F.lit(".")) & (F.length(name) > 3)
    return F.when(~dotted, name).otherwise(F.coalesce(cases, F.when(~(looks & any_of(name, P.SUSPICIOUS_DOMAIN)), name)))


def name_reject_reason(name: Column) -> Column:
    """T12. Why a name is no entity, or null; the tests run in this order."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    low = F.lower(trimmed)
    return (
        F.when(F.length(trimmed) < 2, "length")
        .when(low.isin(P.PLATFORMS), "platform")
        .when(low.isin(P.GENERIC_TERMS), "generic")
        .when(trimmed.rlike(r"^[\d]+[%+]?\s+\w"), "numeric")
        .when(trimmed.rlike(r"(?i)^\d+\+?\s+(animated|free|best|top|new|all|more|less)"), "quantity")
        .when(is_ocr_noise(trimmed), "noise")
        .when(is_screen_recording(trimmed), "screen")
        .when(validate_domain(trimmed).isNull(), "domain")
    )


def clean_entity_name(name: Column) -> Column:
    """T12 without the fuzzy step: the cleaned name, or null."""
    return F.when(name_reject_reason(name).isNull(), fix_misspelling(validate_domain(F.trim(name))))


def min_confidence(confidence: Column, least: float = 0.3) -> Column:
    """T13."""
    return F.coalesce(confidence, F.lit(0.0)) >= least


def transcript_quality(text: Column) -> Column:
    """T14."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", "empty").when(contains_any(text, P.MUSIC_MARKERS), "music_only").when(F.length(F.trim(text)) < 50, "short").when(~contains_any(text, P.ACTION_VERBS), "no_actions").otherwise("real_content")


def script_language(text: Column) -> Column:
    """T15."""
    found = once(F.lower(text), lambda low: F.size(F.filter(F.array(*map(F.lit, P.HINGLISH_MARKERS)), lambda m: F.contains(low, m))))
    return F.when(F.regexp_count(text, F.lit(r"[ऀ-ॿ]")) > F.length(text) * 0.1, "hindi").when(found >= 3, "hinglish").otherwise("other")


def drop_noise_lines(text: Column) -> Column:
    """T16."""
    noise = "(?i)^(?:" + "|".join(P.NOISE_LINES) + ")"
    keep = F.filter(F.split(text, "\n"), lambda line: (F.trim(line) == "") | ((F.length(F.trim(line)) >= 3) & ~F.trim(line).rlike(noise)))
    return F.array_join(keep, "\n")


def clean_ocr(text: Column) -> Column:
    """T17, per text: charset and white space; rows of at most ten characters become null."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s.,:;!?@#/&'()+-]", ""), r"\s+", " "))
    return F.when(F.length(out) > 10, out)


def isolate_post(text: Column) -> Column:
    """T18. The best-scored post of a feed text, without its tails; null if it has at most 50 characters."""
    posts = F.split(text, r"\n(?=[a-z0-9_.]+\s*•\s*\nFollow)|\n(?=\d+[,\d]*\s*\n\d+[,\d]*(?:\n|$))")
    score = lambda p: F.size(words(p)) + F.when(F.contains(p, F.lit("#")), 50).otherwise(0) + F.when(F.regexp_count(p, F.lit("\n")) >= 2, 20).otherwise(0)
    ranked = F.transform(posts, lambda p, i: F.struct(score(p).alias("s"), (-i).alias("i"), F.trim(p).alias("post")))
    best = F.array_max(ranked)["post"]
    long = F.filter(posts, lambda p: F.size(words(p)) >= 20)
    best = F.when((F.size(words(best)) < 20) & (F.size(long) > 0), F.trim(F.get(long, F.lit(0)))).otherwise(best)
    for pattern, to in ((r"\nLikes\n[\d,]+\n[\d,]+$", ""), (r"\nFollow$", ""), (r"\n{3,}", "\n\n")):
        best = F.regexp_replace(best, pattern, to)
    return F.when(F.length(best) > 50, best)


def post_type(url: Column, entries: Column, duration: Column) -> Column:
    """T19."""
    return F.when(F.contains(url, F.lit("/reel/")) | F.contains(url, F.lit("/tv/")), "reel").when(entries > 1, "carousel").when(duration > 0, "reel").otherwise("carousel")


def clean_text(text: Column) -> Column:
    """T20."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "), P.BOILERPLATE, ""))


def keyword_category(text: Column) -> Column:
    """T21. Category with most of its keywords in the text, the first of equals; other if none."""
    hits = lambda low, kws: F.size(F.filter(F.array(*map(F.lit, kws)), lambda k: F.contains(low, k)))
    scores = lambda low: F.array(*[F.struct(hits(low, kws).alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, (c, kws) in enumerate(P.CATEGORY_KEYWORDS.items())])
    return once(once(F.lower(text), lambda low: F.array_max(scores(low))), lambda best: F.when(best["n"] > 0, best["category"]).otherwise("other"))


def first_line(text: Column) -> Column:
    """T22. First line of over three characters."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 3), F.lit(0))


def classify_error(status: Column, message: Column) -> Column:
    """T23. struct(error_type, should_retry, retry_after)."""
    made = lambda kind, retry, after: F.struct(F.lit(kind).alias("error_type"), F.lit(retry).alias("should_retry"), F.lit(after).cast("double").alias("retry_after"))
    return (
        F.when(status == 429, made("temporary", True, 60.0))
        .when(status.isin(P.TEMPORARY_STATUS), made("temporary", True, 30.0))
        .when(status.isin(P.PERMANENT_STATUS), made("permanent", False, None))
        .when(status.isin(P.AUTH_STATUS), made("auth", False, None))
        .when(any_of(message, P.TEMPORARY_ERROR), made("temporary", True, 30.0))
        .when(any_of(message, P.AUTH_ERROR), made("auth", False, None))
        .when(any_of(message, P.NETWORK_ERROR), made("network", True, 60.0))
        .otherwise(made("unknown", True, None))
    )


def key_points(points: Column, most: int = 7) -> Column:
    """T29. Trimmed, of ten characters at least, the first of those equal without regard to case, at most `most`."""
    kept = F.filter(F.transform(points, lambda x: F.trim(x)), lambda p: F.length(p) >= 10)
    full = lambda acc, p: (F.size(acc) >= most) | F.exists(acc, lambda a: F.lower(a) == F.lower(p))
    return F.aggregate(kept, F.expr("cast(array() as array<string>)"), lambda acc, p: F.when(full(acc, p), acc).otherwise(F.concat(acc, F.array(p))))


def valid_subtopics(proposed: Column, allowed: Column) -> Column:
    """T32."""
    return F.slice(F.filter(proposed, lambda s: F.array_contains(allowed, s)), 1, 3)


def tags(topic: Column, subtopics: Column, kind: Column, name: Column, keywords: list[str]) -> Column:
    """T31."""
    found = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(name), k))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(topic), subtopics, F.array(kind), found), lambda t: t.isNotNull())))


def prompt_text(title: Column, body: Column, snippets: Column) -> Column:
    """T34."""
    return F.concat_ws("\n", F.substring(title, 1, 400), F.substring(body, 1, 800), F.array_join(F.slice(snippets, 1, 5), "\n"))


def is_project(kind: Column, name: Column, description: Column) -> Column:
    """T35."""
    return F.coalesce(kind.isin("web_app", "mobile_app"), F.lit(False)) | any_of(description, P.PROJECT_INDICATORS) | any_of(name, P.PROJECT_INDICATORS)


def with_setup_note(description: Column) -> Column:
    """T35."""
    noted = F.concat(F.regexp_replace(description, r"\.+$", ""), F.lit(". See repository for setup instructions."))
    return F.when((F.coalesce(description, F.lit("")) == "") | contains_any(description, P.BUILD_WORDS), description).otherwise(noted)


def guide_title(first_step: Column, name: Column) -> Column:
    """T36. A title if the guide's first three lines have none, else ''."""
    lines = F.slice(F.split(F.trim(first_step), "\n"), 1, 3)
    titled = F.exists(lines, lambda x: F.trim(x).startswith("#") | F.contains(F.lower(x), F.lit("step")) | F.contains(F.lower(x), F.lit("guide")))
    made = F.when(F.coalesce(name, F.lit("")) == "", "Step-by-Step Guide").otherwise(F.concat(F.lit("How to Use "), name))
    return F.when(first_step.isNull() | titled, "").otherwise(made)


def order_sections(summary: Column, guide: Column) -> Column:
    """T36. struct(first, second): swapped if the guide's step stands before the summary's heading."""
    at_s, at_g = F.locate("summary", F.lower(summary)), F.locate("step", F.lower(guide))
    swap = (at_s > 0) & (at_g > 0) & (at_g < at_s)
    return F.struct(F.when(swap, guide).otherwise(summary).alias("first"), F.when(swap, summary).otherwise(guide).alias("second"))


def slugify(text: Column) -> Column:
    """T37."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_tutorial(text: Column) -> Column:
    """T38."""
    return contains_any(text, P.TUTORIAL_WORDS) & (F.length(text) >= 100)


def est_tokens(text: Column) -> Column:
    """T39."""
    return F.floor(F.length(text) / 4)


def fit_dim(vector: Column, n: int) -> Column:
    """T40."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def parse_model_response(text: Column, schema: str) -> Column:
    """T41. The JSON in a fence, else from the first { to the last }."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(bare), schema)


def query_class(query: Column) -> Column:
    """T43."""
    short = (F.size(words(query)) <= 2) & ~contains_any(query, P.QUESTION_WORDS)
    return F.when(short, "lookup").when(contains_any(query, P.SEMANTIC_WORDS), "semantic").when(contains_any(query, P.RELATION_WORDS), "relationship").otherwise("balanced")


def call_cost(tokens_in: Column, tokens_out: Column, price_in: float = P.PRICE_IN, price_out: float = P.PRICE_OUT) -> Column:
    """T44."""
    return tokens_in / 1000 * price_in + tokens_out / 1000 * price_out


def within_budget(task: Column, tokens: Column) -> Column:
    """T44."""
    return tokens <= F.element_at(F.create_map(*[F.lit(x) for t, (n, _) in P.BUDGETS.items() for x in (t, n)]), task)


def sampling_interval(duration: Column, target: int = 30) -> Column:
    """T45."""
    return F.when(duration <= 0, 2.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(10.0), duration / target)))


def node_id(key: Column) -> Column:
    """T46."""
    return F.concat(F.lit("entity-"), key.cast("string"))


def relation_type(name: Column, known: list[str]) -> Column:
    """T46."""
    return F.when(F.upper(name).isin(known), F.upper(name)).otherwise("RELATED_TO")


def normalize_name(name: Column) -> Column:
    """Key of a name: its ASCII letters and digits, lower-case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def names_align(a: Column, b: Column, typos: int = 2, prefix: int = 3) -> Column:
    """J04. Equal, a few edits apart, or one the beginning of the other (normalized)."""
    a, b = normalize_name(a), normalize_name(b)
    begins = (F.least(F.length(a), F.length(b)) >= prefix) & (a.startswith(b) | b.startswith(a))
    return (a != "") & (b != "") & ((a == b) | (F.levenshtein(a, b, typos) >= 0) | begins)
