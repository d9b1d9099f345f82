"""Queries against their DuckDB oracle on the smallest tables, and operators on small literals."""

import os
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom import plans
from graphloom.functions import text as T
from graphloom.operators import chunking, entities, graph, resolve, search
from graphloom.operators import scores as scored
from graphloom.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df, columns):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        try:
            return f"{float(x):.4f}"
        except (TypeError, ValueError):
            return str(x).replace("T", " ")

    return sorted(tuple(map(str, map(plain, r))) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_oracle(spark, con, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


#: Queries of flags, with the columns that must take more than one value in the oracle, lest agreement shows nothing.
BITES = {
    "t03_is_safe_url": ["safe"], "t04_t05_injection": ["injected"], "t07_placeholders": ["description", "summary", "series", "skip"], "t08_ocr_noise": ["noise", "screen"], "t09_fix_misspelling": ["name"],
    "t12_validate_entity_name": ["reason", "name"], "t15_script_language": ["script"], "t22_key_info": ["urls", "tools", "n_lines"], "t24_relevant_hits": ["rank"], "t25_assemble_text": ["origin", "has_caption"], "t27_reference_links": ["origin"], "t28_fill_urls": ["url"],
    "t35_split_projects": ["project"], "t43_query_class": ["kind"], "d07_validate_against_source": ["confidence"], "x02_retry_state": ["status"], "s15_ocr_entry": ["category", "tools", "urls"], "a11_group_by_topic": ["subtopic"], "d12_accept_relationships": ["target", "confidence"], "x08_sessions": ["kind", "n"],
}


@pytest.mark.parametrize("name", sorted(BITES))
def test_oracles_take_several_values(con, name):
    want = con.execute(plans.SQL[name]).df()
    assert all(want[c].nunique(dropna=False) > 1 for c in BITES[name])


def test_some_events_are_late_and_some_are_not(con):
    late = con.execute(plans.SQL["x08_sessions"]).df().query("kind == 'late'")
    assert 0 < late["n"].sum() < con.execute("SELECT count(*) FROM events").fetchone()[0] and (late["n"] >= 0).all()


def test_golden_resolution(spark):
    kinds = "id string, name string, type string, description string"
    old = spark.createDataFrame([
        ("ent-docker", "Docker", "platform", "Containerization platform for building, shipping, and running applications"), ("ent-aws", "AWS", "platform", "Amazon Web Services cloud computing platform"),
        ("ent-vscode", "VS Code", "tool", "Visual Studio Code source code editor from Microsoft"), ("ent-appwrite", "Appwrite", "platform", "Open-source backend server for building web and mobile applications"),
        ("ent-postgres", "PostgreSQL", "database", "Open-source relational database management system"), ("ent-supabase", "Supabase", "platform", "Open-source Firebase alternative built on PostgreSQL"),
    ], kinds)
    new = spark.createDataFrame([
        ("res-01", "Docker", "platform", "Containerization platform"), ("res-02", "docker", "platform", "Container platform"), ("res-03", "VSCode", "tool", "Code editor"),
        ("res-04", "postgres", "database", "Relational database"), ("res-05", "Apprite", "platform", "Open-source backend server"), ("res-06", "Code VS", "tool", "Source code editor from Microsoft"),
        ("res-07", "AWS Cloud", "platform", "Amazon Web Services cloud"), ("res-08", "Kubernetes", "platform", "Container orchestration"),
        ("res-09", "React", "framework", "UI library"), ("res-10", "Supabase", "platform", "Firebase alternative"),
    ], kinds)
    got = {r["query_id"]: (r["decision"], r["base_id"]) for r in resolve.resolve(new, old).collect()}
    merged = {1: "docker", 2: "docker", 3: "vscode", 4: "postgres", 5: "appwrite", 6: "vscode", 7: "aws", 10: "supabase"}
    assert got == {f"res-{i:02}": ("MERGE", f"ent-{merged[i]}") if i in merged else ("NEW", None) for i in range(1, 11)}
    scores = scored.resolution_score(spark.createDataFrame([("all", d, d, b, b) for d, b in got.values()], "category string, expected string, actual string, expected_id string, actual_id string")).collect()
    assert {r["category"] for r in scores} == {"all", None} and all(r["precision"] == r["recall"] == r["f1"] == 1.0 for r in scores)
    # an entity of the graph that tells of the name
    edges = spark.createDataFrame([("ent-docker", "x")], "src string, dst string")
    asked = spark.createDataFrame([("q", "containerization", "idea", "nothing else")], kinds)
    assert tuple(resolve.resolve(asked, old, edges).first()) == ("q", "SIMILAR", "ent-docker", 0.7)
    assert resolve.resolve(asked, old).first()["decision"] == "NEW"


def test_text_functions(spark):
    urls = spark.createDataFrame([("HTTPS://www.Example.com.//a//b/?utm_source=x&b=2&a=1&c=#top",), (None,)], "u string")
    once = urls.select(T.normalize_url(F.col("u")).alias("u"))
    assert once.first()[0] == "https://example.com/a/b?a=1&b=2"
    assert once.select(T.normalize_url(F.col("u"))).first()[0] == once.first()[0]
    safe = spark.createDataFrame([("http://10.0.0.1/x",), ("ftp://a.b",), ("https://a.com",), ("http://localhost/",)], "u string").select(T.is_safe_url(F.col("u"))).collect()
    assert [r[0] for r in safe] == [False, False, True, False]


def test_headers_and_overlap(spark):
    long = "x" * 120
    docs = spark.createDataFrame([(1, f"# A\n{long}\n## B\n{long}\n# C\n{long}")], "doc_id long, text string")
    assert [r["header_path"] for r in chunking.chunk_headers(docs).orderBy("piece").collect()] == ["A", "A > B", "C"]
    pieces = spark.createDataFrame([(1, 0, "a\n\nb"), (1, 1, "c"), (1, 2, "d")], "doc_id long, piece int, text string")
    assert [r["text"] for r in chunking.add_overlap(pieces).orderBy("piece").collect()] == ["a\n\nb", "b\n\nc", "c\n\nd"]


def test_leaders_and_hallucination(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    got = {r["id"]: r["leader"] for r in resolve.elect_leaders(nodes, pairs, lambda df: df.cache()).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    names = spark.createDataFrame([(1, "docker"), (1, "kubernets"), (1, "zebra")], "doc_id long, name string")
    texts = spark.createDataFrame([(1, "We use Docker and Kubernetes.")], "doc_id long, text string")
    assert {r["name"]: r["status"] for r in entities.check_hallucination(names, texts).collect()} == {"docker": "exact", "kubernets": "fuzzy", "zebra": "suspected"}
    known = spark.createDataFrame([("zebra", "kubernetes"), ("none", "x y")], "name string, alias string")
    checked = {r["name"]: (r["status"], r["confidence"]) for r in entities.check_hallucination(names, texts, aliases=known).collect()}
    assert checked == {"docker": ("exact", 1.0), "kubernets": ("fuzzy", 1.0), "zebra": ("alias", 1.0)}
    assert entities.filter_hallucinated(entities.check_hallucination(names, texts)).count() == 2


def test_leaders_of_a_long_chain(spark):
    nodes, pairs = spark.range(1, 61), spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "a long, b long")
    leaders = {r["id"]: r["leader"] for r in resolve.elect_leaders(nodes, pairs, lambda df: spark.createDataFrame(df.collect(), df.schema)).collect()}
    assert leaders == {i: i - (i - 1) % 2 for i in range(1, 61)}


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["A-b c", None, "", "Abc"]
    table = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    k = ["".join(c for c in (n or "").lower() if c.isalnum()) for n in names]
    near = lambda x, y: x and y and (edits(x, y) <= 2 or min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x)))
    got = sorted((r["a"], r["b"]) for r in resolve.aligned_pairs(table).collect())
    assert got == [(i, j) for i in range(len(k)) for j in range(i + 1, len(k)) if near(k[i], k[j])]
    from difflib import SequenceMatcher

    words = sorted({n for n in names if n})
    both = spark.createDataFrame([(w,) for w in words], "a string")
    close = {(r["a"], r["b"]) for r in entities.fuzzy_pairs(both, both.toDF("b"), 0.75).collect()}
    assert close == {(x, y) for x in words for y in words if SequenceMatcher(None, x, y).ratio() >= 0.75}
    bodies = spark.createDataFrame([(i, f"x {n} y") for i, n in enumerate(names)], "id int, body string")
    queries = table.withColumnsRenamed({"id": "query_id", "name": "query"})
    few, many = ({(r["query_id"], r["id"]) for r in search.contains_search(queries, bodies, n).collect()} for n in (1000, 1))
    assert few == many and len(few) >= 60


@pytest.mark.parametrize("least", [0.3, 0.6, 0.75, 0.9, 1.0])
def test_jaccard_pairs_equal_brute_force(spark, least):
    rng = random.Random(12)
    base = [rng.sample(range(60), rng.randint(1, 20)) for _ in range(25)]
    sets = base + [sorted({*b, *rng.sample(range(60), rng.randint(0, 3))} - set(rng.sample(b, rng.randint(0, 1)))) for b in base for _ in range(2)] + [[], [], [1], [1]]
    table = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "id int, tokens array<string>")
    got = {(r["a"], r["b"]): round(r["jaccard"], 9) for r in resolve.jaccard_pairs(table, least).collect()}
    want = {(i, k): round(len({*x} & {*y}) / len({*x} | {*y}), 9) for i, x in enumerate(sets) for k, y in enumerate(sets) if i < k and x and y and len({*x} & {*y}) >= least * len({*x} | {*y})}
    assert got == want and len(want) > 1


def test_outbox_projection(spark):
    rows = [
        (1, 1, "entity.upsert", "a", None, None), (2, 2, "entity.upsert", "b", None, None), (3, 3, "relationship.upsert", "a-b", "a", "b"), (4, 4, "relationship.upsert", "b-b", "b", "b"),
        (5, 5, "entity.delete", "a", None, None), (6, 6, "entity.upsert", "a", None, None), (7, 7, "chunk.upsert", "c1", "doc", None), (8, 8, "content.delete", "doc", None, None),
        (9, 9, "chunk.upsert", "c2", "doc", None), (10, 10, "nonsense", "z", None, None), (11, 11, "relationship.delete", "b-b", None, None), (12, 1, "entity.delete", "b", None, None),
    ]
    log = spark.createDataFrame(rows, "event_id long, ts long, kind string, id string, a string, b string")
    want = {("entity", "a"), ("entity", "b"), ("chunk", "c2"), ("failed", "10")}
    state = jobs.latest_effects(jobs.effects(log))
    assert {(r["grp"], r["id"]) for r in jobs.projection(state).collect()} == want
    again = jobs.latest_effects(jobs.latest_effects(jobs.effects(log.where("event_id > 6"))).unionByName(jobs.latest_effects(jobs.effects(log.where("event_id < 9")))))
    assert {(r["grp"], r["id"]) for r in jobs.projection(again).collect()} == want


def test_merge_entities(spark):
    kinds = "id int, ord int, description string, web_info array<struct<title string, url string>>, tools array<string>, tags array<string>, confidence double, content_type string"
    rows = [(1, 2, "new", [("t", "u"), ("x", "")], ["git", "B"], ["p"], 0.5, "unknown"), (1, 1, "old", [("s", "u"), ("y", "")], ["Git"], ["p", "q"], 0.7, "tool"), (2, 1, None, [], [], [], None, None)]
    got = {r["id"]: r for r in scored.merge_entities(spark.createDataFrame(rows, kinds)).collect()}
    one = got[1]
    assert one["description"] == "old | new" and [tuple(w) for w in one["web_info"]] == [("s", "u"), ("y", ""), ("x", "")] and one["tools"] == ["Git", "B"] and one["tags"] == ["p", "q"]
    assert (one["confidence"], one["version"], one["content_type"]) == (0.7, 2, "tool") and got[2]["content_type"] == "unknown" and got[2]["description"] is None


def test_parities_differ_in_no_more_bits_than_sets_in_tokens(spark):
    rng = random.Random(13)
    base = rng.sample(range(10_000), 300)
    sets = [base, *([*base[n:], *rng.sample(range(10_000, 20_000), n)] for n in (0, 1, 5, 20, 150))]
    bits = [r["bits"] for r in spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, tokens array<int>").select("id", resolve.parities("tokens").alias("bits")).orderBy("id").collect()]
    differ = [sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(bits[0], b)) for b in bits]
    assert all(d <= len({*base} ^ {*s}) for d, s in zip(differ, sets)) and differ[1] == 0 and differ[-1] > 60  # so far over 2 * 300 - 2 * 0.9 / 1.9 * 600 = 31


def joined_rows(df):
    """The most rows that a join or generator of a query has put out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name, below = node.nodeName(), node.children()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [below.apply(i) for i in range(below.length())]
    return most


def test_graph_similarity_pairs_texts_not_copies(spark):
    rng = random.Random(14)
    words = ["red", "blue", "hot", "bolt", "ring", "a"]
    old = [(i, " ".join(rng.choices(words, k=2)), rng.choice([None, "", "blue ring", "hot"])) for i in range(400)]
    new = [(i, rng.choice(["red", "Blue ring", "hot bolt", "ring", "a", None])) for i in range(300)]
    base, asked = spark.createDataFrame(old, "id int, name string, description string"), spark.createDataFrame(new, "id int, name string")
    found = resolve.graph_similarity(asked, base, base.where("id % 3 > 0").select(F.col("id").alias("src"), F.col("id").alias("dst")))
    parts = lambda *c: {w for w in " ".join(x for x in c if x is not None).lower().split(" ")}
    want = {}
    for q, name in new:
        near = [(-len(parts(name) & parts(n, d)), i, d or "") for i, n, d in old if name and i % 3 and {w for w in parts(name) & parts(n, d) if len(w) > 2}]
        hit = [i for _, i, d in sorted(near)[:5] if name.lower() in d or d and d[:20] in name.lower()]
        want |= {q: min(hit)} if hit else {}
    assert {r["query_id"]: r["base_id"] for r in found.collect()} == want and want
    assert joined_rows(found) < 3000  # pairs of rows with a common word: over 20,000


def test_fulltext_search_pairs_token_sets_not_copies(spark):
    rng = random.Random(15)
    words = [f"w{i}" for i in range(7)]
    docs = [(i, " ".join(rng.choices(words, k=2))) for i in range(500)]
    asked = [(i, " ".join(rng.choices([*words, "none"], k=2))) for i in range(200)] + [(900, None), (901, "")]
    found = search.fulltext_search(spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(docs, "id int, body string"), 12)
    df = {w: sum(w in b.split() for _, b in docs) for w in words}
    want = set()
    for q, text in asked:
        scores = [(-round(sum(1 / df[w] for w in {*(text or "").split()} & {*b.split()}), 9), i) for i, b in docs if {*(text or "").split()} & {*b.split()}]
        want |= {(q, i) for _, i in sorted(scores)[:12]}
    assert {(r["query_id"], r["id"]) for r in found.collect()} == want and len(want) > 1000
    assert joined_rows(found) < 5000  # pairs of rows with a common token: some 40,000


def test_exact_name_join_deals_out_copies_of_a_name(spark):
    base = spark.range(4000).coalesce(1).select("id", F.lit("Bolt").alias("name"))
    found = resolve.exact_name_join(base.where("id % 100 = 0").withColumn("name", F.lower("name")), base)
    tasks = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 40 * 4000 and max(tasks) < sum(tasks) / 2  # one task put out all of them


@pytest.mark.parametrize("k", [None, 3])
def test_similar_texts_equal_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(resolve, "LEFT_ROWS", 7)
    monkeypatch.setattr(resolve, "RIGHT_ROWS", 11)
    rng = random.Random(16)
    words = ["red", "blue", "hot", "bolt", "ring", "x1"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)] + ["", "--", "q" * 3000]
    rows = [(f"id{i:02d}", t) for i, t in enumerate(texts)]
    got = [(r["a"], r["b"], r["score"]) for r in resolve.similar_texts(spark.createDataFrame(rows, "a string, text string"), spark.createDataFrame(rows, "b string, text string"), 0.6, k).collect()]
    grams = {i: Counter(s[j : j + n] for s in [t.replace(" ", "").replace("-", "")] for n in (1, 2, 3) for j in range(len(s) - n + 1)) for i, t in rows}
    norm = {i: sum(n * n for n in c.values()) ** 0.5 for i, c in grams.items()}
    want = set()
    for a in grams:
        close = sorted((-s, b) for b in grams if norm[a] and norm[b] and (s := sum(n * grams[b][g] for g, n in grams[a].items()) / (norm[a] * norm[b])) >= 0.6)
        want |= {(a, b, -s) for s, b in close[:k]}
    assert want <= {*got} and len(got) == len({*got}) and all(s >= 0.6 for *_, s in got) and (k or {*got} == want) and len(want) > 100


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_detection_makes_runs_in_the_row(spark):
    texts = spark.createDataFrame([(1, 0, "Big red ring, red  ring big"), (2, 0, "ring"), (3, 0, None), (4, 0, ""), (2, 1, "a red ring")], "doc_id long, chunk long, text string")
    terms = spark.createDataFrame([("ring", "x", 0.5), ("red ring", "y", 0.6), ("red ring big", "z", 0.7), ("ring red", "n", 0.1), ("ring big red ring", "n", 0.1), ("a", "n", 0.1)], "term string, type string, confidence double")
    found = entities.detect_entities(texts, terms)
    assert {tuple(r) for r in found.collect()} == {(1, 0, "red ring", "y", 0.6), (1, 0, "red ring big", "z", 0.7), (1, 0, "ring", "x", 0.5), (1, 0, "ring red", "n", 0.1), (2, 0, "ring", "x", 0.5), (2, 1, "red ring", "y", 0.6)}
    assert plan_of(found).count("Window [") == 1  # the rank; words in order need none
    assert entities.detect_entities(texts, terms.where("false")).count() == 0


def test_names_meet_a_caption_once(spark):
    names = spark.createDataFrame([(1, "ring"), (1, "red ring"), (1, "ring"), (1, "rin"), (2, "bolt"), (2, "nut"), (3, "odd"), (3, None), (None, "lost"), (4, "key"), (4, "keyring"), (4, "lock")], "doc_id long, name string")
    captions = spark.createDataFrame([(1, "A Red Ring and RING"), (2, "bolts"), (4, "key keyring"), (4, "LOCK")], "doc_id long, caption string")
    checked = entities.validate_mentions(names, captions, [])
    want = [(None, "lost"), (1, "rin"), (1, "red ring"), (1, "ring"), (1, "ring"), (2, "bolt"), (2, "nut"), (3, None), (3, "odd"), (4, "keyring"), (4, "lock")]
    assert Counter(map(tuple, checked.collect())) == Counter(want)
    assert plan_of(checked).count("Join") == 1
    texts = spark.createDataFrame([(1, "A Red Ring"), (4, None)], "doc_id long, text string")
    for df in (entities.check_hallucination(names, texts), entities.post_validate(names.withColumn("ord", F.lit(1)).withColumn("confidence", F.lit(0.9)), texts)):
        assert "lower(text" in plan_of(df).split("Join")[-1]  # below the join


@pytest.mark.parametrize("most", [50_000, 0])
def test_vectors_meet_in_blocks(spark, most):
    draw = random.Random(5)
    vectors = [[draw.gauss(0, 1) for _ in range(7)] for _ in range(60)]
    vectors += [vectors[3]] * 30 + [[x * 2 for x in vectors[4]]] * 5 + [[0.0] * 7, None, [None] + [1.0] * 6, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, i % 2, v) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "id long, label int, v array<double>")
    asked, k, least = [r for r in rows if r[0] % 3 == 0 or r[0] > 95], 4, 0.3

    def cosine(x, y):
        if not x or not y or len(x) != len(y) or None in x + y or not any(x) or not any(y):
            return None
        dots = [0.0, 0.0, 0.0]
        for a, b in zip(x, y):
            dots = [dots[0] + a * b, dots[1] + a * a, dots[2] + b * b]
        return dots[0] / (dots[1] ** 0.5 * dots[2] ** 0.5)

    for on in (None, ["label"]):
        want = set()
        for q, label, x in asked:
            scores = sorted((-s, b) for b, other, y in rows if (on is None or label == other) and (s := cosine(x, y)) is not None and s >= least)[:k]
            want |= {(q, b, -s, n + 1) for n, (s, b) in enumerate(scores)}
        queries = table.where(F.col("id").isin([r[0] for r in asked])).withColumnRenamed("id", "query_id")
        found = resolve.knn_join(queries, table.withColumnRenamed("id", "base_id"), k, least, on, most)
        assert "MapInArrow" in plan_of(found) and "zip_with(qv" not in plan_of(found)
        assert {tuple(r) for r in found.collect()} == want


def test_tasks_grow_with_pairs(spark, monkeypatch):
    from graphloom.operators import graph

    monkeypatch.setattr(graph, "TASK_ROWS", 10)
    mentions = spark.createDataFrame([(c, e) for c in range(20) for e in range(c, c + 4)] + [(1, 1), (None, 1), (None, 2)], "chunk long, entity long")
    assert graph.pair_tasks(mentions) == (9, 13) and graph.pair_tasks(mentions.limit(0)) == (4, 4)
    pairs = graph.cooccurrence_edges(mentions)
    assert "13" in pairs._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].split("\n")[0]
    assert {tuple(r) for r in pairs.collect()} == {(a, a + d, min(n, a + 1, 23 - a - d) if d else 0) for a in range(23) for d, n in ((1, 3), (2, 2), (3, 1)) if a + d < 23}
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("weight"))
    leaders = spark.createDataFrame([(i, i - i % 3) for i in range(20)], "id long, leader long")
    nodes = leaders.select("id", F.lit("t").alias("topic")).where("id < 5")
    for one, other in ((graph.merge_nodes(edges, leaders), graph.merge_nodes(edges, leaders, 7)), (graph.neighborhood(nodes, edges.withColumn("rel_type", F.lit("x"))), graph.neighborhood(nodes, edges.withColumn("rel_type", F.lit("x")), 7))):
        assert {tuple(r) for r in one.collect()} == {tuple(r) for r in other.collect()}


def test_aligned_pairs_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(resolve, "TASK_PAIRS", 100, raising=False)
    monkeypatch.setattr(resolve, "NAME_IDS", 7, raising=False)
    names = ["docker", "dockr", "kubernetes", "docker compose", "a"]
    rows = [(i, names[i % 5]) for i in range(100)] + [(0, "dockr"), (3, "kubernets"), (8, "docker compose"), (200, None), (None, "docker")]
    held = sorted({(i, n) for i, n in rows if i is not None and n})
    near = {("docker", "dockr"), ("docker", "docker compose"), ("kubernetes", "kubernets")}
    aligned = lambda x, y: x == y or (x, y) in near or (y, x) in near
    want = sorted({(i, j) for i, x in held for j, y in held if i < j and aligned(x, y)})
    got = resolve.aligned_pairs(spark.createDataFrame(rows, "id long, name string"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() > len(want) // 100


def test_entity_match_in_tasks(spark):
    left = spark.createDataFrame([(1, "A "), (1, "a"), (2, "b"), (None, "c"), (3, None)], "doc_id long, name string")
    right = spark.createDataFrame([(1, "a"), (2, "x"), (None, "c"), (3, None)], "doc_id long, name string")
    want = [(1, "a", True, True), (2, "b", True, False), (2, "x", False, True), (None, "c", False, True), (None, "c", True, False), (3, None, False, True), (3, None, True, False)]
    got = scored.entity_match(left, right, 9)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert got.rdd.getNumPartitions() == 9


def test_neighborhood_deals_edges_out_before_they_meet_nodes(spark):
    edges = spark.createDataFrame([(1, 2, "X"), (2, 3, "X"), (3, 4, "X")], "src long, dst long, rel_type string")
    got = graph.neighborhood(spark.createDataFrame([(2, "t")], "id long, topic string"), edges, 9)
    assert sorted(tuple(r) for r in got.collect()) == [("1", "2", "X"), ("2", "3", "X"), ("2", "t", "BELONGS_TO")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("RepartitionByExpression [src" in x or "RepartitionByExpression [dst" in x for x in plan.splitlines()) == 3


def test_context_of_all_vectors_and_parts(spark, tmp_path):
    vector = lambda x, y: [x, y] + [0.0] * 6
    vectors = [(0, vector(1.0, 0.0)), (1, vector(0.9, 0.1)), (2, vector(0.0, 1.0)), (700, vector(1.0, 0.1))]
    parts = [(1, "red ring", "A", "LARGE"), (2, "old bolt", "B", "SMALL"), (9, "red plate", "C", "LARGE"), (101, "old gear", "D", "PROMO")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(9,)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = plans.QUERIES["r06_retrieve_context"](spark, str(tmp_path))
    got = {(r["query_id"], r["id"]) for r in found.collect()}
    assert got == {(0, 0), (0, 8), (100, 1), (100, 100), (700, 0), (700, 1), (700, 700)}  # 8 and 100 have no vector, 700 has no part
    assert found.where("used IS NULL").isEmpty()


def test_hallucination_check_decides_what_stays(spark):
    from difflib import SequenceMatcher

    from graphloom.plans import text_queries

    checked = text_queries.checked_claims(spark, SF).toPandas()
    assert set(checked["status"]) == {"exact", "alias", "fuzzy", "suspected"}
    assert {c >= 0.5 for c in checked[checked["status"] != "suspected"]["confidence"]} == {True, False}
    stays = checked[(checked["status"] != "suspected") & (checked["confidence"] >= 0.5)]
    assert rows(plans.QUERIES["d08_d09_hallucination"](spark, SF).toPandas(), list(checked)) == rows(stays, list(checked))
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.filter(F.split(F.lower("text"), entities.WORDS), lambda x: x != "").alias("words")).toPandas().set_index("doc_id")["words"]
    for r in checked[checked["status"].isin(["fuzzy", "suspected"])].itertuples():  # all of one word
        ratio = max(SequenceMatcher(None, r.name, w).ratio() for w in set(texts[r.doc_id]))
        assert (r.status, r.ratio) == (("fuzzy", round(ratio, 6)) if ratio >= 0.75 else ("suspected", 0.0))


def test_fuzzy_names_of_several_words(spark):
    names = spark.createDataFrame([(1, "Visual Studo Code"), (1, "visal studio"), (1, "kod"), (1, "four words of it"), (1, ""), (2, "x\U0001f600yz")], "doc_id long, name string")
    texts = spark.createDataFrame([(1, "We like visual, studio code."), (2, "x\U0001f600y z")], "doc_id long, text string")
    got = {r["name"]: (r["status"], r["ratio"]) for r in entities.check_hallucination(names, texts).collect()}
    assert got == {"Visual Studo Code": ("fuzzy", 0.971429), "visal studio": ("fuzzy", 0.96), "kod": ("suspected", 0.0), "four words of it": ("suspected", 0.0), "": ("exact", 1.0), "x\U0001f600yz": ("suspected", 0.0)}


@pytest.mark.parametrize("least", [0.85, 0.9, 0.97])
def test_sets_meet_by_whole_parts(spark, least, monkeypatch):
    monkeypatch.setattr(resolve, "TURN_TOKENS", 500)
    rng = random.Random(14)
    base = [rng.sample(range(400), rng.choice([1, 2, 5, 9, 10, 19, 20, 60, 150, 300])) for _ in range(60)]
    near = [list({*b, *rng.sample(range(400), rng.randint(0, 1 + len(b) // 15))} - set(rng.sample(b, rng.randint(0, len(b) // 15)))) for b in base for _ in range(4)]
    sets = base + near + [[], list(range(1000)), list(range(30, 1000)), list(range(120, 1000))]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, tokens array<int>")
    jaccard = {(i, k): len({*x} & {*y}) / len({*x} | {*y}) for i, x in enumerate(sets) for k, y in enumerate(sets) if i < k and x and y}
    want = {p for p, j in jaccard.items() if j >= least}
    candidates = [tuple(r) for r in resolve.pairs_by_parts(table.where(F.size("tokens") > 0), least).collect()]
    assert want <= set(candidates) and len(set(candidates)) == len(candidates) < len(want) + len(jaccard) // 50
    assert {(r["a"], r["b"]): r["jaccard"] for r in resolve.jaccard_pairs(table, least).collect()} == {p: jaccard[p] for p in want} and len(want) > 50


def test_search_broadcasts_no_growing_table(spark):
    from graphloom.plans import graph_queries

    physical = lambda df: df._jdf.queryExecution().executedPlan().toString()
    queries, docs, degrees = graph_queries.ask(spark, SF)
    assert not any("BroadcastHashJoin" in physical(df) for df in (queries, docs, search.graph_boost(queries.select("query_id", F.col("query_id").alias("id"), F.lit(1).alias("ord")), degrees)))
    found = plans.QUERIES["r07_search_with_fallback"](spark, SF)
    assert "part.parquet" not in physical(found) and "MapInArrow" not in physical(found)  # hits are there once
    hits = search.hybrid_search(queries, docs, degrees, 5, 0.99)
    assert rows(found.toPandas(), ["query_id", "id"]) == rows(search.search_with_fallback(hits, queries.withColumn("query", F.substring_index("query", " ", 1)), docs).toPandas(), ["query_id", "id"])


def test_equal_names_need_no_comparison_of_texts(spark, monkeypatch):
    compared = []
    plain = resolve.similar_texts
    monkeypatch.setattr(resolve, "similar_texts", lambda left, right, *rest: compared.append(left.count()) or plain(left, right, *rest))
    kinds = "id int, name string, type string, description string"
    old = spark.createDataFrame([(3, "Docker", "t", "x"), (2, "docker", "t", "y"), (5, "Visual Studio Code", "t", "z")], kinds)
    new = spark.createDataFrame([(10, "DOCKER", "other", "words"), (11, "VisualStudioCode", "t", "z"), (12, "Zebra", "q", "q"), (13, None, "t", "z")], kinds)
    got = {r["query_id"]: (r["decision"], r["base_id"], r["score"]) for r in resolve.resolve(new, old).collect()}
    assert got[10] == ("MERGE", 2, 1.0) and got[11] == ("MERGE", 5, 1.0) and got[12][:2] == got[13][:2] == ("NEW", None) and compared == [3]


@pytest.mark.parametrize("k", [None, 3])
def test_blocks_of_texts_in_slices(k, monkeypatch):
    rng = random.Random(15)
    texts = ["", "a", "zzzz", *("".join(rng.choices("ab1", k=rng.randint(1, 12))) for _ in range(60)), "ab" * 3000]
    grams = [Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)) for t in texts]
    norm = [sum(n * n for n in g.values()) ** 0.5 for g in grams]
    scores = {(i, j): sum(n * h[w] for w, n in g.items()) / (norm[i] * norm[j]) for i, g in enumerate(grams) for j, h in enumerate(grams) if norm[i] and norm[j]}
    want = [(i, j, s) for i in range(len(texts)) for j, s in sorted(((j, scores[i, j]) for j in range(len(texts)) if scores.get((i, j), 0) >= 0.6), key=lambda x: (-round(x[1], 12), x[0]))[:k]]
    for most in (2**24, 200):
        monkeypatch.setattr(resolve, "DENSE", most)
        got = list(zip(*resolve.similar_in_block(texts, texts, 0.6, k)))
        assert sorted((i, round(s, 9)) for i, _, s in got) == sorted((i, round(s, 9)) for i, _, s in want)
        assert all(abs(scores[i, j] - s) < 1e-12 for i, j, s in got)
