"""The operators against brute force and exact round trips on small fixtures, with nulls, empty texts, repeats and ties."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import align, chaining, column_bwt, nn_descent, order_minhash, packing, tiling, token_files, tokens, toxicity, wrappers
from graphloom.llm.common import batch_minima, shared_dir, shingles, window_minima


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


LONG = 8  # a document of many words, to make a near copy of


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    rows: list[tuple[int | None, str | None]] = [(i, " ".join(word() for _ in range(rng.randint(5, 150)))) for i in range(24)]
    rows += [(30, rows[3][1]), (31, f"{rows[4][1]} {passage}"), (32, f"{passage} {rows[5][1]}"), (33, ""), (34, None), (None, "no id here"), (35, "x"), (36, "  two\n\n words ")]
    near = rows[LONG][1].split()
    near[len(near) // 2] = "changed"
    return [*rows, (37, " ".join(near)), (38, "aaaa" * 200)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 7) for i, t in corpus()], "doc_id long, text string, lang string, spans int")


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.randrange(4) for _ in range(rng.randrange(14))]
        b = [rng.randrange(4) for _ in range(rng.randrange(14))] if rng.random() < 0.4 else [x for x in a if rng.random() < 0.8]
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        most = rng.randrange(9)
        assert align.edit_distance(np.array(a, int), np.array(b, int), most) == min(last[-1], most + 1)


def test_batch_minima_equals_single():
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, 50, n).astype(np.uint32) for n in (0, 3, 6, 9, 13, 14, 200, 1)]
    text, at, _ = batch_minima(codes, 6, 8)
    assert sorted(zip(text.tolist(), at.tolist())) == [(i, p) for i, c in enumerate(codes) for p in window_minima(shingles(c, 6), 8).tolist()]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n in (0, 1, 700):
        for top in (1, 3, 10**12):
            v = np.sort(rng.integers(0, top, n))
            e, _ = token_files.EliasFano.from_bytes(token_files.EliasFano.encode(v).to_bytes())
            assert (e.slice(0, n) == v).all() and [e[i] for i in range(0, n, 97)] == v[::97].tolist()


def test_memoized_tokens():
    e = tokens.Encoder(tokenizer())
    texts = ["a\n  b", "\x1c!\x1d x ", " lead", "tr  ", "", "  \n\n x's 12ab !!?? <|endoftext|> y", *(t or "" for _, t in corpus())]
    assert e.encode(texts) == e._ids(texts)


def test_token_files_round_trip(spark, docs):
    path = shared_dir(spark, "t")
    shards = token_files.write_token_files(docs, path, tokenizer())
    got = token_files.read_token_files(spark, path, shards).orderBy("start").collect()
    plain = tokens.Encoder(tokenizer())
    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    assert [bytes(r["ids"]) for r in got] == [plain._ids([t or ""])[0] + np.uint32(2).tobytes() for _, t in order]
    assert token_files.write_token_files(docs.limit(0), shared_dir(spark, "t"), tokenizer()) == []


def test_packing(spark, docs):
    out = packing.pack(docs, tokenizer(), capacity=64).toPandas()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist() and g["length"].sum() <= 64
    assert out.groupby("doc_id", dropna=False).size().shape[0] == len({i for i, _ in corpus()})
    rng = np.random.default_rng(0)
    for _ in range(10):
        counts = dict(Counter(rng.integers(100, 700, 120).tolist()))
        plan = packing.bin_completion(counts, 1024)
        used = Counter()
        for p, times in plan.items():
            assert sum(p) <= 1024
            for s in p:
                used[s] += times
        assert used == counts and packing.lower_bound(counts, 1024) <= plan.total() <= packing.best_fit_decreasing(counts, 1024).total()


@pytest.mark.parametrize("large", [2000, 1])
def test_repeated_bytes(spark, docs, large):
    got = {(r["doc_id"], r["n_bytes"]): r for r in column_bwt.remove_repeats(docs, 100, large).collect()}
    seen: set[bytes] = set()
    for i, t in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        r = got[i, len(b)]
        assert bytes(r["kept"]) == bytes(x for x, y in zip(b, gone) if not y)
        assert r["n_spans"] == sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))


def test_repeated_bytes_of_many_rows_without_an_id(spark):
    """So many that texts' 24-bit tags collide: all but the first lose the line they share, and only it."""
    line = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(3))[:150]
    docs = spark.range(14_000).selectExpr("CAST(NULL AS LONG) AS doc_id", f"sha2(string(id), 256) || '|{line}' AS text")
    got = column_bwt.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").toPandas()
    assert got["doc_id"].isna().all() and len(got) == 14_000 and (got["n_bytes"] == 215).all()
    removed = sorted(got["n_removed"])
    assert removed[0] == 0 and removed[1] >= 151 and removed[-1] < 160 and sorted(got["n_spans"])[1:] == [1] * 13_999


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in order_minhash.near_duplicates(docs).collect()}
    assert got[30] == (3, False) and got[37] == (LONG, False)
    assert all(got[i] == (i, True) for i in (0, 1, 2, 33, 34, 35, 36))
    assert order_minhash.drop_near_duplicates(docs).count() == len(corpus()) - 2
    assert order_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_passages(spark, docs):
    got = {(r["doc_id"], r["source_id"]): r["end"] - r["start"] for r in chaining.passages(docs).collect()}
    assert got[32, 31] >= 59 and got[32, 5] >= len(corpus()[5][1].split()) - 1
    left = {r["doc_id"]: r["text"] for r in chaining.cut_passages(docs).collect()}
    assert left[0] == corpus()[0][1] and left[31].split()[-60:] == dict(corpus())[31].split()[-60:]
    assert 32 not in left and left[34] is None


@pytest.mark.parametrize("gap", [10, 30, 60, 100, 150, 200])
def test_passages_apart(spark, gap):
    rng = random.Random(gap)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    one, two = words(60), words(60)
    rows = [(i, " ".join(words(20) + one + words(gap) + two + words(20))) for i in (1, 2)]
    spans = [r for r in chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    covered = {p for r in spans for p in range(r["start"], r["end"])}
    assert covered >= {*range(20, 80), *range(80 + gap, 140 + gap)} and all(r["doc_id"] == 2 and r["identity"] >= 0.8 for r in spans)
    assert gap <= 30 or len(covered) == 120


def test_chain_parts_equal_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(200):
        runs, a, b, x, y = [], [], [], 0, 0
        for _ in range(rng.integers(1, 7)):
            n, g, h = rng.integers(6, 40), rng.integers(1, 40), rng.integers(1, 40)
            runs.append((x, y, n))
            same = rng.integers(0, 2**31, n)
            a += [*same, *rng.integers(2**31, 2**32, g)]
            b += [*same, *rng.integers(2**31, 2**32, h)]
            x, y = x + n + g, y + n + h
        a, b = np.array(a, np.uint32), np.array(b, np.uint32)
        cost = [max(q[0] - p[0] - p[2], q[1] - p[1] - p[2]) for p, q in zip(runs, runs[1:])]

        def good(i, j):
            n, m = (runs[j][c] + runs[j][2] - runs[i][c] for c in (0, 1))
            return n if n >= 50 and sum(cost[i:j]) <= round(0.2 * max(n, m), 6) else 0

        best = [0]
        for j in range(len(runs)):
            best.append(max([best[-1]] + [best[i] + good(i, j) for i in range(j + 1) if good(i, j)]))
        got = chaining.parts_of(np.array(runs), a, b, 50, 0.8)
        assert sum(e - s for s, e, *_ in got) == best[-1] and all(p[1] <= q[0] for p, q in zip(got, got[1:]))


def test_tiling(spark, docs):
    words = (corpus()[0][1] + " " + corpus()[1][1]).split()
    item = " ".join(words[10:20] + words[0:10])  # reordered
    bench = spark.createDataFrame([(1, item), (2, "never seen anywhere in it at all"), (3, None), (4, "")], "item_id long, text string")
    both = [{(r["doc_id"], tuple(r["item_ids"]), r["coverage"]) for r in tiling.leaks(docs, bench, max_shipped_words=n).collect()} for n in (10**6, 0)]
    assert both[0] == both[1] and {d for d, items, _ in both[0] if items} <= {0, 1, 30, 31}
    assert tiling.leaks(docs, bench.limit(0)).where("contaminated").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, int(i % 2), (base[i % 20] + 0.02 * rng.standard_normal(16)).tolist()) for i in range(40)] + [(50, 0, None), (51, None, [1.0] * 16), (52, 0, [0.0] * 16), (53, 0, [float("nan")] * 16)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), block=8).collect()}
    v = {i: np.array(e) / np.linalg.norm(e) for i, lab, e in rows[:40]}
    for i in v:
        assert got[i][0] == sum(j != i and j % 2 == i % 2 and v[i] @ v[j] >= 0.93 for j in v)
    assert all(got[i] == (0, i) for i in (50, 51, 52, 53))


def test_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(30)] + (["you", "idiot"] if i % 4 == 0 else []))) for i in range(200)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, iterations=5)
    scores = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    assert all((scores[i] >= 0.3) == (i % 4 == 0) for i in range(150, 200)) and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.fit(docs, labels.limit(0)).score(docs).select("score").distinct().count() == 1
    assert zlib.crc32(b"7") % 4 in range(4)


def test_main_text(spark):
    page = lambda title, body: f"<html><head><style>p{{}}</style></head><body><nav>Menu</nav><div class='cookie-notice'>We use cookies</div><article><h1>{title}</h1><p>{body}<br><p>Tom &amp; Jerry</p><div class='comments'>first!</div></article><footer>f</footer></body>"
    rows = [(i, "https://a.com/x", page(f"T{i}", f"Some  body {i}")) for i in range(6)] + [(10, None, None), (11, "", ""), (12, "u", "plain <b>text</b>")]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3\n\nSome body 3\n\nTom & Jerry" and got[10] == got[11] == "" and got[12] == "plain text"


def main_texts(spark, page, n=6):
    rows = [(i, "https://a.com/x", page(i)) for i in range(n)]
    got = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r["page_id"]: r["text"] for r in got.collect()}


def test_main_text_nested(spark):
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(60))
    article = lambda i: f"<article><header><h1>T{i}</h1><p>Stand {i}</p></header><div class='body'><p>{body(i)}</p></div><section class='more'>{'end%d ' % i * 20}</section></article>"
    for n in (6, 1):  # with the host's statistics, and without
        got = main_texts(spark, lambda i: f"<body><nav>Menu</nav><div class='wrap'>{article(i)}<div class='x'>Other {i}</div></div></body>", n)
        assert all(got[i] == "\n\n".join([f"T{i}", f"Stand {i}", body(i), ("end%d " % i * 20).strip()]) for i in range(n))
        got = main_texts(spark, lambda i: f"<body><div class='a'><h1><a href='/'>T{i}</a></h1><div class='body'><p>{body(i)}</p></div></div></body>", n)
        assert all(got[i] == f"T{i}\n\n{body(i)}" for i in range(n))
    got = main_texts(spark, lambda i: f"<body><div class='top'>Our site</div><div class='body'><p>{body(i)}</p></div><div class='end'>Contact</div></body>")
    assert all(got[i] == body(i) for i in got)  # what all pages share is template


@pytest.mark.parametrize("mark", ["content has-sidebar", "no-sidebar", "layout_with_menu", "without-ads", "widget", "social-page"])
def test_main_text_class_words(spark, mark):
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(40))
    got = main_texts(spark, lambda i: f"<body><div class='{mark}'><p>{text(i)}</p><div class='sidebar'>Aside {i}</div></div></body>")
    assert all(got[i] == text(i) for i in got)


def test_main_text_still_skips(spark):
    long = "advert " * 30
    got = main_texts(spark, lambda i: f"<body><div class='ad'>{long}{i}</div><article><p>Short {i}</p></article><div class='comments'>{long}{i}</div></body>")
    assert all(got[i] == f"Short {i}" for i in got)
    got = main_texts(spark, lambda i: f"<body><div class='cookie-notice'>{long}{i}</div><p>Short {i}</p><div class='comments'>{long}{i}</div></body>")
    assert all(got[i] == f"Short {i}" for i in got)
