"""Operators 11 to 13 against brute-force versions, the rules of their contracts, and odd input."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import combinations, shallot, variants


def word_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- 11: Shallot search


def plain_clusters(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centroids = [v for *_, v in drawn[:k]]
    square = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for number in range(rounds + 1):
        own = [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if number < rounds:
            for j in range(len(centroids)):
                members = [v for (_, v), (_, at) in zip(kept, own) if at == j]
                if members:
                    centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), shas[j]) for (i, _), (d, j) in zip(kept, own)), key=repr)


def vectors(n, dim, seed):
    rng = random.Random(seed)
    return [(i, [rng.choice([-1, 1]) * rng.random() + (i % 5) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("k,dim,rounds", [(8, 6, 5), (1, 3, 2), (40, 2, 3)])
def test_clusters_equal_brute_force(spark, k, dim, rounds):
    rows = vectors(120, dim, k)
    rows += [(rows[7][0], rows[7][1]), (500, rows[3][1]), (501, rows[3][1]), (None, rows[9][1]), (502, None), (503, []), (504, [1.0] * (dim + 1)), (505, [float("nan")] * dim), (506, [float("inf")] * dim), (507, [None] * dim), (508, [-1e-9] * dim)]
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, row string, `v.w` double")
    took = []
    got = sorted(map(tuple, shallot.cluster(table, k, rounds, dim, 1024, 3, took).collect()), key=repr)
    assert got == plain_clusters(rows, k, rounds, dim, 1024, 3)
    assert len(took) == rounds + 1 and (k < 8 or sum(took) < 0.9 * len(got) * k * (rounds + 1))  # bounds spare distances


def test_clusters_of_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    one = [(i, [1.0, 2.0], 0) for i in range(5)]
    got = shallot.cluster(spark.createDataFrame(one, schema), 3, 2, 2).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in got) == [(i, 0, 0, 0) for i in range(5)]  # equal centroids: the first
    assert {r["cluster"] for r in shallot.cluster(spark.createDataFrame(one[:1], schema), 3, 1, 2).collect()} == {0}
    assert shallot.cluster(spark.createDataFrame([], schema), 3, 1, 2).collect() == []
    with pytest.raises(Exception, match="component"):
        shallot.cluster(spark.createDataFrame([(1, [1e30, 0.0], 0)], schema), 1, 1, 2).collect()


def test_ball_search_finds_the_two_nearest():
    rng = np.random.default_rng(4)
    centroids = rng.integers(-9, 9, (12, 2))
    v = rng.integers(-9, 9, (300, 2))
    space = shallot.Space(centroids)
    first = rng.integers(0, 12, 300)
    got = space.nearest(v, first, (first + 1 + rng.integers(0, 11, 300)) % 12)
    d = ((v[:, None] - centroids) ** 2).sum(axis=2)
    for i in range(300):
        best = sorted((int(x), c) for c, x in enumerate(d[i]))
        assert (got[2][i], got[0][i]) == best[0] and got[3][i] == best[1][0]
    assert got[4] < 300 * 12


# --- 12: asymmetric q-chunks


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("most", [1, 30, 4096])  # 1: every chunk is taken for a frequent one
def test_near_pairs_equal_brute_force(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(150)}
    words |= {"commonbeginning" + "".join(rng.choice("xyz") for _ in range(4)) for _ in range(40)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "q" * 70, "q" * 71}
    pairs = [tuple(r) for r in variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), most).collect()]
    assert len(pairs) == len(set(pairs))  # each once
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)}


def plain_variants(docs, least, times, modulus):
    counts = Counter()
    for doc_id, text in docs:
        for run in variants.LETTERS.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items())


def test_variants_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["Straße", "élève", "ÉLÈVES", "receive", "colour", "gemütlich", "banana"]
    docs = []
    for i in range(60):
        words = []
        for _ in range(80):
            w = rng.choice(base[: 2 + i % 6])
            if rng.random() < 0.25:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] * 2]) + w[at + 1 :]
            words.append(w)
        docs.append((i, rng.choice([" ", "1", "_", "\n"]).join(words)))
    docs += [(None, "receive colours " * 9), (7, docs[7][1]), (99, None), (98, ""), (97, "x" * 3_000_000 + " " + "banana " * 200_000)]
    table = spark.createDataFrame([(i, t, 1, "n") for i, t in docs], "doc_id long, text string, n int, `near.n` string")
    got = sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in variants.variants(table, 5, 5, 7).collect())
    assert got == plain_variants(docs, 5, 5, 7)
    assert any(r[3] for r in got) and any(r[2] and not r[3] for r in got)
    assert variants.variants(table.limit(0)).collect() == []


def test_roots_follow_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3")], "word string, form string")
    assert {r["root"] for r in variants.roots(links).collect()} == {"w11"}


def test_stretches_end_between_runs(monkeypatch):
    monkeypatch.setattr(variants, "STRETCH", 7)
    text = "ab cdefghijklmn, opq rst" * 5
    parts = list(variants.stretches(text))
    assert "".join(parts) == text and [w for p in parts for w in variants.LETTERS.findall(p)] == variants.LETTERS.findall(text)


# --- 13: non-negative least squares


def check_packing(docs, got, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    t.encode_special_tokens = True
    want = Counter()
    for doc_id, text in docs:
        want[(doc_id, tuple([*t.encode(text or "", add_special_tokens=False).ids, 1]))] += 1
    by_doc = {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (doc_id, n), rows in by_doc.items():  # repeated rows have each piece as often as they stand
        same = [ids for (i, ids), k in want.items() for _ in range(k) if i == doc_id and len(ids) == n]
        covered = Counter(p for r in rows for p in range(r["start"], r["start"] + r["length"]))
        assert covered == Counter({p: len(same) for p in range(n)})
        assert all(any(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for ids in same) for r in rows)
    assert sum(len(ids) * k for (_, ids), k in want.items()) == sum(r["length"] for r in got)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["length"] > 0
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == window or n < window and n & (n - 1) == 0 for n in ends.values())  # no padding


@pytest.mark.parametrize("window", [16, 64])
def test_packing_keeps_every_id_without_padding(spark, window):
    rng = random.Random(window)
    docs = [(i, " ".join(rng.choice(["one", "Two,", "three's", "naïveté", "4444"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs += [(None, "no id"), (None, None), (3, docs[3][1]), (3, docs[3][1]), (400, ""), (401, "long " * 5000)]
    table = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, length int, `ids.x` string")
    got = combinations.pack(table, word_tokenizer(), window).collect()
    check_packing(docs, got, window)
    assert combinations.pack(table.limit(0), word_tokenizer(), window).collect() == []
    check_packing(docs[:1], combinations.pack(table.limit(1), word_tokenizer(), window).collect(), window)


def test_checksums_by_shuffle_equal_shipped(spark):
    rests = spark.createDataFrame([(1, 10, bytes(range(40)))], "row long, start long, ids binary")
    cuts = spark.createDataFrame([(1, 5, 12, 3, None, 20, 0, 0), (1, 5, 15, 5, None, 20, 1, 0)], combinations.PLACED)
    want = {zlib.crc32(bytes(range(8, 20))), zlib.crc32(bytes(range(20, 40)))}
    for shipped in (0, 10):
        assert {r["ids_crc32"] for r in combinations.checksums(rests, cuts, shipped).collect()} == want


def test_word_encoder_equals_whole_texts():
    coder = combinations.WordEncoder(word_tokenizer(), limit=30)
    texts = ["", " ", "It's we'll'd 'sun O'Neil's", "naïve ÀÉÎ ßµªº x²½ 12 3a", "ΣΑΣ Σ ǅ İstanbul", "é e ́x", "a\x1cb\x1f c\x85d\xa0e f", "<|endoftext|> </w> a</w>b", "日本語 text", "--..!? 'S'T", "Å ﬁ ẞ"]
    for text in texts * 2:
        assert coder.encode([text]) == coder.whole([text]), text
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aB's'd 1é.,́ \t½<") for _ in range(rng.randrange(40)))
        assert coder.encode([text, text]) == coder.whole([text, text]), repr(text)


def test_repeat_counts_minimize_the_squares():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 60, 25)
    counts[0] = 0
    sizes, times = combinations.combinations(counts, 24)
    assert ((sizes * times).sum(axis=1) == 24).all()
    brute = {tuple(sorted(c)) for n in range(1, 4) for c in itertools.product(range(1, 25), repeat=n) if sum(c) == 24 and all(counts[x] >= c.count(x) for x in c)}
    assert brute <= {tuple(sorted(itertools.chain.from_iterable([s] * k for s, k in zip(a, b)))) for a, b in zip(sizes.tolist(), times.tolist())}
    x = combinations.nonnegative(sizes, times, counts.astype(float), least=1e-12)
    left = counts - combinations.product(sizes, times, x, 25)
    slope = combinations.gradient(sizes, times, left)
    assert (x >= 0).all() and slope.max() < 0.05 * counts.max() and abs(slope[x > 0]).max() < 1e-3 * counts.max()  # no descent is left
    planned = combinations.plan({s: int(n) for s, n in enumerate(counts) if n}, 24)
    used = Counter(s for p, n in planned.items() for s in p for _ in range(n))
    assert all(sum(p) == 24 for p in planned) and all(used[s] <= counts[s] for s in used)
    assert sum(s * n for s, n in used.items()) > 0.8 * sum(s * n for s, n in enumerate(counts))  # lengths over half have few partners


def test_repeated_windows_count_once_a_text():
    """A word pair that two texts repeat 500 times is shared by one other text, and windows of one class by none."""
    from graphloom.llm.shared_windows import levels_of

    h = np.array([7] * 1000 + [8] * 6, np.uint32)
    text = np.repeat([0, 1, 2, 3, 4, 5, 6, 7], [500, 500, 1, 1, 1, 1, 1, 1])
    root = np.array([1, 2, 3, 3, 3, 3, 3, 4], np.uint32)[text]
    assert levels_of(h, text, root).tolist() == [1] * 1000 + [1] * 5 + [3]
    assert levels_of(h[1000:1005], text[1000:1005], root[1000:1005]).tolist() == [0] * 5
