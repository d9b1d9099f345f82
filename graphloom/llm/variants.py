"""Operator 12: groups of spelling variants by asymmetric q-chunks.

Words one edit apart are found by a join of signatures, not by comparing words. Of two such words the shorter one, x (of equally
long ones either), contributes two disjoint chunks, its halves; the other one, y, contributes grams as long as the chunks, for
each length x may have. One edit leaves one of the halves whole, and y has it where x has it or one place later (behind an
inserted letter): so y need only show its positional grams within shift one of a chunk. Pairs that meet are verified.

* Frequent chunks: where the words that show a chunk would make over `most` pairs, that chunk makes none. The half with the edit is
  halved again instead, and what is left beside a quarter serves as a longer signature, and so on; at last one letter is left
  out, and words that then agree are all near. So no group of many words with a common beginning is compared all with all, and
  none is dropped.
* A pair may agree beside several such regions (an inserted letter within a run of equal ones). It counts where the region is
  the first, which a comparison of the two words tells, so pairs need no deduplication.

Forms and roots follow from the pairs by grouping; roots by doubling the chain of forms, which is short, as n rises fivefold a link.

Nulls and odd input: a null or empty text has no words. A null doc_id stands as an empty string in the rule that drops letters;
repeated rows count again. Words of any length are kept whole. Extra columns are ignored; an empty table gives no rows. Ties for
a form go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, sliced

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
STRETCH = 1 << 20  # characters of a text that are searched at a time


def stretches(text: str) -> Iterator[str]:
    """The text in pieces of about STRETCH characters that end where no run of letters goes on."""
    a = 0
    while a < len(text):
        b = min(len(text), a + STRETCH)
        run = LETTERS.match(text, b)
        b = run.end() if run else b
        yield text[a:b]
        a = b


def count_words(docs: DataFrame, modulus: int = 199, shortest: int = 6, held: int = 200_000) -> DataFrame:
    """word, n: runs of letters of whole texts by partial counts of a task, of which it holds `held` at most; not summed yet.

    A run for whose document and letters crc32 is divisible by `modulus` loses one letter, as if misspelt."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for batch in sliced(batches, 100):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs: Counter[str] = Counter()
                for part in stretches(text or ""):
                    runs.update(LETTERS.findall(part.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))  # bytes.lower() is A-Z
                key = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    if len(run) >= shortest:
                        h = zlib.crc32(run.encode(), key)
                        if h % modulus == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        if len(run) >= shortest:
                            total[run] += n
            if len(total) > held:
                yield out()
                total.clear()
        if total:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long")


def cut(level: int, part: Column, length: Column) -> Column:
    """Where a part of a word begins that is halved `level` times: part times length over 2^level, down to a whole."""
    return F.shiftright(part.cast("long") * length, level).cast("int")


def without(word: Column, begin: Column, end: Column) -> Column:
    """What is left of a word beside the region; its beginning tells which it is."""
    return F.concat(F.substr(word, F.lit(1), begin), F.lit("-"), F.substr(word, end + 1))


def signatures(words: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The sides of the join at a level: x's chunks and y's grams as (word, longer, part, size, key). words: word and, beyond the first
    level, the parents that were too frequent as (longer, part, size), where size is the length of x.

    At a level x falls into 2^level regions; a key is what stands beside a region, so at the first level a half: of x, and
    of y with its end moved by `longer` (0 or 1), by which y is the longer one."""
    n = F.length("word")
    if level == 1:
        first = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.lit(0))
        x, y = first.withColumn("size", n), first.withColumn("size", n - F.col("longer"))
    else:
        x, y = words.where("side = 'x'").drop("side"), words.where("side = 'y'").drop("side")

    def keyed(df: DataFrame, moved: Column) -> DataFrame:
        own = df.withColumn("part", F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)))
        begin, end = cut(level, F.col("part"), F.col("size")), cut(level, F.col("part") + 1, F.col("size"))
        key = without(F.col("word"), begin, end + moved)
        return own.where(end > begin).select("word", "longer", "part", "size", key.alias("key"))

    return keyed(x, F.lit(0)), keyed(y, F.col("longer"))


def near_pairs(words: DataFrame, most: int = 4096) -> DataFrame:
    """a, b of all words one edit apart, each pair once (a is the shorter or, of equally long ones, the smaller). words: distinct."""
    given, level, found = words.select("word"), 1, []
    ids = ["longer", "part", "size", "key"]
    while True:
        x, y = signatures(given, level)
        both = materialize(x.withColumn("side", F.lit("x")).unionByName(y.withColumn("side", F.lit("y"))), "chunks")
        groups = both.groupBy(*ids).agg(F.count_if(F.col("side") == "x").alias("nx"), F.count_if(F.col("side") == "y").alias("ny"))
        begin, end = cut(level, F.col("part"), F.col("size")), cut(level, F.col("part") + 1, F.col("size"))
        hot = materialize(groups.where((F.col("nx") * F.col("ny") > most) & (end - begin > 1)).select(*ids), "hot")  # with one letter out, its alphabet bounds the group
        ready = both.join(hot, ids, "left_anti")
        left = ready.where("side = 'x'").select(*ids, F.col("word").alias("a"))
        right = ready.where("side = 'y'").select(*ids, F.col("word").alias("b"))
        earlier = (begin > 0) & (F.substr(F.col("a"), begin + 1) == F.substr(F.col("b"), begin + 1 + F.col("longer")))
        met = left.join(right, ids).where(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & ~earlier).where(F.levenshtein("a", "b", 1) == 1)
        found.append(materialize(met.select("a", "b"), "near"))
        given = None if hot.isEmpty() else materialize(both.join(hot, ids).select("side", "word", "longer", "part", "size"), "frequent")
        discard(both)
        discard(hot)
        if given is None:
            break
        level += 1
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def roots(links: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms. links: (word, form), without cycles."""
    state = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(state.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(state)
        state = now
        if state.where("moved").isEmpty():
            return state.select("word", "root")


def variants(docs: DataFrame, least: int = 5, times: int = 5, modulus: int = 199, shortest: int = 6, most: int = 4096) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word with `shortest` letters and `least` occurrences: its form is the most frequent word
    one edit away, if that is `times` as frequent; its root the last of the chain of forms."""
    words = materialize(count_words(docs, modulus, shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")
    pairs = near_pairs(words, most)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    counted = both.join(words.toDF("near", "near_n"), "near").groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(counted, "word", "left")
    chosen = -F.col("best.less") >= times * F.col("n")
    rows = materialize(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_qchunk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their forms and roots."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: crc32 byte by byte, near words by equal remains, chains by recursion.
ORACLE = """
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM found WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(bytes) // 2), lambda i: CAST('0x' || substr(bytes, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM runs, bits),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word AS word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words) UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
ranked AS (SELECT near.word, near.near, w.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near) AS at FROM near JOIN words w ON w.word = near.near),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.at = 1),
chain(word, last, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.last AS root FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
