"""Operator 3: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text (never its labels, lang, source or doc_id): densities and counts of words of a learned lexicon of whole
words and of word beginnings, how near they stand to second-person words, and rates of capitals, punctuation, digits and
obfuscated spellings. The lexicon's weights are log odds of document frequencies among the labelled training rows; the features
of a training row use a lexicon learned without that row's fold, so trees see weights as they are on unseen texts. Trees are
fitted on all folds but the last, the isotonic calibration on the last.

Learning uses at most `max_rows` labelled rows, those with the smallest hash of their doc_id, and the `lexicon_size` units that tell
most of the label; scoring covers every row.

Nulls and odd input: null and empty texts have all features 0 and get the score of such a text. Labels other than 0 and 1, and
null labels or ids, aren't learned from; of several labels of one document the largest counts. Repeated rows are scored each.
Extra columns pass through; one called score is replaced by the model's, but drop_toxic gives it back as it was. Without rows of both labels every score is the share
of label 1 (0 without any row). An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import held_out, materialize, sliced

WORD = re.compile(r"\w+")
OBFUSCATED = re.compile(r"[A-Za-z][0-9@$!*|]+[A-Za-z]|(?<!\w)[A-Za-z](?:[.\-_ ][A-Za-z]){3,}(?!\w)|(.)\1{3,}")
#: Second-person words of English, German, French and Spanish.
YOU = frozenset("you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tus tuyo usted ustedes vosotros".split())
BEGINNINGS = (4, 5)  # letters of a word's beginning that is a unit of its own
FOLDS = 4
FEATURES = 18


def units(word: str) -> list[str]:
    """The word and its beginnings, marked as such."""
    return [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)]


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    words = WORD.findall(text.lower())
    n, n_chars = max(1, len(words)), max(1, len(text))
    whole, begin, hits, you = [], [], [], []
    get = lexicon.get
    for i, w in enumerate(words):
        x = get(w)
        if x is not None:
            whole.append(x)
            hits.append(i)
        elif len(w) > 4:
            x = max((get(f"{w[:k]}~", 0.0) for k in BEGINNINGS if len(w) > k), default=0.0)
            if x:
                begin.append(x)
                hits.append(i)
        if w in YOU:
            you.append(i)
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        spots = np.array([-(10**9), *you, 10**9])
        near = int((np.minimum(spots[at + 1] - hits, np.array(hits) - spots[at]) <= 6).sum())
    capitals, letters = sum(map(str.isupper, text)), sum(map(str.isalpha, text))
    return [
        len(whole) / n, math.log1p(len(whole)), sum(whole) / n, max(whole, default=0.0),
        len(begin) / n, math.log1p(len(begin)), sum(begin) / n, max(begin, default=0.0),
        sum(whole) + sum(begin), near / max(1, len(hits)), math.log1p(near), len(you) / n,
        capitals / max(1, letters), text.count("!") / n_chars, text.count("?") / n_chars,
        (len(text) - letters - text.count(" ") - text.count("\n")) / n_chars, len(OBFUSCATED.findall(text)) / n, math.log1p(len(words)),
    ]


def with_features(docs: DataFrame, lexicons: list[dict[str, float]], by_fold: bool = False) -> DataFrame:
    """All columns but text, and features. by_fold: a row uses the lexicon at its fold, else the last one is used."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            folds = batch.column("fold").to_pylist() if by_fold else [-1] * batch.num_rows
            rows = [features(t, lexicons[f]) for t, f in zip(batch.column("text").to_pylist(), folds)]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], [*keep, "features"])

    schema = StructType([f for f in docs.schema if f.name != "text"]).add("features", ArrayType(DoubleType()))
    return docs.mapInArrow(compute, schema)


def count_units(rows: DataFrame) -> DataFrame:
    """unit, and in how many rows of each label and fold it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int]] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"unit": pa.array([k[0] for k in seen], pa.string()), "cell": pa.array([k[1] for k in seen], pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in sliced(batches):
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold"))):
                own = {u for w in set(WORD.findall((text or "").lower())) for u in units(w)}
                seen.update((u, label * FOLDS + fold) for u in own)
            if len(seen) > 500_000:
                yield out()
                seen.clear()
        yield out()

    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    return rows.select("text", "label", "fold").mapInArrow(count, "unit string, cell long, n long").groupBy("unit").agg(*cells)


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: object | None  # None: every score is `share`
    calibration: object | None
    share: float

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns but text (and any that is called score), and score."""
        kept = [F.col(f"kept.`{c}`") for c in docs.columns if c not in ("text", "score")]
        docs = docs.select(F.struct(*(c for c in docs.columns if c not in ("text", "score"))).alias("kept"), "text")
        if self.trees is None:
            return docs.select(*kept, F.lit(self.share).alias("score"))
        found = with_features(docs, [self.lexicon]).withColumn("__vector", array_to_vector("features"))
        found = self.trees.transform(found).withColumn("__raw", vector_to_array("__probability")[1])
        found = self.calibration.transform(found).withColumn("score", 0.99 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__score")) + 0.01 * F.col("__raw"))  # a calibrated step keeps the trees' order within it
        return found.select(*kept, "score")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, lexicon_size: int = 4000, iterations: int = 30, depth: int = 4) -> ToxicityModel:
    """Learn from the labelled rows (doc_id, toxic) of the documents; rows that must not be learned from are not in `labels`."""
    spark = docs.sparkSession
    own = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()  # the bound of the sample
    sample = spark.createDataFrame([(r[0], r[1]) for r in chosen], "doc_id long, label int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    rows = materialize(rows.repartition(max(2, len(chosen) // 2500), F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "text").select("text", "label", "fold"), "labelled")  # in the same order each time
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("label", "fold").count().collect()}
    n = [[sizes.get((label, f), 0) for f in range(FOLDS)] for label in (0, 1)]
    n_all = sum(map(sum, n))
    share = sum(n[1]) / n_all if n_all else 0.0
    if not sum(n[0]) or not sum(n[1]):
        return ToxicityModel({}, None, None, share)
    toxic, clean = (sum((F.col(f"c{label * FOLDS + f}") for f in range(1, FOLDS)), F.col(f"c{label * FOLDS}")) for label in (1, 0))
    ratio = F.log((toxic + 0.5) / (sum(n[1]) + 1)) - F.log((clean + 0.5) / (sum(n[0]) + 1))
    best = count_units(rows).where((toxic >= 3) & (ratio > math.log(3))).orderBy(F.desc(toxic * ratio), "unit").limit(lexicon_size).toPandas()

    def lexicon(without: int | None) -> dict[str, float]:
        folds = [f for f in range(FOLDS) if f != without]
        t, c = (sum(best[f"c{label * FOLDS + f}"] for f in folds).to_numpy(float) for label in (1, 0))
        n_t, n_c = (sum(n[label][f] for f in folds) for label in (1, 0))
        weight = np.log((t + 0.5) / (n_t + 1)) - np.log((c + 0.5) / (n_c + 1))
        return {u: round(float(w), 4) for u, w, k in zip(best["unit"], weight, t) if k >= 2 and w > math.log(3)}

    if len(best) == 0:
        lexicons = [{}] * (FOLDS + 1)
    else:
        lexicons = [*(lexicon(f) for f in range(FOLDS)), lexicon(None)]
    table = materialize(with_features(rows, lexicons, by_fold=True).withColumn("__vector", array_to_vector("features")).drop("features"), "features")
    last = FOLDS - 1
    enough = all(n[label][last] >= 1 and sum(n[label][:last]) >= 1 for label in (0, 1))
    fitted = table.where(F.col("fold") != last) if enough else table
    trees = GBTClassifier(featuresCol="__vector", labelCol="label", predictionCol="__predicted", maxIter=iterations, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, seed=7).setProbabilityCol("__probability").setRawPredictionCol("__margin").fit(fitted)
    held = trees.transform(table.where(F.col("fold") == last) if enough else table).withColumn("__raw", vector_to_array("__probability")[1])
    calibration = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__score").fit(held.select("__raw", F.col("label").cast("double").alias("label")))
    return ToxicityModel(lexicons[-1], trees, calibration, share)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the documents that aren't held out."""
    return labels.where(~held_out(F.col("doc_id"), 4, 2))


def op3_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return model.score(docs).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, as they are."""
    scored = fit(docs, training_labels(labels)).score(docs.select(F.struct(*docs.columns).alias("own"), "text"))
    return scored.where(F.col("score") < threshold).select(*(F.col(f"own.`{c}`") for c in docs.columns))
