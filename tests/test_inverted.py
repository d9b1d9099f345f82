"""The inverted file and the pivots against brute force, with copies, ties, odd vectors, small blocks and many queries."""

import numpy as np
import pytest

from graphloom.operators import inverted
from graphloom.plans.graph_queries import written

DIM = 6


def vectors():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((9, DIM)) * 3
    v = [(centres[i % 9] + 0.3 * rng.standard_normal(DIM)).tolist() for i in range(270)]
    v[40:60] = [v[40]] * 20  # copies
    rows = [(i, x, i % 2) for i, x in enumerate(v)]
    return [*rows, (300, None, 0), (301, [0.0] * DIM, 0), (302, [float("nan")] * DIM, 1), (303, [1.0], 1), (304, [float("inf")] * DIM, 0), (305, v[3], None), (306, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0)]


def sound(v):
    return v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("on,least,k", [("label", 0.2, 5), (None, 0.9, 3), (None, -1.0, 7)])
def test_index_join_is_exact(spark, on, least, k):
    rows = vectors()
    base = spark.createDataFrame(rows, "base_id long, v array<double>, label int")
    asked = base.where("base_id % 3 = 0").withColumnRenamed("base_id", "query_id")
    looked: list[int] = []
    got = {(r["query_id"], r["rank"]): (r["base_id"], round(r["score"], 9)) for r in inverted.knn_index_join(asked, base, k, least, written(spark), DIM, on, lists=9, probes=1, block=20, most=7, looked=looked).collect()}
    want = {}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if sound(v)}
    label = {i: c for i, _, c in rows}
    for q in unit:
        if q % 3 == 0 and (not on or label[q] is not None):
            scores = sorted((-round(float(unit[q] @ unit[b]), 12), b) for b in unit if not on or label[b] == label[q])
            want |= {(q, n): (b, round(-s, 9)) for n, (s, b) in enumerate([x for x in scores if -x[0] >= least][:k], 1)}
    assert got == want
    if least > 0:
        assert looked[0] + looked[1] < 0.6 * looked[2]  # most lists are out of reach


def test_index_of_no_vectors(spark):
    empty = spark.createDataFrame([], "base_id long, v array<double>")
    assert inverted.knn_index_join(empty.withColumnRenamed("base_id", "query_id"), empty, 3, 0.1, written(spark), DIM).collect() == []


def test_unique_vectors_equal_one_by_one(spark):
    rows = vectors()
    looked: list[int] = []
    table = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = {r["id"]: r["leader"] for r in inverted.greedy_unique(table, 0.95, written(spark), DIM, pivots=9, block=15, most=11, looked=looked).collect()}
    kept: list[int] = []
    want = {}
    centred = {i: np.array(v) - np.mean(v) for i, v, _ in rows if sound(v)}
    centred = {i: v / np.linalg.norm(v) for i, v in centred.items() if np.linalg.norm(v) > 1e-9}
    for i, _, label in rows:
        near = [j for j in kept if i in centred and j in centred and label is not None and label == rows_label(rows, j) and centred[i] @ centred[j] > 0.95]
        want[i] = min(near, default=i)
        if not near:
            kept.append(i)
    assert got == want and looked[0] < 0.5 * looked[1]


def rows_label(rows, i):
    return next(c for j, _, c in rows if j == i)
