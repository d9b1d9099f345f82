"""Change points against a pass over each key's rows, one by one."""

import math
import random

import pytest

from graphloom.operators import scenes
from graphloom.plans.graph_queries import written


def one_by_one(rows, threshold, gap, step):
    kept, last, before = set(), {}, {}
    for key, at, order, value in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        if key not in before:
            change = True
        else:
            moved = step(before[key], value)
            change = moved is not None and not math.isnan(moved) and moved > threshold
        before[key] = value
        if change and (key not in last or last[key] + gap <= at):
            last[key] = at
            kept.add((key, at, order))
    return kept


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("width", [None, 7.0, 0.5])
def test_spaced_changes_equal_a_pass(spark, width):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"k{i % 7}", float(rng.randrange(-60, 200)) / 2, i, rng.choice([None, 0.0, 1.0, 5.0, 9.0, float("nan")])) for i in range(400)]
    rows += [(None, 1.0, 900, 5.0), ("k1", None, 901, 5.0), ("alone", 3.0, 902, None), ("far", -1e6, 903, 0.0), ("far", 1e6, 904, 9.0)]
    given = spark.createDataFrame(rows, "`a key` string, at double, n long, `x.y` double")
    got = scenes.change_points(given, "a key", "at", "n", "x.y", 3.0, 2.5, written(spark), width=width)
    want = one_by_one(rows, 3.0, 2.5, lambda a, b: None if a is None or b is None else abs(b - a))
    assert collected(got) == sorted(want) and 20 < len(want) < 300
    assert collected(scenes.change_points(given.limit(0), "a key", "at", "n", "x.y", 3.0, 2.5, written(spark))) == []


def test_a_long_chain_takes_few_rounds(spark):
    """A chain of 1000 points is followed in some ten rounds, not a thousand."""
    writes = []

    def counted(df):
        writes.append(1)
        return written(spark)(df)

    rows = spark.range(1000).selectExpr("1 AS k", "cast(id AS double) AS at", "id AS n", "cast(id * 10 AS double) AS v")
    got = scenes.change_points(rows, "k", "at", "n", "v", 1.0, 1.0, counted)
    assert got.count() == 1000 and len(writes) <= 3 * 11 + 3


def test_correlation_of_odd_vectors(spark):
    pairs = [([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), ([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ([1.0, 1.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], []), ([1.0, None], [1.0, 2.0])]
    table = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    got = [r[0] for r in table.select(scenes.correlation_gap(table["a"], table["b"])).collect()]
    assert got[:2] == pytest.approx([0.0, 2.0]) and got[2:] == [0.0, None, None, None, None]
