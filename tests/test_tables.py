"""Bucketed tables and graphs as files: what is touched, what is read, what comes back."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.plans.graph_queries import written
from graphloom.sources import buckets, graph_files


def files(path):
    return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_spans_are_replaced_pruned_and_dropped(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(400).selectExpr("id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id AS int)) AS at").union(spark.createDataFrame([(900, None)], "id long, at timestamp_ntz"))
    buckets.write_by_time(rows, path, "at")
    before = files(path)
    buckets.write_by_time(spark.createDataFrame([(7, "2024-03-15")], "id long, at string").withColumn("at", F.col("at").cast("timestamp_ntz")), path, "at")
    after = files(path)
    changed = {os.path.basename(os.path.dirname(f)) for f in before.keys() ^ after.keys()}
    one = (19797 // 30)  # 2024-03-15 is day 19797
    assert changed == {f"bucket={one}"} and all(after[f] == before[f] for f in before.keys() & after.keys())
    part = buckets.read_between(spark, path, "at", "2024-03-01", "2024-04-01")
    days = {19783 // 30, 19814 // 30}
    assert {r[0] for r in part.select(F.input_file_name()).distinct().collect() if not any(f"bucket={b}/" in r[0] for b in range(min(days), max(days) + 1))} == set()
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    left = {r["id"] for r in part.collect()}
    assert 7 in left and all(one != (19723 + i) // 30 for i in left - {7}) and left - {7}
    gone = buckets.drop_old(spark, path, "2025-01-01", 6)
    cutoff = 20089 - 180  # 2025-01-01 is day 20089
    assert gone == [b for b in range(19723 // 30, (19723 + 399) // 30 + 1) if (b + 1) * 30 <= cutoff]
    kept = {r["id"] for r in spark.read.parquet(path).collect()}
    assert kept == {i for i in range(400) if (19723 + i) // 30 not in gone} | {900}
    assert buckets.drop_old(spark, path, "2025-01-01", 6) == []


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    path, kinds = f"{tmp_path}/u", "`the id` long, v string, o long"
    give = lambda rows: buckets.upsert(path, spark.createDataFrame(rows, kinds), ["the id"], "o", "v", written(spark), 8)
    seen = lambda: {r[0]: (r[1], r[2]) for r in spark.read.parquet(path).select("`the id`", "v", "o").collect()}
    give([(1, None, 9)])
    assert not os.path.exists(path)
    give([(i, f"a{i}", 1) for i in range(100)] + [(None, "x", 1), (100, None, 1)])
    before = files(path)
    give([(5, "new", 2), (5, "older", 0), (5, None, 7), (6, "old", 0)])
    after = files(path)
    assert seen() == {i: ("new", 2) if i == 5 else (f"a{i}", 1) for i in range(100)}
    assert 1 <= len({os.path.dirname(f) for f in before.keys() ^ after.keys()}) <= 2
    give([(5, "new", 2), (200, "late", None)])
    give([(200, "late", None)])
    assert seen() == {i: ("new", 2) if i == 5 else (f"a{i}", 1) for i in range(100)} | {200: ("late", None)}


@pytest.mark.parametrize("form", ["graphml", "node_link"])
def test_graphs_come_back(spark, tmp_path, form):
    nodes = [("a", "Tool", " <b> & \"c\" 'd' ü日本 "), ("x y", None, None), ("n", "T\n2", "]]>")]
    edges = [("a", "x y", "USES", 0.1), ("a", "a", "LIKES", None), ("n", "zz", None, 1e-300)]
    n, e = spark.createDataFrame(nodes, "id string, type string, name string"), spark.createDataFrame(edges, "src string, dst string, rel_type string, weight double")
    for i, (given_n, given_e) in enumerate([(n, e), (n.limit(0), e.limit(0))]):
        path = f"{tmp_path}/{form}-{i}"
        getattr(graph_files, f"write_{form}")(given_n, given_e, path)
        got_n, got_e = getattr(graph_files, f"read_{form}")(spark, path)
        assert sorted(map(tuple, got_n.collect())) == sorted(map(tuple, given_n.collect())) and sorted(map(tuple, got_e.collect()), key=str) == sorted(map(tuple, given_e.collect()), key=str)


def test_graphml_files_are_graphs(spark, tmp_path):
    import xml.etree.ElementTree as tree

    n = spark.createDataFrame([("a", "Tool", "x < y")], "id string, type string, name string").coalesce(1)
    graph_files.write_graphml(n, spark.createDataFrame([("a", "a", "R", 2.0)], "src string, dst string, rel_type string, weight double").coalesce(1), f"{tmp_path}/g", directed=True)
    for kind, ids, data in (("node", {"id": "a"}, {"type": "Tool", "name": "x < y"}), ("edge", {"source": "a", "target": "a"}, {"rel_type": "R", "weight": "2.0"})):
        folder = f"{tmp_path}/g/{kind}s"
        roots = [tree.parse(f"{folder}/{f}").getroot() for f in os.listdir(folder) if f.startswith("part-")]
        elements = [x for r in roots for x in r]
        assert all(r.tag == "graph" and r.attrib == {"edgedefault": "directed"} for r in roots) and len(elements) == 1
        assert elements[0].tag == kind and elements[0].attrib == ids and {x.attrib["key"]: x.text for x in elements[0]} == data and {x.tag for x in elements[0]} == {"data"}
