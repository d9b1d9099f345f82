"""Batches, streams and their folds: order within a batch, state over many micro-batches, rows out of order."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.operators import batches
from graphloom.operators import scores as scored
from graphloom.plans.graph_queries import written
from graphloom.streaming import jobs, ordered

KINDS = "id string, name string, type string, description string"


def golden(tmp_path, **changes):
    entities = [{"id": "ent-a", "name": "VS Code", "type": "tool", "description": "source code editor"}, {"id": "ent-b", "name": "AWS", "type": "platform", "description": "web services cloud computing"}]
    pairs = [
        {"id": "p1", "category": "alias", "query": {"name": "VSCode", "type": "tool", "description": "code editor"}, "expected": {"decision": "MERGE", "canonical_id": "ent-a"}},
        {"id": "p2", "category": "unrelated", "query": {"name": "React", "type": "framework", "description": "UI library"}, "expected": {"decision": "NEW", "canonical_id": None} | changes},
    ]
    path = tmp_path / "golden.json"
    path.write_text(json.dumps({"existing_entities": entities, "pairs": pairs}, indent=1))
    return f"file://{path}"


def test_golden_set_is_read_checked_and_scored(spark, tmp_path):
    existing, pairs = batches.load_golden(spark, golden(tmp_path))
    from graphloom.operators.resolve import resolve

    decisions = batches.golden_decisions(pairs, resolve(pairs.select("id", "name", "type", "description"), existing))
    scores = {r["category"]: r["f1"] for r in scored.resolution_score(decisions).collect()}
    assert scores[None] == 1.0 and scores["alias"] == 1.0
    for wrong in ({"decision": "MAYBE"}, {"decision": None}, {"canonical_id": "ent-a"}, {"decision": "MERGE", "canonical_id": "ent-z"}, {"decision": "SIMILAR"}):
        with pytest.raises(ValueError, match="p2"):
            batches.load_golden(spark, golden(tmp_path, **wrong))


def test_later_entities_see_earlier_ones(spark):
    old = spark.createDataFrame([("x1", "Docker", "platform", "containers")], KINDS)
    new = spark.createDataFrame([
        ("n1", "Postgres SQL", "database", "relational database system"), ("n2", "postgres-sql", "tool", "a thing of another kind altogether"), ("n3", "docker", "tool", "whale"),
        ("n4", "PostgresSQL", "database", "relational database system"), ("n5", "Postgres SQL", "database", "relational database system"), ("n6", "Zebra", "animal", "striped"),
        ("n7", "日本", "place", "country"), ("n8", "日本", "place", "land"), ("n9", "Postgres SQ", "database", "relational database system"),
    ], KINDS)
    got = {r["query_id"]: (r["decision"], r["target"], r["target_id"]) for r in batches.resolve_batch(new, old, written(spark)).collect()}
    merged = {"n2": "n1", "n4": "n1", "n5": "n1", "n8": "n7", "n9": "n1"}
    assert got == {"n1": ("NEW", None, None), "n3": ("MERGE", "existing", "x1"), "n6": ("NEW", None, None), "n7": ("NEW", None, None)} | {k: ("MERGE", "batch", v) for k, v in merged.items()}
    assert batches.resolve_batch(new.limit(0), old, written(spark)).collect() == []


def test_lead_or_follow_equals_one_by_one(spark):
    rng = random.Random(2)
    nodes = [(i, rng.randrange(25)) for i in range(60)]
    edges = [(i, rng.randrange(i)) for i in range(1, 60) for _ in range(rng.randrange(3))]
    leads: dict[int, bool] = {}
    for i, key in nodes:
        leads[i] = not any(leads[j] for j, k in nodes[:i] if k == key or (i, j) in edges)
    got = batches.lead_or_follow(spark.createDataFrame(nodes, "a long, key long"), spark.createDataFrame(edges, "later long, earlier long"), written(spark)).collect()
    assert {r["a"]: r["leads"] for r in got} == leads


def outbox_rows(n):
    rng = random.Random(9)
    kinds = [*jobs.KINDS, "nonsense"]
    return [(i, i // 3, rng.choice(kinds), str(rng.randrange(12)), str(rng.randrange(12)), rng.choice([None, str(rng.randrange(12))])) for i in range(n)]


def test_ten_micro_batches_equal_one(spark, tmp_path):
    log = spark.createDataFrame(outbox_rows(300), "event_id long, ts long, kind string, id string, a string, b string")
    want = {tuple(r) for r in jobs.projection(jobs.latest_effects(jobs.effects(log))).collect()}
    state = f"file://{tmp_path}/state"
    for number in range(10):
        jobs.fold_batch(log.where(F.col("event_id") % 10 == number), number, state, 4)
        if number in (3, 9):  # run again, as after a lost driver
            jobs.fold_batch(log.where(F.col("event_id") % 10 == number), number, state, 4)
    assert {tuple(r) for r in jobs.projection(jobs.outbox_state(spark, state)).collect()} == want
    jobs.fold_batch(log.limit(0), 10, state, 4)
    jobs.fold_batch(log.where("event_id = 5"), 11, state, 4)  # one bucket or two
    assert {tuple(r) for r in jobs.projection(jobs.outbox_state(spark, state)).collect()} == want
    assert len(set(jobs.pointer(spark, state).values())) > 1  # the others stay where they were
    left = {int(p) for p in os.listdir(tmp_path / "state/versions") if any(f.startswith("bucket") for f in os.listdir(tmp_path / "state/versions" / p))}
    assert left <= {8, 9, 11}  # older versions of a bucket are removed
    assert jobs.outbox_state(spark, f"file://{tmp_path}/none") is None


def test_attempts_with_backoff():
    fold = ordered.attempts(5, 300, 3)
    state, out, again = fold(None, [(1000, 1, True)], 2000)
    assert out == [(1000, 1, "pending", 6000)] and again == 6000
    state, out, again = fold(state, [], 6000)
    assert out == [(6000, 1, "claimable", None)] and again is None
    state, out, again = fold(state, [(7000, 2, True), (30_000, 3, False), (31_000, 4, True)], 40_000)
    assert out == [(7000, 2, "pending", 17_000), (17_000, 2, "claimable", None), (30_000, 2, "done", None)] and again is None
    assert fold(None, [(0, 1, True), (1, 2, True), (2, 3, True), (3, 4, False)], 9)[1][-1] == (2, 3, "dead", None)
    assert ordered.attempts(5, 300, 20)(None, [(i, i, True) for i in range(10)], 10)[1][-1][3] == 9 + 300_000


def test_limits_and_heartbeats():
    out = ordered.accepted(2, 1.0)(None, [(0, 1, True), (10, 2, True), (20, 3, True), (1000, 4, True), (1005, 5, True), (1011, 6, True)], 2000)[1]
    assert out == [(1, True), (2, True), (3, False), (4, True), (5, False), (6, True)]
    beat = ordered.heartbeats(1)
    state, out, again = beat(None, [(0, 1, True), (900, 2, True), (3000, 3, True)], 3500)
    assert out == [(1900, 1, "pending")] and state == (3000, 1) and again == 4001
    assert beat(state, [], 5000) == ((None, 2), [(4000, 2, "pending")], None)


def test_stream_rows_out_of_order(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(i, begin + timedelta(seconds=20 * i), i % 2, i % 3 != 0) for i in range(40)]
    schema = "n long, ts timestamp, user long, flag boolean"
    for part, own in enumerate(([*rows[10:20]], [*rows[:10]], [*rows[20:]])):  # the first ten come late, within the bound
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"file://{tmp_path}/log/{part}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log/*")
    with ordered.state_with_timers(spark):
        got = jobs.run_to_table(ordered.limit_stream(stream(), "user", 2, 120, "10 minutes"), f"file://{tmp_path}/out", f"file://{tmp_path}/check").collect()
    mark = rows[-1][1] - timedelta(minutes=10)
    want = set()
    for user in (0, 1):
        own = [(int(1000 * (at - begin).total_seconds()), n, f) for n, at, u, f in rows if u == user and at <= mark]
        want |= {(user, *x) for x in ordered.accepted(2, 120)(None, own, 1 << 60)[1]}
    assert {tuple(r) for r in got} == want and {r["accepted"] for r in got} == {True, False}


def test_slices_are_micro_batches_however_many_files_the_log_has(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, begin + timedelta(minutes=i)) for i in range(2000)], "n long, ts timestamp").repartition(23)
    sizes = []
    stream = jobs.in_slices(log, f"file://{tmp_path}/log")
    stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count())).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) == 4 and sum(sizes) == 2000


def test_state_is_stored_once_a_bucket(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(i, begin + timedelta(seconds=i), None if i % 300 == 7 else i % 300, True) for i in range(900)] + [(900, begin + timedelta(days=1), 0, True)]
    spark.createDataFrame(rows, "n long, ts timestamp, user long, flag boolean").coalesce(1).write.parquet(f"file://{tmp_path}/log")
    log = spark.readStream.schema("n long, ts timestamp, user long, flag boolean").parquet(f"file://{tmp_path}/log")
    with ordered.state_with_timers(spark):
        stream = ordered.in_order(log, "user", ordered.accepted(2, 3600), "recent array<long>", "user long, n long, accepted boolean", "1 minute", 4)
        query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    assert 0 < sum(o["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for o in p["stateOperators"]) < 20
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {(u, n, n < 600) for n, _, u, _ in rows[:900]}


def test_reset_of_stale_jobs(spark):
    now = datetime(2024, 1, 1)
    table = spark.createDataFrame([(1, "processing", now - timedelta(seconds=601), 0), (2, "processing", now - timedelta(seconds=600), 4), (3, "done", now - timedelta(days=1), 1), (4, "processing", None, 0)], "job_id long, status string, heartbeat timestamp, attempt int")
    steps = spark.createDataFrame([(1, "a", "running"), (1, "b", "done"), (2, "a", "running"), (9, "a", "running")], "job_id long, step string, status string")
    after, reset = ordered.reset_stale(table, steps, F.lit(now))
    assert {tuple(r) for r in after.select("job_id", "status", "attempt").collect()} == {(1, "pending", 1), (2, "processing", 4), (3, "done", 1), (4, "processing", 0)}
    assert {tuple(r) for r in reset.select("job_id", "step", "status").collect()} == {(1, "a", "pending"), (1, "b", "done"), (2, "a", "running"), (9, "a", "running")}
