"""Queries of operators whose rows depend on earlier rows: batches, streams and ordered passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import batches as B
from ..operators import inverted as I
from ..operators import scenes
from ..sources.tables import table as t
from ..streaming import jobs as X
from ..streaming import ordered as O
from .graph_queries import KNN_SQL, scratch, written
from .registry import query

GRAMS_SQL = "list_concat(list_transform(range(1, length(k) + 1), lambda i: substr(k, i, 1)), list_transform(range(1, length(k)), lambda i: substr(k, i, 2)), list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3)))"


@query("j05_resolve_batch", f"""
WITH RECURSIVE base AS (SELECT p_partkey AS id, p_size < 5 AS old, p_name || ' ' || substr(p_brand, 7) AS name, p_type AS type, CAST(p_retailprice AS VARCHAR) AS description FROM part),
ents AS MATERIALIZED (SELECT id, old, CASE WHEN old THEN name WHEN id % 5 = 0 THEN upper(replace(name, ' ', '-')) WHEN id % 5 = 1 THEN substr(name, 1, 2) || substr(name, 4) ELSE name END AS name, type, description FROM base),
keyed AS MATERIALIZED (SELECT id, old, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, regexp_replace(lower(name || ' ' || type || ' ' || description), '[^a-z0-9]', '', 'g') AS k FROM ents),
grams AS MATERIALIZED (SELECT id, gram, count(*) AS tf FROM (SELECT id, unnest({GRAMS_SQL}) AS gram FROM keyed) GROUP BY ALL),
vocabulary AS (SELECT gram, row_number() OVER (ORDER BY gram) AS g FROM (SELECT DISTINCT gram FROM grams)),
vectors AS MATERIALIZED (SELECT k.id, k.old, k.name, k.key, list(coalesce(x.tf, 0)::FLOAT ORDER BY v.g) AS e, sqrt(sum(coalesce(x.tf, 0) * coalesce(x.tf, 0))) AS norm FROM keyed k CROSS JOIN vocabulary v LEFT JOIN grams x ON x.id = k.id AND x.gram = v.gram GROUP BY ALL),
scored AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.old, list_inner_product(a.e, b.e)::DOUBLE / (a.norm * b.norm) AS score, lower(a.name) = lower(b.name) AS exact, a.key = b.key AS alias,
    a.key = b.key OR levenshtein(a.key, b.key) <= 2 OR least(length(a.key), length(b.key)) >= 3 AND (starts_with(a.key, b.key) OR starts_with(b.key, a.key)) AS aligned
  FROM vectors a JOIN vectors b ON NOT a.old AND (b.old OR b.id < a.id)),
ten AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS n FROM scored WHERE old AND score >= 0.6),
outcome AS (SELECT v.id, (SELECT min(b) FROM scored s WHERE s.a = v.id AND old AND exact) AS exact, (SELECT min(row(n, b, score)) FROM ten WHERE ten.a = v.id AND n <= 10 AND alias) AS alias,
    (SELECT row(b, score, aligned) FROM ten WHERE ten.a = v.id AND n = 1) AS best FROM vectors v WHERE NOT old),
against AS MATERIALIZED (SELECT id, CASE WHEN exact IS NOT NULL OR alias IS NOT NULL OR best[2] >= 0.92 OR best[2] >= 0.85 AND best[3] THEN 'MERGE' WHEN best[2] >= 0.85 THEN 'SIMILAR' ELSE 'NEW' END AS decision,
    coalesce(exact, alias[2], CASE WHEN best[2] >= 0.85 THEN best[1] END) AS base_id, CASE WHEN exact IS NOT NULL THEN 1.0 ELSE coalesce(alias[3], best[2]) END AS score FROM outcome),
waiting AS MATERIALIZED (SELECT w.id, row_number() OVER (ORDER BY w.id) AS n, list(s.b) FILTER (alias OR s.score >= 0.92 OR s.score >= 0.85 AND aligned) AS before FROM against w LEFT JOIN scored s ON s.a = w.id AND NOT s.old WHERE w.decision <> 'MERGE' GROUP BY w.id),
walk(n, nodes) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT w.n, CASE WHEN list_has_any(walk.nodes, coalesce(w.before, [])) THEN walk.nodes ELSE list_append(walk.nodes, w.id) END FROM walk JOIN waiting w ON w.n = walk.n + 1),
made AS MATERIALIZED (SELECT unnest(nodes) AS node FROM (SELECT nodes FROM walk ORDER BY n DESC LIMIT 1)),
pairs AS (SELECT s.*, row_number() OVER (PARTITION BY a, CASE WHEN alias THEN 0 WHEN s.score >= 0.92 OR s.score >= 0.85 AND aligned THEN 1 ELSE 2 END ORDER BY round(s.score, 9) DESC, b) AS n,
    CASE WHEN alias THEN 0 WHEN s.score >= 0.92 OR s.score >= 0.85 AND aligned THEN 1 ELSE 2 END AS kind FROM scored s JOIN made ON made.node = s.b WHERE NOT s.old AND (alias OR s.score >= 0.85)),
chosen AS (SELECT w.id, made.node IS NOT NULL AS makes, against.decision, against.base_id, against.score AS base_score, n0.b AS b0, n0.exact AS e0, n0.score AS s0, n1.b AS b1, n1.score AS s1, n2.b AS b2, n2.score AS s2
  FROM waiting w JOIN against ON against.id = w.id LEFT JOIN made ON made.node = w.id LEFT JOIN pairs n0 ON n0.a = w.id AND n0.kind = 0 AND n0.n = 1 LEFT JOIN pairs n1 ON n1.a = w.id AND n1.kind = 1 AND n1.n = 1 LEFT JOIN pairs n2 ON n2.a = w.id AND n2.kind = 2 AND n2.n = 1)
SELECT id AS query_id, decision, 'existing' AS target, base_id AS target_id, round(score, 4) AS score FROM against WHERE decision = 'MERGE'
UNION ALL SELECT id, CASE WHEN NOT makes THEN 'MERGE' WHEN decision = 'SIMILAR' OR b2 IS NOT NULL THEN 'SIMILAR' ELSE 'NEW' END, CASE WHEN NOT makes THEN 'batch' WHEN decision = 'SIMILAR' THEN 'existing' WHEN b2 IS NOT NULL THEN 'batch' END,
  CASE WHEN NOT makes THEN coalesce(b0, b1) WHEN decision = 'SIMILAR' THEN base_id ELSE b2 END, round(CASE WHEN NOT makes AND b0 IS NOT NULL THEN CASE WHEN e0 THEN 1.0 ELSE s0 END WHEN NOT makes THEN s1 WHEN decision = 'SIMILAR' THEN base_score ELSE s2 END, 4) FROM chosen""")
def j05_batch(spark, d):
    """Parts of small size exist; the others come in the order of their ids, a fifth under an alias, a fifth misspelt."""
    name = F.concat_ws(" ", "p_name", F.substring("p_brand", 7, 99))
    alias = F.upper(F.replace("name", F.lit(" "), F.lit("-")))
    typo = F.concat(F.substring("name", 1, 2), F.substring("name", 4, 999))
    base = t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") < 5).alias("old"), name.alias("name"), F.col("p_type").alias("type"), F.col("p_retailprice").cast("string").alias("description"))
    new = base.where("NOT old").withColumn("name", F.when(F.col("id") % 5 == 0, alias).when(F.col("id") % 5 == 1, typo).otherwise(F.col("name")))
    return B.resolve_batch(new.drop("old"), base.where("old").drop("old"), written(spark))


LATE = "8 days"  # a slice of the log is shorter


def log(spark, d) -> DataFrame:
    return X.in_slices(t(spark, d, "events"), scratch(spark, "log"))


def run_timed(spark, stream: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    with O.state_with_timers(spark):
        return X.run_to_table(stream, path, f"{path}-checkpoint")


MARK_SQL = "m AS (SELECT epoch_us(max(ts)) // 1000 - 8 * 86400000 AS mark FROM events), e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events, m WHERE epoch_us(ts) // 1000 <= mark)"


@query("x02_retry_stream", f"""
WITH {MARK_SQL},
r AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS id, ms, event_id, event_type <> 'purchase' AS failed, mark FROM e),
c AS (SELECT *, sum(CAST(failed AS INT)) OVER w AS failures, sum(CAST(NOT failed AS INT)) OVER w AS successes, lead(ms) OVER (PARTITION BY id ORDER BY ms, event_id) AS next FROM r WINDOW w AS (PARTITION BY id ORDER BY ms, event_id)),
o AS (SELECT *, coalesce(lag(failures >= 3 OR successes > 0) OVER (PARTITION BY id ORDER BY ms, event_id), false) AS ended FROM c),
s AS (SELECT *, CASE WHEN NOT failed THEN 'done' WHEN failures >= 3 THEN 'dead' ELSE 'pending' END AS status, ms + 1000 * least(300, 5 * 2 ** (failures - 1))::BIGINT AS retry FROM o WHERE NOT ended)
SELECT id, ms, CAST(failures AS INT) AS attempts, status, CASE WHEN status = 'pending' THEN retry END AS retry_ms FROM s
UNION ALL SELECT id, retry, CAST(failures AS INT), 'claimable', NULL FROM s WHERE status = 'pending' AND retry <= coalesce(next, mark)""")
def x02_stream(spark, d):
    """A user's events of a day are the attempts at one outbox event; a purchase is a success."""
    e = log(spark, d)
    tries = e.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("id"), "ts", F.col("event_id").alias("n"), (F.col("event_type") != "purchase").alias("flag"))
    return run_timed(spark, O.retry_stream(tries, "id", LATE), "retries")


@query("x04_rate_limit_stream", f"""
WITH RECURSIVE {MARK_SQL}, r AS (SELECT user_id, event_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM e),
walk(user_id, event_id, n, recent, accepted) AS (
  SELECT user_id, event_id, n, [ms], true FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN len(list_filter(w.recent, lambda x: x > r.ms - 86400000)) < 3 THEN list_append(list_filter(w.recent, lambda x: x > r.ms - 86400000), r.ms) ELSE list_filter(w.recent, lambda x: x > r.ms - 86400000) END,
    len(list_filter(w.recent, lambda x: x > r.ms - 86400000)) < 3 FROM walk w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT user_id, event_id, accepted FROM walk""")
def x04_stream(spark, d):
    e = log(spark, d).select("user_id", "ts", F.col("event_id").alias("n"), F.lit(True).alias("flag"))
    return run_timed(spark, O.limit_stream(e, "user_id", 3, 86400.0, LATE), "limits").withColumnRenamed("n", "event_id")


@query("x05_stale_stream", f"""
WITH {MARK_SQL}, g AS (SELECT user_id, ms, mark, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS next FROM e)
SELECT user_id, ms + 21600000 AS reset_ms, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ms) AS INT) AS attempt, 'pending' AS status FROM g WHERE coalesce(next, mark) > ms + 21600000""")
def x05_stream(spark, d):
    """A user's events as the heartbeats of a job that is stale after six hours."""
    e = log(spark, d).select("user_id", "ts", F.col("event_id").alias("n"), F.lit(True).alias("flag"))
    return run_timed(spark, O.stale_stream(e, "user_id", 21_600, LATE), "stale")


ARRIVAL = "least(day(ts) // 8 + CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 11 = 0 THEN 2 ELSE 0 END, 5)"
HOURS, DAY = 6 * 3_600_000_000, 24 * 3_600_000_000


def sessions_sql() -> str:
    """Slice by slice: what is not late joins the rows of open sessions; sessions that end before the new watermark are put out."""
    steps = [f"e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS us, {ARRIVAL} AS slice FROM events)", "open0 AS (SELECT user_id, us FROM e WHERE false)"]
    mark = lambda k: f"(SELECT coalesce(max(us) // 1000 * 1000 - {DAY}, 0) FROM e WHERE slice < {k})"
    for k in range(6):
        steps += [
            f"in{k} AS (SELECT user_id, us FROM open{k} UNION ALL SELECT user_id, us FROM e WHERE slice = {k} AND us + {HOURS} > {mark(k)})",
            f"run{k} AS (SELECT user_id, us, sum(begins) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {HOURS} THEN 0 ELSE 1 END AS begins FROM in{k}))",
            f"s{k} AS MATERIALIZED (SELECT user_id, us, min(us) OVER w AS first, max(us) OVER w AS last, max(us) OVER w + {HOURS} <= {mark(k + 1)} OR {k} = 5 AS closed FROM run{k} WINDOW w AS (PARTITION BY user_id, s))",
            f"open{k + 1} AS (SELECT user_id, us FROM s{k} WHERE NOT closed)",
        ]
    put = " UNION ALL ".join(f"SELECT user_id, first, last, count(*) AS n FROM s{k} WHERE closed GROUP BY ALL" for k in range(6))
    return f"WITH {', '.join(steps)}, put AS MATERIALIZED ({put}) SELECT 'session' AS kind, user_id, make_timestamp(first) AS start, make_timestamp(last) AS last, n FROM put UNION ALL SELECT 'late', e.user_id, NULL, NULL, count(*) - coalesce(any_value(p.held), 0) FROM e LEFT JOIN (SELECT user_id, sum(n)::BIGINT AS held FROM put GROUP BY 1) p ON p.user_id = e.user_id GROUP BY e.user_id"


@query("x08_sessions", sessions_sql())
def x08_sessions(spark, d):
    """Sessions of users, six hours apart at most, from a log that arrives in six slices, each read by a run of its own; a seventh of the events
    comes a slice late, some two. Each user's late events are counted."""
    folder, out = scratch(spark, "arrivals"), scratch(spark, "sessions")
    log = t(spark, d, "events").select("user_id", "ts", F.expr(ARRIVAL.replace("//", "div")).alias("slice"))
    for part in (*(log.where(F.col("slice") == k) for k in range(6)), X.closed_by(log, "3 days")):
        part.drop("slice").write.mode("append").parquet(folder)
        arrived = spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
        found = X.run_to_table(X.session_windows(arrived), out, f"{out}-checkpoint")
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    late = X.late_rows(log, found).select(F.lit("late").alias("kind"), "user_id", F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(None).cast("timestamp_ntz").alias("last"), F.col("n_late").alias("n"))
    return found.select(F.lit("session").alias("kind"), "user_id", plain("start"), plain("last"), "n").union(late)


@query("x05_reset_stale", """
WITH j AS (SELECT o_orderkey AS job_id, o_orderstatus = 'P' AS processing, o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1995-01-01 00:10:00' - INTERVAL 600 SECOND AS old, o_orderkey % 3 AS attempt, o_orderstatus FROM orders)
SELECT job_id, CASE WHEN old THEN 'pending' WHEN processing THEN 'processing' ELSE lower(o_orderstatus) END AS job_status, attempt + CAST(old AS INT) AS attempt, l_linenumber AS step, CASE WHEN l_linestatus = 'F' THEN 'done' WHEN coalesce(old, false) THEN 'pending' ELSE 'running' END AS step_status
FROM j JOIN lineitem ON l_orderkey = job_id""")
def x05_reset(spark, d):
    """Orders as jobs, their lines as steps: what is on the way is in processing, its date the heartbeat."""
    status = F.when(F.col("o_orderstatus") == "P", "processing").otherwise(F.lower("o_orderstatus"))
    jobs = t(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("heartbeat"), (F.col("o_orderkey") % 3).alias("attempt"))
    steps = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("step"), F.when(F.col("l_linestatus") == "F", "done").otherwise("running").alias("status"))
    jobs, steps = O.reset_stale(jobs, steps, F.expr("timestamp_ntz'1995-01-01 00:10:00'"))
    return jobs.select("job_id", F.col("status").alias("job_status"), "attempt").join(steps.withColumnRenamed("status", "step_status"), "job_id")


@query("j03_knn_index", f"WITH {KNN_SQL} SELECT query_id, base_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM knn WHERE rank <= 10")
def j03_index(spark, d):
    """The queries of j03_knn_join through the inverted file: a vector's own row is the eleventh."""
    v = t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    found = I.knn_index_join(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "base_id"), 11, 0.2, written(spark), 64, "label")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "base_id"))
    return found.where("query_id <> base_id").withColumn("rank", rank).where("rank <= 10").select("query_id", "base_id", F.round("score", 4).alias("score"), "rank")


@query("w11_greedy_unique", """
WITH RECURSIVE given AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL UNION ALL
  SELECT vec_id + 1000000000, label, list_transform(embedding, lambda x, i: CAST(CAST(x AS DOUBLE) * (1 + 0.02 * (i % 5)) AS FLOAT)) FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 3 = 0),
v AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - list_avg(list_transform(embedding, lambda y: CAST(y AS DOUBLE)))) AS e FROM given),
near AS MATERIALIZED (SELECT b.id, list(a.id ORDER BY a.id) AS before FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) > 0.95 GROUP BY b.id),
w AS MATERIALIZED (SELECT v.id, v.label, v.n, coalesce(near.before, CAST([] AS BIGINT[])) AS before FROM v LEFT JOIN near ON near.id = v.id),
walk(label, n, id, leader, kept) AS (
  SELECT label, n, id, id, [id] FROM w WHERE n = 1
  UNION ALL SELECT w.label, w.n, w.id, coalesce(list_min(list_intersect(w.before, k.kept)), w.id), CASE WHEN list_has_any(w.before, k.kept) THEN k.kept ELSE list_append(k.kept, w.id) END FROM walk k JOIN w ON w.label = k.label AND w.n = k.n + 1)
SELECT id, leader FROM walk""")
def w11(spark, d):
    """Every vector, and a near copy of every third, with the vector that stands for it: the first of its label that correlates with it by
    over 0.95 and stands for itself."""
    v = t(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    near = F.transform("v", lambda x, i: (x.cast("double") * (1 + 0.02 * ((i + 1) % 5))).cast("float"))
    copies = v.where("id % 3 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "label", near.alias("v"))
    return I.greedy_unique(v.union(copies), 0.95, written(spark), 64)


def spaced_sql(rows: str, key: str, order: str, step: str, gap: str) -> str:
    """Change points one by one, of rows (key, moment, order, ...) with `before`, the value of the row before."""
    return f"""
WITH RECURSIVE {rows},
c AS (SELECT {key}, moment, min({order}) AS {order}, row_number() OVER (PARTITION BY {key} ORDER BY moment) AS n FROM f WHERE r = 1 OR {step} GROUP BY {key}, moment),
walk({key}, n, moment, {order}, last, kept) AS (
  SELECT {key}, n, moment, {order}, moment, true FROM c WHERE n = 1
  UNION ALL SELECT c.{key}, c.n, c.moment, c.{order}, CASE WHEN w.last + {gap} <= c.moment THEN c.moment ELSE w.last END, w.last + {gap} <= c.moment FROM walk w JOIN c ON c.{key} = w.{key} AND c.n = w.n + 1)
SELECT {key}, moment AS "at", {order} FROM walk WHERE kept"""


@query("w09_change_points", spaced_sql(
    "f AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS moment, event_id, value, lag(value) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id))",
    "user_id", "event_id", "abs(value - before) > 20", "3600"))
def w09(spark, d):
    """A user's events that differ from the one before by over 20, an hour apart."""
    e = t(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), "event_id", "value")
    return scenes.change_points(e, "user_id", "at", "event_id", "value", 20.0, 3600.0, written(spark))


@query("w09_scene_changes", spaced_sql(
    """g AS (SELECT label, vec_id // 2 AS moment, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - list_avg(list_transform(embedding, lambda y: CAST(y AS DOUBLE)))) AS e FROM embeddings WHERE label IS NOT NULL),
f AS (SELECT label, CAST(moment AS DOUBLE) AS moment, vec_id, e, lag(e) OVER w AS before, row_number() OVER w AS r FROM g WINDOW w AS (PARTITION BY label ORDER BY moment, vec_id))""",
    "label", "vec_id", "len(e) = len(before) AND 1 - list_cosine_similarity(e, before) > 0.95", "12"))
def w09_scenes(spark, d):
    """Vectors of a label as a film's frames, two a second: scenes whose features correlate by under 0.05 with the frame before, 12 seconds apart."""
    frames = t(spark, d, "embeddings").select("label", F.expr("vec_id div 2").alias("at"), "vec_id", "embedding")
    return scenes.change_points(frames, "label", "at", "vec_id", "embedding", 0.95, 12.0, written(spark), scenes.correlation_gap)
