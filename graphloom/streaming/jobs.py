"""Structured Streaming jobs over the event log (X01, X04, X07, X08). Each has a batch twin that the oracle checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The event log as a stream, with an event time that takes a watermark."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """X08. Counts and sums of each type and window; windows close after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_windows(events: DataFrame, key: str = "user_id", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """X08. Sessions of a key: rows less than `gap` apart, put out once the watermark has passed a session's end. A row that comes when the
    watermark of the batch before has passed its time and the gap is late and in no session; one that comes in time, but after its
    neighbours' session was put out, begins another."""
    made = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return made.select(F.col("session_window.start").alias("start"), "last", key, "n")


def late_rows(rows: DataFrame, sessions: DataFrame, key: str = "user_id") -> DataFrame:
    """X08. key, n_rows, n_late: how many rows of a log that was read to its end are in none of the sessions put out."""
    given, held = rows.groupBy(key).agg(F.count("*").alias("n_rows")), sessions.groupBy(key).agg(F.sum("n").alias("held"))
    return given.join(held, key, "left").select(key, "n_rows", (F.col("n_rows") - F.coalesce("held", F.lit(0))).alias("n_late"))


def closed_by(log: DataFrame, wait: str, key: str = "user_id", at: str = "ts") -> DataFrame:
    """X08. The log's last row, again, without a key and `wait` later: it lets the watermark pass all sessions before it."""
    end = log.agg(F.max(at).alias(at)).where(f"{at} IS NOT NULL").select((F.col(at) + F.expr(f"INTERVAL {wait}")).alias(at))
    return log.limit(0).unionByName(end, allowMissingColumns=True)


def dedup_stream(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """X07."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


#: What an outbox event does: the table it is about and whether it deletes.
KINDS = {"entity.upsert": ("entity", False), "entity.delete": ("entity", True), "relationship.upsert": ("relationship", False), "relationship.delete": ("relationship", True), "chunk.upsert": ("chunk", False), "content.delete": ("content", True)}


def effects(events: DataFrame) -> DataFrame:
    """X01. events (event_id, ts, kind, id, a, b) -> what they do: grp, id, deleted and the rest. a and b are a relationship's ends, a
    is a chunk's content. A deletion also stands as a row of gone:grp, for what hangs on the deleted; unknown kinds fail."""
    grp = F.element_at(F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v[0]))]), F.col("kind"))
    deleted = F.col("kind").isin([k for k, v in KINDS.items() if v[1]])
    rows = events.withColumn("grp", F.coalesce(grp, F.lit("failed"))).withColumn("deleted", deleted)
    rows = rows.withColumn("id", F.when(F.col("grp") == "failed", F.col("event_id").cast("string")).otherwise(F.col("id")))
    gone = rows.where("deleted AND grp IN ('entity', 'content')").withColumn("grp", F.concat(F.lit("gone:"), "grp"))
    return rows.where("grp <> 'content'").unionByName(gone).select("grp", "id", "deleted", "a", "b", "event_id", "ts")


def latest_effects(rows: DataFrame) -> DataFrame:
    """The last effect on each thing: of the others nothing is left to see."""
    last = F.max(F.struct("ts", "event_id", "deleted", "a", "b")).alias("x")
    return rows.groupBy("grp", "id").agg(last).select("grp", "id", "x.deleted", "x.a", "x.b", "x.event_id", "x.ts")


def projection(state: DataFrame) -> DataFrame:
    """grp, id, event_id of what stands: entities, relationships both of whose ends weren't deleted since, chunks whose content wasn't
    deleted since, and failed events."""
    when = F.struct("ts", "event_id")
    gone = state.where("grp LIKE 'gone:%'").select(F.substring_index("grp", ":", -1).alias("of"), F.col("id").alias("gone_id"), when.alias("gone_at"))
    stands = state.where("NOT deleted AND grp IN ('entity', 'relationship', 'chunk', 'failed')")
    ends = stands.where("grp IN ('relationship', 'chunk')").withColumn("at", when).withColumn("of", F.when(F.col("grp") == "chunk", "content").otherwise("entity"))
    ends = ends.select("grp", "id", "at", "of", F.explode(F.array_compact(F.array("a", "b"))).alias("gone_id"))
    lost = ends.join(gone, ["of", "gone_id"]).where("gone_at > at").select("grp", "id").distinct()
    return stands.join(lost, ["grp", "id"], "left_anti").select("grp", "id", "event_id")


def latest_per_key(events: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last event of each key, of which a projection needs no other."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return events.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def pointer(spark: SparkSession, state: str, before: int | None = None) -> dict[int, int]:
    """Of each bucket of the state the batch that wrote it last, as the last whole batch (or the last one before a number) has left it: as
    many rows as there are buckets."""
    from pyspark.errors import AnalysisException

    try:
        seen = spark.read.schema("bucket int, version long, batch long").option("recursiveFileLookup", True).parquet(f"{state}/pointer")
    except AnalysisException:  # no batch yet
        return {}
    seen = seen if before is None else seen.where(F.col("batch") < before)
    last = seen.agg(F.max("batch")).first()[0]
    return {r["bucket"]: r["version"] for r in seen.where(F.col("batch") == last).collect() if r["bucket"] >= 0} if last is not None else {}


def buckets_of(spark: SparkSession, state: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{state}/versions/{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*paths) if paths else None


def outbox_state(spark: SparkSession, state: str) -> DataFrame | None:
    """X01. The table of effects as the last whole batch left it; None before the first."""
    return buckets_of(spark, state, pointer(spark, state))


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold_batch(batch: DataFrame, number: int, state: str, buckets: int) -> None:
    """X01. Fold a micro-batch into the state. Only buckets (by hash of grp and id) that the batch has effects in are read and written anew;
    a pointer, written last, tells where each bucket is. A batch that is run again starts from the pointer before it and so writes the
    same. What neither this pointer nor the one before needs is removed."""
    spark = batch.sparkSession
    batch.persist()
    now = latest_effects(effects(batch)).withColumn("bucket", F.pmod(F.xxhash64("grp", "id"), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in now.select("bucket").distinct().collect()]
    before = pointer(spark, state, number)
    old = buckets_of(spark, state, {b: before[b] for b in touched if b in before})
    merged = latest_effects(now.drop("bucket") if old is None else now.drop("bucket").unionByName(old))
    merged = merged.withColumn("bucket", F.pmod(F.xxhash64("grp", "id"), F.lit(buckets)).cast("int"))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/versions/{number}")
    batch.unpersist()
    after = before | dict.fromkeys(touched, number)
    rows = [(b, v, number) for b, v in after.items()] or [(-1, -1, number)]
    spark.createDataFrame(rows, "bucket int, version long, batch long").coalesce(1).write.mode("overwrite").parquet(f"{state}/pointer/{number}")
    for b, v in pointer(spark, state, number - 1).items():
        if before.get(b) != v:
            remove(spark, f"{state}/versions/{v}/bucket={b}")


def project_outbox(events: DataFrame, state: str, checkpoint: str, buckets: int = 16) -> None:
    """X01. Fold a stream of outbox events into a table of effects below `state`. Re-applying converges; outbox_state() reads the table,
    projection() what stands."""
    query = events.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, state, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def in_slices(log: DataFrame, folder: str, slices: int = 4, at: str = "ts") -> DataFrame:
    """The event log as a stream of micro-batches, each a stretch of time, written one after the other as a log would be. A slice is as many
    files as the session has cores, and a micro-batch takes as many, so their number doesn't depend on how the log lies in files."""
    spark = log.sparkSession
    files = spark.sparkContext.defaultParallelism
    first, last = log.agg(F.min(at), F.max(at)).first()
    for i in range(slices):
        begin, end = (F.lit(first + (last - first) * k / slices) for k in (i, i + 1))
        log.where((F.col(at) >= begin) & ((F.col(at) < end) | F.lit(i + 1 == slices))).repartition(files).write.parquet(f"{folder}/{i}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")
    return stream.withColumn(at, F.col(at).cast("timestamp"))


class RateLimiter:
    """X04. State of one key: times of its accepted events within the window (transformWithStateInPandas)."""

    def __new__(cls, most: int, seconds: float):
        from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

        class Processor(StatefulProcessor):
            def init(self, handle: StatefulProcessorHandle) -> None:
                self.times = handle.getValueState("times", "times array<double>")

            def handleInputRows(self, key, rows, timers):
                recent = list(self.times.get()[0]) if self.times.exists() else []
                out = []
                for frame in rows:
                    for t, e in sorted(zip(frame["t"], frame["event_id"])):
                        recent = [x for x in recent if x > t - seconds]
                        ok = len(recent) < most
                        if ok:
                            recent.append(float(t))
                        out.append((key[0], e, ok))
                self.times.update((recent,))
                yield pd.DataFrame(out, columns=["user_id", "event_id", "accepted"])

            def close(self) -> None:
                pass

        return Processor()


def rate_limit_stream(events: DataFrame, most: int, seconds: float) -> DataFrame:
    """X04."""
    timed = events.select("user_id", "event_id", F.col("ts").cast("double").alias("t"))
    return timed.groupBy("user_id").transformWithStateInPandas(RateLimiter(most, seconds), outputStructType="user_id long, event_id long, accepted boolean", outputMode="append", timeMode="None")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into Parquet and read that."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)

