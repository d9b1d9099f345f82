"""Streams whose result depends on the order of a key's rows (X02, X04, X05): rows wait in state until the watermark has passed them, then
are folded in the order of their times, whichever micro-batch brought them. Timers in event time start the folding."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: fold(state, rows, upto): state is a tuple or None, rows are (ms, n, flag) in order, upto is the watermark in ms. It gives the new state,
#: what to put out, and when to be called again though no row comes (None: needn't).
Fold = Callable[[tuple | None, list[tuple[int, int, bool]], int], tuple[tuple | None, list[tuple], int | None]]


class InOrder(StatefulProcessor):
    """Folds the rows of each key in the order of (ms, n). It is given buckets of keys, so state is fetched and stored once for all keys of a
    bucket, not once a key; a bucket has one timer, the earliest of its keys."""

    def __init__(self, fold: Fold, state: str, columns: list[str]):
        self.fold, self.schema, self.columns = fold, state, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string, ms long, n long, flag boolean")
        self.states = handle.getListState("states", f"id string, again long, {self.schema}")
        self.timer = handle.getValueState("timer", "at long")

    def set_timer(self, at: int | None) -> None:
        """The bucket's timer goes to `at` unless it stands earlier."""
        stands = self.timer.get()[0] if self.timer.exists() else None
        if at is None or stands is not None and stands <= at:
            return
        if stands is not None:
            self.handle.deleteTimer(stands)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(i, int(m), int(n), bool(f)) for frame in rows for i, m, n, f in zip(frame["id"], frame["ms"], frame["n"], frame["flag"])]
        self.waiting.appendList(new)
        self.set_timer(min(m for _, m, _, _ in new))
        yield pd.DataFrame([], columns=[*self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        ready: dict[str | None, list[tuple[int, int, bool]]] = {}
        later, n_held = [], 0
        for i, m, n, f in self.waiting.get():
            n_held += 1
            if m <= upto:
                ready.setdefault(i, []).append((int(m), int(n), bool(f)))
            else:
                later.append((i, int(m), int(n), bool(f)))
        known = {i: (again, tuple(state)) for i, again, *state in self.states.get()}
        due = ready.keys() | {i for i, (again, _) in known.items() if again is not None and again <= upto}
        put_out = []
        for i in due:
            state, out, again = self.fold(known[i][1] if i in known else None, sorted(ready.get(i, [])), upto)
            known[i] = (again, tuple(state))
            put_out += [(i, *row) for row in out]
        if len(later) < n_held:
            self.waiting.put(later) if later else self.waiting.clear()
        if due:
            self.states.put([(i, again, *state) for i, (again, state) in known.items()])
        self.timer.clear()
        self.set_timer(min([m for _, m, _, _ in later] + [again for again, _ in known.values() if again is not None], default=None))
        yield pd.DataFrame(put_out, columns=self.columns)

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, fold: Fold, state: str, output: str, late: str, buckets: int = 1024) -> DataFrame:
    """rows (key, ts, n, flag) as a stream, up to `late` out of order -> what the fold puts out, as `output` (the key first). Keys are dealt
    into `buckets` by their hash; a task holds the rows in wait and the states of one bucket at a time."""
    timed = rows.withWatermark("ts", late).withColumn("id", F.col(key).cast("string"))
    timed = timed.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"), "ts", "id", "n", "flag", F.unix_millis("ts").alias("ms"))
    columns = [part.split()[0] for part in output.split(", ")]
    kind = output.split(", ")[0].split()[1]
    plain = ", ".join([f"{columns[0]} string", *output.split(", ")[1:]])
    out = timed.groupBy("bucket").transformWithStateInPandas(InOrder(fold, state, columns), outputStructType=plain, outputMode="append", timeMode="EventTime")
    return out.withColumn(columns[0], F.col(columns[0]).cast(kind))


@contextlib.contextmanager
def state_with_timers(spark: SparkSession) -> Iterator[None]:
    """Streams with timers need a state store that sorts; streams started within get it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def attempts(base: int = 5, longest: int = 300, most: int = 3) -> Fold:
    """X02. Puts out (ms, attempts, status, retry_ms) of each change: pending after a failed attempt, claimable when its backoff of base * 2^n
    seconds (`longest` at most) is over and no attempt came before, done after a success, dead after `most` failures. What comes after done or
    dead is nobody's attempt and ignored."""

    def fold(state, rows, upto):
        failures, status, retry = state or (0, "new", None)
        out = []

        def release(until: int) -> None:
            nonlocal status
            if status == "pending" and retry <= until:
                status = "claimable"
                out.append((retry, failures, status, None))

        for ms, _, failed in rows:
            if status in ("done", "dead"):
                break
            release(ms)
            if failed:
                failures += 1
                status, retry = ("dead", None) if failures >= most else ("pending", ms + 1000 * min(longest, base << (failures - 1)))
            else:
                status, retry = "done", None
            out.append((ms, failures, status, retry))
        release(upto)
        return (failures, status, retry), out, retry if status == "pending" else None

    return fold


def retry_stream(events: DataFrame, key: str, late: str) -> DataFrame:
    """X02. events (key, ts, n, flag: failed) as a stream -> key, ms, attempts, status, retry_ms of each change, as time goes by."""
    return in_order(events, key, attempts(), "failures int, status string, retry long", f"{key} string, ms long, attempts int, status string, retry_ms long", late)


def accepted(most: int, seconds: float) -> Fold:
    """X04. Puts out (n, accepted): denied if `most` accepted rows lie in the trailing seconds."""
    span = int(1000 * seconds)

    def fold(state, rows, upto):
        recent, out = list(state[0]) if state else [], []
        for ms, n, _ in rows:
            recent = [x for x in recent if x > ms - span]
            ok = len(recent) < most
            if ok:
                recent.append(ms)
            out.append((n, ok))
        return (recent,), out, None

    return fold


def limit_stream(events: DataFrame, key: str, most: int, seconds: float, late: str) -> DataFrame:
    """X04. events (key, ts, n, flag) as a stream -> key, n, accepted. State: the times of at most `most` rows a key."""
    return in_order(events, key, accepted(most, seconds), "recent array<long>", f"{key} long, n long, accepted boolean", late)


def heartbeats(stale: int) -> Fold:
    """X05. Puts out (reset_ms, attempt, status) when `stale` seconds have passed since a heartbeat and none came: the job is pending again, its
    attempt one more. The next heartbeat is that of the new attempt."""

    def fold(state, rows, upto):
        beat, attempt = state or (None, 0)
        out = []
        for ms in [*(ms for ms, *_ in rows), None]:
            due = None if beat is None else beat + 1000 * stale
            if due is not None and (ms is not None and ms > due or ms is None and due < upto):
                attempt += 1
                out.append((due, attempt, "pending"))
                beat = None
            beat = beat if ms is None else ms
        return (beat, attempt), out, None if beat is None else beat + 1000 * stale + 1

    return fold


def stale_stream(beats: DataFrame, key: str, stale: int, late: str) -> DataFrame:
    """X05. beats (key, ts, n, flag) as a stream -> key, reset_ms, attempt, status of jobs whose heartbeat has stopped, found by a timer."""
    return in_order(beats, key, heartbeats(stale), "beat long, attempt int", f"{key} long, reset_ms long, attempt int, status string", late)


def reset_stale(jobs: DataFrame, steps: DataFrame, now, stale: int = 600) -> tuple[DataFrame, DataFrame]:
    """X05, of tables. jobs (job_id, status, heartbeat, attempt, ...) and steps (job_id, status, ...) after jobs in processing whose heartbeat is
    older than `stale` seconds went back to pending with one more attempt and their running steps to pending. A null heartbeat isn't old."""
    old = F.coalesce((F.col("status") == "processing") & (F.col("heartbeat") < now - F.expr(f"INTERVAL {stale} SECOND")), F.lit(False))
    after = jobs.withColumn("__old", old)
    hit = after.where("__old").select("job_id").withColumn("__hit", F.lit(True))
    reset = steps.join(hit, "job_id", "left").withColumn("status", F.when(F.col("__hit") & (F.col("status") == "running"), "pending").otherwise(F.col("status"))).drop("__hit")
    changed = after.withColumns({"status": F.when(F.col("__old"), "pending").otherwise(F.col("status")), "attempt": F.col("attempt") + F.col("__old").cast("int")})
    return changed.drop("__old"), reset
