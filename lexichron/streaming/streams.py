"""Streaming forms of daily usage, token buckets, checkpoint writes and the job state machine.

Every stream ends in files: complete-mode totals replace their folder batch by batch, appended rows go to parquet with
a checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import BACKOFF_S, STALE_S
from ..operators.usage import take
from ..session import shared_dir


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; ts as an instant, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


#: Streams with timers keep their state in this store.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, mode: str = "append", where: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now, and returns what it wrote. conf: settings of the session for that time."""
    with settings(stream.sparkSession, conf or {}):
        return _drained(stream, mode, where)


def _drained(stream: DataFrame, mode: str, where: str | None) -> DataFrame:
    spark = stream.sparkSession
    root = where or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def usage_totals(events: DataFrame) -> DataFrame:
    """day, tokens, answers as they grow; the state is a row a day."""
    spends = events.filter("event_type = 'purchase'").select(F.to_date("ts").alias("day"), F.floor("value").cast("bigint").alias("tokens"))
    return spends.groupBy("day").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("answers"))


def first_of_each(rows: DataFrame, *keys: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key that arrives within delay: at-least-once writes become idempotent."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def bucket_stream(requests: DataFrame, capacity: float, per_hour: float, delay: str = "1 hour") -> DataFrame:
    """requests(id, key, ts) with allowed and wait; the state of a key is its level and its last time.

    A bucket that the watermark finds full again is forgotten: a new one is full too. So state grows with the keys of a
    refill's time, not with all keys ever seen.
    """
    rate = per_hour / 3600

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (capacity, -1)
        pdf = pd.concat(list(frames)).sort_values(["ts_us", "id"])
        rows = []
        for i, ts in zip(pdf["id"], pdf["ts_us"], strict=True):
            allowed, wait, level = take(level, 0.0 if last < 0 else (ts - last) / 1e6, capacity, rate)
            last = int(ts)
            rows.append((i, allowed, wait))
        state.update((float(level), last))
        full_ms = last // 1_000 + int((capacity - level) / rate * 1_000) + 1_000
        state.setTimeoutTimestamp(max(full_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["id", "allowed", "wait"])

    timed = requests.withWatermark("ts", delay).select("id", "key", F.unix_micros("ts").alias("ts_us"), "ts")
    return timed.groupBy("key").applyInPandasWithState(run, "id bigint, allowed boolean, wait double", "level double, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def step(state: dict, event: dict, max_attempts: int = 3) -> str:
    """Applies one queue event to a job's state and names the outcome. event: op, lease, seconds, permanent."""
    op = event["op"]
    if op == "claim":
        if state["status"] != "queued":
            return "ignored"
        state.update(status="running", attempts=state["attempts"] + 1, lease=state["lease"] + 1)
        return "claimed"
    if state["status"] != "running" or event["lease"] != state["lease"]:
        return "lease_lost"
    if op == "complete":
        state["status"] = "done"
        return "done"
    if op == "defer":
        state.update(status="queued", attempts=state["attempts"] - 1)
        return "deferred"
    final = bool(event["permanent"]) or state["attempts"] >= max_attempts
    state["status"] = "failed" if final else "queued"
    return "failed" if final else "retrying"


def job_stream(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """seq, job_id, outcome, status, attempts, lease of events(job_id, seq, op, lease, permanent) in order of seq.

    The state of a job is its row; its lease never goes down, so a late result of an earlier run changes nothing.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, lease = state.get if state.exists else ("queued", 0, 0)
        job = {"status": status, "attempts": attempts, "lease": lease}
        rows = []
        for e in pd.concat(list(frames)).sort_values("seq").to_dict("records"):
            outcome = step(job, e, max_attempts)
            rows.append((e["seq"], key[0], outcome, job["status"], job["attempts"], job["lease"]))
        state.update((job["status"], job["attempts"], job["lease"]))
        yield pd.DataFrame(rows, columns=["seq", "job_id", "outcome", "status", "attempts", "lease"])

    return events.groupBy("job_id").applyInPandasWithState(
        run, "seq bigint, job_id bigint, outcome string, status string, attempts int, lease bigint", "status string, attempts int, lease bigint", "append", GroupStateTimeout.NoTimeout
    )


def at_time(state: dict, ts_ms: int, stale_s: float, max_attempts: int = 3) -> int | None:
    """Takes a job back from a worker that has held it for stale_s by ts_ms; the moment when that was due, or None."""
    due = state["locked_ms"] + int(stale_s * 1_000)
    if state["status"] != "running" or due > ts_ms:
        return None
    state.update(status="failed" if state["attempts"] >= max_attempts else "queued", run_after_ms=due)
    return due


def timed_step(state: dict, event: dict, max_attempts: int = 3) -> str:
    """step() with times: a job is claimed only from its run_after on; a failure waits twice as long each time, a deferral as
    long as it says."""
    ts = event["ts_ms"]
    if event["op"] == "claim" and state["status"] == "queued" and state["run_after_ms"] > ts:
        return "not_ready"
    outcome = step(state, event, max_attempts)
    if outcome == "claimed":
        state["locked_ms"] = ts
    elif outcome == "retrying":
        state["run_after_ms"] = ts + BACKOFF_S * 1_000 * 2 ** (state["attempts"] - 1)
    elif outcome == "deferred":
        state["run_after_ms"] = ts + int(max(0.0, event["seconds"]) * 1_000)
    return outcome


class TimedJob(StatefulProcessor):
    """A job's row as value state, with one timer: when its lease goes stale, or when it may be claimed again."""

    NAMES = ("status", "attempts", "lease", "run_after_ms", "locked_ms")
    TAKES = ("ts_ms", "seq", "op", "lease", "permanent", "seconds")
    OUT = ("seq", "job_id", "at_ms", "outcome", "status", "attempts", "lease")

    def __init__(self, stale_s: float, max_attempts: int):
        self.stale_s, self.max_attempts = stale_s, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, lease bigint, run_after_ms bigint, locked_ms bigint")

    def _read(self) -> tuple[dict, int]:
        """The job's row, and when the timer was due that was set with it; 0 if there is none."""
        kept = self.job.get()
        state = dict(zip(self.NAMES, kept or ("queued", 0, 0, 0, 0), strict=True))
        return state, self._due(state) if kept else 0

    def _due(self, state: dict) -> int:
        return {"running": state["locked_ms"] + int(self.stale_s * 1_000), "queued": state["run_after_ms"]}.get(state["status"], 0)

    def _keep(self, state: dict, now_ms: int, before: int) -> None:
        """Stores the row and sets the one timer that it needs, in place of the one due at `before`."""
        self.job.update(tuple(state[n] for n in self.NAMES))
        due = self._due(state)
        if before and (before != due or due <= now_ms):
            self.handle.deleteTimer(before)
        if due > now_ms:
            self.handle.registerTimer(due)

    def _row(self, seq: int | None, key: tuple, at_ms: int, outcome: str, state: dict) -> tuple:
        return seq, key[0], at_ms, outcome, state["status"], state["attempts"], state["lease"]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (state, before), out, last = self._read(), [], 0
        frames = list(rows)
        pdf = frames[0] if len(frames) == 1 else pd.concat(frames)
        columns = [pdf[c].tolist() for c in self.TAKES]
        for i in np.lexsort((pdf["seq"].to_numpy(), pdf["ts_ms"].to_numpy())).tolist():
            e = {c: column[i] for c, column in zip(self.TAKES, columns, strict=True)}
            if (due := at_time(state, e["ts_ms"], self.stale_s, self.max_attempts)) is not None:
                out.append(self._row(None, key, due, "reclaimed", state))
            outcome, last = timed_step(state, e, self.max_attempts), e["ts_ms"]
            out.append(self._row(e["seq"], key, last, outcome, state))
        self._keep(state, max(last, timerValues.getCurrentWatermarkInMs()), before)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (state, before), now = self._read(), expiredTimerInfo.getExpiryTimeInMs()
        due = at_time(state, now, self.stale_s, self.max_attempts)
        ready = due is None and state["status"] == "queued" and state["run_after_ms"] == now
        if due is not None or ready:
            self._keep(state, now, before)
            yield self._frame([self._row(None, key, now, "ready" if ready else "reclaimed", state)])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        """rows as columns of plain objects: a job has few rows, so that what a frame costs by itself counts."""
        values = np.empty((len(rows), len(self.OUT)), object)
        values[:] = rows
        return pd.DataFrame(values, columns=list(self.OUT), copy=False)

    def close(self) -> None:
        pass


def timed_job_stream(events: DataFrame, stale_s: float = STALE_S, max_attempts: int = 3, delay: str = "1 minute") -> DataFrame:
    """seq, job_id, at, outcome, status, attempts, lease of events(job_id, seq, ts, op, lease, permanent, seconds), in the order
    of ts and seq.

    Besides a row for each event, a job whose worker has held it for stale_s is taken back, and one whose waiting time ends is
    ready: rows without seq, at the moment it was due, which come with the job's next event or, without one, when the
    watermark passes that moment. Run it with drain(…, conf=ROCKS).
    """
    timed = events.withWatermark("ts", delay).select("job_id", "seq", "ts", F.unix_millis("ts").alias("ts_ms"), "op", "lease", "permanent", "seconds")
    schema = "seq bigint, job_id bigint, at_ms bigint, outcome string, status string, attempts int, lease bigint"
    made = timed.groupBy("job_id").transformWithStateInPandas(TimedJob(stale_s, max_attempts), schema, "Append", "EventTime")
    return made.select("seq", "job_id", F.timestamp_millis("at_ms").alias("at"), "outcome", "status", "attempts", "lease")
