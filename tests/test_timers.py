"""Jobs with timers: what is due happens without an event of the job."""

import datetime as dt
from types import SimpleNamespace

import pandas as pd

from lexichron.streaming import streams as X

START = dt.datetime(2024, 1, 15, 12)
SCHEMA = "job_id long, seq long, ts timestamp, op string, lease long, permanent boolean, seconds double"


def event(job, seq, second, op, lease=0, seconds=0.0):
    return (job, seq, START + dt.timedelta(seconds=second), op, lease, False, seconds)


def run(spark, tmp_path, *batches):
    """The rows of a stream that reads one file a batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    made = X.drain(X.timed_job_stream(source, stale_s=600, delay="0 seconds"), where=str(tmp_path / "q"), conf=X.ROCKS)
    return {(r.job_id, r.seq, r.outcome): ((r["at"] - START).total_seconds(), r.status, r.attempts, r.lease) for r in made.collect()}


def test_late_lease_is_reclaimed_without_an_event(spark, tmp_path):
    other = [event(9, 100 + i, 1_000 * (i + 1), "claim") for i in range(3)]
    got = run(spark, tmp_path, [event(1, 1, 0, "claim"), event(2, 2, 0, "claim"), event(2, 3, 100, "fail", 1)], *[[e] for e in other])
    assert got[1, None, "reclaimed"] == (600.0, "queued", 1, 1)
    assert got[2, 3, "retrying"][0] == 100.0 and got[2, None, "ready"] == (130.0, "queued", 1, 1)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != X.ROCKS["spark.sql.streaming.stateStore.providerClass"]


def test_events_come_after_what_was_due(spark, tmp_path):
    rows = [event(1, 1, 0, "claim"), event(1, 2, 700, "complete", 1), event(1, 3, 701, "claim"), event(1, 4, 702, "defer", 2, 50.0), event(1, 5, 703, "claim"), event(1, 6, 760, "claim"), event(1, 7, 800, "complete", 3)]
    got = run(spark, tmp_path, rows)
    assert got[1, None, "reclaimed"] == (600.0, "queued", 1, 1) and got[1, 2, "lease_lost"][1] == "queued"
    assert got[1, 4, "deferred"] == (702.0, "queued", 1, 2) and got[1, 5, "not_ready"][1] == "queued"
    assert got[1, 6, "claimed"] == (760.0, "running", 2, 3) and got[1, 7, "done"] == (800.0, "done", 2, 3)


def test_attempts_end(spark, tmp_path):
    rows = [event(1, i, 1_000 * i, "claim") for i in range(1, 5)]
    got = run(spark, tmp_path, rows, [event(2, 9, 9_000, "claim")], [event(2, 10, 9_001, "claim")])
    assert got[1, 4, "ignored"] == (4_000.0, "failed", 3, 3)


class Store:
    """What a job's handle and value state hold, and the calls made: each is a round trip to the store."""

    def __init__(self):
        self.row, self.timers, self.calls = None, set(), []

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls.append("get")
        return self.row

    def update(self, row):
        self.calls.append("update")
        self.row = row

    def registerTimer(self, ms):  # noqa: N802
        self.calls.append("set")
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls.append("delete")
        self.timers.discard(ms)


def test_few_calls_a_job():
    """A job costs one read, one write and its own timer's calls, however it comes out; timers are not listed."""
    store, job = Store(), X.TimedJob(600, 3)
    job.init(store)
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)

    def after(*events):
        store.calls = []
        frame = pd.DataFrame([(1, seq, START, ms, op, lease, False, seconds) for seq, ms, op, lease, seconds in events], columns=["job_id", "seq", "ts", "ts_ms", "op", "lease", "permanent", "seconds"])
        halves = [frame[:1], frame[1:]] if len(frame) > 1 else [frame]
        made = pd.concat(job.handleInputRows((1,), iter(halves), times))
        return made["outcome"].tolist(), store.calls, store.timers

    assert after((2, 1_000, "claim", 0, 0.0), (1, 1_000, "complete", 1, 0.0)) == (["lease_lost", "claimed"], ["get", "update", "set"], {601_000})
    assert after((3, 2_000, "claim", 0, 0.0)) == (["ignored"], ["get", "update", "set"], {601_000})
    assert after((4, 3_000, "defer", 1, 50.0)) == (["deferred"], ["get", "update", "delete", "set"], {53_000})
    assert after((5, 60_000, "complete", 1, 0.0)) == (["lease_lost"], ["get", "update", "delete"], set())
    assert after((6, 61_000, "claim", 0, 0.0), (7, 62_000, "complete", 2, 0.0)) == (["claimed", "done"], ["get", "update", "delete"], set())
