import datetime as dt

from pyspark.sql import functions as F

from lexichron.operators import catalogue as K
from lexichron.operators import jobs as J
from lexichron.schemas import JOBS
from lexichron.streaming.streams import step

NOW = dt.datetime(2024, 1, 15, 12)


def job(i, status="queued", attempts=0, lease=0, run_after=NOW, locked_at=None, kind="transcribe", most=3):
    return (i, i, kind, status, attempts, lease, most, run_after, locked_at, "w1" if locked_at else None, None)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), JOBS)


def at(spark):
    return F.lit("2024-01-15 12:00:00").cast("timestamp")


def test_claim_takes_each_ready_job_once(spark):
    rows = [job(i) for i in range(40)] + [job(90, "running", 1, 1), job(91, run_after=NOW + dt.timedelta(seconds=1))]
    got = J.claims(frame(spark, *rows), at(spark), 4).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3] and len({r.locked_by for r in got}) == 4
    assert all((r.status, r.attempts, r.lease) == ("running", 1, 1) for r in got)
    assert len(J.claims(frame(spark, *rows), at(spark), 100).collect()) == 40


def test_fail_backs_off_and_ends(spark):
    jobs = frame(spark, job(1, "running", 1, 1), job(2, "running", 2, 2), job(3, "running", 3, 3), job(4, "running", 1, 5))
    results = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, 3, False), (4, 4, True)], "id long, lease long, permanent boolean")
    got = {r.id: r for r in J.fail(jobs, results, at(spark)).collect()}
    assert (got[1].status, got[1].run_after) == ("queued", NOW + dt.timedelta(seconds=30))
    assert got[2].run_after == NOW + dt.timedelta(seconds=60)
    assert (got[3].status, got[3].run_after) == ("failed", NOW)
    assert got[4].outcome == "lease_lost" and got[4].status == "running"


def test_defer_gives_the_attempt_back(spark):
    jobs = frame(spark, job(1, "running", 1, 1))
    results = spark.createDataFrame([(1, 1, 45.0)], "id long, lease long, seconds double")
    r = J.defer(jobs, results, at(spark)).first()
    assert (r.status, r.attempts, r.lease, r.run_after) == ("queued", 0, 1, NOW + dt.timedelta(seconds=45))


def test_complete_is_fenced(spark):
    jobs = frame(spark, job(1, "running", 1, 2), job(2, "queued", 1, 1))
    results = spark.createDataFrame([(1, 1), (2, 1)], "id long, lease long")
    assert {r.outcome for r in J.complete(jobs, results).collect()} == {"lease_lost"}


def test_reclaim(spark):
    old = NOW - dt.timedelta(hours=1)
    jobs = frame(spark, job(1, "running", 1, 1, locked_at=old), job(2, "running", 3, 1, locked_at=old), job(3, "running", 1, 1, locked_at=NOW))
    got = {r.id: r.status for r in J.reclaim(jobs, at(spark)).collect()}
    assert got == {1: "queued", 2: "failed"}
    after = {r.id: r.status for r in J.apply_changes(jobs, J.reclaim(jobs, at(spark))).collect()}
    assert after == {1: "queued", 2: "failed", 3: "running"}


def test_state_machine_matches_the_tables():
    s = {"status": "queued", "attempts": 0, "lease": 0}
    e = lambda op, lease=None, permanent=False: {"op": op, "lease": lease, "permanent": permanent}
    assert step(s, e("claim")) == "claimed" and s == {"status": "running", "attempts": 1, "lease": 1}
    assert step(s, e("defer", 1)) == "deferred" and s["attempts"] == 0
    assert step(s, e("claim")) == "claimed" and s["lease"] == 2
    assert step(s, e("complete", 1)) == "lease_lost"
    assert step(s, e("complete", 2)) == "done"
    t = {"status": "queued", "attempts": 0, "lease": 0}
    said = []
    for _ in range(3):
        step(t, e("claim"))
        said.append(step(t, e("fail", t["lease"])))
    assert said == ["retrying", "retrying", "failed"]


def test_insert_if_absent_keeps_the_first(spark):
    rows = spark.createDataFrame([(2, "a", "second"), (1, "a", "first"), (3, "b", "held")], "ord long, key string, title string")
    held = spark.createDataFrame([("b",)], "key string")
    assert [r.title for r in K.insert_if_absent(rows, held, "key", "ord").collect()] == ["first"]
    assert tuple(K.ingest_counts(rows, held, "key", "ord").first()) == (1, 2)


def test_checkpoints(spark):
    schema = "episode_id long, idx int, start_ms long, end_ms long, sha256 string"
    plan = [(e, i, i * 10, i * 10 + 10, "h") for e in (1, 2, 3, 4) for i in range(3)]
    saved = plan[0:3] + plan[3:4] + [(3, 0, 0, 10, "other")] + [(4, 0, 0, 9, "h"), (4, 1, 10, 20, "h")]
    left = K.checkpoint_diff(spark.createDataFrame(saved, schema), spark.createDataFrame(plan, schema)).groupBy("episode_id").count().collect()
    assert {r.episode_id: r["count"] for r in left} == {2: 2, 3: 3, 4: 3}
