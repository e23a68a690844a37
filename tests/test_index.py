"""Storing, rebuilding, draining and coding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexichron.operators import audio as A
from lexichron.operators import catalogue as K
from lexichron.operators import evaluation as V
from lexichron.operators.transcribe import drain
from lexichron.schemas import SCHEMAS
from lexichron.sources import store
from lexichron.sources import index as index_module
from lexichron.sources.index import index_new, refresh_search, search_stored, timed_searches


def chunk(episode, idx, text):
    words = [(w, 10.0 * idx + 0.4 * i, 10.0 * idx + 0.4 * i + 0.3) for i, w in enumerate(text.split())]
    return (episode, idx, 10.0 * idx, 10.0 * idx + 10, text, words, "m", "x")


def job(number, episode, status="done"):
    return (number, episode, "transcribe", status, 1, 1, 3, None, None, None, None)


def test_index_new_once_and_search(spark, tmp_path):
    root = str(tmp_path)
    store.apply_schema(spark, root)
    store.append(spark.createDataFrame([job(1, 1), job(2, 2), job(3, 3, "queued"), job(4, 4)], SCHEMAS["jobs"]), root, "jobs")
    rows = [chunk(1, 0, "the runners were running along the river"), chunk(1, 1, "until the rain stopped them"), chunk(2, 0, "a kitchen full of bread"), chunk(3, 0, "not yet finished")]
    store.append(spark.createDataFrame(rows, SCHEMAS["chunks"]), root, "chunks")
    assert index_new(spark, root) == {"episodes": 3, "passages": 2}  # episode 4 has no words
    p = store.load(spark, root, "passages").orderBy("id").collect()
    assert [(r.episode_id, r.idx, r.start_s, r.text) for r in p] == [(1, 0, 0.0, "the runners were running along the river until the rain stopped them"), (2, 0, 0.0, "a kitchen full of bread")]
    assert all(len(r.embedding) == 64 and r.embed_model == "hash-1" for r in p)
    assert index_new(spark, root) == {"episodes": 1, "passages": 0}
    q = spark.createDataFrame([(1, "who runs?"), (2, "breads")], "query_id long, question string")
    for mode in ("keyword", "vector", "hybrid", "rerank"):
        hits = search_stored(spark, root, q, mode, 1).collect()
        assert {(r.query_id, r.episode_id) for r in hits} == {(1, 1), (2, 2)} or mode != "keyword"
        assert len(hits) == 2 and all(r.text and r.end_s > r.start_s for r in hits)
    with pytest.raises(ValueError):
        search_stored(spark, root, q, "magic")
    ticks = iter(range(100))
    times = timed_searches(spark, root, q, ("keyword", "hybrid"), most=1, clock=lambda: float(next(ticks)))
    assert {r["mode"]: r.p50_seconds for r in V.median_seconds(times, "mode").collect()} == {"keyword": 1.0, "hybrid": 1.0}


def test_new_episodes_leave_stored_files_alone(spark, tmp_path):
    root = str(tmp_path)
    store.apply_schema(spark, root)

    def put(number, text):
        store.append(spark.createDataFrame([job(number, number)], SCHEMAS["jobs"]), root, "jobs")
        store.append(spark.createDataFrame([chunk(number, 0, text)], SCHEMAS["chunks"]), root, "chunks")

    def files():
        return {str(f): f.stat().st_mtime_ns for part in ("passages", "search/v1") for f in (tmp_path / part).rglob("*.parquet") if "cells" not in str(f) and "shape" not in str(f)}

    def best(words):
        q = spark.createDataFrame([(1, words)], "query_id long, question string")
        return [r.episode_id for r in search_stored(spark, root, q, "keyword").collect()]

    for i in range(1, 7):
        put(i, f"the river ran past house {i}")
    index_new(spark, root)
    before = files()
    put(7, "bread and salt for the rivers")
    assert index_new(spark, root) == {"episodes": 1, "passages": 1}
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    assert best("salt") == [7] and sorted(best("river")) == [1, 2, 3, 4, 5] and refresh_search(spark, root) == "kept"
    # a changed passage makes a whole new index
    changed = store.load(spark, root, "passages").filter("episode_id = 2").withColumn("text", F.lit("snow fell"))
    assert K.rebuild_rows(changed, changed, f"{root}/passages", SCHEMAS["passages"]) == 1
    assert refresh_search(spark, root) == "built" and best("snow") == [2] and 2 not in best("river house")
    assert not (tmp_path / "search/v1").exists()
    # an addition that did not end is made good
    index_module._set_state(spark, root, 2, "adding")
    assert refresh_search(spark, root) == "built" and best("snow") == [2]


def test_rebuilt_episodes_lose_all_they_had(spark, tmp_path):
    path, schema = str(tmp_path / "t"), SCHEMAS["usage_daily"].__class__.fromDDL("episode_id long, text string")
    spark.createDataFrame([], schema).write.parquet(path)
    put = lambda rows, ids: K.rebuild_rows(spark.createDataFrame(rows, schema), spark.createDataFrame([(i,) for i in ids], "episode_id long"), path, schema, size=2)
    read = lambda: sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).select(schema.names).collect())
    put([(i, f"{i}{x}") for i in range(6) for x in "ab"], range(6))
    assert len(read()) == 12
    put([(2, "new")], [2, 3])
    assert read() == sorted([(i, f"{i}{x}") for i in (0, 1, 4, 5) for x in "ab"] + [(2, "new")])
    put([], range(6))
    assert read() == []


def test_new_episodes_come_with_their_jobs(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "b", 3), (4, "c", 4)], "id long, dedup_key string, ord int")
    held = spark.createDataFrame([("a",)], "dedup_key string")
    jobs = spark.createDataFrame([(4, "transcribe")], "episode_id long, kind string")
    new, queued = K.save_episodes(rows, held, jobs)
    assert sorted(r.id for r in new.collect()) == [2, 4] and [(r.episode_id, r.kind) for r in queued.collect()] == [(2, "transcribe")]


def test_workers_drain_the_queue(spark):
    rows = [job(i, i, "queued")[:7] + (None,) * 4 for i in range(1, 6)]
    start = F.lit("2024-01-15 00:00:00").cast("timestamp")
    jobs = spark.createDataFrame(rows, SCHEMAS["jobs"]).withColumn("run_after", start)
    turn, slept = [0], []

    def run(claimed):  # job 2 meets a rate limit once, job 3 fails for good
        error = F.when(F.col("id") == 3, "permanent").when((F.col("id") == 2) & (F.col("lease") < 3), "rate_limited")
        return claimed.select("id", error.alias("error"), F.lit(30.0).alias("retry_after"))

    def now():
        turn[0] += 1
        return F.lit("2024-01-15 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.lit(turn[0]))

    save = lambda df: spark.createDataFrame(df.collect(), df.schema)
    done = drain(jobs, 3, run, save, now, slept.append, most_turns=9)
    assert {r.id: r.status for r in done.collect()} == {1: "done", 2: "done", 3: "failed", 4: "done", 5: "done"}
    assert turn[0] < 18 and slept
    assert drain(jobs, 3, run, save, lambda: start - F.make_dt_interval(days=F.lit(1)), slept.append, most_turns=2).filter("status = 'queued'").count() == 5
    assert slept[-2:] == [5.0, 5.0]


def test_codecs(spark):
    tone = np.round(8_000 * np.sin(np.arange(16_000) / 20)).astype("<i2")
    df = spark.createDataFrame([(1, bytearray(tone.tobytes())), (2, None)], "episode_id long, audio binary")
    files = A.encode_audio(df)
    assert files.filter("episode_id = 1").first().audio[:4] == b"RIFF"
    back = {r.episode_id: r.audio for r in A.load_audio(files).collect()}
    assert back[1] == tone.tobytes() and back[2] is None


def test_whole_transcripts_and_vectors_do_not_move(spark):
    """An episode of one chunk is a transcript as it is, and passages get their vectors in a map; several chunks are put together."""
    from lexichron.operators import retrieval as R
    from lexichron.sources.index import stored_transcripts

    shape = "episode_id long, idx int, words array<struct<text:string,start:double,end:double>>"
    one = [(1, 0, [("a", 0.0, 0.4), ("b", 0.5, 0.9)]), (2, 0, []), (3, 0, None)]
    got = stored_transcripts(spark.createDataFrame(one, shape))
    assert sorted(tuple(r) for r in got.collect())[:2] == [(1, ["a", "b"], [0, 500], [400, 900]), (2, [], [], [])]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    more = spark.createDataFrame([*one, (1, 2, [("d", 2.0, 2.1)]), (1, 1, [("c", 1.0, 1.1)])], shape)
    assert {r.episode_id: r.tokens for r in stored_transcripts(more).collect()} == {1: ["a", "b", "c", "d"], 2: [], 3: None}
    docs = spark.createDataFrame([(1, "x", "One two,  two"), (2, "y", " \t"), (3, "z", None), (4, None, "two three")], "id long, tag string, text string")
    plain = {r.id: r.embedding for r in R.hash_embed(docs).collect()}
    made = R.embedded(docs)
    assert {(r.id, r.tag, r.text): r.embedding for r in made.collect()} == {(r.id, r.tag, r.text): plain.get(r.id) for r in docs.collect()} and set(plain) == {1, 4}
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
