import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from lexichron.operators import audio as A
from lexichron.operators import evaluation as V
from lexichron.operators import transcribe as T
from lexichron.schemas import JOBS
from tests.test_jobs import NOW, at, frame, job


def tone(ms, loud=8_000):
    t = np.arange(A.RATE * ms // 1000)
    return (loud * np.sin(t * 0.2)).astype("<i2")


def test_speech_spans(spark):
    samples = np.concatenate([tone(1_000, 0), tone(2_000), tone(300, 0), tone(1_000), tone(2_000, 0), tone(500)])
    assert A.speech_spans(samples) == [(800, 4_500), (6_100, 6_800)]
    df = spark.createDataFrame([(1, bytearray(samples.tobytes())), (2, None), (3, bytearray(b"\x00"))], "episode_id long, audio binary")
    assert [(r.episode_id, r.start_ms) for r in A.find_speech(df).orderBy("start_ms").collect()] == [(1, 800), (1, 6_100)]
    row = df.filter("episode_id = 1").select(A.cut_samples(F.col("audio"), F.lit(1_000), F.lit(1_500)).alias("c"), A.duration_seconds(F.col("audio")).alias("d")).first()
    assert row.c == samples[16_000:24_000].tobytes() and row.d == 7


def scene(rng, spans, seconds, noise_db, over_db=18):
    """Noise whose loudness noise_db(second) changes, with bursts of a speech-like rhythm over it."""
    n = seconds * A.RATE
    t = np.arange(n) / A.RATE
    noise = 10 ** (np.interp(t, np.arange(seconds), [noise_db(s) for s in range(seconds)]) / 20)
    out = noise * rng.normal(size=n)
    for a, b in spans:
        i = slice(int(a * A.RATE), int(b * A.RATE))
        rhythm = 0.55 + 0.45 * np.sin(2 * np.pi * 4 * t[i])
        out[i] += noise[i] * 10 ** (over_db / 20) * rhythm * np.sin(2 * np.pi * 220 * t[i]) * 1.4
    return np.clip(out * 32_768, -32_768, 32_767).astype("<i2")


def test_speech_over_changing_noise():
    """A room that gets 30 decibels louder: late noise is louder than early speech."""
    rng = np.random.default_rng(6)
    for _ in range(5):
        at, spans = 2.0, []
        while at < 110:
            length = rng.uniform(1.0, 8.0)
            spans.append((at, at + length))
            at += length + rng.uniform(1.5, 5.0)
        found = A.speech_spans(scene(rng, spans, 125, lambda s: -55 + 30 * s / 125))
        assert len(found) == len(spans)
        for (a, b), (s, e) in zip(spans, found, strict=True):
            assert abs(s - (a * 1_000 - A.PAD_MS)) <= 120 and abs(e - (b * 1_000 + A.PAD_MS)) <= 120


def test_noise_alone_and_short_clicks_are_no_speech():
    rng = np.random.default_rng(7)
    samples = scene(rng, [], 30, lambda s: -30)
    for i in range(0, 30 * A.RATE, 5 * A.RATE):
        samples[i : i + A.FRAME] = 20_000  # a click of one frame
    assert A.speech_spans(samples) == [] and A.speech_spans(np.zeros(A.RATE, "<i2")) == []


def test_likeliest_path_equals_all_paths():
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(60):
        odds = rng.normal(size=9) * 2
        cost = lambda path: sum(o for o, x in zip(odds, path, strict=True) if x) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))
        best = max(itertools.product((False, True), repeat=9), key=cost)
        assert abs(cost(A.smoothed(odds, 1.5).tolist()) - cost(best)) < 1e-9


def test_transcribe_only_what_is_missing(spark):
    plan = spark.createDataFrame([(1, i, i * 60_000, i * 60_000 + 50_000, "h", bytearray(b"x")) for i in range(3)], "episode_id long, idx int, start_ms long, end_ms long, sha256 string, audio binary")
    saved = plan.drop("audio").filter("idx = 0")
    reply = json.dumps({"text": " hi there ", "words": [{"word": " hi", "start": 0.1, "end": 0.2}]})
    asked = []

    def recognise(df):
        asked.append(df.count())
        return df.select("episode_id", "idx", F.lit(reply).alias("reply"))

    made = T.transcribe(plan, saved, recognise, "m").orderBy("idx").collect()
    assert asked == [2] and [r.idx for r in made] == [1, 2]
    assert made[0].words[0].start == 60.1 and made[0].text == "hi there"
    total = T.transcription_totals(plan.drop("audio"), saved).first()
    assert (total.chunks_total, total.transcribed, total.skipped) == (3, 2, 1)


def test_a_turn_of_the_workers(spark):
    old = NOW - dt.timedelta(hours=1)
    jobs = frame(spark, *[job(i) for i in range(1, 5)], job(9, "running", 3, 4, locked_at=old), job(10, "done"))
    errors = spark.createDataFrame([(1, None, None), (2, "rate_limited", 45.0), (3, "permanent", None), (4, "network", None)], "id long, error string, retry_after double")
    after, outcomes = T.work(jobs, at(spark), 4, lambda claimed: errors)
    assert after.schema.names == JOBS.names
    got = {r.id: r for r in after.collect()}
    assert {i: got[i].status for i in got} == {1: "done", 2: "queued", 3: "failed", 4: "queued", 9: "failed", 10: "done"}
    assert (got[2].attempts, got[2].run_after) == (0, NOW + dt.timedelta(seconds=45))
    assert (got[4].attempts, got[4].run_after) == (1, NOW + dt.timedelta(seconds=30))
    assert got[1].locked_by is None and got[1].lease == 1
    assert {r.id: r.outcome for r in outcomes.collect()} == {1: "done", 2: "deferred", 3: "failed", 4: "retrying"}


def test_sessions(spark):
    ref = [("a", 1), ("b", 1), ("c", 2), ("d", 2)]
    hyp = [("a", 1.0, 1.2), ("b", 1.3, 1.5), ("x", 2.0, 2.2), ("c", 3.9, 4.0), ("e", 5.0, 5.2)]
    schema = "session_id long, ref array<struct<word:string,utterance:long>>, hyp array<struct<word:string,start:double,end:double>>, spans array<struct<utterance:long,start:double,end:double>>"
    df = spark.createDataFrame([(1, ref, hyp, [(1, 1.0, 2.0), (2, 4.0, 6.0)])], schema)
    steps = V.session_words(df)
    assert {(r.utterance, r.errors) for r in V.worst_utterances(steps).collect()} == {(1, 1), (2, 1)}
    off = [r.outside for r in steps.filter("kind = 'equal'").orderBy(F.desc("outside")).collect()]
    assert abs(off[0] - 0.05) < 1e-9 and off[1:] == [0.0, 0.0]


def test_clip_report(spark):
    pairs = spark.createDataFrame([(1, "a b c d".split(), "a b x d".split(), 600.0, 10.0)], "pair_id long, ref array<string>, hyp array<string>, audio_s double, took_s double")
    drafts = spark.createDataFrame([(1, "a b c d".split())], "pair_id long, draft array<string>")
    assert tuple(V.clip_report(pairs, drafts).first()) == (1, 4, 0.25, 60.0, True)


def test_audio_to_words_by_the_limit_of_the_back_end(spark):
    parts = [tone(1_000, 0)] + [x for _ in range(3) for x in (tone(3_000), tone(1_500, 0))]
    df = spark.createDataFrame([(1, bytearray(np.concatenate(parts).tobytes())), (2, bytearray(tone(3_000, 0).tobytes()))], "episode_id long, audio binary")

    def recognise(chunks):
        """Says how long each file is that it gets."""
        size = ((F.octet_length("audio") - 44) / 2 / A.RATE).cast("string")
        word = F.concat(F.lit('{"text": "", "words": [{"word": "s'), size, F.lit('", "start": 0.5, "end": 0.7}]}'))
        return chunks.select("episode_id", "idx", word.alias("reply"))

    whole = T.transcribe_audio(df, recognise).collect()
    assert [(r.episode_id, r.n_chunks, [w.text for w in r.words]) for r in whole] == [(1, 1, ["s12.4"])]
    recognise.max_chunk_ms = 4_000
    (r,) = T.transcribe_audio(df, recognise).collect()
    assert r.n_chunks == 3 and [w.text for w in r.words] == ["s3.4"] * 3
    assert [round(w.start, 3) for w in r.words] == [1.3, 5.8, 10.3]
    assert T.transcribe_audio(df, recognise, max_chunk_ms=8_000).first().n_chunks == 2
