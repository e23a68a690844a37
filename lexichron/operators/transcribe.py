"""Chunks to transcripts with checkpoints, and one turn of the workers over the job table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.feeds import parse_transcription
from . import jobs as J
from .audio import cut_samples, encode_audio, find_speech, wav_bytes
from .catalogue import checkpoint_diff
from .sequence import chunk_plan, shift_words

Recogniser = Callable[[DataFrame], DataFrame]


def transcribe(plan: DataFrame, saved: DataFrame, recognise: Recogniser, model: str) -> DataFrame:
    """The chunks to append: episode_id, idx, start_s, end_s, text, words, model, audio_sha256.

    plan: episode_id, idx, start_ms, end_ms, sha256, audio; saved: the same without audio. Only chunks without a valid
    checkpoint reach recognise(episode_id, idx, audio) -> (episode_id, idx, reply); times become absolute.
    """
    keys = ["episode_id", "idx"]
    todo = plan.join(checkpoint_diff(saved, plan.drop("audio")), keys, "left_semi")
    replies = recognise(todo.select(*keys, "audio"))
    made = todo.drop("audio").join(replies, keys).withColumn("t", parse_transcription(F.col("reply")))
    start = F.col("start_ms") / 1000
    return made.select(
        *keys, start.alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), F.col("t.text").alias("text"), shift_words(F.col("t.words"), start).alias("words"), F.lit(model).alias("model"), F.col("sha256").alias("audio_sha256")
    )


#: Milliseconds of a chunk for recognisers that state no limit of their own.
CHUNK_MS = 600_000


def transcribe_audio(recordings: DataFrame, recognise: Recogniser, max_chunk_ms: int | None = None, encode: Callable[[bytes], bytes] = wav_bytes) -> DataFrame:
    """episode_id, n_chunks, words (absolute times, in order) of recordings(episode_id, audio), without checkpoints.

    The length of a chunk belongs to the back end: a recogniser may have an attribute max_chunk_ms, else CHUNK_MS holds,
    unless the caller sets another. Recordings without speech have no row. Chunks are cut from their recording where it lies,
    and a recording's words meet in one row, as in a transcript.
    """
    limit = max_chunk_ms or getattr(recognise, "max_chunk_ms", CHUNK_MS)
    plan = written(chunk_plan(find_speech(recordings), limit).select("episode_id", "idx", "start_ms", "end_ms"))
    parts = plan.join(recordings.select("episode_id", "audio"), "episode_id").withColumn("audio", cut_samples(F.col("audio"), F.col("start_ms"), F.col("end_ms")))
    replies = recognise(encode_audio(parts.select("episode_id", "idx", "audio"), encode))
    made = plan.join(replies, ["episode_id", "idx"]).withColumn("t", parse_transcription(F.col("reply")))
    made = made.select("episode_id", "idx", shift_words(F.col("t.words"), F.col("start_ms") / 1000).alias("words"))
    packed = made.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("idx", "words"))).alias("c"))
    return packed.select("episode_id", F.size("c").alias("n_chunks"), F.flatten("c.words").alias("words"))


def transcription_totals(plan: DataFrame, saved: DataFrame) -> DataFrame:
    """episode_id, chunks_total, transcribed, skipped."""
    todo = checkpoint_diff(saved, plan).withColumn("todo", F.lit(1))
    rows = plan.select("episode_id", "idx").join(todo, ["episode_id", "idx"], "left")
    n = rows.groupBy("episode_id").agg(F.count("*").alias("chunks_total"), F.count("todo").alias("transcribed"))
    return n.withColumn("skipped", F.col("chunks_total") - F.col("transcribed"))


def work(jobs: DataFrame, now: Column, workers: int, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(jobs after, outcomes) of one turn: reclaim the stale, claim, run, settle by the kind of error.

    run(claimed jobs) -> (id, error, retry_after): no error is done, rate_limited waits and gives the attempt back,
    permanent fails, anything else is tried again. Who loses the lease changes nothing.
    """
    fresh = J.apply_changes(jobs, J.reclaim(jobs, now))
    held = J.claims(fresh, now, workers)
    running = J.apply_changes(fresh, held.select("id", "status", "attempts", "lease", "locked_at", "locked_by"))
    done = held.select("id", "lease").join(run(held), "id").withColumn("r", J.route(F.col("error"), F.col("retry_after")))
    ended = J.complete(running, done.filter("r.outcome = 'done'").select("id", "lease"))
    failed = J.fail(running, done.filter("r.outcome IN ('failed', 'retrying')").select("id", "lease", (F.col("r.outcome") == "failed").alias("permanent")), now)
    waiting = J.defer(running, done.filter("r.outcome = 'deferred'").select("id", "lease", F.col("r.wait_s").alias("seconds")), now)
    names = ["id", "status", "attempts", "run_after", "outcome"]
    settled = (
        ended.join(running.select("id", "attempts", "run_after"), "id").select(names)
        .unionByName(failed.join(running.select("id", "attempts"), "id").select(names))
        .unionByName(waiting.select(names))
    )
    none = F.lit(None)
    changes = settled.drop("outcome").withColumns({"locked_at": none.cast("timestamp"), "locked_by": none.cast("string")})
    return J.apply_changes(running, changes), settled.select("id", "outcome")


def drain(
    jobs: DataFrame,
    workers: int,
    run: Callable[[DataFrame], DataFrame],
    save: Callable[[DataFrame], DataFrame],
    now: Callable[[], Column],
    sleep: Callable[[float], None],
    until_empty: bool = True,
    idle_s: float = 5.0,
    most_turns: int | None = None,
) -> DataFrame:
    """The job table after turns of the workers: save(jobs) writes each turn's table and reads it back.

    A turn that settles nothing sleeps idle_s seconds; with until_empty the loop ends when no queued or running job is
    left, and deferred jobs count as left. A rate limit makes the next turn wait as long as it says.
    """
    turns = 0
    while most_turns is None or turns < most_turns:
        turns += 1
        after, outcomes = work(jobs, now(), workers, run)
        counts = {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
        jobs = save(after)
        if not counts:
            if until_empty and J.unfinished(jobs).first().unfinished == 0:
                break
            sleep(idle_s)
        elif counts.get("deferred"):
            first = jobs.filter("status = 'queued'").agg((F.unix_timestamp(F.min("run_after")) - F.unix_timestamp(now())).alias("wait")).first().wait
            sleep(max(0.0, float(first or 0)))
    return jobs
