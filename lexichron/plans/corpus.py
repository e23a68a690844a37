"""The domain's tables as views over the data folder: episodes, words, chunks, questions, jobs, speech, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dedup_key, split_words
from ..session import spread, table

#: The clock of all job and usage views; never the wall clock, so that runs agree.
NOW = "2024-01-15 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, feed_url, guid, title, audio_url, dedup_key, n_words: one episode a document."""
    d = table(spark, sf_dir, "documents")
    guid = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("feed_url"),
        guid.alias("guid"),
        F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit("https://audio.example/"), guid, F.lit(".mp3")).alias("audio_url"),
        dedup_key(F.col("source"), guid).alias("dedup_key"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, tokens, starts, ends (milliseconds): a word every 400 ms, with a pause of 20 s after each 50."""
    d = spread(table(spark, sf_dir, "documents"))
    w = d.select(F.col("doc_id").alias("episode_id"), split_words(F.col("text")).alias("tokens"))
    starts = F.when(F.size("tokens") > 0, F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i * 400 + F.floor(i / 50) * 20_000).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    return w.select("episode_id", "tokens", starts.alias("starts")).withColumn("ends", F.transform("starts", lambda s: s + 300))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, pos, text, start_ms, end_ms: a row a word, in the order of pos."""
    d = spread(table(spark, sf_dir, "documents"))
    w = d.select(F.col("doc_id").alias("episode_id"), F.posexplode(split_words(F.col("text"))).alias("pos", "text"))
    start = (F.col("pos") * 400 + F.floor(F.col("pos") / 50) * 20_000).cast("bigint")
    return w.withColumn("start_ms", start).withColumn("end_ms", start + 300)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, idx, words: a chunk a turn of a conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("idx"), split_words(F.col("text")).alias("words"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question: all benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows over the events: state from the id, times from ts."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("episode_id"),
        F.col("event_type").alias("kind"),
        status.alias("status"),
        (F.floor(F.col("event_id") / 4) % 4).cast("int").alias("attempts"),
        (F.floor(F.col("event_id") / 4) % 7).cast("bigint").alias("lease"),
        F.lit(3).alias("max_attempts"),
        ts.alias("run_after"),
        F.when(status == "running", ts).alias("locked_at"),
        F.when(status == "running", F.concat(F.lit("w"), (F.col("event_id") % 5).cast("string"))).alias("locked_by"),
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, start_ms, end_ms of speech segments, from the events of each user."""
    e = table(spark, sf_dir, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("span_id"), start.alias("start_ms"), (start + F.floor(F.col("value") * 1000).cast("bigint")).alias("end_ms"))


def spends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, day, tokens of the purchases, as language-model calls."""
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("id"), ts.alias("ts"), F.to_date(ts).alias("day"), F.floor("value").cast("bigint").alias("tokens"))
