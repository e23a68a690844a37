"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])

EPISODES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("feed_url", T.StringType(), False),
        T.StructField("guid", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("audio_url", T.StringType(), False),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("duration_seconds", T.IntegerType()),
        T.StructField("dedup_key", T.StringType(), False),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("episode_id", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("attempts", T.IntegerType(), False),
        T.StructField("lease", T.LongType(), False),
        T.StructField("max_attempts", T.IntegerType(), False),
        T.StructField("run_after", T.TimestampType()),
        T.StructField("locked_at", T.TimestampType()),
        T.StructField("locked_by", T.StringType()),
        T.StructField("last_error", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("episode_id", T.LongType(), False),
        T.StructField("idx", T.IntegerType(), False),
        T.StructField("start_s", T.DoubleType(), False),
        T.StructField("end_s", T.DoubleType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("words", T.ArrayType(WORD), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("audio_sha256", T.StringType(), False),
    ]
)

PASSAGES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("episode_id", T.LongType(), False),
        T.StructField("idx", T.IntegerType(), False),
        T.StructField("start_s", T.DoubleType(), False),
        T.StructField("end_s", T.DoubleType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embed_model", T.StringType()),
    ]
)

USAGE = T.StructType([T.StructField("day", T.DateType(), False), T.StructField("tokens", T.LongType(), False), T.StructField("answers", T.LongType(), False)])

SCHEMAS = {"episodes": EPISODES, "jobs": JOBS, "chunks": CHUNKS, "passages": PASSAGES, "usage_daily": USAGE}
