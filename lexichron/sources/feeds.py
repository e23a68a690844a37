"""Feeds and files: RSS items, golden questions, reference texts, cached words; their writers."""

from __future__ import annotations

import os
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dedup_key, duration_seconds

ENCLOSURE = T.StructType([T.StructField("_url", T.StringType()), T.StructField("_type", T.StringType())])
ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("guid", T.StringType()),
        T.StructField("pubDate", T.StringType()),
        T.StructField("enclosure", T.ArrayType(ENCLOSURE)),
        T.StructField("itunes:duration", T.StringType()),
    ]
)
DATE_FORMAT = "d MMM yyyy HH:mm:ss Z"


def fetch_feed(url: str, path: str, timeout: float = 20.0) -> str:
    """Lands a feed at path, whole or not at all; HTTP errors are raised. Redirects are followed."""
    with urllib.request.urlopen(url, timeout=timeout) as got:  # noqa: S310
        content = got.read()
    with open(f"{path}.part", "wb") as out:
        out.write(content)
    os.replace(f"{path}.part", path)
    return path


class DownloadFailed(Exception):
    def __init__(self, reason: str, permanent: bool):
        super().__init__(reason)
        self.permanent = permanent


def download(url: str, path: str, most_bytes: int = 400 * 1024 * 1024, timeout: float = 60.0) -> str:
    """Lands a file piece by piece. Client errors but 429, and files over most_bytes, fail for good; all else may be
    tried again. No part of a failed file stays."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as got, open(path, "wb") as out:  # noqa: S310
            size = 0
            while piece := got.read(1 << 20):
                size += len(piece)
                if size > most_bytes:
                    raise DownloadFailed("too large", permanent=True)
                out.write(piece)
    except BaseException as e:
        if os.path.exists(path):
            os.remove(path)
        if isinstance(e, urllib.error.HTTPError):
            raise DownloadFailed(f"status {e.code}", permanent=400 <= e.code < 500 and e.code != 429) from e
        if isinstance(e, OSError):
            raise DownloadFailed(str(e), permanent=False) from e
        raise
    return path


def first_audio(enclosures: Column) -> Column:
    """URL of the first enclosure that has one and whose type is empty or audio."""
    fits = F.filter(enclosures, lambda e: (F.coalesce(e["_url"], F.lit("")) != "") & ((F.coalesce(e["_type"], F.lit("")) == "") | F.startswith(e["_type"], F.lit("audio/"))))
    return F.get(fits, F.lit(0))["_url"]


def published_at(raw: Column) -> Column:
    """The date of a feed item in UTC; NULL if it cannot be read."""
    day = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    return F.try_to_timestamp(F.regexp_replace(day, r"\s(GMT|UTC|UT|Z)$", " +0000"), F.lit(DATE_FORMAT))


def item_title(raw: Column) -> Column:
    """Only a missing or empty title is untitled; one of white space is trimmed to nothing."""
    return F.trim(F.when(F.coalesce(raw, F.lit("")) == "", "Untitled").otherwise(raw))


def episodes_of(items: DataFrame, feed_url: str | Column) -> DataFrame:
    """ord, feed_url, guid, title, audio_url, published_at, duration_seconds, dedup_key of items(item_pos, …), newest first;
    items without audio are left out, and undated ones come last. feed_url: the feed of all items, or a column."""
    audio = first_audio(F.col("enclosure"))
    rows = items.select(
        "item_pos",
        (F.lit(feed_url) if isinstance(feed_url, str) else feed_url).alias("feed_url"),
        F.coalesce(F.nullif(F.trim("guid"), F.lit("")), audio).alias("guid"),
        item_title(F.col("title")).alias("title"),
        audio.alias("audio_url"),
        published_at(F.col("pubDate")).alias("published_at"),
        duration_seconds(F.col("`itunes:duration`")).alias("duration_seconds"),
    ).filter("audio_url IS NOT NULL")
    rows = rows.withColumn("dedup_key", dedup_key(F.col("feed_url"), F.col("guid")))
    # one feed is one file of at most some thousand items
    from pyspark.sql import Window

    order = Window.partitionBy("feed_url").orderBy(F.col("published_at").desc_nulls_last(), "item_pos")
    return rows.withColumn("ord", F.row_number().over(order)).drop("item_pos")


def read_feed(spark: SparkSession, path: str, feed_url: str) -> DataFrame:
    """Episodes of an RSS file."""
    items = spark.read.format("xml").option("rowTag", "item").option("ignoreSurroundingSpaces", "false").schema(ITEM).load(path)
    return episodes_of(items.withColumn("item_pos", F.monotonically_increasing_id()), feed_url)


def newest(episodes: DataFrame, limit: int | None) -> DataFrame:
    """The newest `limit` episodes of each feed; 0 and None mean all."""
    return episodes.filter(F.col("ord") <= limit) if limit else episodes


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions, one JSON object a line; blank lines are skipped."""
    return spark.read.schema("question string, feed_url string, guid string, answer_time double, generator string").json(path).filter("question IS NOT NULL")


def write_golden(golden: DataFrame, path: str) -> None:
    golden.write.mode("overwrite").json(path)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """file, text of reference transcripts: blank lines and lines that begin with # left out, the others joined."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    kept = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return raw.select("file", F.array_join(kept, " ").alias("text"))


def read_cached_words(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, text, start, end of cached transcriptions (one JSON document a file)."""
    schema = "text string, words array<struct<text:string,start:double,end:double>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("words").alias("pos", "w"))
    return raw.select("file", "pos", "w.text", "w.start", "w.end")


def audio_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of landed audio files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def parse_transcription(raw: Column) -> Column:
    """struct<text, words> of a recogniser's JSON reply: words trimmed, missing words an empty array."""
    reply = F.from_json(raw, "text string, words array<struct<word:string,start:double,end:double>>")
    words = F.transform(reply["words"], lambda w: F.struct(F.trim(w["word"]).alias("text"), w["start"].alias("start"), w["end"].alias("end")))
    return F.struct(F.trim(reply["text"]).alias("text"), F.coalesce(words, F.array().cast("array<struct<text:string,start:double,end:double>>")).alias("words"))


def flatten_segments(segments: Column) -> Column:
    """struct<text, words> of an offline recogniser's segments<text, words>."""
    text = F.array_join(F.transform(segments, lambda s: F.trim(s["text"])), " ")
    return F.struct(text.alias("text"), F.flatten(F.transform(segments, lambda s: s["words"])).alias("words"))
