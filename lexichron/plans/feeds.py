"""Queries over feed items made of the web pages, and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch, table
from ..sources import feeds as S
from ..sources.feedsource import read_feeds
from ..streaming import streams as X
from .base import ORACLES, query
from . import usage  # noqa: F401  (its SQL is shared)

_LINKS = r"""regexp_extract_all(html, 'href="([^"]*)"', 1)"""


@query("feed_items", rf"""WITH p AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS raw, {_LINKS} AS links FROM pages),
  a AS (SELECT page_id, CASE WHEN raw = '' THEN 'Untitled' ELSE trim(raw) END AS title, list_filter(list_transform(range(len(links)), lambda i: CASE WHEN i % 3 <> 0 AND links[i + 1] <> '' THEN links[i + 1] END), lambda x: x IS NOT NULL)[1] AS audio_url FROM p)
  SELECT page_id, title, audio_url FROM a WHERE audio_url IS NOT NULL""")
def feed_items(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    kind = lambda i: F.when(i % 3 == 0, "video/mp4").when(i % 3 == 1, "").otherwise("audio/mpeg")
    enclosures = F.transform(links, lambda x, i: F.struct(x.alias("_url"), kind(i).alias("_type")))
    rows = p.select("page_id", S.item_title(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title"), S.first_audio(enclosures).alias("audio_url"))
    return rows.filter("audio_url IS NOT NULL")


@query("published_at", "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN epoch(date_trunc('second', ts))::BIGINT - 7200 END AS at FROM events")
def published_at(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.when(F.col("event_id") % 9 == 0, "some day in May").otherwise(F.concat(F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200")))
    return e.select("event_id", F.unix_seconds(S.published_at(raw)).alias("at"))


#: Items of a feed file that the query writes.
FEED_ITEMS = 1_000


@query("fetch_feeds", """SELECT doc_id, 'guid-' || doc_id AS guid, 'Talk ' || doc_id AS title, 'https://audio.example/' || doc_id || '.mp3' AS audio_url, (doc_id % 5000)::INTEGER AS duration_seconds
  FROM documents WHERE doc_id % 7 <> 3""")
def fetch_feeds(spark, sf_dir):
    """Feeds of the documents, written as files and fetched from their URLs, one task a feed; every seventh item has no audio."""
    i = F.col("doc_id").cast("string")
    audio = F.when(F.col("doc_id") % 7 != 3, F.concat(F.lit('<enclosure url="https://audio.example/'), i, F.lit('.mp3" type="audio/mpeg"/>'))).otherwise("")
    item = F.concat(F.lit("<item><title>Talk "), i, F.lit("</title><guid>guid-"), i, F.lit("</guid>"), audio, F.lit("<itunes:duration>"), (F.col("doc_id") % 5_000).cast("string"), F.lit("</itunes:duration></item>"))
    d = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(F.floor(F.col("doc_id") / FEED_ITEMS).alias("feed"), "doc_id", item.alias("item"))
    files = d.groupBy("feed").agg(F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", "item")))["item"], "").alias("items"))
    head = '<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" version="2.0"><channel><title>t</title>'
    root = scratch(spark)
    files.select("feed", F.concat(F.lit(head), "items", F.lit("</channel></rss>")).alias("value")).repartition("feed").write.partitionBy("feed").text(root)
    # the shared folder as the executors see it; on a cluster that is a mounted path or a store that serves URLs
    urls = sorted(r.path for r in spark.read.format("binaryFile").load(f"{root}/*").select("path").collect())  # a path a feed
    made, _ = read_feeds(spark, urls)
    return made.select(F.regexp_extract("guid", r"\d+", 0).cast("bigint").alias("doc_id"), "guid", "title", "audio_url", "duration_seconds")


@query("usage_stream", ORACLES["usage_daily"])
def usage_stream(spark, sf_dir):
    return X.drain(X.usage_totals(X.read_events(spark, sf_dir)), "complete")


@query("token_bucket_stream", ORACLES["token_bucket"])
def token_bucket_stream(spark, sf_dir):
    e = X.read_events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")
    return X.drain(X.bucket_stream(e, 2.0, 0.5))


@query("first_of_each_stream", "SELECT event_id FROM events")
def first_of_each_stream(spark, sf_dir):
    twice = X.read_events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return X.drain(X.first_of_each(twice, "event_id")).select("event_id")


OPS = ("claim", "fail", "claim", "defer", "claim", "complete")
#: The state machine as one recursive step an event: {order} of events, {before} what time alone has changed, {ready} whether a
#: job may be claimed.
MACHINE_SQL = """WITH RECURSIVE e AS (SELECT user_id AS job_id, event_id AS seq, ts, {ops}[event_id % 6 + 1] AS op, event_id % 3 AS lease, event_id % 11 = 0 AS permanent, (event_id % 7 * 100000)::BIGINT AS seconds,
    row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS k FROM events),
  s AS (
    SELECT job_id, 0::BIGINT AS k, 'queued' AS status, 0 AS attempts, 0::BIGINT AS lease, TIMESTAMP '1970-01-01' AS run_after, TIMESTAMP '1970-01-01' AS locked, 0::BIGINT AS seq, '' AS outcome FROM (SELECT DISTINCT job_id FROM e)
    UNION ALL
    SELECT job_id, k, CASE outcome WHEN 'claimed' THEN 'running' WHEN 'done' THEN 'done' WHEN 'deferred' THEN 'queued' WHEN 'failed' THEN 'failed' WHEN 'retrying' THEN 'queued' ELSE status END,
      attempts + (outcome = 'claimed')::INT - (outcome = 'deferred')::INT, lease + (outcome = 'claimed')::INT,
      CASE outcome WHEN 'retrying' THEN ts + INTERVAL 30 SECOND * (2 ** (attempts - 1))::INT WHEN 'deferred' THEN ts + INTERVAL 1 SECOND * seconds ELSE run_after END,
      CASE WHEN outcome = 'claimed' THEN ts ELSE locked END, seq, outcome
    FROM (SELECT *, CASE WHEN op = 'claim' THEN CASE WHEN status <> 'queued' THEN 'ignored' WHEN {ready} THEN 'claimed' ELSE 'not_ready' END
        WHEN status <> 'running' OR event_lease <> lease THEN 'lease_lost' WHEN op = 'complete' THEN 'done' WHEN op = 'defer' THEN 'deferred' WHEN permanent OR attempts >= 3 THEN 'failed' ELSE 'retrying' END AS outcome
      FROM (SELECT e.job_id, e.k, e.seq, e.ts, e.op, e.lease AS event_lease, e.permanent, e.seconds, s.attempts, s.lease, s.locked, {before}
        FROM s JOIN e ON e.job_id = s.job_id AND e.k = s.k + 1)))
  SELECT seq, job_id, outcome, status, attempts, lease FROM s WHERE k > 0"""
#: A lease of the query's timed jobs.
STALE_DAYS = 6


def queue_events(spark, sf_dir):
    ops = F.element_at(F.array(*map(F.lit, OPS)), (F.col("event_id") % 6 + 1).cast("int"))
    e = F.col("event_id")
    return X.read_events(spark, sf_dir).select(
        F.col("user_id").alias("job_id"), e.alias("seq"), "ts", ops.alias("op"), (e % 3).alias("lease"), (e % 11 == 0).alias("permanent"), (e % 7 * 100_000).cast("double").alias("seconds")
    )


@query("job_stream", MACHINE_SQL.format(ops=list(OPS), order="event_id", ready="true", before="s.status, s.run_after"))
def job_stream(spark, sf_dir):
    return X.drain(X.job_stream(queue_events(spark, sf_dir)))


_STALE = f"(s.status = 'running' AND s.locked + INTERVAL {STALE_DAYS} DAY <= e.ts)"


@query("timed_job_stream", MACHINE_SQL.format(
    ops=list(OPS), order="ts, event_id", ready="run_after <= ts",
    before=f"CASE WHEN {_STALE} THEN CASE WHEN s.attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE s.status END AS status, CASE WHEN {_STALE} THEN s.locked + INTERVAL {STALE_DAYS} DAY ELSE s.run_after END AS run_after",
))
def timed_job_stream(spark, sf_dir):
    """The events' rows; whether a timer or the next event takes a job back makes no difference to them."""
    made = X.drain(X.timed_job_stream(queue_events(spark, sf_dir), STALE_DAYS * 86_400), conf=X.ROCKS)
    return made.filter("seq IS NOT NULL").select("seq", "job_id", "outcome", "status", "attempts", "lease")
