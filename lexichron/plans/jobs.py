"""Queries over the job queue and the catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import dedup_key, duration_seconds, failure_class
from ..operators import catalogue as K
from ..operators import jobs as J
from ..operators.sequence import shift_words as shifted
from ..session import scratch
from ..sources import index, store
from ..sources.feeds import flatten_segments as flattened
from ..sources.feeds import parse_transcription as parsed
from . import corpus as C
from . import sequences  # noqa: F401  (its passages query comes first)
from .base import ORACLES, query

JOBS_SQL = f"""
jobs AS (SELECT event_id AS id, user_id AS episode_id, event_type AS kind, ['queued', 'running', 'done', 'failed'][event_id % 4 + 1] AS status, ((event_id // 4) % 4)::INTEGER AS attempts,
  ((event_id // 4) % 7)::BIGINT AS lease, 3 AS max_attempts, ts AS run_after, CASE WHEN event_id % 4 = 1 THEN ts END AS locked_at, CASE WHEN event_id % 4 = 1 THEN 'w' || event_id % 5 END AS locked_by,
  TIMESTAMP '{C.NOW}' AS now FROM events)
"""
#: Results that workers report: of every job, under its lease or one before it.
RESULT_SQL = "result AS (SELECT *, lease - (id % 3 = 0)::INT AS result_lease, status = 'running' AND id % 3 <> 0 AS held, id % 11 = 0 AS permanent, (id % 50 - 5)::DOUBLE AS seconds FROM jobs)"


def results(jobs):
    return jobs.select("id", (F.col("lease") - (F.col("id") % 3 == 0).cast("int")).alias("lease"), (F.col("id") % 11 == 0).alias("permanent"), (F.col("id") % 50 - 5).cast("double").alias("seconds"))


@query("claim_next", f"""WITH {JOBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY run_after, id) AS r FROM jobs WHERE status = 'queued' AND run_after <= now)
  SELECT id, kind, 'running' AS status, attempts + 1 AS attempts, lease + 1 AS lease, 'w' || r AS locked_by FROM r WHERE r <= 4""")
def claim_next(spark, sf_dir):
    return J.claims(C.jobs(spark, sf_dir), C.now(), 4).select("id", "kind", "status", "attempts", "lease", "locked_by")


@query("complete_jobs", f"WITH {JOBS_SQL}, {RESULT_SQL} SELECT id, CASE WHEN held THEN 'done' ELSE status END AS status, CASE WHEN held THEN 'done' ELSE 'lease_lost' END AS outcome FROM result")
def complete_jobs(spark, sf_dir):
    j = C.jobs(spark, sf_dir)
    return J.complete(j, results(j).select("id", "lease"))


@query("fail_backoff", f"""WITH {JOBS_SQL}, {RESULT_SQL}, f AS (SELECT *, permanent OR attempts >= max_attempts AS final FROM result)
  SELECT id, CASE WHEN NOT held THEN status WHEN final THEN 'failed' ELSE 'queued' END AS status,
    epoch_us(CASE WHEN held AND NOT final THEN now + to_microseconds((30000000 * pow(2, attempts - 1))::BIGINT) ELSE run_after END) AS run_after_us,
    CASE WHEN NOT held THEN 'lease_lost' WHEN final THEN 'failed' ELSE 'retrying' END AS outcome FROM f""")
def fail_backoff(spark, sf_dir):
    j = C.jobs(spark, sf_dir)
    return J.fail(j, results(j).select("id", "lease", "permanent"), C.now()).select("id", "status", F.unix_micros("run_after").alias("run_after_us"), "outcome")


@query("defer_jobs", f"""WITH {JOBS_SQL}, {RESULT_SQL}
  SELECT id, CASE WHEN held THEN 'queued' ELSE status END AS status, CASE WHEN held THEN attempts - 1 ELSE attempts END AS attempts, lease,
    epoch_us(CASE WHEN held THEN now + to_microseconds((greatest(0, seconds) * 1000000)::BIGINT) ELSE run_after END) AS run_after_us, CASE WHEN held THEN 'deferred' ELSE 'lease_lost' END AS outcome FROM result""")
def defer_jobs(spark, sf_dir):
    j = C.jobs(spark, sf_dir)
    d = J.defer(j, results(j).select("id", "lease", "seconds"), C.now())
    return d.select("id", "status", "attempts", "lease", F.unix_micros("run_after").alias("run_after_us"), "outcome")


@query("reclaim_stale", f"""WITH {JOBS_SQL} SELECT id, CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'queued' END AS status, epoch_us(now) AS run_after_us,
  'reclaimed: worker ' || coalesce(locked_by, 'unknown') || ' held the job since ' || strftime(locked_at, '%Y-%m-%d %H:%M:%S') AS last_error
  FROM jobs WHERE status = 'running' AND locked_at < now - INTERVAL 30 MINUTE""")
def reclaim_stale(spark, sf_dir):
    r = J.reclaim(C.jobs(spark, sf_dir), C.now())
    return r.select("id", "status", F.unix_micros("run_after").alias("run_after_us"), "last_error")


@query("reclaim_counts", f"""WITH {JOBS_SQL} SELECT CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'queued' END AS status, count(*) AS n
  FROM jobs WHERE status = 'running' AND locked_at < now - INTERVAL 30 MINUTE GROUP BY 1""")
def reclaim_counts(spark, sf_dir):
    return J.status_report(J.reclaim(C.jobs(spark, sf_dir), C.now()))


@query("jobs_after_reclaim", f"""WITH {JOBS_SQL} SELECT id, CASE WHEN status = 'running' AND locked_at < now - INTERVAL 30 MINUTE THEN CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'queued' END ELSE status END AS status, attempts, lease FROM jobs""")
def jobs_after_reclaim(spark, sf_dir):
    j = C.jobs(spark, sf_dir)
    return J.apply_changes(j, J.reclaim(j, C.now())).select("id", "status", "attempts", "lease")


@query("status_report", f"WITH {JOBS_SQL} SELECT status, count(*) AS n FROM jobs GROUP BY status")
def status_report(spark, sf_dir):
    return J.status_report(C.jobs(spark, sf_dir))


@query("unfinished_jobs", f"WITH {JOBS_SQL} SELECT count(*) AS unfinished FROM jobs WHERE status IN ('queued', 'running')")
def unfinished_jobs(spark, sf_dir):
    return J.unfinished(C.jobs(spark, sf_dir))


@query("enqueue_missing", f"""WITH {JOBS_SQL} SELECT DISTINCT u.c_custkey AS episode_id, k.kind FROM customer u, (VALUES ('click'), ('view'), ('transcribe')) k(kind)
  WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.episode_id = u.c_custkey AND j.kind = k.kind)""")
def enqueue_missing(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    wanted = c.select(F.col("c_custkey").alias("episode_id"), F.explode(F.array(*map(F.lit, ("click", "view", "transcribe")))).alias("kind"))
    return J.enqueue(C.jobs(spark, sf_dir), wanted)


@query("worker_routes", """WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'rate_limited' WHEN 'signup' THEN 'lease_lost' WHEN 'error' THEN 'permanent' ELSE 'network' END AS error, CASE WHEN event_id % 2 = 0 THEN value END AS after FROM events)
  SELECT event_id, CASE WHEN error IS NULL THEN 'done' WHEN error = 'rate_limited' THEN 'deferred' WHEN error = 'lease_lost' THEN 'lease_lost' WHEN error = 'permanent' THEN 'failed' ELSE 'retrying' END AS outcome,
    CASE WHEN error = 'rate_limited' THEN greatest(0.0::DOUBLE, coalesce(after, 60.0::DOUBLE)) END AS wait_s FROM e""")
def worker_routes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.col("event_type")
    error = F.when(t == "click", None).when(t == "view", "rate_limited").when(t == "signup", "lease_lost").when(t == "error", "permanent").otherwise("network")
    return e.select("event_id", J.route(error, F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("r")).select("event_id", "r.outcome", "r.wait_s")


@query("outcome_http", """SELECT event_id, CASE event_type WHEN 'click' THEN 429 WHEN 'view' THEN 503 WHEN 'signup' THEN 503 WHEN 'error' THEN 502 ELSE 200 END AS status,
  CASE WHEN event_type IN ('click', 'signup') THEN floor(value)::INTEGER + 1 END AS retry_after FROM events""")
def outcome_http(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.col("event_type")
    outcome = F.when(t == "click", "limited").when(t == "view", "budget").when(t == "signup", "rate_limited").when(t == "error", "model_error").otherwise("ok")
    return e.select("event_id", J.http_status(outcome, F.col("value")).alias("h")).select("event_id", "h.status", "h.retry_after")


@query("failure_classes", """WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 500 ELSE 503 END AS status,
    CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN value::VARCHAR WHEN 2 THEN 'soon' ELSE '-5' END AS after FROM events)
  SELECT event_id, CASE WHEN status IS NULL OR status >= 500 THEN 'retryable' WHEN status = 429 THEN 'rate_limited' WHEN status >= 400 THEN 'permanent' ELSE 'ok' END AS kind,
    CASE WHEN status = 429 THEN greatest(0.0::DOUBLE, coalesce(try_cast(after AS DOUBLE), 60.0::DOUBLE)) END AS wait FROM e""")
def failure_classes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    status = F.when(i % 6 == 1, 200).when(i % 6 == 2, 404).when(i % 6 == 3, 429).when(i % 6 == 4, 500).when(i % 6 == 5, 503)
    after = F.when(i % 4 == 1, F.col("value").cast("string")).when(i % 4 == 2, "soon").when(i % 4 == 3, "-5")
    return e.select("event_id", failure_class(status, after, 60).alias("f")).select("event_id", "f.kind", "f.wait")


@query("dedup_keys", "SELECT doc_id AS id, sha256(source || chr(10) || 'doc-' || doc_id) AS dedup_key FROM documents")
def dedup_keys(spark, sf_dir):
    return C.episodes(spark, sf_dir).select("id", "dedup_key")


_RAW = "CASE event_id % 7 WHEN 0 THEN floor(value)::INTEGER || '' WHEN 1 THEN event_id % 60 || ':' || event_id % 59 WHEN 2 THEN '1:' || event_id % 60 || ':0' || event_id % 10 WHEN 3 THEN '  90 ' WHEN 4 THEN 'about an hour' WHEN 5 THEN '' ELSE '-' || event_id END"


@query("parse_duration", rf"""WITH r AS (SELECT event_id, {_RAW} AS raw FROM events), p AS (SELECT *, string_split(trim(raw), ':') AS p FROM r)
  SELECT event_id, raw, CASE WHEN len(list_filter(p, lambda x: NOT regexp_full_match(x, '\s*[+-]?[0-9.]+\s*'))) = 0 AND list_reduce(list_transform(p, lambda x: trunc(try_cast(x AS DOUBLE))::BIGINT), lambda a, x: a * 60 + x) >= 0
    THEN list_reduce(list_transform(p, lambda x: trunc(try_cast(x AS DOUBLE))::BIGINT), lambda a, x: a * 60 + x)::INTEGER END AS seconds FROM p""")
def parse_duration(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.expr(
        "CASE event_id % 7 WHEN 0 THEN cast(floor(value) AS string) WHEN 1 THEN concat(event_id % 60, ':', event_id % 59) WHEN 2 THEN concat('1:', event_id % 60, ':0', event_id % 10)"
        " WHEN 3 THEN '  90 ' WHEN 4 THEN 'about an hour' WHEN 5 THEN '' ELSE concat('-', event_id) END"
    )
    return e.select("event_id", raw.alias("raw")).withColumn("seconds", duration_seconds(F.col("raw")))


FEED_SQL = """feed AS (SELECT doc_id + 1 AS ord, source AS feed_url, 'doc-' || (doc_id % 700) AS guid, sha256(source || chr(10) || 'doc-' || (doc_id % 700)) AS dedup_key FROM documents),
held AS (SELECT sha256(source || chr(10) || 'doc-' || doc_id) AS dedup_key FROM documents WHERE doc_id % 3 = 0)"""


def feed(spark, sf_dir):
    """A feed with repeats, and the keys a catalogue already holds."""
    e = spark.read.parquet(f"{sf_dir}/documents.parquet")
    guid = F.concat(F.lit("doc-"), (F.col("doc_id") % 700).cast("string"))
    rows = e.select((F.col("doc_id") + 1).alias("ord"), F.col("source").alias("feed_url"), guid.alias("guid"), dedup_key(F.col("source"), guid).alias("dedup_key"))
    return rows, C.episodes(spark, sf_dir).filter("id % 3 = 0").select("dedup_key")


@query("insert_if_absent", f"WITH {FEED_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY ord) AS n FROM feed) SELECT dedup_key, ord, feed_url, guid FROM x WHERE n = 1 AND dedup_key NOT IN (SELECT dedup_key FROM held)")
def insert_if_absent(spark, sf_dir):
    return K.insert_if_absent(*feed(spark, sf_dir), "dedup_key", "ord")


@query("ingest_counts", f"WITH {FEED_SQL} SELECT count(DISTINCT dedup_key) FILTER (dedup_key NOT IN (SELECT dedup_key FROM held)) AS new, count(*) - count(DISTINCT dedup_key) FILTER (dedup_key NOT IN (SELECT dedup_key FROM held)) AS skipped FROM feed")
def ingest_counts(spark, sf_dir):
    return K.ingest_counts(*feed(spark, sf_dir), "dedup_key", "ord")


PLAN_SQL = """plan AS (SELECT conv_id AS episode_id, turn AS idx, turn * 1000 AS start_ms, turn * 1000 + length(text) AS end_ms, md5(role) AS sha256 FROM conversations),
saved AS (SELECT episode_id, idx, start_ms, CASE WHEN episode_id % 5 = 0 AND idx = 1 THEN end_ms + 1 ELSE end_ms END AS end_ms, CASE WHEN episode_id % 7 = 0 AND idx = 0 THEN 'other' ELSE sha256 END AS sha256 FROM plan WHERE idx % 3 <> 2)"""


def plan_and_saved(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan = c.select(
        F.col("conv_id").alias("episode_id"), F.col("turn").alias("idx"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + F.length("text")).alias("end_ms"), F.md5(F.col("role").cast("binary")).alias("sha256")
    )
    moved = F.when((F.col("episode_id") % 5 == 0) & (F.col("idx") == 1), F.col("end_ms") + 1).otherwise(F.col("end_ms"))
    other = F.when((F.col("episode_id") % 7 == 0) & (F.col("idx") == 0), "other").otherwise(F.col("sha256"))
    return plan, plan.filter("idx % 3 <> 2").withColumns({"end_ms": moved, "sha256": other})


@query("checkpoint_diff", f"""WITH {PLAN_SQL}, j AS (SELECT s.episode_id, bool_or(p.episode_id IS NULL OR p.sha256 <> s.sha256) AS stale FROM saved s LEFT JOIN plan p USING (episode_id, idx, start_ms, end_ms) GROUP BY 1)
  SELECT p.episode_id, p.idx FROM plan p WHERE NOT EXISTS (SELECT 1 FROM saved s JOIN j ON j.episode_id = s.episode_id AND NOT stale WHERE s.episode_id = p.episode_id AND s.idx = p.idx AND s.start_ms = p.start_ms AND s.end_ms = p.end_ms)""")
def checkpoint_diff(spark, sf_dir):
    plan, saved = plan_and_saved(spark, sf_dir)
    return K.checkpoint_diff(saved, plan)


@query("episodes_to_index", f"WITH {JOBS_SQL} SELECT DISTINCT episode_id FROM jobs WHERE status = 'done' AND kind = 'signup' AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = episode_id)")
def episodes_to_index(spark, sf_dir):
    j = C.jobs(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "signup", "transcribe").otherwise(F.col("kind")))
    return K.to_index(j, C.chunks(spark, sf_dir))


@query("searchable_episodes", "SELECT doc_id AS id, source AS feed_url FROM documents WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = doc_id)")
def searchable_episodes(spark, sf_dir):
    return K.searchable(C.episodes(spark, sf_dir), C.chunks(spark, sf_dir)).select("id", "feed_url")


@query("cascade_delete", "SELECT conv_id AS episode_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')) GROUP BY conv_id")
def cascade_delete(spark, sf_dir):
    gone = C.episodes(spark, sf_dir).filter("feed_url IN ('src1', 'src2')")
    return K.cascade(C.chunks(spark, sf_dir), gone).groupBy("episode_id").agg(F.count("*").alias("n"))


@query("save_episodes", f"WITH {FEED_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY ord) AS n FROM feed) SELECT ord AS episode_id, 'transcribe' AS kind FROM x WHERE n = 1 AND dedup_key NOT IN (SELECT dedup_key FROM held)")
def save_episodes(spark, sf_dir):
    rows, held = feed(spark, sf_dir)
    jobs = C.jobs(spark, sf_dir).select("episode_id", "kind")
    return K.save_episodes(rows.withColumn("id", F.col("ord")), held, jobs)[1]


@query("update_durations", """WITH m AS (SELECT user_id, max(floor(value)::INTEGER) AS d FROM events GROUP BY user_id)
  SELECT doc_id AS id, coalesce(d, (n_chars % 90)::INTEGER) AS duration_seconds FROM documents LEFT JOIN m ON user_id = doc_id""")
def update_durations(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 90).cast("int").alias("duration_seconds"))
    measured = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("episode_id"), F.floor("value").cast("int").alias("duration_seconds"))
    return K.update_durations(d, measured)


_NO_WITH = ORACLES["passages"].replace("WITH RECURSIVE ", "", 1)


@query("index_new", f"SELECT count(DISTINCT episode_id) AS episodes, count(*) AS passages FROM (WITH RECURSIVE {_NO_WITH}) WHERE episode_id % 3 <> 0 AND episode_id % 4 <> 1")
def index_new(spark, sf_dir):
    """Stores transcripts and jobs, indexes what is finished in two runs, and counts what the second one stored."""
    root, t = scratch(spark), C.transcripts(spark, sf_dir)
    store.apply_schema(spark, root)
    # known by its tokens: the words would be made twice for a look at whether they are there
    said = t.filter("episode_id IS NOT NULL AND tokens IS NOT NULL")
    word = lambda x: F.struct(x["tokens"].alias("text"), (x["starts"] / 1000).alias("start"), (x["ends"] / 1000).alias("end"))
    chunk = said.select(
        "episode_id", F.lit(0).alias("idx"), F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"), F.lit("").alias("text"), F.transform(F.arrays_zip("tokens", "starts", "ends"), word).alias("words"), F.lit("m").alias("model"), F.lit("x").alias("audio_sha256")
    )
    store.append(chunk, root, "chunks")
    job = t.select(F.col("episode_id").alias("id"), "episode_id", F.lit("transcribe").alias("kind"), F.when(F.col("episode_id") % 3 != 0, "done").otherwise("queued").alias("status"))
    job = job.select("*", F.lit(1).alias("attempts"), F.lit(1).alias("lease"), F.lit(3).alias("max_attempts"), *[F.lit(None).alias(c) for c in ("run_after", "locked_at", "locked_by", "last_error")])
    for turn in (F.col("episode_id") % 4 == 1, F.col("episode_id") % 4 != 1):
        store.append(job.filter(turn), root, "jobs")
        index.index_new(spark, root)
    made = store.load(spark, root, "passages").filter("episode_id % 4 <> 1")
    return made.agg(F.count_distinct("episode_id").alias("episodes"), F.count("*").alias("passages"))


@query("shift_words", """SELECT event_id, round(value + user_id, 3) AS "start", round(value + 0.5 + user_id, 3) AS "end" FROM events""")
def shift_words(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    word = F.array(F.struct(F.col("event_type").alias("text"), F.col("value").alias("start"), (F.col("value") + 0.5).alias("end")))
    return e.select("event_id", F.get(shifted(word, F.col("user_id")), F.lit(0)).alias("w")).select("event_id", "w.start", "w.end")


@query("parse_transcription", """SELECT doc_id, trim(text) AS text, 1 AS words, source AS first_word FROM documents WHERE text IS NOT NULL""")
def parse_transcription(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    word = F.struct(F.concat(F.lit(" "), "source", F.lit(" ")).alias("word"), F.lit(0.5).alias("start"), F.lit(1.0).alias("end"))
    reply = parsed(F.to_json(F.struct(F.concat(F.lit("  "), "text").alias("text"), F.array(word).alias("words"))))
    return d.select("doc_id", reply.alias("r")).select("doc_id", "r.text", F.size("r.words").alias("words"), F.get("r.words", F.lit(0))["text"].alias("first_word"))


@query("flatten_segments", """SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS text, count(*)::INTEGER AS words FROM conversations GROUP BY conv_id""")
def flatten_segments(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    segment = F.struct("turn", F.concat(F.lit(" "), "text").alias("text"), F.array(F.struct(F.col("role").alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))).alias("words"))
    packed = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(segment)).alias("s"))
    return packed.select("conv_id", flattened(F.col("s")).alias("f")).select("conv_id", "f.text", F.size("f.words").alias("words"))
