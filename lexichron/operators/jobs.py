"""The job queue as pure steps over a jobs table: each takes the table and a given time, and returns rows.

Spark is the single writer of a step, so "skip what another worker holds" becomes "the r-th ready job goes to the r-th
worker". A result counts only if the job still runs under the same lease; leases never go down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKOFF_S, STALE_S = 30, 30 * 60


def after_seconds(now: Column, seconds: Column) -> Column:
    return now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def ready(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter((F.col("status") == "queued") & (F.col("run_after") <= now))


def claims(jobs: DataFrame, now: Column, workers: int) -> DataFrame:
    """The claimed rows in their new state: of each kind the `workers` oldest ready jobs, one a worker."""
    place = Window.partitionBy("kind").orderBy("run_after", "id")
    mine = ready(jobs, now).withColumn("r", F.row_number().over(place)).filter(F.col("r") <= workers)
    return mine.withColumns(
        {
            "status": F.lit("running"),
            "attempts": F.col("attempts") + 1,
            "lease": F.col("lease") + 1,
            "locked_at": now,
            "locked_by": F.concat(F.lit("w"), F.col("r").cast("string")),
        }
    ).drop("r")


def fenced(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs joined with results(id, lease, …): adds `held`, false where the lease or the status has moved on."""
    r = results.withColumnRenamed("lease", "result_lease")
    return jobs.join(r, "id").withColumn("held", (F.col("status") == "running") & (F.col("lease") == F.col("result_lease")))


def complete(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """id, status, outcome of results(id, lease): done, or lease_lost without a change."""
    f = fenced(jobs, results)
    return f.select("id", F.when(F.col("held"), "done").otherwise(F.col("status")).alias("status"), F.when(F.col("held"), "done").otherwise("lease_lost").alias("outcome"))


def fail(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """id, status, run_after, outcome of results(id, lease, permanent): failed for good, or queued with a doubled wait."""
    f = fenced(jobs, results)
    final = F.col("permanent") | (F.col("attempts") >= F.col("max_attempts"))
    wait = F.lit(BACKOFF_S) * F.pow(F.lit(2.0), F.col("attempts") - 1)
    return f.select(
        "id",
        F.when(~F.col("held"), F.col("status")).when(final, "failed").otherwise("queued").alias("status"),
        F.when(F.col("held") & ~final, after_seconds(now, wait)).otherwise(F.col("run_after")).alias("run_after"),
        F.when(~F.col("held"), "lease_lost").when(final, "failed").otherwise("retrying").alias("outcome"),
    )


def defer(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """id, status, attempts, lease, run_after, outcome of results(id, lease, seconds): queued again, the attempt given back."""
    f = fenced(jobs, results)
    wait = F.greatest(F.lit(0.0), F.col("seconds").cast("double"))
    return f.select(
        "id",
        F.when(F.col("held"), "queued").otherwise(F.col("status")).alias("status"),
        F.when(F.col("held"), F.col("attempts") - 1).otherwise(F.col("attempts")).alias("attempts"),
        "lease",
        F.when(F.col("held"), after_seconds(now, wait)).otherwise(F.col("run_after")).alias("run_after"),
        F.when(F.col("held"), "deferred").otherwise("lease_lost").alias("outcome"),
    )


def reclaim(jobs: DataFrame, now: Column, stale_s: int = STALE_S) -> DataFrame:
    """id, status, run_after, last_error of the running jobs held for too long, as they are after it."""
    old = jobs.filter((F.col("status") == "running") & (F.col("locked_at") < now - F.make_dt_interval(secs=F.lit(stale_s).cast("decimal(18,6)"))))
    said = F.concat(F.lit("reclaimed: worker "), F.coalesce("locked_by", F.lit("unknown")), F.lit(" held the job since "), F.date_format("locked_at", "yyyy-MM-dd HH:mm:ss"))
    return old.select("id", F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("queued").alias("status"), now.alias("run_after"), said.alias("last_error"))


def apply_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """jobs with the columns of changes(id, …) in place of their own."""
    names = [c for c in changes.columns if c in jobs.columns and c != "id"]
    new = changes.select("id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in names])
    both = jobs.join(new, "id", "left")
    out = [F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in jobs.columns]
    return both.select(*out)


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(episode_id, kind) without those that have a job, each once."""
    return wanted.distinct().join(jobs.select("episode_id", "kind"), ["episode_id", "kind"], "left_anti")


def status_report(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def unfinished(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin("queued", "running")).alias("unfinished"))


def route(error: Column, retry_after: Column) -> Column:
    """What a worker does after a run: struct<outcome, wait_s> from the error's kind."""
    outcome = F.when(error.isNull(), "done").when(error == "rate_limited", "deferred").when(error == "lease_lost", "lease_lost").when(error == "permanent", "failed").otherwise("retrying")
    return F.struct(outcome.alias("outcome"), F.when(error == "rate_limited", F.greatest(F.lit(0.0), F.coalesce(retry_after, F.lit(60.0)))).alias("wait_s"))


def http_status(outcome: Column, wait: Column) -> Column:
    """struct<status, retry_after> of a served question."""
    after = F.floor(wait).cast("int") + 1
    status = F.when(outcome == "limited", 429).when(outcome.isin("budget", "rate_limited"), 503).when(outcome == "model_error", 502).otherwise(200)
    return F.struct(status.alias("status"), F.when(outcome.isin("limited", "rate_limited"), after).alias("retry_after"))


def retry_waits(tries: int = 4) -> list[int]:
    """Seconds before each further try of a call to a model: 1, 2, 4, 8."""
    return [2**i for i in range(tries)]
