"""What a server would answer, for many requests at once: admission, health, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import http_status
from ..operators.usage import LIMIT, RESERVE, budget_guard, token_bucket


def admit(requests: DataFrame, capacity: float, per_hour: float, limit: int = LIMIT, reserve: int = RESERVE) -> DataFrame:
    """id, outcome, status, retry_after of requests(id, key, ts, tokens): the rate limit first, then the day's budget over
    the requests that passed it."""
    limited = token_bucket(requests.select("id", "key", F.unix_micros("ts").alias("ts_us")), capacity, per_hour)
    passed = requests.join(limited.filter("allowed").select("id"), "id").withColumn("day", F.to_date("ts"))
    budget = budget_guard(passed.select("id", "ts", "day", "tokens"), limit, reserve).select("id", "refused")
    outcome = F.when(~F.col("allowed"), "limited").when(F.col("refused"), "budget").otherwise("ok")
    both = limited.join(budget, "id", "left").withColumn("outcome", outcome).withColumn("h", http_status(F.col("outcome"), F.col("wait")))
    return both.select("id", "outcome", "h.status", "h.retry_after")


def health(passages: DataFrame, mode: str = "hybrid") -> DataFrame:
    """One row: passages, embedded, mode."""
    return passages.agg(F.count("*").alias("passages"), F.count("embedding").alias("embedded")).withColumn("mode", F.lit(mode))


def listed(episodes: DataFrame, passages: DataFrame) -> DataFrame:
    """Searchable episodes, newest first, undated ones last."""
    from ..operators.catalogue import searchable

    return searchable(episodes, passages).orderBy(F.col("published_at").desc_nulls_last(), "id")
