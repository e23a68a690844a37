"""Daily usage, budget guard, token buckets, fingerprints and verified copies."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_total
from .scan import scanned

LIMIT, RESERVE = 180_000, 2_500


def usage_daily(spends: DataFrame) -> DataFrame:
    """day, tokens, answers of spends(day, tokens)."""
    return spends.groupBy("day").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("answers"))


def merge_usage(table: DataFrame, more: DataFrame) -> DataFrame:
    """Two usage tables added up day by day."""
    return table.unionByName(more).groupBy("day").agg(F.sum("tokens").alias("tokens"), F.sum("answers").alias("answers"))


def budget_guard(spends: DataFrame, limit: int, reserve: int) -> DataFrame:
    """spends(id, ts, day, tokens) with used (the day's tokens before) and refused. Refused calls count as asked for. A day's
    calls are added up range by range, so that one busy day is not one task."""
    used = running_total(spends, "tokens", ["ts", "id"], "day", "used")
    used = used.withColumn("used", F.col("used") - F.coalesce("tokens", F.lit(0)))
    return used.withColumn("refused", F.col("used") + reserve > limit)


def strict_budget(spends: DataFrame, limit: int, reserve: int) -> DataFrame:
    """id, day, used, refused, where refused calls use nothing: one pass a day."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        used = 0
        for i, day, tokens, _ in rows:
            no = used + reserve > limit
            yield i, day, used, no
            used += 0 if no else tokens

    return scanned(spends.select("id", "day", "tokens", "ts"), "day", ["ts", "id"], run, "id bigint, day date, used bigint, refused boolean")


def take(tokens: float, since: float, capacity: float, rate: float) -> tuple[bool, float, float]:
    """(allowed, wait, tokens left) of one request, `since` seconds after the last."""
    tokens = min(capacity, tokens + since * rate)
    if tokens >= 1:
        return True, 0.0, tokens - 1
    return False, (1 - tokens) / rate, tokens


def token_bucket(requests: DataFrame, capacity: float, per_hour: float) -> DataFrame:
    """requests(id, key, ts_us) with allowed and wait: a bucket a key, full at first. One pass a key, since the cap makes
    the level depend on the order of requests."""
    rate = per_hour / 3600

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        level, last = capacity, None
        for i, _, ts in rows:
            allowed, wait, level = take(level, 0.0 if last is None else (ts - last) / 1e6, capacity, rate)
            last = ts
            yield i, allowed, wait

    return scanned(requests.select("id", "key", "ts_us"), "key", ["ts_us", "id"], run, "id bigint, allowed boolean, wait double")


#: Keys of a block of a fingerprint, and blocks of a block of blocks.
BLOCK = 4_096


def fingerprint(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """n, md5 of a table with a whole-number key: equal for equal tables, comparable with other engines.

    Rows as text are joined in the order of key and digested for each block of BLOCK keys, the digests of BLOCK blocks are
    joined and digested again, and those once more; so no task holds more than a block, or a row for each BLOCK**2 keys.
    """
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    now = df.select(F.col(key).cast("bigint").alias("k"), row.alias("r"), F.lit(1).cast("bigint").alias("n"))

    def digested(rows: DataFrame, *by: str) -> DataFrame:
        packed = rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "r"))).alias("all"))
        return packed.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.md5(F.array_join(F.col("all.r"), "|").cast("binary")).alias("r"))

    for _ in range(2):
        now = digested(now.withColumn("b", F.floor(F.col("k") / BLOCK)), "b").withColumnRenamed("b", "k")
    return digested(now).withColumnRenamed("r", "md5")


def wide_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """n, xor, total of row hashes: an order-free fingerprint that needs no sort and no gathering, for tables of any size."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def copy_verified(df: DataFrame, path: str, *columns: str) -> DataFrame:
    """Writes df to a path that must not exist, reads it back and compares fingerprints; raises if they differ."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if wide_fingerprint(df, *columns).first() != wide_fingerprint(back, *columns).first():
        raise ValueError(f"the copy at {path} differs from its source")
    return back


def next_id(df: DataFrame, key: str = "id") -> DataFrame:
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))
