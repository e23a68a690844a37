"""Queries over usage, limits and fingerprints, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clock, client_key, valid_request
from ..operators import usage as U
from . import corpus as C
from .base import query

SPEND_SQL = "spend AS (SELECT event_id AS id, ts, ts::DATE AS day, floor(value)::BIGINT AS tokens FROM events WHERE event_type = 'purchase')"


@query("usage_daily", f"WITH {SPEND_SQL} SELECT day, sum(tokens)::BIGINT AS tokens, count(*) AS answers FROM spend GROUP BY day")
def usage_daily(spark, sf_dir):
    return U.usage_daily(C.spends(spark, sf_dir))


@query("usage_merge", f"WITH {SPEND_SQL} SELECT day, (2 * sum(tokens))::BIGINT AS tokens, (2 * count(*))::BIGINT AS answers FROM spend GROUP BY day")
def usage_merge(spark, sf_dir):
    day = U.usage_daily(C.spends(spark, sf_dir))
    return U.merge_usage(day, day)


@query("budget_guard", f"""WITH {SPEND_SQL}, u AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY day ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM spend)
  SELECT id, used, used + 25 > 1800 AS refused FROM u""")
def budget_guard(spark, sf_dir):
    return U.budget_guard(C.spends(spark, sf_dir), 1_800, 25).select("id", "used", "refused")


@query("strict_budget", f"""WITH RECURSIVE {SPEND_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, id) AS k FROM spend),
  w(id, day, k, used, refused, spent) AS (
    SELECT id, day, k, 0::BIGINT, 25 > 1800, tokens FROM o WHERE k = 1
    UNION ALL SELECT o.id, o.day, o.k, w.spent, w.spent + 25 > 1800, w.spent + CASE WHEN w.spent + 25 > 1800 THEN 0 ELSE o.tokens END FROM w JOIN o ON o.day = w.day AND o.k = w.k + 1)
  SELECT id, used, refused FROM w""")
def strict_budget(spark, sf_dir):
    return U.strict_budget(C.spends(spark, sf_dir), 1_800, 25).select("id", "used", "refused")


@query("token_bucket", """WITH RECURSIVE o AS (SELECT event_id AS id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  w(id, user_id, k, t, level, allowed, wait) AS (
    SELECT id, user_id, k, t, 1.0::DOUBLE, true, 0.0::DOUBLE FROM o WHERE k = 1
    UNION ALL SELECT o.id, o.user_id, o.k, o.t, CASE WHEN x.v >= 1 THEN x.v - 1 ELSE x.v END, x.v >= 1, CASE WHEN x.v >= 1 THEN 0.0 ELSE (1 - x.v) / (0.5::DOUBLE / 3600) END
    FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1, LATERAL (SELECT least(2.0::DOUBLE, w.level + ((o.t - w.t) / 1e6::DOUBLE) * (0.5::DOUBLE / 3600)) AS v) x)
  SELECT id, allowed, wait FROM w""")
def token_bucket(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    r = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return U.token_bucket(r, 2.0, 0.5)


@query("client_key", """WITH e AS (SELECT event_id, 'p' || user_id AS peer, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '6.6.6.6, 198.51.100.' || user_id || ', 10.1.2.3' WHEN 2 THEN ' , 7.7.7.' || user_id ELSE ' ,, ' END AS xff, event_id % 3 AS hops, event_id % 5 <> 0 AS trusted FROM events),
  x AS (SELECT *, list_filter(list_transform(string_split(xff, ','), lambda s: trim(s)), lambda s: s <> '') AS parts FROM e)
  SELECT event_id, CASE WHEN trusted AND len(parts) > 0 THEN parts[greatest(len(parts) - hops, 0) + 1] ELSE peer END AS key FROM x""")
def client_keys(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.col("user_id").cast("string")
    i = F.col("event_id")
    xff = F.when(i % 4 == 1, F.concat(F.lit("6.6.6.6, 198.51.100."), u, F.lit(", 10.1.2.3"))).when(i % 4 == 2, F.concat(F.lit(" , 7.7.7."), u)).when(i % 4 == 3, " ,, ")
    return e.select("event_id", client_key(F.concat(F.lit("p"), u), xff, (i % 3).cast("int"), i % 5 != 0).alias("key"))


@query("clock", "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock FROM (SELECT event_id, floor(value * 20)::BIGINT AS s FROM events)")
def clocks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", clock(F.col("value") * 20).alias("clock"))


@query("valid_requests", "SELECT item_id, coalesce(length(text) BETWEEN 3 AND 300 AND coalesce(nullif(item_id % 13, 12), 5) BETWEEN 1 AND 10, false) AS valid FROM benchmark")
def valid_requests(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    k = F.when(F.col("item_id") % 13 != 12, F.col("item_id") % 13)
    return b.select("item_id", valid_request(F.col("text"), k).alias("valid"))


@query("fingerprint", f"""WITH a AS (SELECT o_orderkey // {U.BLOCK} AS b, count(*) AS n, md5(string_agg(concat_ws(',', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority), '|' ORDER BY o_orderkey)) AS d FROM orders GROUP BY 1),
  c AS (SELECT b // {U.BLOCK} AS c, sum(n) AS n, md5(string_agg(d, '|' ORDER BY b)) AS d FROM a GROUP BY 1)
  SELECT coalesce(sum(n), 0)::BIGINT AS n, md5(coalesce(string_agg(d, '|' ORDER BY c), '')) AS md5 FROM c""")
def fingerprint(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return U.fingerprint(o, "o_orderkey", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("copy_verify", "SELECT count(*) AS n, true AS same FROM events")
def copy_verify(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    a = U.wide_fingerprint(e, *e.columns)
    b = U.wide_fingerprint(e.repartition(7, "user_id"), *e.columns).selectExpr("n AS n2", "xor AS x2", "total AS t2")
    return a.crossJoin(b).select("n", ((F.col("n") == F.col("n2")) & (F.col("xor") == F.col("x2")) & (F.col("total") == F.col("t2"))).alias("same"))  # one row each


@query("next_ids", "SELECT coalesce(max(event_id), 0) + 1 AS next_id FROM events")
def next_ids(spark, sf_dir):
    return U.next_id(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id")
