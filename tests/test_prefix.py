"""Running totals by ranges."""

import datetime
import random

from pyspark.sql import functions as F

from lexichron.operators import evaluation as V
from lexichron.operators import usage as U
from lexichron.operators.prefix import running_total


def plain(rows):
    """(key, order) -> running total, one row after another."""
    out, sums = {}, {}
    for key, at, value in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        sums[key] = sums.get(key, 0) + (value or 0)
        out[key, at] = sums[key]
    return out


def test_keys_within_and_across_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, *"abcdefgh"]), i, rng.choice([None, -5, 1, 7])) for i in range(4_000)]
    df = spark.createDataFrame(rows, "key string, at long, `v.x` long").repartition(7)
    made = running_total(df, "v.x", ["at"], "key")
    assert made.columns == ["key", "at", "v.x", "running"]
    assert {(r.key, r.at): r.running for r in made.collect()} == plain(rows)


def test_no_key_at_all(spark):
    df = spark.range(10_000).withColumn("v", F.lit(1)).repartition(9)
    assert running_total(df, "v", ["id"]).filter("running <> id + 1").count() == 0
    assert running_total(df.limit(0), "v", ["id"]).collect() == []


def test_hot_day_is_many_tasks(spark):
    """No task holds a whole day, and the guard agrees with a plain loop."""
    day, start = datetime.date(2024, 1, 15), datetime.datetime(2024, 1, 15)
    rows = [(i, start + datetime.timedelta(seconds=i // 3), day, 1 + i % 5) for i in range(6_000)]
    spends = spark.createDataFrame(rows, "id long, ts timestamp, day date, tokens long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else ranges this small are put together
    made = U.budget_guard(spends, 9_000, 100)
    used = 0
    got = {r.id: (r.used, r.refused) for r in made.collect()}
    for i, _, _, tokens in rows:
        assert got[i] == (used, used + 100 > 9_000)
        used += tokens
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 3_000


def test_p95_over_many_values(spark):
    values = [random.Random(3).gauss(0, 3) for _ in range(2_001)]
    df = spark.createDataFrame([(max(v, 0.0),) for v in values] + [(None,)], "outside double").repartition(6)
    r = V.timing_summary(df).first()
    kept = sorted(max(v, 0.0) for v in values)
    assert (r.n, r.p95, r.worst) == (2_001, kept[int(0.95 * 2_000)], kept[-1])
    assert abs(r.inside_rate - sum(v <= 0 for v in kept) / 2_001) < 1e-12
