import pytest
from pyspark.sql import functions as F

from lexichron.operators import retrieval as R
from lexichron.plans import serve
from lexichron.schemas import SCHEMAS
from lexichron.sources import feeds, store


def test_admission(spark):
    rows = [(1, "a", "2024-01-01 00:00:00", 100), (2, "a", "2024-01-01 00:00:01", 100), (3, "b", "2024-01-01 00:00:02", 178_000), (4, "c", "2024-01-01 00:00:03", 1)]
    df = spark.createDataFrame(rows, "id long, key string, ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: (r.outcome, r.status, r.retry_after) for r in serve.admit(df, 1.0, 3600.0 / 10).collect()}
    assert got == {1: ("ok", 200, None), 2: ("limited", 429, 10), 3: ("ok", 200, None), 4: ("budget", 503, None)}


def test_health_and_list(spark):
    p = spark.createDataFrame([(1, 5, 0, 0.0, 1.0, "t", [1.0], "m"), (2, 6, 0, 0.0, 1.0, "t", None, None)], SCHEMAS["passages"])
    assert tuple(serve.health(p).first()) == (2, 1, "hybrid")
    e = spark.sql("SELECT * FROM VALUES (5L, timestamp'2024-01-01'), (6L, timestamp'2024-02-01'), (7L, NULL) AS t(id, published_at)")
    assert [r.id for r in serve.listed(e, p).collect()] == [6, 5]


def test_copy_all(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    store.apply_schema(spark, a)
    episode = spark.createDataFrame([(4, "f", "g", "t", "u", None, None, "k")], SCHEMAS["episodes"])
    store.append(episode, a, "episodes")
    assert store.copy_all(spark, a, b) == {"episodes": 5, "jobs": 1, "passages": 1}
    with pytest.raises(ValueError):
        store.copy_all(spark, a, b)


def test_cached_and_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = str(tmp_path / "c")
    assert store.cached(spark, path, make).count() == store.cached(spark, path, make).count() == 3 and made == [1]
    store.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_download(tmp_path):
    source, target = tmp_path / "x", tmp_path / "y"
    source.write_bytes(b"abc" * 1000)
    assert open(feeds.download(source.as_uri(), str(target)), "rb").read() == source.read_bytes()
    with pytest.raises(feeds.DownloadFailed) as e:
        feeds.download(source.as_uri(), str(target), most_bytes=10)
    assert e.value.permanent and not target.exists()
    with pytest.raises(feeds.DownloadFailed) as e:
        feeds.download((tmp_path / "none").as_uri(), str(target))
    assert not e.value.permanent


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "running dogs"), (2, "a cat")], "id long, text string")
    q = spark.createDataFrame([(1, "dog runs")], "query_id long, question string")
    assert R.keyword_leg(R.postings(docs), q).collect() == []
    assert [r.id for r in R.keyword_leg(R.postings(docs, R.stemmed_terms), q, analyze=R.stemmed_terms).collect()] == [1]
