import pytest
from pyspark.sql import functions as F

from lexichron.models import RateLimited, with_retries
from lexichron.operators import usage as U
from lexichron.sources import feeds as S
from lexichron.sources import store

FEED = """<?xml version="1.0"?><rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>Feed</title>
<item><title>Part 1</title><guid>g1</guid><pubDate>Mon, 01 Sep 2025 10:00:00 GMT</pubDate><enclosure url="https://e.example/1.mp3" type="audio/mpeg"/><itunes:duration>45:30</itunes:duration></item>
<item><title>Film</title><guid>g2</guid><enclosure url="https://e.example/2.mp4" type="video/mp4"/></item>
<item><title>No sound</title><guid>g3</guid></item>
<item><title> </title><pubDate>Wed, 01 Oct 2025 12:00:00 +0200</pubDate><enclosure url="https://e.example/3.mp4" type="video/mp4"/><enclosure url="https://e.example/3.mp3" type=""/><itunes:duration>1:02:03</itunes:duration></item>
<item><guid>g4</guid><pubDate>some day</pubDate><enclosure url="https://e.example/4.mp3" type="audio/mp3"/></item>
</channel></rss>"""


def test_feed(spark, tmp_path):
    path = tmp_path / "feed.xml"
    path.write_text(FEED)
    rows = S.read_feed(spark, str(path), "https://feed.example").orderBy("ord").collect()
    assert [(r.title, r.guid, r.duration_seconds, r.published_at and str(r.published_at)) for r in rows] == [
        ("", "https://e.example/3.mp3", 3723, "2025-10-01 10:00:00"),
        ("Part 1", "g1", 2730, "2025-09-01 10:00:00"),
        ("Untitled", "g4", None, None),
    ]
    assert S.newest(S.read_feed(spark, str(path), "u"), 2).count() == 2
    assert S.newest(S.read_feed(spark, str(path), "u"), 0).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "ref.txt").write_text("# note\n\n one two \n  # other\nthree\n")
    assert S.read_reference(spark, str(tmp_path / "ref.txt")).first().text == "one two three"
    (tmp_path / "g.jsonl").write_text('{"question": "q", "feed_url": "f", "guid": "g", "answer_time": 1.5, "generator": "x"}\n\n')
    assert [r.answer_time for r in S.read_golden(spark, str(tmp_path / "g.jsonl")).collect()] == [1.5]
    (tmp_path / "w.json").write_text('{"text": "a b", "words": [{"text": "a", "start": 0.0, "end": 0.1}, {"text": "b", "start": 0.2, "end": 0.3}]}')
    assert [r.text for r in S.read_cached_words(spark, str(tmp_path / "w.json")).orderBy("pos").collect()] == ["a", "b"]
    reply = '{"text": " hi ", "words": [{"word": " hi ", "start": 0.5, "end": 0.9}]}'
    got = spark.range(1).select(S.parse_transcription(F.lit(reply)).alias("t"), S.parse_transcription(F.lit('{"text": "x"}')).alias("u")).first()
    assert got.t.words[0].text == "hi" and got.u.words == []


def test_store(spark, tmp_path):
    root = str(tmp_path / "db")
    store.apply_schema(spark, root)
    store.apply_schema(spark, root)
    rows = spark.createDataFrame([("2024-01-01", 5, 1)], "day string, tokens int, answers int")
    store.append(rows, root, "usage_daily")
    assert store.load(spark, root, "usage_daily").first().tokens == 5
    spark.range(1).write.mode("overwrite").parquet(f"{root}/jobs")
    with pytest.raises(ValueError):
        store.apply_schema(spark, root)


def test_copy_and_fingerprints(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    back = U.copy_verified(df, str(tmp_path / "copy"), "id", "x")
    assert U.fingerprint(df, "id", "id", "x").first() == U.fingerprint(back, "id", "id", "x").first()
    with pytest.raises(Exception):  # noqa: B017
        U.copy_verified(df, str(tmp_path / "copy"), "id", "x")
    assert U.next_id(df.limit(0)).first().next_id == 1


def test_token_bucket(spark):
    r = spark.createDataFrame([(1, "k", 0), (2, "k", 0), (3, "k", 1_000_000), (4, "other", 0)], "id long, key string, ts_us long")
    got = {x.id: x.allowed for x in U.token_bucket(r, 1.0, 3600.0).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_budget(spark):
    s = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01 01:00:00', date'2024-01-01', 177501L), (2L, timestamp'2024-01-01 02:00:00', date'2024-01-01', 10L), (3L, timestamp'2024-01-02 00:00:00', date'2024-01-02', 1L) AS t(id, ts, day, tokens)")
    want = {1: False, 2: True, 3: False}
    assert {r.id: r.refused for r in U.budget_guard(s, U.LIMIT, U.RESERVE).collect()} == want
    assert {r.id: r.refused for r in U.strict_budget(s, U.LIMIT, U.RESERVE).collect()} == want


def test_retries():
    waits, tries = [], iter([ConnectionError(), RateLimited(3), TimeoutError()])

    def call():
        e = next(tries, None)
        if e:
            raise e
        return "ok"

    assert with_retries(call, waits.append) == "ok" and waits == [1, 3, 4]
    with pytest.raises(RateLimited):
        with_retries(lambda: (_ for _ in ()).throw(RateLimited(99)), waits.append)
    with pytest.raises(ValueError):
        with_retries(lambda: (_ for _ in ()).throw(ValueError()), waits.append)
