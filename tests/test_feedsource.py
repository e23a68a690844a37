"""Many feeds from their URLs, as a batch and as a stream that goes on where it stopped."""

import urllib.error

from lexichron.sources import feedsource as X
from lexichron.streaming.streams import drain

ITEM = '<item><title>{t}</title><guid> {g} </guid><pubDate>Mon, 0{d} Jan 2024 10:00:00 GMT</pubDate><enclosure url="https://a.example/{g}.mp3" type="audio/mpeg"/><itunes:duration>1:02</itunes:duration></item>'


def feed(path, *items):
    body = "".join(ITEM.format(t=t, g=g, d=d) for t, g, d in items)
    path.write_text(f'<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>x</title>{body}<item><title>no audio</title></item></channel></rss>')
    return path.as_uri()


def test_many_feeds_and_failures(spark, tmp_path):
    urls = [feed(tmp_path / f"{i}.xml", (f"older {i}", f"g{i}a", 1), (f"newer {i}", f"g{i}b", 2)) for i in range(5)]
    (tmp_path / "bad.xml").write_text("<rss><channel><item>")
    missing = (tmp_path / "none.xml").as_uri()
    episodes, failed = X.read_feeds(spark, [*urls, (tmp_path / "bad.xml").as_uri(), missing, "no url"])
    rows = {(r.feed_url, r.ord): (r.guid, r.title, r.duration_seconds) for r in episodes.collect()}
    assert len(rows) == 10 and rows[urls[3], 1] == ("g3b", "newer 3", 62) and rows[urls[3], 2] == ("g3a", "older 3", 62)
    errors = {r.feed_url: r.error for r in failed.collect()}
    assert len(errors) == 3 and errors[missing].startswith("URLError")
    assert spark.read.format("feeds").option("urls", '["a", "b", "c"]').load().rdd.getNumPartitions() == 3


def test_tries_again_before_the_first_item(monkeypatch):
    calls, slept = [], []

    def broken(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", None, None)
        yield (url, 0, "t", "g", None, [], None, None)

    monkeypatch.setattr(X, "items_of", broken)
    assert [r[1] for r in X.fetched("u", sleep=slept.append)] == [0] and slept == [1, 2]

    def gone(url, timeout):
        raise urllib.error.HTTPError(url, 404, "gone", None, None)
        yield

    monkeypatch.setattr(X, "items_of", gone)
    rows = list(X.fetched("u", sleep=slept.append))
    assert len(rows) == 1 and "404" in rows[0][-1] and slept == [1, 2]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    listed, where = tmp_path / "list.txt", str(tmp_path / "q")
    first, second = feed(tmp_path / "1.xml", ("one", "a", 1)), feed(tmp_path / "2.xml", ("two", "b", 1))
    listed.write_text(f"{first}\n{second}")  # the second line is not whole yet
    guids = lambda: sorted(r.guid.strip() for r in drain(X.stream_feeds(spark, str(listed)), where=where).filter("guid IS NOT NULL").collect())
    assert guids() == ["a"]
    (tmp_path / "1.xml").unlink()  # a feed that was taken is not fetched again
    with open(listed, "a") as f:
        f.write("\n")
    assert guids() == ["a", "b"] and guids() == ["a", "b"]
