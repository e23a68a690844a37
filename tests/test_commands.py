"""The commands over one store, from feeds to search."""

import pytest
from pyspark.sql import functions as F

from lexichron.__main__ import main
from lexichron.schemas import SCHEMAS
from lexichron.sources import store
from tests.test_feedsource import feed

ROOT = []


def recognised(claimed):
    """A worker's run that stores a chunk of words for every job."""
    words = F.array(*[F.struct(F.lit(w).alias("text"), F.lit(0.4 * i).alias("start"), F.lit(0.4 * i + 0.3).alias("end")) for i, w in enumerate("the harbour lights went out".split())])
    made = claimed.select("episode_id", F.lit(0).alias("idx"), F.lit(0.0).alias("start_s"), F.lit(2.0).alias("end_s"), F.lit("t").alias("text"), words.alias("words"), F.lit("m").alias("model"), F.lit("x").alias("audio_sha256"))
    store.append(made, ROOT[-1], "chunks")
    return claimed.select("id", F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("retry_after"))


def test_from_feed_to_search(spark, tmp_path, capsys):
    root = str(tmp_path / "store")
    ROOT.append(root)
    urls = [feed(tmp_path / "a.xml", ("one", "a", 1), ("two", "b", 2)), feed(tmp_path / "b.xml", ("three", "c", 3))]
    run = lambda *argv: (main([*argv, "--store", root], spark), capsys.readouterr().out)[1]
    assert run("ingest", *urls, "--limit", "1") == "{'new': 2, 'skipped': 0, 'failed_feeds': 0}\n"
    assert run("ingest", *urls) == "{'new': 1, 'skipped': 2, 'failed_feeds': 0}\n"
    assert "queued" in run("status")
    run("worker", "--run", "tests.test_commands:recognised", "--workers", "5", "--until-empty")
    assert "|  done|  3|" in run("status")
    assert run("index") == "{'episodes': 3, 'passages': 3}\n" and run("index") == "{'episodes': 0, 'passages': 0}\n"
    found = run("search", "harbours", "--mode", "keyword")
    assert found.count("harbour lights") == 3 and "three" in found
    copy = str(tmp_path / "copy")
    highest = store.load(spark, root, "passages").agg(F.max("id")).first()[0]
    assert f"'jobs': 4, 'passages': {highest + 1}" in run("copy-data", copy)
    assert store.load(spark, copy, "chunks").count() == 3 and set(SCHEMAS) >= {"episodes", "jobs"}


def test_missing_folder_is_an_error(spark):
    with pytest.raises(SystemExit):
        main(["search", "x"], spark)
