"""Quotes found by their runs of tokens, against a search word by word."""

import random

from pyspark.sql import functions as F

from lexichron.operators import location as L
from lexichron.operators import quotes as Q

SCHEMA = "episode_id long, quote string, start_ms long, end_ms long"


def episode(rng, n, step=400):
    """Few different words, so that runs repeat, some of them of several tokens or of none."""
    words = [rng.choice(["so", "then", "we", "went-out", "home", "'quoted'", "--", "it’s", "Ünder", "½"]) for _ in range(n)]
    return words, [i * step for i in range(n)]


def same_as_by_words(spark, rows, quotes):
    t = spark.createDataFrame(rows, "episode_id long, tokens array<string>, starts array<long>")
    q = spark.createDataFrame(quotes, SCHEMA)
    key = lambda r: (r.episode_id, r.quote, r.start_ms, r.end_ms)
    got = {key(r): r.at_ms for r in Q.located(q, t).collect()}
    want = {key(r): r.at_ms for r in Q.located_by_words(q, t).collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(got[k] is None for k in got.keys() - want.keys())
    return want


def test_equals_search_by_words(spark):
    rng = random.Random(8)
    rows, quotes = [], []
    for e in range(12):
        words, starts = episode(rng, rng.choice([3, 40, 400]))
        if e % 4 == 3:
            starts = [s - 5_000 * (i % 50 == 49) for i, s in enumerate(starts)]  # some starts go back
        rows.append((e, words, starts))
        for _ in range(40):
            a, n = rng.randrange(len(words)), rng.choice([1, 3, 4, 5, 8, 11, 30])
            low = max(0, starts[a] + rng.choice([-40_000, -900, 0, 500, 30_000]))
            quotes.append((e, " ".join(words[a : a + n]), low, low + rng.choice([500, 20_000, 45_000, 10_000_000])))
    found = same_as_by_words(spark, rows, quotes)
    assert sum(v is not None for v in found.values()) > 60 and sum(v is None for v in found.values()) > 60


def test_rows_that_ask_for_nothing(spark):
    rows = [(1, ["one", "two", "three", "four"], [0, 400, 800, 1_200]), (2, [], []), (3, None, None), (4, ["a", "b", "c", "d"], [0, None, 1, 2])]
    quotes = [(1, "one two three four", 0, 2_000), (1, "one two three", 0, 2_000), (1, None, 0, 2_000), (None, "one two three four", 0, 2_000), (9, "one two three four", 0, 9)]
    quotes += [(1, "one two three four", None, None), (1, "one two three four", 9_000, 1_000), (2, "one two three four", 0, 9), (3, "one two three four", 0, 9), (1, "one two three four", 0, 2_000)]
    t = spark.createDataFrame(rows, "episode_id long, tokens array<string>, starts array<long>")
    out = Q.located(spark.createDataFrame(quotes, SCHEMA).withColumn("extra", F.lit("x")), t)
    assert out.columns == ["episode_id", "quote", "start_ms", "end_ms", "extra", "at_ms"]
    got = [r.at_ms for r in out.collect()]
    assert len(got) == 10 and sorted(x for x in got if x is not None) == [0, 0]


def test_one_long_episode_is_linear(spark):
    """Rows that meet stay near the matches: a quote that stands once meets its own runs alone, however long the episode."""
    n = 30_000
    words = [f"w{i}" for i in range(n)]
    t = spark.createDataFrame([(1, words, [i * 400 for i in range(n)])], "episode_id long, tokens array<string>, starts array<long>")
    asks = [(str(a), 1, " ".join(words[a : a + 9]), a * 400, a * 400 + 45_000) for a in range(0, n - 20, 10)]
    q = spark.createDataFrame(asks, "ask string, episode_id long, quote string, start_ms long, end_ms long")
    wanted = L.quote_runs(q)
    assert L.token_runs(t, wanted).count() == wanted.count() == 3 * len(asks)
    assert L.places_of(q, t, 1_000).filter("at_ms = cast(ask as bigint) * 400").count() == len(asks)
