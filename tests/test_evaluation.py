import random
import tracemalloc

from pyspark.sql import functions as F

from lexichron.operators import evaluation as V


def pairs(spark, *rows):
    return spark.createDataFrame([(i, a.split(), b.split()) for i, (a, b) in enumerate(rows)], "pair_id long, ref array<string>, hyp array<string>")


def test_wer(spark):
    p = pairs(spark, ("alpha bravo charlie delta", "alpha bravo zulu delta echo"))
    r = V.error_counts(V.alignments(p)).first()
    assert (r.substitutions, r.deletions, r.insertions) == (1, 0, 1)
    assert V.pooled_wer(p).first().wer == 0.5
    pooled = pairs(spark, ("a", "b"), ("a b c d e f g h i", "a b c d e f g h i"), ("", "x y"))
    assert V.pooled_wer(pooled).first().wer == 0.1


def test_wer_of_many_distinct_words(spark):
    ref, hyp = " ".join(f"w{i}" for i in range(150)), " ".join(f"w{i}" for i in range(150) if i % 10)
    assert V.pooled_wer(pairs(spark, (ref, hyp))).first().edits == 15


def test_alignment_is_cheapest_and_long_pairs_are_fine(spark, monkeypatch):
    import random
    from functools import lru_cache

    rng = random.Random(2)
    for _ in range(60):
        ref, hyp = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))

        @lru_cache(None)
        def cost(i, j):
            if not i or not j:
                return i + j
            return min(cost(i - 1, j - 1) + (ref[i - 1] != hyp[j - 1]), cost(i - 1, j) + 1, cost(i, j - 1) + 1)

        steps = V.align(ref, hyp)
        assert sum(k != "equal" for k, _, _ in steps) == cost(len(ref), len(hyp))
        assert [i for k, i, _ in steps if k != "ins"] == list(range(len(ref))) and [j for k, _, j in steps if k != "del"] == list(range(len(hyp)))
        assert all((k == "equal") == (ref[i] == hyp[j]) for k, i, j in steps if k in ("equal", "sub"))
    ref = [f"w{rng.randrange(3_000)}" for _ in range(4_000)]
    hyp = [w for w in ref if rng.random() > 0.05]
    assert V.pooled_wer(pairs(spark, (" ".join(ref), " ".join(hyp)))).first().edits == len(ref) - len(hyp)
    assert sum(k != "equal" for k, _, _ in V.align(ref, hyp)) == len(ref) - len(hyp)
    monkeypatch.setattr(V, "CODES", 50)
    assert V.pooled_wer(pairs(spark, (" ".join(ref[:300]), " ".join(ref[10:300])))).first().edits == 10


def test_golden_lookup_and_generation(spark):
    episodes = spark.createDataFrame([(1, "f", "a"), (2, "f", "b")], "id long, feed_url string, guid string")
    golden = spark.createDataFrame([("q", "f", "a"), ("r", "f", "gone"), ("s", None, "a")], "question string, feed_url string, guid string")
    found, counts = V.lookup_golden(golden, episodes)
    assert [(r.question, r.episode_id) for r in found.collect()] == [("q", 1)] and tuple(counts.first()) == (1, 2)
    sampled = spark.createDataFrame([(1, i, 0, 9_000, "f", "a") for i in range(4)], "episode_id long, idx int, start_ms long, end_ms long, feed_url string, guid string")
    replies = spark.createDataFrame([(1, 0, False, " why? ", "said here"), (1, 1, True, "x", "y"), (1, 2, None, "how?", "nowhere")], "episode_id long, idx int, skip boolean, question string, evidence string")
    rows, stats = V.generate_golden(sampled, replies, lambda df: df.withColumn("at_ms", F.when(F.col("quote") == "said here", 1_234)))
    assert [tuple(r) for r in rows.collect()] == [("why?", "f", "a", 1.23)] and tuple(stats.first()) == (4, 2, 1)
    assert V.median_seconds(spark.createDataFrame([("m", 1.0), ("m", 5.0), ("m", 2.0)], "mode string, seconds double"), "mode").first().p50_seconds == 2.0


def test_normalized_pairs(spark):
    df = spark.createDataFrame([(1, "Mister Quilter's well-known 'song'!", "mister quilters"), (2, "...", "x")], "pair_id long, ref string, hyp string")
    assert [(r.pair_id, r.ref) for r in V.normalized_pairs(df).collect()] == [(1, ["mister", "quilter's", "well", "known", "song"])]


def test_metrics(spark):
    golden = spark.createDataFrame([(1, 10, 5_000), (2, 10, 70_000), (3, 11, 0)], "query_id long, episode_id long, answer_ms long")
    results = spark.createDataFrame(
        [("m", 1, 1, 10, 0, 10_000), ("m", 2, 1, 11, 60_000, 80_000), ("m", 2, 3, 10, 60_000, 80_000), ("m", 3, 1, 10, 0, 9)], "mode string, query_id long, rank int, episode_id long, start_ms long, end_ms long"
    )
    m = V.retrieval_metrics(V.first_correct(results, golden)).first()
    assert (m.queries, round(m.recall_1, 3), round(m.recall_5, 3), round(m.mrr, 3), m.median_offset_ms, round(m.within, 3)) == (3, 0.333, 0.667, 0.444, 5_000, 0.333)


def test_p95_and_sample(spark):
    o = spark.createDataFrame([(float(i),) for i in range(21)], "outside double")
    r = V.timing_summary(o).first()
    assert (r.p95, r.worst) == (19.0, 20.0)
    p = spark.createDataFrame([(e, i) for e in range(3) for i in range(10)], "episode_id long, idx long")
    drawn = V.golden_sample(p, 7).groupBy("episode_id").count().collect()
    assert [r["count"] for r in drawn] == [2, 2, 2]
    assert V.golden_sample(p, 7).exceptAll(V.golden_sample(p, 7)).count() == 0


def test_top_substitutions(spark):
    steps = V.alignments(pairs(spark, ("a b c", "a x c"), ("b q", "x q"), ("z", "y")))
    assert [tuple(r) for r in V.top_substitutions(steps, 1).collect()] == [("b", "x", 2)]
    assert steps.filter(F.col("kind") == "equal").count() == 3


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def replayed(steps, ref, hyp):
    """The edits of an alignment that uses every word of both sides once, in order."""
    assert [i for kind, i, _ in steps if kind != "ins"] == list(range(len(ref)))
    assert [j for kind, _, j in steps if kind != "del"] == list(range(len(hyp)))
    assert all((ref[i] == hyp[j]) == (kind == "equal") for kind, i, j in steps if kind in ("equal", "sub"))
    return sum(kind != "equal" for kind, _, _ in steps)


def test_alignment_in_parts_costs_no_more(monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(V, "CELLS", 30)
    monkeypatch.setattr(V, "WIDTH", 2)
    for _ in range(300):
        ref = [rng.choice("abcde") for _ in range(rng.randint(0, 60))]
        hyp = [w for w in ref if rng.random() > 0.2] if rng.random() < 0.5 else [rng.choice("abcde") for _ in range(rng.randint(0, 60))]
        want = plain_distance(ref, hyp)
        assert replayed(V.align(ref, hyp), ref, hyp) == want == V.distance(*V._codes(ref, hyp))


def test_long_alignment_in_little_memory():
    """30,000 words a side, one in fifty changed, in well under 200 MB (the whole table would take 900)."""
    rng = random.Random(13)
    ref = [f"w{rng.randrange(4_000)}" for _ in range(30_000)]
    hyp = []
    for w in ref:
        p = rng.random()
        hyp += [] if p < 0.006 else [w, "uh"] if p < 0.012 else ["oh"] if p < 0.02 else [w]
    tracemalloc.start()
    steps = V.align(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and replayed(steps, ref, hyp) == V.distance(*V._codes(ref, hyp)) < 1_000
