import numpy as np
import pytest
from pyspark.sql import functions as F

from lexichron.llm import mixing as M
from tests.llm.conftest import prose


def level(sizes, weights, share=1.5, most=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(target.values())
        ideal = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if ideal[s] > most * sizes[s]}
        if not over:
            return target | ideal
        for s in over:
            target[s] = most * sizes[s]
        free -= over
    return target


@pytest.fixture
def corpus(spark, rng):
    rows = []
    for i in range(3_000):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", "e", None])
        rows.append((i, prose(rng, rng.choice([1, 5, 20, 60, 300])), source, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")


def test_targets_and_taken(spark, corpus):
    made = M.mix(corpus, group=50, fan=4).toPandas()
    sizes = {(None if s is None or s != s else s): int(n) for s, n in made.groupby("source", dropna=False)["size"].sum().items()}
    want = level(sizes, M.WEIGHTS)
    assert len(made) == 3_000 and made["copies"].between(0, 2).all()
    for s, group in made.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert np.isclose(group["target"].iloc[0], want[s])
        taken = (group["copies"] * group["size"]).sum()
        assert abs(taken - want[s]) <= 0.01 * want[s] + 5
    again = M.mix(corpus.repartition(7), group=50, fan=4).toPandas()
    assert (made.sort_values("doc_id")["copies"].to_numpy() == again.sort_values("doc_id")["copies"].to_numpy()).all()


def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 50, 30).astype(float), rng.random(30)
    total, runs = np.zeros(30), 1_500
    for seed in range(runs):
        out = M.pivot(p, size, [str(i) for i in range(30)], seed)
        assert np.isclose((out * size).sum(), (p * size).sum()) and ((out > 0) & (out < 1)).sum() <= 1
        total += out
    assert np.abs(total / runs - p).max() < 0.08


def test_rows(spark, awkward, nothing):
    made = M.mix(awkward).toPandas()
    assert len(made) == 11 and (made["copies"] * made["size"] <= 2 * made["size"]).all()
    assert M.mix(nothing).collect() == [] and M.mixed_documents(nothing).collect() == []
    out = M.mixed_documents(awkward)
    assert out.columns == awkward.columns
    fine = made[made["size"] > 0]
    assert out.filter("text IS NOT NULL AND trim(text) <> ''").count() <= 2 * len(fine)


def test_mixed_documents_repeat_as_mix_says(spark, corpus):
    counts = {r.doc_id: r.copies for r in M.mix(corpus).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in M.mixed_documents(corpus).groupBy("doc_id").count().collect()}
    assert got == counts
    twice = corpus.filter("doc_id < 200").union(corpus.filter("doc_id < 200"))
    total = M.mix(twice).selectExpr("sum(copies) AS n").first().n
    assert M.mixed_documents(twice).count() == total


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.copies) for r in M.mix(df).collect()] == [(0, 0.0, 0)] * 2


def test_many_equal_rows(spark, monkeypatch, rng):
    """A row that stands for a third of all is numbered in blocks and takes as many copies as the mix gave its rows."""
    monkeypatch.setattr(M, "REPEATS", 50)
    rows = [(7, "hot words here", "a", "same")] * 700 + [(7, "hot words here", "a", f"other {i}") for i in range(40)]
    rows += [(i, prose(rng, rng.choice([3, 20])), rng.choice("ab"), "x") for i in range(100, 1_400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __m string").repartition(6)
    made = M.mix(df)
    per = {r.key: (r.n, r.total) for r in made.groupBy("key").agg(F.count("*").alias("n"), F.sum("copies").alias("total")).collect()}
    assert made.count() == len(rows) and max(n for n, _ in per.values()) == 740
    out = M.mixed_documents(df.withColumnRenamed("__m", "extra"))
    assert out.count() == sum(t for _, t in per.values())
    hot = out.filter("doc_id = 7").groupBy("extra").count().collect()
    assert sum(r["count"] for r in hot) == next(t for n, t in per.values() if n == 740)
    assert all(r["count"] <= 2 * (700 if r.extra == "same" else 1) for r in hot)


def test_sources_as_many_as_hosts(spark):
    rows = [(i, "word " * (1 + i * 7 % 13), f"host-{i * 37 % 900:04d}" if i % 50 else None) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = df.select("source", M.word_count().alias("size"))
    got = {r.source: r.target for r in M.source_targets(sizes, M.Shelf(spark)).collect()}
    per = {}
    for _, text, source in rows:
        per[source] = per.get(source, 0) + len(text.split())
    want = level(per, M.WEIGHTS)
    assert got.keys() == want.keys() and all(np.isclose(got[s], want[s]) for s in want)
