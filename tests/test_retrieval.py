import numpy as np
import pytest
from pyspark.sql import functions as F

from lexichron.operators import retrieval as R

LEG = "query_id long, id long, rank int"


def leg(spark, ids):
    return spark.createDataFrame([(1, d, r + 1) for r, d in enumerate(ids)], LEG)


def test_rrf(spark):
    got = {r.id: r.score for r in R.rrf(leg(spark, [1, 2, 3]), leg(spark, [3, 1, 4])).collect()}
    assert got[1] == 1 / 61 + 1 / 62
    assert sorted(got, key=lambda d: (-got[d], d)) == [1, 3, 2, 4]
    only = R.fused(leg(spark, [7, 8]), leg(spark, []))
    assert [r.id for r in only.orderBy("rank").collect()] == [7, 8]


def test_keyword_or_and_stopwords(spark):
    docs = spark.createDataFrame([(1, "vector search and vector stores"), (2, "the search"), (3, "nothing here")], "id long, text string")
    q = spark.createDataFrame([(1, "Vector the SEARCH"), (2, "the of and"), (3, "")], "query_id long, question string")
    got = R.keyword_leg(R.postings(docs), q).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.rank) for r in got] == [(1, 1, 1), (1, 2, 2)]


def test_vector_leg_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 16))
    v[5] = v[6]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(900, None), (901, [None] * 16), (902, [0.0] * 16), (903, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = df.filter("id < 40").withColumnRenamed("id", "query_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in R.vector_leg(df, q, 10, queries_a_block=16, rows_a_block=70).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for i in range(40):
        assert got[i] == sorted(range(300), key=lambda j: (round(1 - float(unit[i] @ unit[j]), 12), j))[:10]


def test_rerank_keeps_ties_in_order(spark):
    found = spark.createDataFrame([(1, 5, 1, "alpha"), (1, 4, 2, "beta question"), (1, 3, 3, "question of beta")], "query_id long, id long, rank int, text string")
    q = spark.createDataFrame([(1, "beta question")], "query_id long, question string")
    assert [r.id for r in R.rerank(found, q, 2).orderBy("rank").collect()] == [4, 3]


def test_search_modes(spark):
    docs = spark.createDataFrame([(1, "apples and pears"), (2, "pears alone"), (3, "plums")], "id long, text string")
    vectors = R.hash_embed(docs)
    q = spark.createDataFrame([(1, "pears alone")], "query_id long, question string")
    q = q.join(R.hash_embed(q.select(F.col("query_id").alias("id"), F.col("question").alias("text"))).withColumnRenamed("id", "query_id"), "query_id")
    for mode in ("keyword", "vector", "hybrid", "rerank"):
        best = R.search(R.postings(docs), vectors, docs, q, mode, 2).orderBy("rank").first()
        assert best.id == 2 or mode == "keyword"
    with pytest.raises(ValueError):
        R.search(R.postings(docs), vectors, docs, q, "magic")


def test_embed_pending_is_idempotent(spark):
    rows = [(1, "a b", None, None), (2, "c", [1.0] * 64, "old"), (3, "d", [0.5] * 64, "new")]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<float>, embed_model string")
    done = R.embed_pending(df, "new")
    assert R.pending(done, "new").count() == 0
    assert {r.id: r.embedding[0] for r in done.collect()}[3] == 0.5


def test_lsh_finds_near_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    v = np.repeat(centres, 6, axis=0) + 0.15 * rng.normal(size=(360, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    got = R.lsh_leg(df, df.withColumnRenamed("id", "query_id"), 6).collect()
    right = {(i, j) for i in range(360) for j in np.argsort(-(v @ v[i]), kind="stable")[:6].tolist()}
    assert len(right & {(r.query_id, r.id) for r in got}) / len(right) >= 0.9 and len(got) < 360 * 8


def test_lsh_meets_in_blocks_not_in_buckets(spark, monkeypatch):
    """What the library's own similarity join ranks, without a join by bucket; rows without a vector take no part."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 12)) / 3.0
    v[200:240] = v[200]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, v[7].tolist()), (8, v[9].tolist()), (400, [0.0] * 12)]
    odd = [(401, None), (402, [None] * 12), (403, [float("nan")] * 12)]
    shape = "id long, embedding array<double>"
    good, df = spark.createDataFrame(rows, shape), spark.createDataFrame(rows + odd, shape)
    asks = lambda x: x.filter("id % 3 = 0 OR id >= 400").withColumnRenamed("id", "query_id")
    as_vector = lambda x, key: x.select(key, array_to_vector("embedding").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=2, seed=7).fit(as_vector(good, "id"))
    near = model.approxSimilarityJoin(as_vector(asks(good), "query_id"), as_vector(good, "id"), 1.2, "distance")
    want = R.ranked(near.select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.id").alias("id"), "distance"), 20, F.asc("distance"))
    found = lambda: R.lsh_leg(df, asks(df), 20, tables=2)
    got = lambda x: sorted((r.query_id, r.rank, r.id) for r in x.collect())
    assert "Join" not in found()._jdf.queryExecution().executedPlan().toString()
    assert got(found()) == got(want)
    monkeypatch.setattr(R, "QUERY_BLOCK", 30)
    monkeypatch.setattr(R, "ROW_BLOCK", 90)
    assert "Join" not in found()._jdf.queryExecution().executedPlan().toString()
    assert got(found()) == got(want)
    assert R.lsh_leg(df.filter("id > 500"), asks(df)).collect() == []


def test_keyword_search_is_the_leg_over_postings(spark, monkeypatch):
    """One pass over the texts gives what joins give: with repeated ids, null texts, and questions that are too many to send."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["Été", "the"]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i - 20, text(int(rng.integers(0, 30)))) for i in range(700)] + [(5_000, None)]
    q = spark.createDataFrame([(i, text(6)) for i in range(30)] + [(90, "the"), (91, None), (92, "unsaid")], "query_id long, question string")
    got = lambda df: sorted((r.query_id, r.id, r.rank) for r in df.collect())
    for more in ([], [(3, text(9)), (3, text(9)), (None, text(5))]):
        docs = spark.createDataFrame(rows + more, "id long, text string").repartition(5)
        want = got(R.keyword_leg(R.postings(docs), q, 7))
        assert got(R.keyword_search(docs, q, 7)) == want
        monkeypatch.setattr(R, "SUMMED", 50)
        assert got(R.keyword_search(docs, q, 7)) == want
        monkeypatch.setattr(R, "SUMMED", 2_000_000)
    monkeypatch.setattr(R, "ASKED_PAIRS", 3)
    assert got(R.keyword_search(docs, q, 7)) == want
    monkeypatch.undo()
    small = docs.filter("id < 400 AND id <> 3")
    plan = R.keyword_search(small, q, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_best_keeps_the_greatest():
    rng = np.random.default_rng(6)
    best, rows = R.Best(3, 2), []
    best.most = 10
    for _ in range(40):
        ids, sums = rng.choice(10_000, 4, replace=False), rng.integers(0, 6, (4, 2)).astype(float)
        best.add_sums(sums, ids)
        rows += [(q, -sums[d, q], ids[d]) for d in range(4) for q in range(2) if sums[d, q]]
    want = [x for q in range(2) for x in sorted(r for r in rows if r[0] == q)[:3]]
    assert [(q, -s, i) for q, i, s in zip(*best.found(), strict=True)] == want


def test_hash_embed_is_row_wise(spark):
    rows = [(1, "A b, b! ...c"), (2, "?!"), (3, None), (4, " ... "), (5, "été été x")]
    docs = spark.createDataFrame(rows, "id long, text string")
    twice = docs.unionByName(docs.filter("id = 1"))
    got = {r.id: r.embedding for r in R.hash_embed(docs).collect()}
    weights = {}
    for r in R.hash_weights(docs).collect():
        weights.setdefault(r.id, [0.0] * 64)[r.bucket] = float(np.float32(r.weight))
    assert got == weights
    assert {r.id: r.embedding for r in R.hash_embed(twice).collect()} == weights
    assert "Generate" not in R.hash_embed(docs)._jdf.queryExecution().optimizedPlan().toString()


def test_vector_leg_of_one_block(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = df.filter("id < 30").withColumnRenamed("id", "query_id")
    got = lambda df: sorted((r.query_id, r.id, r.rank) for r in df.collect())
    assert got(R.vector_leg(df, q, 9)) == got(R.vector_leg(df, q, 9, queries_a_block=7, rows_a_block=50)) == got(R.vector_leg(df, q, 9, rows_a_block=50))
    assert R.vector_leg(df, q.limit(0), 9).collect() == []


def test_equal_distances_are_told_apart_as_a_plain_loop_does():
    """Rows of the same counts in other places are equally far but for the order in which a length is summed."""
    import math

    import pyarrow as pa

    rng = np.random.default_rng(11)
    counts = np.zeros((600, 64))
    for row in counts:
        row[rng.choice(64, 9, replace=False)] = [5, 4, 3, 3, 2, 2, 1, 1, 1]
    v = (counts / np.sqrt((counts * counts).sum(1))[:, None]).astype(np.float32).astype(np.float64)
    asked = rng.integers(0, 2, (20, 64)).astype(float)

    def dot(a, b):
        total = 0.0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            total += x * y
        return total

    size = [math.sqrt(dot(x, x)) for x in v]
    rows, asks = pa.table({"id": np.arange(600), "embedding": list(v)}), pa.table({"query_id": np.arange(20), "embedding": list(asked)})
    got = R._nearest(rows, asks, 50).to_pylist()
    for i, q in enumerate(asked):
        far = [1 - dot(q, x) / (math.sqrt(dot(q, q)) * s) for x, s in zip(v, size, strict=True)]
        want = sorted(range(600), key=lambda j: (far[j], j))[:50]
        assert [(r["id"], r["distance"]) for r in got if r["query_id"] == i] == [(j, far[j]) for j in want]
