"""The stored full-text index against scans over all postings."""

import random

from pyspark.sql import functions as F

from lexichron.functions.text import keyword_terms
from lexichron.operators import retrieval as R
from lexichron.sources import textindex as X


def corpus(spark, n=1_500, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["running", "runner", "runs", "Straße", "été", "the"]
    weights = [1 / (i + 1) for i in range(300)] + [0.02] * 6
    rows = [(i * 7, " ".join(rng.choices(words, weights, k=rng.choice([0, 5, 30, 60])))) for i in range(n)] + [(-5, None)]
    return spark.createDataFrame(rows, "id long, text string").repartition(5)


def asks(spark):
    rows = [(1, "w250 w17"), (2, "the w0"), (3, "runs w299 w298 w297"), (4, "nothing here at all"), (5, ""), (6, None), (7, "w1 w2 w3 w4 été STRASSE straße"), (8, "w120")]
    return spark.createDataFrame(rows, "query_id long, question string")


def rows(df):
    return sorted((r.query_id, r.id, r.rank) for r in df.collect())


def test_same_ranks_as_a_full_scan(spark, tmp_path):
    docs = corpus(spark)
    for analyze, name in ((keyword_terms, "plain"), (R.stemmed_terms, "stems")):
        path = str(tmp_path / name)
        X.build(docs, path, analyze, block_docs=16, folders=3)
        for k in (1, 10, 50):
            assert rows(X.search(path, asks(spark), k, analyze)) == rows(R.keyword_leg(R.postings(docs, analyze), asks(spark), k, analyze))


def test_stems_meet(spark, tmp_path):
    docs = spark.createDataFrame([(1, "many runners were running"), (2, "he runs and runs"), (3, "a walk")], "id long, text string")
    X.build(docs, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "run"), (2, "walking")], "query_id long, question string")
    assert rows(X.search(str(tmp_path / "i"), q)) == [(1, 1, 2), (1, 2, 1), (2, 3, 1)]
    stored = {(r.term, r.id): (r.tf, r.positions) for r in X.postings(spark, str(tmp_path / "i")).collect()}
    assert stored["run", 2] == (2, [0, 1]) and stored["run", 1] == (1, [2])


def test_blocks_are_skipped(spark, tmp_path):
    """A few documents repeat rare words; of common words' blocks most are never read."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=6)) for _ in range(4_000)]
    for i in range(60):
        texts[i * 3] = "quartz " * 9 + texts[i]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    path = str(tmp_path / "i")
    X.build(docs, path, keyword_terms)
    q = spark.createDataFrame([(1, "quartz b c")], "query_id long, question string")
    _, had, read = X.search_plan(path, q, 20, keyword_terms)
    assert read.agg(F.sum("n")).first()[0] < had.agg(F.sum("n")).first()[0] / 5
    assert rows(X.search(path, q, 20, keyword_terms)) == rows(R.keyword_leg(R.postings(docs), q, 20))


def test_only_asked_folders_are_read(spark, tmp_path, monkeypatch):
    docs, path = corpus(spark, 200), str(tmp_path / "i")
    shape = X.build(docs, path, keyword_terms, folders=8)
    q = R.query_terms(spark.createDataFrame([(1, "w17")], "query_id long, question string"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "9000")
    plan = X._asked(spark, path, q, shape)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder#", "folder#").replace("[(folder", "[folder") and "EqualTo(term,w17)" in plan.replace("In(term, [w17])", "EqualTo(term,w17)")
    monkeypatch.setattr(X, "LISTED", 1)
    assert rows(X.search(path, asks(spark), 5, keyword_terms)) == rows(R.keyword_leg(R.postings(docs), asks(spark), 5))


def test_added_documents(spark, tmp_path):
    docs, path = corpus(spark, 400), str(tmp_path / "i")
    X.build(docs.filter("id < 1400"), path, keyword_terms, block_docs=16, folders=2)
    before = set(X.blocks(spark, path).inputFiles())
    X.add(docs.filter("id >= 1400"), path, keyword_terms, block_docs=16)
    assert before < set(X.blocks(spark, path).inputFiles())
    assert rows(X.search(path, asks(spark), 20, keyword_terms)) == rows(R.keyword_leg(R.postings(docs), asks(spark), 20))
    X.build(docs.limit(0), str(tmp_path / "none"))
    assert X.search(str(tmp_path / "none"), asks(spark)).collect() == []


def test_an_index_is_built_without_a_shuffle_of_words(spark, tmp_path, monkeypatch):
    """A block's rows come from the texts of one task; a search by joins gives what the sweep over blocks gives."""
    docs, path = corpus(spark, 300), str(tmp_path / "i")
    plan = X.blocks_of(docs, keyword_terms, 0, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Aggregate" not in plan
    X.build(docs, path, keyword_terms, block_docs=16)
    stored = X.postings(spark, path).collect()
    terms = docs.select("id", F.posexplode(keyword_terms(F.col("text"))).alias("pos", "term")).groupBy("term", "id").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    assert sorted((r.term, r.id, r.tf, r.positions) for r in stored) == sorted((r.term, r.id, len(r.p), r.p) for r in terms.collect())
    assert all(r.ids == sorted(r.ids) and r.n == len(r.ids) <= 16 and r.top == max(r.tfs) for r in X.blocks(spark, path).collect())
    swept = rows(X.search(path, asks(spark), 5, keyword_terms))
    monkeypatch.setattr(X, "few_asked", lambda terms: None)
    assert rows(X.search(path, asks(spark), 5, keyword_terms)) == swept


def test_a_term_has_one_row_a_slab(spark, tmp_path):
    """Rows to sort and store are terms of slabs, not of blocks; a slab ends where its words are enough."""
    docs, path = corpus(spark, 600).coalesce(2), str(tmp_path / "i")
    X.build(docs, path, R.stemmed_terms, block_docs=16)
    stored = X._stored(spark, path)
    assert stored.count() == stored.select("term", "slab").distinct().count() < X.blocks(spark, path).count() / 3
    words = docs.select("id", F.posexplode(R.stemmed_terms(F.col("text"))).alias("pos", "term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    assert sorted((r.term, r.id, r.tf) for r in X.postings(spark, path).collect()) == sorted(tuple(r) for r in words.collect())
    much = R.SLICE_WORDS
    assert list(R.slices([much // 2] * 5, 1)) == [(0, 2), (2, 4), (4, 5)]
    assert list(R.slices([much // 2] * 5, 4)) == [(0, 4), (4, 5)] and list(R.slices([], 4)) == []
    assert list(R.slices([1] * 10, 4)) == [(0, 10)] and list(R.slices([much, 0, 2 * much, 1], 1)) == [(0, 2), (2, 3), (3, 4)]
