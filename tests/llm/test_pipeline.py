import pytest

import corpus_pipeline as P
from lexichron.llm import bpe, mixing, neardup, pii, toxicity
from lexichron.llm.registry import QUERIES
from tests.llm.conftest import prose
from tests.oracle import SF


KEY = b"the key of the pipeline's tests"


@pytest.fixture(autouse=True)
def key(spark):
    spark.conf.set(P.KEY_SETTING, KEY.hex())
    yield
    spark.conf.unset(P.KEY_SETTING)


def test_stages_are_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    # stage by stage, from the operators' own results
    bad = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).filter("predicted = 1").collect()}
    one = [r for r in docs.collect() if r.doc_id not in bad]
    step = P.STAGES[0][1](spark, docs, SF)
    assert step.columns == docs.columns and sorted(step.collect()) == sorted(one) and bad
    two = spark.createDataFrame(one, docs.schema)
    kept = {r.doc_id for r in neardup.near_duplicates(two, 5).filter("kept").collect()}
    step = P.STAGES[1][1](spark, two, SF)
    assert {r.doc_id for r in step.collect()} == kept and step.columns == docs.columns and len(kept) < len(one)
    three = spark.createDataFrame([r for r in one if r.doc_id in kept], docs.schema)
    r = pii.Replacer(KEY)
    step = P.STAGES[2][1](spark, three, SF)
    assert {x.doc_id: x.text for x in step.collect()} == {x.doc_id: r.replace(x.text)[0] for x in three.collect()}
    copies = {x.doc_id: x.copies for x in mixing.mix(step).collect() if x.copies}
    four = P.STAGES[3][1](spark, step, SF)
    assert {x.doc_id: x["count"] for x in four.groupBy("doc_id").count().collect()} == copies and four.columns == docs.columns
    last = P.STAGES[4][1](spark, four, SF)
    assert last.count() == sum(copies.values())
    whole = P.run(spark, SF)
    assert sorted(whole.collect()) == sorted(bpe.bpe_digest(four).collect())


def test_awkward_documents_pass_through(spark, awkward, nothing):
    docs = awkward
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
    docs = nothing
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_every_query_runs_on_the_small_tables(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and sum(n.startswith("op") for n in names) == 13
    for name in ("op4_tokens", "op5_media", "op9_mixing", "op10_pii"):
        table = "embeddings" if name == "op5_media" else "documents"
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_rows_of_one_id_are_neither_lost_nor_mixed_up(spark, rng):
    texts = [prose(rng, 80) for _ in range(4)]
    rows = [(1, texts[0], "en", "a", 9), (1, texts[1], "en", "a", 9), (2, texts[0] + " more", "en", "a", 9), (None, texts[2], "en", "b", 9), (3, texts[3], "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.neardup_stage(spark, docs, SF).collect()
    assert sorted(r.text for r in kept) == sorted(texts)
    assert sorted(r.text for r in P.pii_stage(spark, spark.createDataFrame(kept, docs.schema), SF).collect()) == sorted(texts)


def test_a_fresh_key_where_none_is_set(spark):
    assert P.surrogate_key(spark) == KEY
    spark.conf.unset(P.KEY_SETTING)
    assert len(P.surrogate_key(spark)) == 32 and P.surrogate_key(spark) != P.surrogate_key(spark)


def test_runs_beside_each_other_keep_their_tables(spark):
    import threading

    from lexichron.llm import common as C

    mine = C.Shelf(spark)
    kept = mine.put(spark.range(3))

    def other():
        C.Shelf(spark).put(spark.range(5))
        C.clear_shelves()

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert kept.count() == 3 and mine in C._EVERY
    C.clear_shelves(C.open_shelves() - 1)
    assert mine not in C._EVERY
