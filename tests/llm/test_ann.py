import numpy as np

from lexichron.llm import ann as A
from lexichron.llm.registry import ORACLES, QUERIES
from tests.oracle import SF, database, same

SCHEMA = "vec_id long, embedding array<float>, score string"


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA).repartition(3)
    got = {}
    for r in A.nearest(df, df.filter("vec_id % 100 = 0")).collect():  # 7% of the rows are ranked exactly
        got.setdefault(r.query_id, []).append(r.vec_id)
    wide, hit = x.astype(float), 0
    for q, found in got.items():
        s = wide @ wide[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20]) & set(found))
    assert len(got) == 60 and hit / (60 * 20) >= 0.95


def test_ties_copies_and_awkward_vectors(spark):
    rows = [(i, [1.0, 2.0], "x") for i in range(500)] + [(600, [0.0, 0.0], "x"), (601, None, "x"), (602, [1.0, None], "x"), (603, [float("nan"), 1.0], "x"), (604, [float("inf"), 1.0], "x"), (605, [], "x")]
    rows += [(606, [1.0, 2.0, 3.0], "x"), (700, [2.0, 4.0], "x"), (None, [1.0, 2.0], "x"), (0, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = A.nearest(df, df.filter("vec_id % 100 = 0 OR vec_id > 599")).orderBy("query_id", "rank").collect()
    first = [r.vec_id for r in got if r.query_id == 0]
    assert first == [700, *range(1, 20)]
    assert {r.query_id for r in got} == {0, 100, 200, 300, 400, 700}
    assert [r.vec_id for r in got if r.query_id == 700] == [0, *range(19)]  # both rows of id 0
    assert all(r.score == 5.0 for r in got if r.query_id == 100 and r.vec_id != 700)


def test_blocks_share_the_shortlist(spark):
    """Many blocks of queries and rows find what one finds; the scan decides, as 2% of the rows are ranked exactly."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8_000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    sent = spark.sparkContext.broadcast(A.fit(df))
    index = A.Shelf(spark).put(A.build_index(df, sent))
    wide, queries = x.astype(float), df.filter("vec_id % 80 = 0")
    for rows in (8_000, 500):
        got = A.search(index, queries, sent, depth=160, queries_a_block=30, rows_a_block=rows).toPandas()
        assert got.groupby("query_id").size().tolist() == [20] * 100 and (got.sort_values(["query_id", "rank"])["rank"].to_numpy() == np.tile(np.arange(1, 21), 100)).all()
        hit = 0
        for q, part in got.groupby("query_id"):
            s = wide @ wide[q]
            assert np.allclose(s[part.vec_id], part.score)
            s[q] = -np.inf
            hit += len(set(np.argsort(-s, kind="stable")[:20]) & set(part.vec_id))
        assert hit / 2_000 >= 0.9


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [0.5, 1.0], "x")], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in A.nearest(two, two.filter("vec_id = 0")).collect()] == [(0, 1, 1, 0.5)]
    assert A.nearest(two.limit(0), two.limit(0)).collect() == []


def test_anisotropic_codes_lower_parallel_error():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2_000, 32))
    errors = []
    for threshold in (0.0, 0.4):
        A.THRESHOLD, old = threshold, A.THRESHOLD
        quant = A.Quantiser(32, x)
        A.THRESHOLD = old
        cut = quant.cut(x)
        codes, _, gap = quant._code(cut)
        errors.append(float(np.mean(gap**2)))
    assert errors[1] < errors[0]


def test_tables_equal_decoded_products():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 10))
    quant = A.Quantiser(10, x)
    codes, t = quant.encode(x), quant.tables(x[:3])
    decoded = quant.books[np.arange(quant.pieces), quant._code(quant.cut(x))[0]].reshape(300, -1)[:, :10]
    assert np.allclose(sum(t[:, b, :][:, codes[:, b]] for b in range(codes.shape[1])), x[:3] @ decoded.T, atol=1e-4)


def test_query_equals_its_sql(spark):
    same(QUERIES["op3_ann"](spark, SF), ORACLES["op3_ann"], database())


def test_a_repeated_query_id_asks_with_its_valid_vector(spark):
    """Of rows that share an id the invalid ones never take the place of a query."""
    bad = [[0.0, 0.0], None, [1.0], [float("nan"), 1.0], [None, 1.0]]
    rows = [(20, x) for x in bad] + [(20, [1.0, 0.0])] + [(i, [float(i), 1.0]) for i in range(1, 9)]
    for order in (rows, rows[::-1]):
        v = spark.createDataFrame(order, "vec_id long, embedding array<double>").coalesce(1)
        got = A.nearest(v, v.filter("vec_id = 20")).orderBy("rank").collect()
        assert [(r.query_id, r.vec_id, r.score) for r in got] == [(20, i, float(i)) for i in range(8, 0, -1)]
