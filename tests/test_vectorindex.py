"""The stored vector index against exact search."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexichron.operators import retrieval as R
from lexichron.sources import vectorindex as X


def frame(spark, v, start=0):
    return spark.createDataFrame([(start + i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")


def clustered(n, dim=24, groups=40, spread=0.15, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))


def hits(df):
    return {(r.query_id, r.id) for r in df.collect()}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    v = clustered(3_000)
    df = frame(spark, v)
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    return df, path, X.build(df, path)


def test_recall_on_clusters_from_few_files(spark, stored):
    df, path, cells = stored
    assert cells.rows.sum() == 3_000 and 1 < len(cells.centres) <= 80
    q = df.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    want = hits(R.vector_leg(df, q))
    assert len(want & hits(X.nearest(path, q))) / len(want) >= 0.9
    assert cells.probes < len(cells.centres) / 3
    one = q.filter("query_id = 0").withColumn("reach", F.lit(-1.0))
    probed = X._probed(one, cells, 0, cells.probes)
    plan = X._compared(path, cells, probed, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    rows = X._rows(spark, path)
    read = rows.filter(F.col("cell").isin([r.cell for r in probed.collect()])).select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read < len(rows.inputFiles()) / 3


def test_recall_on_random_vectors(spark, tmp_path):
    v = np.random.default_rng(5).normal(size=(1_200, 32))
    df = frame(spark, v)
    X.build(df, str(tmp_path / "i"))
    q = df.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    want = hits(R.vector_leg(df, q))
    assert len(want & hits(X.nearest(str(tmp_path / "i"), q))) / len(want) >= 0.9


def test_exact_search_reads_what_it_must(spark, stored):
    df, path, _ = stored
    q = df.filter("id % 100 = 7").withColumnRenamed("id", "query_id")
    rows = lambda x: sorted((r.query_id, r.id, r.rank) for r in x.collect())
    assert rows(X.nearest(path, q, 20, probes=1, exact=True)) == rows(R.vector_leg(df, q, 20))


def test_pairs_of_queries_and_cells_leave_in_bounded_batches():
    """An exact search may want all cells for all queries: no batch holds more than PAIRS of them."""
    rng = np.random.default_rng(2)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 4)))
    cells = X.Cells(unit(300), np.zeros(300, int), unit(1), np.ones(300, int), np.full(300, 2.0), 1)
    ran = []
    asked = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))), select=lambda *_: asked, mapInArrow=lambda f, _: ran.append(f))
    X._probed(asked, cells, 4, 300)
    q = pa.record_batch({"query_id": np.arange(500), "embedding": pa.array(list(unit(500))), "reach": np.full(500, 2.0)})
    made = list(ran[0](iter([q])))
    assert max(b.num_rows for b in made) <= 8_192
    pairs = {p for b in made for p in zip(b["query_id"].to_pylist(), b["cell"].to_pylist(), strict=True)}
    assert len(pairs) == sum(b.num_rows for b in made) == 500 * 296


def test_rows_beyond_the_reach_stay_behind():
    v = clustered(200, dim=8)
    rows = pa.table({"id": np.arange(200), "embedding": list(v)})
    asks = pa.table({"query_id": [0, 1], "embedding": list(v[:2])})
    every = R._nearest(rows, asks, 50).to_pylist()
    tenth = [[r["distance"] for r in every if r["query_id"] == q][9] for q in (0, 1)]
    near = R._nearest(rows, asks.append_column("reach", pa.array([tenth[0], -1.0])), 50).to_pylist()
    assert near == [r for r in every if r["query_id"] == 1 or r["distance"] <= tenth[0]]


def test_rows_without_a_direction_and_hot_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "ROW_BLOCK", 50)
    monkeypatch.setattr(X, "QUERY_BLOCK", 7)
    v = clustered(400, dim=8, groups=5)
    v[100:300] = v[100]
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8), (904, [None] * 8), (None, v[3].tolist())]
    df = frame(spark, v).unionByName(spark.createDataFrame(odd[:5], "id long, embedding array<double>"))
    path = str(tmp_path / "i")
    cells = X.build(df, path, k=10)
    assert cells.rows.sum() == 400
    q = df.filter("id < 40 OR id >= 900").withColumnRenamed("id", "query_id")
    rows = lambda x: sorted((r.query_id, r.id, r.rank) for r in x.collect())
    assert rows(X.nearest(path, q, 10, exact=True)) == rows(R.vector_leg(df, q, 10))


def test_added_rows_are_found(spark, tmp_path):
    v = clustered(600)
    path = str(tmp_path / "i")
    X.build(frame(spark, v[:500]), path)
    before = X._rows(spark, path).inputFiles()
    assert X.add(frame(spark, v[500:], 500), path).rows.sum() == 600
    assert set(before) < set(X._rows(spark, path).inputFiles())
    q = frame(spark, v[500:], 500).withColumnRenamed("id", "query_id")
    found = {(r.query_id, r.id) for r in X.nearest(path, q, 1).collect()}
    assert found == {(i, i) for i in range(500, 600)}


def test_no_rows(spark, tmp_path):
    nothing = spark.createDataFrame([], "id long, embedding array<double>")
    path = str(tmp_path / "i")
    X.build(nothing, path)
    assert X.nearest(path, frame(spark, clustered(3)).withColumnRenamed("id", "query_id")).collect() == []


def test_rows_stay_where_they_are_read(spark, stored, monkeypatch):
    """A block of queries goes to the rows of its cells, each of which is a file; more queries meet them in a shuffle."""
    df, path, cells = stored
    assert len(X._rows(spark, path).inputFiles()) == (cells.rows > 0).sum()
    q = df.filter("id % 100 = 7").withColumnRenamed("id", "query_id").withColumn("reach", F.lit(-1.0))
    plan = lambda: X._compared(path, cells, X._probed(q, cells, 0, 5), 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan()
    twice = q.unionByName(q.filter("query_id = 7").withColumn("embedding", F.reverse("embedding")))
    found = lambda: sorted(tuple(r) for r in X.nearest(path, twice.drop("reach"), 20, exact=True).collect())
    several = found()
    monkeypatch.setattr(X, "SENT_PAIRS", 3)
    assert "Exchange" in plan() and found() == several
    rows = lambda x: sorted((r.query_id, r.id, r.rank) for r in x.collect())
    assert rows(X.nearest(path, q, 20, exact=True)) == rows(R.vector_leg(df, q, 20))
