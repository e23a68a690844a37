"""A stored inverted-file index over vectors: a tree of spherical k-means cells, a folder a cell, and searches that read the
folders of the nearest cells alone.

The tree is fitted on a bounded sample; every row is then put into the cell that the tree leads to. A search takes each query's
nearest cells, as many as reached RECALL of the exact neighbours for a sample of rows when the index was built, and compares
exactly within them. An exact search goes on to all cells that the triangle inequality cannot rule out.

Vectors that are null, zero, of another length than most, or not finite are not indexed, as they have no cosine distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import CANDIDATES, MARGIN, QUERY_BLOCK, ROW_BLOCK, _closest, _matrix, _nearest, nearest_in_groups, ranked, vector_leg
from ..session import delete, written

#: Cells at most (their centres go to every task), rows of the sample a cell, and rows that measure the recall.
MOST_CELLS, SAMPLE_A_CELL, MEASURED = 16_384, 64, 64
#: Distances of queries to cells in memory at a time, and pairs of a query and a cell that leave a task at a time.
DISTANCES, PAIRS = 1 << 20, 8_192
#: Pairs of a query and a cell that go to every task; more meet their rows in a shuffle.
SENT_PAIRS = 4_000_000
#: Share of the exact neighbours that the measured rows must find.
RECALL = 0.95
ROUNDS = 10


@dataclass
class Cells:
    """Centres of the cells and of the branches above them, as unit vectors; rows and radius (a chord) of each cell."""

    centres: np.ndarray
    branch_of: np.ndarray
    branches: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    probes: int


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k unit centres of the unit rows of x; centres that lose all their rows go."""
    different = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = different[rng.choice(len(different), min(k, len(different)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1)
        centres = sums[size > 1e-12] / size[size > 1e-12, None]
    return centres


def _unit(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and unit rows of the vectors that have a direction."""
    ids, x = _matrix(ids, vectors, dim)
    size = np.sqrt((x * x).sum(1))
    good = (size > 0) & np.isfinite(size)
    return ids[good], x[good] / size[good, None]


def _fit(sample: DataFrame, dim: int, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, the branch of each, and the branches' centres: the sample (of bounded size) is split into branches in one task,
    and each branch into its cells in a task of its own."""
    branches = max(1, round(cells**0.5))
    kind = "branch int, centre array<double>"

    def split(table: pa.Table) -> pa.Table:
        _, x = _unit(*(table.combine_chunks()[c].chunk(0) for c in ("id", "embedding")), dim)
        made = spherical_kmeans(x, branches, seed) if len(x) else np.zeros((0, dim))
        return pa.table({"branch": pa.array(np.arange(len(made)), pa.int32()), "centre": pa.array(list(made), pa.list_(pa.float64()))})

    top = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(split, kind).orderBy("branch").collect()
    upper = np.array([r.centre for r in top]).reshape(-1, dim)
    sent = sample.sparkSession.sparkContext.broadcast(upper)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _unit(b.column(0), b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float64())), pa.array((x @ sent.value.T).argmax(1), pa.int32())], names=["id", "embedding", "branch"])

    def leaves(key: tuple, table: pa.Table) -> pa.Table:
        _, x = _unit(*(table.combine_chunks()[c].chunk(0) for c in ("id", "embedding")), dim)
        made = spherical_kmeans(x, max(1, -(-cells // len(sent.value))), seed + key[0].as_py())
        return pa.table({"branch": pa.array([key[0].as_py()] * len(made), pa.int32()), "centre": pa.array(list(made), pa.list_(pa.float64()))})

    if not len(upper):
        return np.zeros((0, dim)), np.zeros(0, int), upper
    low = sample.mapInArrow(put, "id bigint, embedding array<double>, branch int").groupBy("branch").applyInArrow(leaves, kind).orderBy("branch", "centre").collect()
    return np.array([r.centre for r in low]).reshape(-1, dim), np.array([r.branch for r in low]), upper


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The rows of x as lists of a kind of number."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def _placed(rows: DataFrame, dim: int, cells: Cells) -> DataFrame:
    """id, embedding, cell, away (the chord to the cell's centre) of the rows that have a direction."""
    sent = rows.sparkSession.sparkContext.broadcast((cells.centres, cells.branch_of, cells.branches))
    # vectors of single precision travel as such
    single = dict(rows.dtypes)["embedding"] == "array<float>"
    kind = pa.float32() if single else pa.float64()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, branch_of, branches = sent.value
        for b in batches:
            ids, x = _matrix(b.column(0), b.column(1), dim)
            size = np.sqrt((x * x).sum(1))
            good = (size > 0) & np.isfinite(size)
            ids, x, unit = ids[good], x[good], x[good] / size[good, None]
            at = (unit @ branches.T).argmax(1) if len(unit) else np.zeros(0, int)
            cell = np.zeros(len(unit), np.int64)
            for branch in np.unique(at):
                of, mine = np.flatnonzero(branch_of == branch), at == branch
                cell[mine] = of[(unit[mine] @ centres[of].T).argmax(1)]
            away = np.sqrt(((unit - centres[cell]) ** 2).sum(1)) if len(unit) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(x.astype(np.float32 if single else np.float64), kind), pa.array(cell, pa.int32()), pa.array(away)], names=["id", "embedding", "cell", "away"])

    source = rows.select(F.col("id").cast("bigint").alias("id"), "embedding" if single else F.col("embedding").cast("array<double>").alias("embedding"))
    return source.mapInArrow(put, f"id bigint, embedding {'array<float>' if single else 'array<double>'}, cell int, away double")


def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float = RECALL, k: int = CANDIDATES, seed: int = 7) -> Cells:
    """Writes the index of vectors(id, embedding) to path, which must not exist. cells: about the square root of the rows, at
    most MOST_CELLS, unless given. Every row that has a direction is indexed; the tree sees a sample, of SAMPLE_A_CELL rows
    a cell, drawn by a hash of the id."""
    spark = vectors.sparkSession
    sizes = vectors.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim, n = (sizes["dim"], sizes["count"]) if sizes else (1, 0)
    cells = cells or min(MOST_CELLS, max(1, round(n**0.5)))
    share = min(1.0, cells * SAMPLE_A_CELL / max(1, n))
    sample = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sample = written(sample.filter((F.size("embedding") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))))
    made = Cells(*_fit(sample, dim, cells, seed), np.zeros(0), np.zeros(0), 1)
    _store(_placed(vectors, dim, made), path, "errorifexists")
    made = _summed(spark, path, made)
    made.probes = _measured(spark, path, made, sample, recall, k)
    _save(spark, path, made)
    return made


def add(vectors: DataFrame, path: str) -> Cells:
    """Appends vectors(id, embedding), of ids that the index does not hold, to the stored cells; the tree stays."""
    spark, made = vectors.sparkSession, load(vectors.sparkSession, path)
    _store(_placed(vectors, made.centres.shape[1], made), path, "append")
    made = _summed(spark, path, made)
    _save(spark, path, made)
    return made


def _store(placed: DataFrame, path: str, mode: str) -> None:
    """Rows of a cell lie together in one file; adaptive execution splits the tasks of hot cells, which have several."""
    dealt = placed.hint("rebalance", "cell").select("id", F.col("embedding").cast("array<double>").alias("embedding"), "cell", "away")
    dealt.write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, embedding array<double>, away double, cell int").parquet(f"{path}/rows")


def _summed(spark: SparkSession, path: str, cells: Cells) -> Cells:
    """cells with the numbers of rows and radii of what is stored: a row a cell."""
    rows, radius = np.zeros(len(cells.centres), np.int64), np.zeros(len(cells.centres))
    for r in _rows(spark, path).groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
        rows[r.cell], radius[r.cell] = r.n, r.radius
    return Cells(cells.centres, cells.branch_of, cells.branches, rows, radius, cells.probes)


def _save(spark: SparkSession, path: str, c: Cells) -> None:
    centres = [(i, x.tolist(), int(c.branch_of[i]), int(c.rows[i]), float(c.radius[i]), c.probes) for i, x in enumerate(c.centres)]
    branches = [(-1 - i, x.tolist(), None, None, None, None) for i, x in enumerate(c.branches)]
    df = spark.createDataFrame(centres + branches, "cell int, centre array<double>, branch int, n long, radius double, probes int")
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def load(spark: SparkSession, path: str) -> Cells:
    """The cells of a stored index: at most MOST_CELLS centres and their branches."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    low, top = [r for r in rows if r.cell >= 0], [r for r in rows if r.cell < 0][::-1]
    dim = len(rows[0].centre) if rows else 1
    matrix = lambda rs: np.array([r.centre for r in rs]).reshape(-1, dim)
    probes = low[0].probes if low else 1
    return Cells(matrix(low), np.array([r.branch for r in low], int), matrix(top), np.array([r.n for r in low], int), np.array([r.radius for r in low]), probes)


def _order(x: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """For unit rows of x the cells that hold rows, nearest first, and the chord to each."""
    chord = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ cells.centres.T)))
    chord[:, cells.rows == 0] = np.inf
    order = np.argsort(chord, axis=1, kind="stable")
    return order, np.take_along_axis(chord, order, 1)


def _measured(spark: SparkSession, path: str, cells: Cells, sample: DataFrame, recall: float, k: int) -> int:
    """The least number of cells a query that finds `recall` of the exact neighbours of MEASURED rows of the sample."""
    asks = sample.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(MEASURED)
    rows = _rows(spark, path)
    true = vector_leg(rows.select("id", "embedding"), asks.withColumnRenamed("id", "query_id"), k + 1).filter("query_id <> id")
    # at most k rows a measured one, which go to the rows
    cell = rows.select("id", "cell").join(F.broadcast(written(true)), "id").groupBy("query_id").agg(F.collect_list("cell").alias("cells")).collect()  # k cells a measured row
    if not cell:
        return 1
    vector = {r.id: r.embedding for r in asks.collect()}
    x = np.array([vector[r.query_id] for r in cell])
    order, _ = _order(x / np.linalg.norm(x, axis=1, keepdims=True), cells)
    place = np.argsort(order, axis=1, kind="stable")
    needed = np.sort(np.concatenate([place[i, r.cells] for i, r in enumerate(cell)])) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def nearest(path: str, queries: DataFrame, k: int = CANDIDATES, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, id, rank of the k rows nearest to queries(query_id, embedding) by cosine distance, from the index at path.

    probes: cells a query reads, as measured when the index was built unless given. exact: all cells that may hold one of the
    k nearest are read too, which gives what vector_leg gives.
    """
    spark = queries.sparkSession
    cells = load(spark, path)
    asked = written(queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(-1.0).alias("reach")))
    take = min(len(cells.centres), probes or cells.probes)
    first = _compared(path, cells, _probed(asked, cells, 0, take), k)
    if exact:
        first = written(first)
        kth = ranked_distance(first, k)
        again = asked.drop("reach").join(kth, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        first = first.unionByName(_compared(path, cells, _probed(again, cells, take, len(cells.centres)), k))
    return ranked(first, k, F.asc("distance"))


def ranked_distance(found: DataFrame, k: int) -> DataFrame:
    """query_id, reach: the k-th smallest distance of the queries that have k of found(query_id, id, distance)."""
    best = found.join(ranked(found, k, F.asc("distance")).filter(F.col("rank") == k), ["query_id", "id"], "left_semi")
    return best.groupBy("query_id").agg(F.max("distance").alias("reach"))


def _probed(asked: DataFrame, cells: Cells, start: int, stop: int) -> DataFrame:
    """query_id, embedding, reach, cell of asked(query_id, embedding, reach): the cells at places start to stop of each query's
    order; with a reach that is not negative, only those that may hold a row within that cosine distance.

    A query may have all cells, so its pairs leave PAIRS at a time, however many cells and queries there are."""
    sent = asked.sparkSession.sparkContext.broadcast(cells)
    shape = pa.list_(pa.float64())
    step = max(1, min(QUERY_BLOCK, DISTANCES // max(1, len(cells.centres))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                at, x = _unit(pa.array(np.arange(part.num_rows)), part.column(1), c.centres.shape[1])
                order, chord = _order(x, c)
                order, chord, reach = order[:, start:stop], chord[:, start:stop], part.column(2).to_numpy()[at][:, None]
                least = np.maximum(0.0, chord - c.radius[order] - MARGIN)
                wanted = np.isfinite(chord) & ((reach < 0) | (least**2 / 2 <= reach + MARGIN))
                row, place = np.nonzero(wanted)
                for first in range(0, len(row), PAIRS):
                    of, cell = row[first : first + PAIRS], order[row[first : first + PAIRS], place[first : first + PAIRS]]
                    query, vector, far = (column.take(pa.array(at[of])) for column in part.columns)
                    yield pa.RecordBatch.from_arrays([query, vector.cast(shape), far, pa.array(cell, pa.int32())], names=["query_id", "embedding", "reach", "cell"])

    return asked.select("query_id", "embedding", "reach").mapInArrow(run, "query_id bigint, embedding array<double>, reach double, cell int")


def _compared(path: str, cells: Cells, probed: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance: for each query at least the k nearest of its cells, within its reach if it has one. Only the folders of cells that some
    query asks for are listed and read. A block of queries goes to the tasks that read the rows, so that no row moves; of more queries,
    hot cells, and cells that many ask for, are dealt into blocks on both sides."""
    spark = probed.sparkSession
    probed = written(probed)
    few = _sent(probed)
    if few is not None:
        return _read_by(_rows(spark, path).filter(F.col("cell").isin(sorted(few.of))), few, k)
    asks = {r.cell: r["count"] for r in probed.groupBy("cell").count().collect()}  # at most a row a cell
    blocks = [(c, max(1, -(-int(cells.rows[c]) // ROW_BLOCK)), max(1, -(-n // QUERY_BLOCK))) for c, n in asks.items()]
    shape = F.broadcast(spark.createDataFrame(blocks, "cell int, row_blocks int, query_blocks int"))
    rows = _rows(spark, path).filter(F.col("cell").isin(list(asks))).join(shape, "cell")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = rows.select("id", "embedding", "cell", block("id", "row_blocks").alias("i"), every("query_blocks").alias("j"))
    probed = probed.join(shape, "cell").select("query_id", "embedding", "reach", "cell", every("row_blocks").alias("i"), block("query_id", "query_blocks").alias("j"))
    return nearest_in_groups(rows, probed, k, "cell", "i", "j")


@dataclass
class Sent:
    """A block of queries(query_id, embedding, reach), and the places of those that ask for each cell."""

    queries: pa.Table
    of: dict[int, np.ndarray]


def _sent(probed: DataFrame) -> Sent | None:
    """probed(query_id, embedding, reach, cell) if it is few enough to go to every task."""
    pairs = probed.select("query_id", "cell").limit(SENT_PAIRS + 1).toArrow()
    if pairs.num_rows > SENT_PAIRS or pairs["query_id"].null_count:
        return None
    ids, at = np.unique(pairs["query_id"].to_numpy(), return_inverse=True)
    if len(ids) > QUERY_BLOCK:
        return None
    queries = probed.select("query_id", "embedding", "reach").distinct().orderBy("query_id").toArrow()
    if queries.num_rows != len(ids):  # an id with several vectors
        return None
    cell = pairs["cell"].to_numpy()
    order = np.argsort(cell, kind="stable")
    different, first = np.unique(cell[order], return_index=True)
    return Sent(queries, dict(zip(different.tolist(), np.split(at[order], first[1:]), strict=False)))


def _read_by(rows: DataFrame, few: Sent, k: int) -> DataFrame:
    """query_id, id, distance: a map over rows(id, embedding, cell), whose tasks hand on the k best a query of their own."""
    sent = rows.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, kept = sent.value, []
        for b in batches:
            cell = b.column(2).to_numpy()
            for lo, hi in pairwise([0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]):
                for first in range(lo, hi, ROW_BLOCK):
                    part = pa.Table.from_batches([b.slice(first, min(ROW_BLOCK, hi - first))])
                    kept.append(_nearest(part, asks.queries.take(pa.array(asks.of[int(cell[first])])), k))
                    if sum(x.num_rows for x in kept) > max(100_000, 4 * k * asks.queries.num_rows):
                        kept = [_closest(pa.concat_tables(kept), k)]
        if kept:
            yield from _closest(pa.concat_tables(kept), k).combine_chunks().to_batches()

    return rows.select("id", "embedding", "cell").mapInArrow(run, "query_id bigint, id bigint, distance double")


def drop(spark: SparkSession, path: str) -> None:
    delete(spark, path)
