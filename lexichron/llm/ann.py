"""Operator 3: maximum inner product search with score-aware (anisotropic) product quantisation.

Vectors are cut into pieces of PIECE numbers, each coded with four bits. Codes and codebooks minimise
|r|^2 + (eta - 1) * (r . x/|x|)^2 over the residual r, so that error parallel to the vector, which moves the largest
inner products most, costs more (Guo et al., 2020). A search looks a query up in tables of partial products (two
four-bit codes to a byte, sixteen bytes for 64 numbers); the best of the scan, and only those, are ranked by the exact
inner product in double precision.

The codebooks are fitted on at most SAMPLE vectors (those of smallest hash); every row is indexed, and the index is
written once. Queries and index rows are dealt by hash into blocks of about QUERIES and ROWS; each pair of blocks is one
group of a co-group, whose memory is bounded, and gives the best k a query. The plan does not depend on how many there
are. The shortlist of a query has DEPTH + ROOT * sqrt(n) rows in all (1.4% of 50,000 rows, 0.03% of 10^8), of which a
block of an n-th of the rows ranks its share and half as much again. Recall is measured against brute force in the tests.

Results: vectors that are null, zero, of another length than most, or that hold null or non-finite numbers take no
part; rows of equal vectors tie and go by smaller vec_id (blocks collapse equal vectors before the scan, so copies
crowd out nothing); rows that repeat a vec_id are one query and never found by it, and rows that also repeat its vector
are one row with a count; null vec_ids take no part; with fewer candidates than k all are returned; an empty table gives
an empty table. Columns other than vec_id and embedding, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, table

PIECE, CODES = 2, 16
SAMPLE, QUERIES, ROWS, TOP = 8_192, 1_024, 8_192, 20
DEPTH, ROOT = 256, 2.0
#: Share of a query's norm that a product must reach for its error to matter; sets eta.
THRESHOLD = 0.2
ROUNDS = 5


def matrix(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and rows (double) of the vectors that take part."""
    good = pc.and_(pc.and_(pc.is_valid(ids), pc.is_valid(vectors)), pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    x = vectors.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids.filter(good).to_numpy(zero_copy_only=False).astype(np.int64)[ok], x[ok]


class Quantiser:
    """Codebooks (pieces, CODES, PIECE) and what is needed to code vectors with them."""

    def __init__(self, dim: int, sample: np.ndarray):
        self.dim, self.pieces = dim, 2 * math.ceil(dim / (2 * PIECE))
        self.eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x = self.cut(sample)
        start = np.linspace(0, max(0, len(x) - 1), CODES).astype(int)
        self.books = x[start].transpose(1, 0, 2).copy() if len(x) else np.zeros((self.pieces, CODES, PIECE))
        for _ in range(ROUNDS if len(x) else 0):
            codes, unit, gap = self._code(x)
            for m in range(self.pieces):
                r = x[:, m] - self.books[m, codes[:, m]]
                others = gap - (r * unit[:, m]).sum(1)
                w = self.eta - 1
                outer = unit[:, m, :, None] * unit[:, m, None, :] * w + np.eye(PIECE)
                wish = x[:, m] + w * (others + (x[:, m] * unit[:, m]).sum(1))[:, None] * unit[:, m]
                for k in range(CODES):
                    mine = codes[:, m] == k
                    if mine.any():
                        self.books[m, k] = np.linalg.solve(outer[mine].sum(0), wish[mine].sum(0))
                gap = others + ((x[:, m] - self.books[m, codes[:, m]]) * unit[:, m]).sum(1)

    def cut(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.pieces * PIECE))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), self.pieces, PIECE)

    def _code(self, x: np.ndarray, passes: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes by coordinate descent over the pieces, unit vectors, and the parallel residual r . x/|x|."""
        unit = x / np.sqrt((x**2).sum((1, 2), keepdims=True))
        codes = np.stack([((x[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(self.pieces)], 1)
        r = x - self.books[np.arange(self.pieces), codes]
        along = (r * unit).sum(2)
        gap = along.sum(1)
        for _ in range(passes):
            for m in range(self.pieces):
                others = gap - along[:, m]
                rest = x[:, m, None] - self.books[m]
                par = (rest * unit[:, m, None]).sum(2)
                codes[:, m] = ((rest**2).sum(2) + (self.eta - 1) * (others[:, None] + par) ** 2).argmin(1)
                along[:, m] = par[np.arange(len(x)), codes[:, m]]
                gap = others + along[:, m]
        return codes, unit, gap

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        if not len(x):
            return np.zeros((0, self.pieces // 2), np.uint8)
        codes = self._code(self.cut(x))[0].astype(np.uint8)
        return codes[:, 0::2] * CODES + codes[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Partial products of each query with each pair of codes: (queries, bytes, 256)."""
        part = np.einsum("qmp,mkp->qmk", self.cut(q), self.books)
        return (part[:, 0::2, :, None] + part[:, 1::2, None, :]).reshape(len(q), self.pieces // 2, CODES * CODES).astype(np.float32)


def exact(q: np.ndarray, columns: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Inner products of each query with its picked rows, summed in order in double precision; columns holds rows^T."""
    total = np.zeros(pick.shape)
    for j in range(q.shape[1]):
        total += q[:, j, None] * columns[j][pick]
    return total


def scan_block(q_ids: np.ndarray, q: np.ndarray, tables: np.ndarray, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, codes: np.ndarray, top: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The best top rows of a block for each query among the depth best of the table scan: scores and ids (-inf and -1
    where there are fewer)."""
    order = np.argsort(ids, kind="stable")
    ids, copies, x, codes = ids[order], copies[order], x[order], codes[order]
    _, first, inverse = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    # the smallest top + 1 ids of each distinct vector
    each, inverse = np.repeat(ids, copies), np.repeat(inverse, copies)
    by = np.argsort(inverse, kind="stable")
    nth = np.arange(len(by)) - np.searchsorted(inverse[by], inverse[by])
    wide = min(top + 1, int(nth.max()) + 1)
    members = np.full((len(first), wide), -1, np.int64)
    fits = nth < wide
    members[inverse[by][fits], nth[fits]] = each[by][fits]
    x, codes, n = x[first], codes[first], len(first)
    depth = min(n, max(depth, top + 1))
    columns = np.ascontiguousarray(x.T)
    best_s, best_i = [], []
    for a in range(0, len(q), 128):
        t = tables[a : a + 128]
        approx = np.zeros((len(t), n), np.float32)
        for b in range(codes.shape[1]):
            approx += t[:, b, :][:, codes[:, b]]
        pick = np.argpartition(-approx, depth - 1, axis=1)[:, :depth] if depth < n else np.tile(np.arange(n), (len(t), 1))
        score = exact(q[a : a + 128], columns, pick)
        few = min(depth, top + 1)
        # ties between distinct vectors are rare; those at the edge are settled by the smallest id of the vector
        at = np.lexsort((members[pick, 0], -score), axis=1)[:, :few]
        pick, score = np.take_along_axis(pick, at, 1), np.take_along_axis(score, at, 1)
        got_i = members[pick].reshape(len(t), -1)
        got_s = np.repeat(score, wide, axis=1)
        got_s = np.where((got_i < 0) | (got_i == q_ids[a : a + 128, None]), -np.inf, got_s)
        best_s.append(got_s)
        best_i.append(got_i)
    return best_of(np.concatenate(best_s), np.concatenate(best_i), top)


def best_of(score: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -score), axis=1)[:, :top]
    return np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Quantiser | None:
    """Codebooks for vectors(vec_id, embedding); None if no vector can take part."""
    dims = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.size("embedding").alias("d")).count()
    usual = dims.filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return None
    rows = vectors.filter((F.size("embedding") == usual["d"]) & F.col("vec_id").isNotNull())
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not some.num_rows:
        return None
    some = some.combine_chunks()
    _, x = matrix(some["vec_id"].combine_chunks(), some["embedding"].combine_chunks(), usual["d"])
    return Quantiser(usual["d"], x)


def build_index(vectors: DataFrame, quant, top: int = TOP) -> DataFrame:
    """vec_id, copies, embedding, code of every row that takes part; quant is a broadcast Quantiser. Equal rows are one
    with their number, of which no more than top can be found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):  # the coder's distances of a part take a few MB
                part = batch.slice(at, 2_048)
                n, x = matrix(pa.array(np.arange(part.num_rows)), part.column(2), quant.value.dim)
                code = quant.value.encode(x)
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                own = [part.column(i).take(pa.array(n)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, values, pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "copies", "embedding", "code"])

    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    counted = rows.agg(F.least(F.count("*"), F.lit(top)).alias("copies")).select("vec_id", "copies", "embedding")
    return counted.mapInArrow(run, "vec_id bigint, copies bigint, embedding array<double>, code binary")


def can_ask(dim: int):
    """Whether an embedding takes part: of dim finite numbers, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size("embedding") == dim) & ~bad & F.exists("embedding", lambda x: x != 0)


def search(index: DataFrame, queries: DataFrame, quant, top: int = TOP, depth: int | None = None, queries_a_block: int = QUERIES, rows_a_block: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the top nearest rows of a written index for each row of queries(vec_id, embedding)."""
    dim = quant.value.dim
    # of rows that share an id, one whose vector can ask is the query, whatever the order of rows: the one of smallest hash
    asked = queries.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(can_ask(dim))
    asked = asked.groupBy("vec_id").agg(F.min_by("embedding", F.struct(F.xxhash64("embedding"), F.col("embedding"))).alias("embedding"))
    n = index.count()
    row_blocks, query_blocks = max(1, math.ceil(n / rows_a_block)), max(1, math.ceil(asked.count() / queries_a_block))
    depth = depth or math.ceil(DEPTH + ROOT * math.sqrt(n))
    share = depth if row_blocks == 1 else math.ceil(1.5 * depth / row_blocks) + top

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    rows = index.select("*", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(row_blocks)).cast("int").alias("i"), every(query_blocks).alias("j"))
    asked = asked.select("*", every(row_blocks).alias("i"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("j"))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(block: pa.Table, asking: pa.Table) -> pa.Table:
        if not block.num_rows or not asking.num_rows:
            return out.empty_table()
        block, asking = block.combine_chunks(), asking.combine_chunks()
        q_ids, q = matrix(asking["vec_id"].chunk(0), asking["embedding"].chunk(0), dim)
        if not len(q):
            return out.empty_table()
        x = block["embedding"].chunk(0).flatten().to_numpy().reshape(-1, dim)
        codes = np.frombuffer(b"".join(block["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        score, ids = scan_block(q_ids, q, quant.value.tables(q), block["vec_id"].to_numpy(), block["copies"].to_numpy(), x, codes, top, share)
        real = score > -np.inf
        return pa.table([pa.array(np.repeat(q_ids, real.sum(1))), pa.array(ids[real]), pa.array(score[real])], schema=out)

    found = rows.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, depth: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Fits, indexes vectors and searches them for queries."""
    quant = fit(vectors, sample)
    if quant is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sent = vectors.sparkSession.sparkContext.broadcast(quant)
    return search(Shelf(vectors.sparkSession).put(build_index(vectors, sent, top)), queries, sent, top, depth)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
"""
