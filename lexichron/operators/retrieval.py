"""Keyword and vector legs, rank fusion, hydration, reranking and pluggable models.

Legs return (query_id, id, rank), best first, with ties to the smaller id. Only ids and ranks travel until the few
winners are joined with their texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_terms, stem, stems

CANDIDATES, SHORTLIST, RRF_K = 50, 20, 60
#: Queries and rows of a block.
QUERY_BLOCK, ROW_BLOCK = 1_024, 16_384
#: Pairs of a question and a term that go to every task; more are joined. Pairs of a posting and a question, or of a text
#: and a question, that are added up at a time.
ASKED_PAIRS, SUMMED = 200_000, 2_000_000
#: Words that a task handles at a time.
SLICE_WORDS = 1 << 20


def ranked(scores: DataFrame, k: int, *best: Column) -> DataFrame:
    """query_id, id, rank of the k best rows a query; the limit reaches below the shuffle (WindowGroupLimit)."""
    place = Window.partitionBy("query_id").orderBy(*best, F.col("id"))
    return scores.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "id", "rank")


def query_terms(queries: DataFrame, analyze: Callable[[Column], Column] = keyword_terms) -> DataFrame:
    """query_id, term of queries(query_id, question), each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(analyze(F.col("question")))).alias("term"))


def postings(docs: DataFrame, analyze: Callable[[Column], Column] = keyword_terms, only: DataFrame | None = None) -> DataFrame:
    """term, id, tf of docs(id, text): what an index stores. analyze may also be stemmed_terms, on both sides. Without a
    stored index, only(term) keeps the terms asked for, and the others go before anything is shuffled."""
    terms = docs.select("id", F.explode(analyze(F.col("text"))).alias("term"))
    if only is not None:
        terms = terms.join(only.select("term").distinct(), "term", "left_semi")
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"))


def stemmed_terms(text: Column) -> Column:
    return stems(keyword_terms(text))


#: Analyses that change each word of another one by itself, which may be done once a different word where words are counted.
BY_WORD = {stemmed_terms: (keyword_terms, stem)}


def keyword_scores(index: DataFrame, queries: DataFrame, analyze: Callable[[Column], Column] = keyword_terms) -> DataFrame:
    """query_id, id, score: matching places of any term of queries(query_id, question).

    With terms joined by OR every minimal cover is one place, so cover density counts matching places.
    """
    return index.join(query_terms(queries, analyze), "term").groupBy("query_id", "id").agg(F.sum("tf").alias("score"))


def keyword_leg(index: DataFrame, queries: DataFrame, k: int = CANDIDATES, analyze: Callable[[Column], Column] = keyword_terms) -> DataFrame:
    return ranked(keyword_scores(index, queries, analyze), k, F.desc("score"))


class Asked:
    """The questions of a scan: their terms, and for each term the places of the questions that have it."""

    def __init__(self, pairs: list[tuple[int, str]]) -> None:
        queries, at = np.unique(np.array([q for q, _ in pairs], np.int64), return_inverse=True)
        terms = sorted({t for _, t in pairs})
        number = {t: i for i, t in enumerate(terms)}
        code = np.array([number[t] for _, t in pairs], np.int64)
        self.queries, self.terms = queries, pa.array(terms, pa.string())
        self.asks = at[np.argsort(code, kind="stable")]
        self.upto = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(terms)))]).astype(np.int64)

    def codes(self, terms: pa.Array) -> np.ndarray:
        """The numbers of terms, -1 for those that no question has."""
        return pc.fill_null(pc.index_in(terms, self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def sums(self, code: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """A row a document and a column a question: the weights of the document's terms that the question has. code: numbers
        of terms that are asked for, doc: below n and in order."""
        width, total = len(self.queries), np.zeros(n * len(self.queries))
        for at, value in self._asking(code, doc, weight):
            total += np.bincount(at, value, n * width)
        return total.reshape(n, width)

    def greatest(self, code: np.ndarray, doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """As sums, but the greatest value instead of the sum."""
        most = np.zeros(n * len(self.queries), np.int64)
        for at, each in self._asking(code, doc, value):
            np.maximum.at(most, at, each)
        return most.reshape(n, len(self.queries))

    def _asking(self, code: np.ndarray, doc: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The cells of doc and question that each term belongs to, with its value, about SUMMED at a time."""
        width, cost, lo = len(self.queries), np.cumsum(np.diff(self.upto)[code]), 0
        while lo < len(code):
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + SUMMED)))
            c, first = code[lo:hi], self.upto[code[lo:hi]]
            times = self.upto[c + 1] - first
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield np.repeat(doc[lo:hi] * width, times) + self.asks[np.repeat(first, times) + place], np.repeat(value[lo:hi], times)
            lo = hi


class Best:
    """The k rows of greatest score of each query so far, ties to the smaller id."""

    def __init__(self, k: int, queries: int) -> None:
        self.k, self.most = k, max(100_000, 4 * k * queries)
        self.least, self.held, self.n = np.ones(queries), [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, ids, score))
        self.n += len(query)
        if self.n > self.most:
            query, ids, score = self.found()
            self.held, self.n = [(query, ids, score)], len(query)
            last = np.flatnonzero(np.append(query[1:] != query[:-1], True)) if len(query) else np.zeros(0, int)
            full = last[np.bincount(query, minlength=len(self.least))[query[last]] == self.k]
            self.least[query[full]] = np.maximum(self.least[query[full]], score[full])

    def add_sums(self, sums: np.ndarray, ids: np.ndarray) -> None:
        doc, query = np.nonzero(sums >= self.least)
        self.add(query, ids[doc], sums[doc, query])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        keep = np.arange(len(order)) - np.searchsorted(query, query) < self.k
        return query[keep], ids[order][keep], score[order][keep]

    def batch(self, queries: np.ndarray) -> pa.RecordBatch:
        query, ids, score = self.found()
        return pa.RecordBatch.from_arrays([pa.array(queries[query]), pa.array(ids), pa.array(score.astype(np.int64))], names=["query_id", "id", "score"])


def few_asked(terms: DataFrame) -> Asked | None:
    """The terms(query_id, term) if they are few enough to go to every task."""
    if dict(terms.dtypes)["query_id"] not in ("bigint", "int", "smallint", "tinyint"):
        return None
    pairs = [tuple(r) for r in terms.select("query_id", "term").limit(ASKED_PAIRS + 1).collect()]
    return None if len(pairs) > ASKED_PAIRS or any(q is None for q, _ in pairs) else Asked(pairs)


def one_row_an_id(rows: DataFrame) -> bool:
    """True if each row has a whole number of its own as id: what an id adds up to then is in one row. Reads the ids alone."""
    return dict(rows.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint") and rows.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty()


def keyword_search(docs: DataFrame, queries: DataFrame, k: int = CANDIDATES, analyze: Callable[[Column], Column] = keyword_terms) -> DataFrame:
    """query_id, id, rank: keyword_leg of the postings of docs(id, text), in one pass over the texts.

    All of a document's terms are in its row, so a task adds up its own documents' scores and hands on the k best a query;
    nothing else is shuffled. Repeated ids, and questions of too many terms for a task, go by joins.
    """
    terms = query_terms(queries, analyze)
    asked = few_asked(terms)
    if asked is None or not one_row_an_id(docs):
        return keyword_leg(postings(docs, analyze, only=terms), queries, k, analyze)
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = sent.value
        best, step = Best(k, len(asks.queries)), max(1, min(256, SUMMED // max(1, len(asks.queries))))
        for b in batches:
            for lo in range(0, b.num_rows, step):
                ids, words = b.column(0).slice(lo, step).to_numpy(), b.column(1).slice(lo, step)
                doc = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
                code = asks.codes(words.flatten())
                # a pair of a document and a term once, with its number of places
                pair, times = np.unique(doc[code >= 0] * len(asks.terms) + code[code >= 0], return_counts=True)
                best.add_sums(asks.sums(pair % max(1, len(asks.terms)), pair // max(1, len(asks.terms)), times, len(ids)), ids)
        yield best.batch(asks.queries)

    scores = docs.select(F.col("id").cast("bigint").alias("id"), analyze(F.col("text")).alias("terms")).mapInArrow(run, "query_id bigint, id bigint, score bigint")
    return ranked(scores, k, F.desc("score"))


def slices(size: np.ndarray, step: int = 1) -> Iterator[tuple[int, int]]:
    """Ranges of rows with `size` words each: `step` rows, or as many times that as have SLICE_WORDS words together."""
    upto, lo = np.append(0, np.cumsum(size)), 0
    while lo < len(size):
        within = int(np.searchsorted(upto, upto[lo] + SLICE_WORDS, side="right")) - 1 - lo
        hi = len(size) if lo + within >= len(size) else min(len(size), lo + max(1, within // step) * step)
        yield lo, hi
        lo = hi


def _matrix(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and double rows of the vectors of length dim without nulls; others are left out."""
    good = pc.and_(pc.is_valid(vectors), pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    x = vectors.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    whole = np.isfinite(x).all(1)
    return ids.filter(good).to_numpy(zero_copy_only=False)[whole], x[whole]


def vector_leg(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, queries_a_block: int = QUERY_BLOCK, rows_a_block: int = ROW_BLOCK) -> DataFrame:
    """The k rows of vectors(id, embedding) nearest by cosine distance to each of queries(query_id, embedding).

    Exact. One block of queries goes to every task, which hands on the best k a query of its own rows. More queries, and
    the rows, are dealt into blocks by hash; each pair of blocks is one group of a co-group, of bounded size, that gives the
    best k a query. The plan does not depend on how many there are.
    """
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding")
    rows = vectors.select(F.col("id").cast("bigint").alias("id"), "embedding")
    found = by_blocks(rows, asked, lambda candidates, asking: _nearest(candidates, asking, k), k, queries_a_block, rows_a_block)
    return ranked(found, k, F.asc("distance"))


def by_blocks(rows: DataFrame, asked: DataFrame, best: Callable[[pa.Table, pa.Table], pa.Table], k: int, queries_a_block: int, rows_a_block: int) -> DataFrame:
    """query_id, id, distance: what best(candidates, asking), which gives at most k rows a row of asking, finds in each block of
    rows(id, …) for each block of asked(query_id, …). No task holds more than a few blocks."""
    shape = "query_id bigint, id bigint, distance double"
    few = asked.limit(queries_a_block + 1).toArrow()
    if few.num_rows <= queries_a_block:
        sent = rows.sparkSession.sparkContext.broadcast(few)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: list[pa.Table] = []
            for b in batches:
                for lo in range(0, b.num_rows, rows_a_block):
                    kept.append(best(pa.Table.from_batches([b.slice(lo, rows_a_block)]), sent.value))
                    if sum(x.num_rows for x in kept) > max(100_000, 4 * k * sent.value.num_rows):
                        kept = [_closest(pa.concat_tables(kept), k)]
            if kept:
                yield from _closest(pa.concat_tables(kept), k).combine_chunks().to_batches()

        return rows.mapInArrow(run, shape)
    row_blocks, query_blocks = max(1, math.ceil(rows.count() / rows_a_block)), max(1, math.ceil(asked.count() / queries_a_block))

    def block(key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    rows = rows.select("*", block("id", row_blocks).alias("i"), every(query_blocks).alias("j"))
    asked = asked.select("*", every(row_blocks).alias("i"), block("query_id", query_blocks).alias("j"))
    return rows.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInArrow(best, shape)


#: Far above what rounding moves a cosine distance.
MARGIN = 1e-9


def nearest_in_groups(rows: DataFrame, asked: DataFrame, k: int, *by: str) -> DataFrame:
    """query_id, id, distance: the k rows(id, embedding) nearest to each of asked(query_id, embedding) within each group of
    equal `by`, both sides of which must be of bounded size.

    A matrix product chooses the rows up to the k-th distance and a margin beyond; of those alone the distance is summed in
    order, as a plain loop would.
    """
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(lambda candidates, asking: _nearest(candidates, asking, k), "query_id bigint, id bigint, distance double")


def _closest(found: pa.Table, k: int) -> pa.Table:
    """The k rows of least distance of each query of found, ties to the smaller id."""
    query, ids, distance = (found[c].to_numpy() for c in ("query_id", "id", "distance"))
    order = np.lexsort((ids, distance, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return found.take(pa.array(order[place < k]))


def _sizes(x: np.ndarray) -> np.ndarray:
    """The lengths of the rows of x, their squares summed in order as a plain loop would: another order of the sum moves the
    last place of a distance, and with it which of two rows at one distance comes first."""
    square = np.zeros(len(x))
    for column in x.T:
        square += column * column
    return np.sqrt(square)


def _nearest(candidates: pa.Table, asking: pa.Table, k: int) -> pa.Table:
    """query_id, id, distance of the k candidates nearest to each row of asking; where that has a reach that is not negative, of
    those up to that distance and a margin."""
    out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
    if not candidates.num_rows or not asking.num_rows:
        return out.empty_table()
    candidates, asking = candidates.combine_chunks(), asking.combine_chunks()
    dim = max((n for n in pc.list_value_length(asking["embedding"]).to_pylist() if n), default=1)
    v_ids, v = _matrix(candidates["id"].chunk(0), candidates["embedding"].chunk(0), dim)
    whole, q = _matrix(pa.array(np.arange(asking.num_rows)), asking["embedding"].chunk(0), dim)
    q_ids = asking["query_id"].to_numpy()[whole]
    reach = asking["reach"].to_numpy()[whole] if "reach" in asking.column_names else np.full(len(q), -1.0)
    most = np.where(reach < 0, np.inf, reach + MARGIN)
    v_size, parts = _sizes(v), []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        sizes = _sizes(part)
        with np.errstate(invalid="ignore", divide="ignore"):
            rough = np.nan_to_num(1 - part @ v.T / (sizes[:, None] * v_size), nan=np.inf)
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] + MARGIN if rough.shape[1] > k else np.full(len(part), np.inf)
        edge = np.minimum(edge, most[at : at + 256])
        asks, found = np.nonzero((rough <= edge[:, None]) & np.isfinite(rough))
        product = np.zeros(len(asks))
        for j in range(dim):  # in order, as a plain loop would add
            product += part[asks, j] * v[found, j]
        distance = 1 - product / (sizes[asks] * v_size[found])
        order = np.lexsort((v_ids[found], distance, asks))
        place = np.arange(len(order)) - np.searchsorted(asks[order], asks[order])
        best = order[place < k]
        parts.append(pa.table([pa.array(q_ids[at + asks[best]]), pa.array(v_ids[found[best]]), pa.array(distance[best])], schema=out))
    return pa.concat_tables(parts).combine_chunks() if parts else out.empty_table()


def rrf(*legs: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, id, score: sum of 1 / (k + rank) over the legs, added leg by leg so that sums do not vary."""
    parts = [leg.select("query_id", "id", F.lit(i).alias("leg"), (1.0 / (F.col("rank") + k)).alias("part")) for i, leg in enumerate(legs)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    packed = both.groupBy("query_id", "id").agg(F.sort_array(F.collect_list(F.struct("leg", "part"))).alias("parts"))
    return packed.select("query_id", "id", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["part"]).alias("score"))


def fused(*legs: DataFrame, limit: int = SHORTLIST) -> DataFrame:
    """query_id, id, score, rank: the fused ranking cut at limit."""
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rrf(*legs).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= limit)


def single_leg(leg: DataFrame, limit: int) -> DataFrame:
    """A leg as a result of its own: the score comes from the rank, not from the leg's measure."""
    return leg.filter(F.col("rank") <= limit).withColumn("score", 1.0 / (F.col("rank") + RRF_K))


def hydrate(results: DataFrame, texts: DataFrame) -> DataFrame:
    """Results with the columns of texts(id, …); ids without a text are dropped, ranks stay."""
    return results.join(texts, "id")


def overlap_score(question: Column, text: Column) -> Column:
    """The default reranker: distinct words in common."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(question), words(text))).cast("double")


def rerank(results: DataFrame, queries: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The k best of results(query_id, id, rank, text) by scorer(question, text); equal scores keep their order."""
    scored = results.join(queries.select("query_id", "question"), "query_id").withColumn("score", scorer(F.col("question"), F.col("text")))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("fused_rank", F.col("rank")).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def search(index: DataFrame, vectors: DataFrame, texts: DataFrame, queries: DataFrame, mode: str = "hybrid", k: int = 5) -> DataFrame:
    """query_id, id, rank, score and the columns of texts. queries: query_id, question, embedding.

    Modes: keyword, vector, hybrid, rerank (a shortlist of the fused legs, rescored).
    """
    if mode == "keyword":
        return hydrate(single_leg(keyword_leg(index, queries), k), texts)
    if mode == "vector":
        return hydrate(single_leg(vector_leg(vectors, queries), k), texts)
    if mode not in ("hybrid", "rerank"):
        raise ValueError(f"unknown mode: {mode}")
    both = fused(keyword_leg(index, queries), vector_leg(vectors, queries), limit=k if mode == "hybrid" else SHORTLIST)
    found = hydrate(both, texts)
    return rerank(found, queries, k) if mode == "rerank" else found


# --- models ---------------------------------------------------------------------------------------------------------


def hash_weights(docs: DataFrame, dim: int = 64) -> DataFrame:
    """id, bucket, weight of docs(id, text): words hashed to dim buckets (a power of two), unit length. JVM only."""
    w = docs.select("id", F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("w")).select("id", F.regexp_replace("w", r"^[.,?!]+|[.,?!]+$", "").alias("w")).filter("w <> ''")
    bucket = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 25, 8), 16, 10).cast("bigint") % dim
    n = w.groupBy("id", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    size = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")).cast("double"))
    return n.select("id", "bucket", (F.col("n") / size).alias("weight"))


def hash_embed(docs: DataFrame, dim: int = 64) -> DataFrame:
    """id, embedding of docs(id, text): hash_weights as a dense array; a text without words has no row. A row-wise map where
    each id is one row: each different word of a slice of texts is hashed once."""
    if one_row_an_id(docs):
        made = _with_vectors(docs.select(F.col("id").cast("bigint").alias("id"), "text"), dim).filter("embedding IS NOT NULL")
        return made.select(F.col("id").cast(docs.schema["id"].dataType).alias("id"), "embedding")
    m = hash_weights(docs, dim).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)).cast("float")).alias("embedding"))


def embedded(docs: DataFrame, embed: Callable[[DataFrame], DataFrame] = hash_embed) -> DataFrame:
    """docs(id, text, …) with the column embedding of embed(id, text) -> (id, embedding), NULL where that gives none. The default
    adds it in a row-wise map, without a shuffle of texts, where each id is one row."""
    if embed is hash_embed and one_row_an_id(docs):
        return _with_vectors(docs)
    return docs.join(embed(docs.select("id", "text")), "id", "left")


def _with_vectors(docs: DataFrame, dim: int = 64) -> DataFrame:
    """docs(text, …) with the column embedding, NULL for a text without words. A row-wise map: each different word of a slice of texts is hashed once."""
    # one string a text goes to Python, not one a word
    bare = docs.withColumn("__words", F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = [*docs.columns, "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pc.split_pattern(b.column(b.num_columns - 1), " ")
            size = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
            made = [_hashed(words.slice(lo, hi - lo), size[lo:hi], dim) for lo, hi in slices(size)]
            vectors = pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors], names=names)

    return bare.mapInArrow(run, f"{shape}, embedding array<float>")


def _hashed(words: pa.Array, size: np.ndarray, dim: int) -> pa.Array:
    """The vector of each list of words, of `size` words each; null without words."""
    doc = np.repeat(np.arange(len(words)), size)
    coded = words.flatten().dictionary_encode()
    bare = [w.strip(".,?!").encode() for w in coded.dictionary.to_pylist()]
    bucket = np.array([int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[12:]) % dim if w else -1 for w in bare], np.int64)[coded.indices.to_numpy()]
    n = np.bincount(doc[bucket >= 0] * dim + bucket[bucket >= 0], minlength=len(words) * dim).reshape(-1, dim)
    some = n.any(1)
    unit = (n[some] / np.sqrt((n[some] * n[some]).sum(1).astype(np.float64))[:, None]).astype(np.float32)
    offsets = pa.array(np.append(0, np.cumsum(some)) * dim, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()), mask=pa.array(~some))


def pending(passages: DataFrame, model: str) -> DataFrame:
    """Rows whose embedding is missing or made by another model."""
    return passages.filter(F.col("embedding").isNull() | ~F.col("embed_model").eqNullSafe(F.lit(model)))


def embed_pending(passages: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame] = hash_embed) -> DataFrame:
    """passages with the vectors of pending rows made anew by embed(id, text) -> (id, embedding)."""
    made = embed(pending(passages, model).select("id", "text")).select("id", F.col("embedding").alias("made"))
    both = passages.join(made, "id", "left")
    new = F.col("made").isNotNull()
    return both.withColumn("embedding", F.coalesce("made", "embedding")).withColumn("embed_model", F.when(new, F.lit(model)).otherwise(F.col("embed_model"))).drop("made")


def lsh_leg(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, width: float = 0.5, tables: int = 12, reach: float = 1.2, seed: int = 7) -> DataFrame:
    """An approximate vector leg for unit vectors: hash tables of random projections propose rows within `reach`, exact
    distance ranks them. Neighbours at distance d share a bucket of one table with a chance of about 1 - 0.8 d / width
    (d well under width): meant for near neighbours, as of embedded texts; far ones are found by vector_leg.

    Buckets have no bound (a projection of unit vectors falls into a few, whatever their number), so rows and queries do not
    meet by bucket: each carries its buckets into blocks of bounded size, and only the k best a query leave a block.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def kept(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).cast("bigint").alias(key), "embedding").filter("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)").distinct()

    rows, asked = kept(vectors, "id"), kept(queries, "query_id")
    if not (first := rows.limit(1).select(array_to_vector("embedding").alias("v"))).count():
        return ranked(rows.join(asked, F.lit(False)).select("query_id", "id", F.lit(0.0).alias("distance")), k, F.asc("distance"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(first)

    def hashed(df: DataFrame) -> DataFrame:
        h = model.transform(df.withColumn("v", array_to_vector("embedding")))
        return h.withColumn("buckets", F.transform("h", lambda x: vector_to_array(x)[0])).drop("v", "h")

    found = by_blocks(hashed(rows), hashed(asked), lambda candidates, asking: _in_buckets(candidates, asking, k, reach), k, QUERY_BLOCK, ROW_BLOCK)
    return ranked(found, k, F.asc("distance"))


def _in_buckets(candidates: pa.Table, asking: pa.Table, k: int, reach: float) -> pa.Table:
    """query_id, id, distance of the k candidates nearest to each row of asking, of those that share a bucket of a table with it
    and lie within reach."""
    out = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
    if not candidates.num_rows or not asking.num_rows:
        return out.empty_table()
    dim = pc.list_value_length(asking["embedding"])[0].as_py()

    def arrays(t: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = t.combine_chunks()
        at, x = _matrix(pa.array(np.arange(t.num_rows)), t["embedding"].chunk(0), dim)
        buckets = t["buckets"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        return t[key].to_numpy()[at], x, buckets[at].T.copy()

    (v_ids, v, v_buckets), (q_ids, q, q_buckets) = arrays(candidates, "id"), arrays(asking, "query_id")
    v_square, parts = (v * v).sum(1), []
    for at in range(0, len(q), 64):
        part = q[at : at + 64]
        rough = (part * part).sum(1)[:, None] + v_square - 2 * (part @ v.T)
        asks, found = np.nonzero(rough <= reach * reach + MARGIN)
        shared = np.zeros(len(asks), bool)
        for of_q, of_v in zip(q_buckets, v_buckets, strict=True):
            shared |= of_q[at + asks] == of_v[found]
        asks, found = asks[shared], found[shared]
        rough = rough[asks, found]
        order = np.lexsort((rough, asks))
        place = np.arange(len(order)) - np.searchsorted(asks[order], asks[order])
        edge = np.full(len(part), np.inf)
        edge[asks[order[place == k - 1]]] = rough[order[place == k - 1]]
        near = rough <= edge[asks] + MARGIN
        asks, found = asks[near], found[near]
        square = np.zeros(len(asks))
        for j in range(dim):  # in order, as a plain loop would add
            square += (part[asks, j] - v[found, j]) ** 2
        distance = np.sqrt(square)
        order = np.lexsort((v_ids[found], distance, asks))
        place = np.arange(len(order)) - np.searchsorted(asks[order], asks[order])
        best = order[(place < k) & (distance[order] < reach)]
        parts.append(pa.table([pa.array(q_ids[at + asks[best]]), pa.array(v_ids[found[best]]), pa.array(distance[best])], schema=out))
    return pa.concat_tables(parts).combine_chunks() if parts else out.empty_table()
