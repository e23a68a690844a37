"""A stored full-text index: postings with positions in blocks of documents, with the largest term count of each block, and a
top-k search that skips the blocks that cannot hold a result.

BLOCK_DOCS documents that follow one another in a task's input make a block, the same for all terms. A block has a term's
postings in it and their largest count, so the counts of a query's terms add up to a bound on every score in
the block. Blocks that follow one another make a slab, of at most SLICE_WORDS words unless it is one block; a row holds a term's blocks in a slab, so that
there are few rows to sort and to store. A search first reads these heads alone, scores each query's most promising blocks, and then reads of all others
only those whose bound reaches the k-th score found. The result is that of a scan over all postings.

Rows lie in folders by a hash of the term, each file sorted by term, so that a search lists and reads the folders and row groups of its
terms. Documents without terms have no postings. An id must be indexed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import BY_WORD, CANDIDATES, SUMMED, Asked, Best, few_asked, query_terms, ranked, slices, stemmed_terms
from ..session import written

#: Documents of a block, characters of a folder in a new index, and terms that are handed to the scan as a list.
BLOCK_DOCS, FOLDER_CHARACTERS, LISTED = 64, 200_000_000, 2_000
#: Numbers of blocks that a task has for itself.
TASK_BLOCKS = 1 << 32
#: A term's blocks in a slab, which is named by its first block: their numbers, largest counts, documents and first postings; and
#: the postings of all of them.
SCHEMA = "term string, slab bigint, blocks array<bigint>, tops array<int>, ns array<int>, firsts array<int>, ids array<bigint>, tfs array<int>, positions array<array<int>>, folder int"
#: What no term holds.
GAP = "\0"


@dataclass
class Shape:
    """Folders of the index, and the number of its next block."""

    folders: int
    next_block: int


def folder_of(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def blocks_of(docs: DataFrame, analyze: Callable[[Column], Column], first: int, block_docs: int) -> DataFrame:
    """Rows of SCHEMA but for the folder, of docs(id, text): a row a term and slab. A row-wise map without a shuffle:
    a task makes blocks of the documents as they come, numbered within its own range of TASK_BLOCKS from `first` on."""

    analyze, change = BY_WORD.get(analyze, (analyze, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first + TaskContext.get().partitionId() * TASK_BLOCKS
        for b in batches:
            ids, words = b.column(0), pc.split_pattern(b.column(1), GAP)
            size = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
            for lo, hi in slices(size, block_docs):
                yield _packed(ids.slice(lo, hi - lo), words.slice(lo, hi - lo), block, block_docs, change)
                block += -(-(hi - lo) // block_docs)

    shape = SCHEMA.removesuffix(", folder int")
    terms = docs.select(F.col("id").cast("bigint").alias("id"), analyze(F.col("text")).alias("terms"))
    # one string a document goes to Python, not one a word
    return terms.select("id", F.when(F.size("terms") > 0, F.array_join("terms", GAP)).alias("terms")).mapInArrow(run, shape)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """The places where a run of equal keys begins."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _packed(ids: pa.Array, words: pa.Array, slab: int, block_docs: int, change: Callable[[str], str] | None) -> pa.RecordBatch:
    """The rows of a slab: a document's row holds all of its terms, in order; change(term) is what they are stored as."""
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    coded = words.flatten().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    if change:
        changed = pa.array([change(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        terms, code = changed.dictionary, changed.indices.to_numpy().astype(np.int64)[code]
    # terms together, and within them blocks, documents and places in order
    known = ids.to_numpy()
    by_id = np.lexsort((known, np.arange(len(known)) // block_docs))
    place = np.empty(len(known), np.int64)
    place[by_id] = np.arange(len(known))
    doc = np.repeat(place, size)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    order = np.argsort(code * max(1, len(known)) + doc, kind="stable")
    code, doc = code[order], doc[order]
    posting = _changes(code, doc)
    tf = np.diff(np.append(posting, len(code)))
    of, doc = code[posting], doc[posting]
    block = _changes(of, doc // block_docs)
    term = _changes(of[block])
    lists = lambda at, values, n: pa.ListArray.from_arrays(pa.array(np.append(at, n), pa.int32()), values)
    places = lists(posting, pa.array(pos[order], pa.int32()), len(code))
    start = block[term]
    columns = [
        terms.take(pa.array(of[start])),
        pa.array(np.full(len(term), slab), pa.int64()),
        lists(term, pa.array(slab + doc[block] // block_docs, pa.int64()), len(block)),
        lists(term, pa.array(np.maximum.reduceat(tf, block) if len(block) else block, pa.int32()), len(block)),
        lists(term, pa.array(np.diff(np.append(block, len(of))), pa.int32()), len(block)),
        lists(term, pa.array(block - np.repeat(start, np.diff(np.append(term, len(block)))), pa.int32()), len(block)),
        lists(start, pa.array(known[by_id][doc], pa.int64()), len(of)),
        lists(start, pa.array(tf, pa.int32()), len(of)),
        lists(start, places, len(of)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "slab", "blocks", "tops", "ns", "firsts", "ids", "tfs", "positions"])


def build(docs: DataFrame, path: str, analyze: Callable[[Column], Column] = stemmed_terms, block_docs: int = BLOCK_DOCS, folders: int | None = None) -> Shape:
    """Writes the index of docs(id, text) to path, which must not exist. folders: by the length of the texts unless given."""
    if not folders:
        folders = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // FOLDER_CHARACTERS))
    return _store(docs, path, analyze, block_docs, Shape(folders, 0), "errorifexists")


def add(docs: DataFrame, path: str, analyze: Callable[[Column], Column] = stemmed_terms, block_docs: int = BLOCK_DOCS) -> Shape:
    """Appends docs(id, text), of ids that the index does not hold, as new blocks; no stored file changes."""
    return _store(docs, path, analyze, block_docs, load(docs.sparkSession, path), "append")


def _store(docs: DataFrame, path: str, analyze: Callable[[Column], Column], block_docs: int, shape: Shape, mode: str) -> Shape:
    """Each task sorts and writes the blocks of its own documents: no word is shuffled, and a term of many blocks lies in
    as many files as tasks had it."""
    spark = docs.sparkSession
    placed = blocks_of(docs, analyze, shape.next_block, block_docs).withColumn("folder", folder_of(F.col("term"), shape.folders))
    placed.sortWithinPartitions("folder", "term", "slab").write.mode(mode).partitionBy("folder").parquet(f"{path}/blocks")
    last = _stored(spark, path).agg(F.max(F.array_max("blocks"))).first()[0]
    shape = Shape(shape.folders, 0 if last is None else last + 1)
    _save(spark, path, shape)
    return shape


def _save(spark: SparkSession, path: str, shape: Shape) -> None:
    spark.createDataFrame([(shape.folders, shape.next_block)], "folders int, next_block long").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> Shape:
    r = spark.read.parquet(f"{path}/shape").first()
    return Shape(r.folders, r.next_block)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/blocks")


def _blocks(stored: DataFrame, *lists: str) -> DataFrame:
    """term, slab, block, top, n of stored rows, and of `lists` (ids, tfs, positions) the part of the block: a row a block."""
    one = lambda i: [F.get("blocks", i).alias("block"), F.get("tops", i).alias("top"), F.get("ns", i).alias("n"), *[F.slice(c, F.get("firsts", i) + 1, F.get("ns", i)).alias(c) for c in lists]]
    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("blocks") - 1), lambda i: F.struct(*one(i)))).alias("b")
    return stored.select("term", "slab", "folder", each).select("term", "slab", "folder", "b.*")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """term, slab, folder, block, top, n, ids, tfs, positions of everything stored."""
    return _blocks(_stored(spark, path), "ids", "tfs", "positions")


def postings(spark: SparkSession, path: str) -> DataFrame:
    """term, id, tf, positions of everything stored."""
    each = F.explode(F.arrays_zip("ids", "tfs", "positions")).alias("p")
    return _stored(spark, path).select("term", each).select("term", F.col("p.ids").alias("id"), F.col("p.tfs").cast("bigint").alias("tf"), F.col("p.positions").alias("positions"))


def _asked(spark: SparkSession, path: str, terms: DataFrame, shape: Shape) -> DataFrame:
    """The stored rows of the folders and, if they are few, the terms that terms(query_id, term) asks for."""
    found = _stored(spark, path)
    asked = terms.select("term", folder_of(F.col("term"), shape.folders).alias("folder")).distinct()
    few = asked.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        return found.filter(F.col("folder").isin(sorted({r.folder for r in few}))).filter(F.col("term").isin(sorted(r.term for r in few)))
    return found.join(asked, ["folder", "term"], "left_semi")


def _scores(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, id, score of the documents in the blocks of wanted(query_id, term, block): complete scores, as all of a query's
    terms in a block are wanted together."""
    met = _blocks(stored, "ids", "tfs").select("term", "block", "ids", "tfs").join(wanted, ["term", "block"])
    each = met.select("query_id", F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
    return each.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.sum("p.tfs").alias("score"))


def search_plan(path: str, queries: DataFrame, k: int, analyze: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a search: query_id, id, score of the documents that were scored, the k best of a query and task at least; and query_id, term, block, n of the stored blocks
    that queries(query_id, question) have, and of those that were read."""
    spark = queries.sparkSession
    shape = load(spark, path)
    terms = written(query_terms(queries, analyze))
    stored = _asked(spark, path, terms, shape)
    heads = _blocks(stored).select("term", "slab", "block", "top", "n").join(terms, "term")
    few = few_asked(terms)
    if few:
        bounds = written(_bounds(stored, few))
    else:
        bounds = written(heads.groupBy("query_id", "slab", "block").agg(F.sum("top").alias("bound"), F.max("n").alias("least")))
    # the best blocks of a query that hold k documents together: at most k blocks, as each holds one
    best = ranked(bounds.withColumnRenamed("block", "id"), k, F.desc("bound")).withColumnRenamed("id", "block").join(bounds, ["query_id", "block"])
    held = F.sum("least").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seeds = written(best.withColumn("held", held - F.col("least")).filter(F.col("held") < k).select("query_id", "slab", "block"))
    first_rows = heads.join(seeds, ["query_id", "block"], "left_semi")
    scored_in = (lambda wanted, rows: _swept(stored, few, wanted, k)) if few else (lambda wanted, rows: _scores(stored, rows.select("query_id", "term", "block")))
    first = written(scored_in(seeds, first_rows))
    kth = ranked(first, k, F.desc("score")).filter(F.col("rank") == k).join(first, ["query_id", "id"]).select("query_id", F.col("score").alias("least_score"))
    rest = bounds.join(seeds, ["query_id", "block"], "left_anti").join(kth, "query_id", "left")
    rest = written(rest.filter(F.col("bound") >= F.coalesce("least_score", F.lit(0))).select("query_id", "slab", "block"))
    more_rows = heads.join(rest, ["query_id", "block"], "left_semi")
    scored = first.unionByName(scored_in(rest, more_rows))
    return scored, heads, first_rows.unionByName(more_rows)


def _slab_by_slab(rows: DataFrame, start: Callable[[], tuple[Callable[[pa.Table], list[pa.RecordBatch]], Callable[[], list[pa.RecordBatch]]]], shape: str) -> DataFrame:
    """Each slab's rows(slab, …) come to one task. start() gives a task what makes batches of the rows of a slab, and what makes
    those of its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, end = start()
        held: list[pa.RecordBatch] = []
        for b in batches:
            slab = b["slab"].to_numpy()
            for lo, hi in pairwise([*_changes(slab).tolist(), len(slab)]):
                if held and slab[lo] != held[0]["slab"][0].as_py():
                    yield from sweep(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from sweep(pa.Table.from_batches(held).combine_chunks())
        yield from end()

    return rows.repartition("slab").sortWithinPartitions("slab").mapInArrow(run, shape)


def _steps(blocks: int, docs: int, asks: Asked) -> Iterator[tuple[int, int]]:
    """Ranges of a slab's blocks, each of `docs` rows of sums, that are added up at a time."""
    step = max(1, SUMMED // max(1, docs * len(asks.queries)))
    return ((lo, min(blocks, lo + step)) for lo in range(0, blocks, step))


def _bounds(stored: DataFrame, asked: Asked) -> DataFrame:
    """query_id, slab, block, bound, least of the blocks that hold a term of a query: the bound on a score in it, and the number
    of documents that have one at least. A slab's heads come to one task."""
    sent = stored.sparkSession.sparkContext.broadcast(asked)

    def sweep(rows: pa.Table) -> list[pa.RecordBatch]:
        asks, slab, made = sent.value, rows["slab"][0].as_py(), []
        lists = [rows[c].combine_chunks() for c in ("blocks", "tops", "ns")]
        code = np.repeat(asks.codes(rows["term"].combine_chunks()), pc.list_value_length(lists[0]).to_numpy())
        block, top, n = (x.flatten().to_numpy()[code >= 0] for x in lists)
        code, block = code[code >= 0], block - slab
        order = np.argsort(block, kind="stable")
        code, block, top, n = code[order], block[order], top[order], n[order]
        for lo, hi in _steps(int(block[-1]) + 1 if len(block) else 0, 1, asks):
            of = slice(*np.searchsorted(block, (lo, hi)))
            sums = asks.sums(code[of], block[of] - lo, top[of], hi - lo)
            most = asks.greatest(code[of], block[of] - lo, n[of], hi - lo)
            at, query = np.nonzero(sums)
            columns = [asks.queries[query], np.full(len(at), slab), slab + lo + at, sums[at, query].astype(np.int64), most[at, query].astype(np.int64)]
            made.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "slab", "block", "bound", "least"]))
        return made

    return _slab_by_slab(stored.select("slab", "term", "blocks", "tops", "ns"), lambda: (sweep, list), "query_id bigint, slab bigint, block bigint, bound bigint, least bigint")


def _swept(stored: DataFrame, asked: Asked, wanted: DataFrame, k: int) -> DataFrame:
    """query_id, id, score of the k best documents a query and task in the blocks of wanted(query_id, slab, block). The rows of a
    slab, a row a term, come to one task, which adds up the scores of the blocks that a query wants."""
    sent = stored.sparkSession.sparkContext.broadcast(asked)
    blocks_wanted = wanted.groupBy("slab", "block").agg(F.collect_list(F.col("query_id").cast("bigint")).alias("who"))
    met = stored.select("slab", "term", "blocks", "ns", "ids", "tfs").join(wanted.select("slab").distinct(), "slab", "left_semi")
    both = met.unionByName(blocks_wanted.select("slab", F.array("block").alias("blocks"), "who"), allowMissingColumns=True)

    def start() -> tuple[Callable[[pa.Table], list[pa.RecordBatch]], Callable[[], list[pa.RecordBatch]]]:
        asks, best = sent.value, Best(k, len(sent.value.queries))
        return lambda rows: _sweep(rows, asks, best) or [], lambda: [best.batch(asks.queries)]

    return _slab_by_slab(both, start, "query_id bigint, id bigint, score bigint")


def _sweep(rows: pa.Table, asks: Asked, best: Best) -> None:
    """Adds the scores of a slab's blocks, of the queries that want them, to best."""
    slab, asking = rows["slab"][0].as_py(), rows.filter(pc.is_valid(rows["who"])).combine_chunks()
    rows = rows.filter(pc.is_valid(rows["term"])).combine_chunks()
    if not asking.num_rows or not rows.num_rows:
        return
    blocks, ns, ids, tfs = (rows[c].combine_chunks() for c in ("blocks", "ns", "ids", "tfs"))
    code = np.repeat(asks.codes(rows["term"].combine_chunks()), pc.list_value_length(ids).to_numpy())
    block = np.repeat(blocks.flatten().to_numpy() - slab, ns.flatten().to_numpy())
    flat, tf = ids.flatten().to_numpy(), tfs.flatten().to_numpy()
    who = asking["who"].combine_chunks()
    wanted_in = np.repeat(asking["blocks"].combine_chunks().flatten().to_numpy() - slab, pc.list_value_length(who).to_numpy())
    wanted_by = np.searchsorted(asks.queries, who.flatten().to_numpy())
    asked = np.zeros(int(max(block.max(), wanted_in.max())) + 1, bool)
    asked[wanted_in] = True
    keep = (code >= 0) & asked[block]
    order = np.flatnonzero(keep)[np.lexsort((flat[keep], block[keep]))]
    code, block, flat, tf = code[order], block[order], flat[order], tf[order]
    begins = _changes(block, flat) if len(flat) else np.zeros(0, np.int64)
    of_doc, docs = block[begins], flat[begins]
    number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(flat))))
    most = int(np.bincount(of_doc).max()) if len(of_doc) else 1
    for lo, hi in _steps(len(asked), most, asks):
        mine, rows_of = slice(*np.searchsorted(of_doc, (lo, hi))), slice(*np.searchsorted(block, (lo, hi)))
        if mine.start == mine.stop:
            continue
        sums = asks.sums(code[rows_of], number[rows_of] - mine.start, tf[rows_of], mine.stop - mine.start)
        wants = np.zeros((hi - lo, len(asks.queries)), bool)
        these = (wanted_in >= lo) & (wanted_in < hi)
        wants[wanted_in[these] - lo, wanted_by[these]] = True
        best.add_sums(np.where(wants[of_doc[mine] - lo], sums, 0), docs[mine])


def search(path: str, queries: DataFrame, k: int = CANDIDATES, analyze: Callable[[Column], Column] = stemmed_terms) -> DataFrame:
    """query_id, id, rank: the k documents with most matching places of any term of queries(query_id, question), ties to the
    smaller id; what retrieval.keyword_leg gives over all postings. analyze must be the index's own."""
    return ranked(search_plan(path, queries, k, analyze)[0], k, F.desc("score"))
