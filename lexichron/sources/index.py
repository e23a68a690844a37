"""The stored index: passages with vectors, made for finished transcriptions that have none, and searches over them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import rebuild_rows, to_index
from ..operators.retrieval import SHORTLIST, embedded, fused, hash_embed, hydrate, overlap_score, rerank, single_leg, stemmed_terms
from ..operators.sequence import make_passages
from ..schemas import SCHEMAS
from ..session import delete, written
from . import textindex, vectorindex
from .store import exists, load

#: Passages of an episode have numbers of so many bits.
PASSAGE_BITS = 20


def stored_transcripts(chunks: DataFrame) -> DataFrame:
    """episode_id, tokens, starts, ends (milliseconds) of chunks(episode_id, idx, words): one row an episode."""
    ms = lambda name: F.transform("words", lambda x: F.round(x[name] * 1000).cast("bigint"))
    parts = chunks.select("episode_id", "idx", F.col("words.text").alias("tokens"), ms("start").alias("starts"), ms("end").alias("ends"))
    if chunks.groupBy("episode_id").count().filter("count > 1").isEmpty():  # nothing to put together, so that no word moves
        return parts.drop("idx")
    packed = parts.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("idx", "tokens", "starts", "ends"))).alias("c"))
    return packed.select("episode_id", *[F.flatten(f"c.{name}").alias(name) for name in ("tokens", "starts", "ends")])


def index_new(
    spark: SparkSession, root: str, model: str = "hash-1", embed: Callable[[DataFrame], DataFrame] = hash_embed, analyze: Callable[[Column], Column] = stemmed_terms
) -> dict[str, int]:
    """Cuts, embeds and stores the passages of all finished episodes without passages, and brings the search index up to them;
    returns the numbers of episodes and passages. May be repeated: an episode that stopped half way is made anew as a whole,
    and stored passages of other episodes stay as they lie."""
    chunks = load(spark, root, "chunks")
    todo = written(to_index(load(spark, root, "jobs"), load(spark, root, "passages")))
    made = make_passages(stored_transcripts(chunks.join(todo, "episode_id", "left_semi")))
    made = written(made.withColumn("id", F.shiftleft(F.col("episode_id"), PASSAGE_BITS) + F.col("idx")))
    rows = embedded(made, embed).select(
        "id", "episode_id", "idx", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "text", "embedding", F.lit(model).alias("embed_model")
    )
    new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS["passages"]])
    rebuild_rows(new, todo, f"{root}/passages", SCHEMAS["passages"])
    refresh_search(spark, root, analyze)
    return {"episodes": todo.count(), "passages": made.count()}


def _state(spark: SparkSession, root: str) -> tuple[int, str]:
    """Version of the search index and its state; version 0 where there is none."""
    path = f"{root}/search/current"
    if not exists(spark, path):
        return 0, "none"
    r = spark.read.parquet(path).first()
    return (r.version, r.state) if r else (0, "none")


def _set_state(spark: SparkSession, root: str, version: int, state: str) -> None:
    spark.createDataFrame([(version, state)], "version int, state string").coalesce(1).write.mode("overwrite").parquet(f"{root}/search/current")


def refresh_search(spark: SparkSession, root: str, analyze: Callable[[Column], Column] = stemmed_terms) -> str:
    """Brings the stored search index up to the stored passages; returns kept, added or built.

    New passages are added to the text and vector index as new files. If an indexed passage is gone, has another text or
    another model's vector, or an addition did not end, an index of the next version is built beside the old one, which goes
    when the new one is in place.
    """
    version, state = _state(spark, root)
    passages = load(spark, root, "passages")
    mark = F.xxhash64("text", "embed_model")
    now = written(passages.select("id", mark.alias("mark")))
    at = f"{root}/search/v{version}"
    if state == "ready":
        known = spark.read.schema("id bigint, mark bigint").parquet(f"{at}/ids")
        if known.join(now, ["id", "mark"], "left_anti").isEmpty():
            new = written(passages.join(known, "id", "left_anti"))
            if new.isEmpty():
                return "kept"
            _set_state(spark, root, version, "adding")
            textindex.add(new.select("id", "text"), f"{at}/text", analyze)
            vectorindex.add(new.select("id", "embedding"), f"{at}/vectors")
            new.select("id", mark.alias("mark")).write.mode("append").parquet(f"{at}/ids")
            _set_state(spark, root, version, "ready")
            return "added"
    fresh = f"{root}/search/v{version + 1}"
    delete(spark, fresh)  # left by a build that did not end
    textindex.build(passages.select("id", "text"), f"{fresh}/text", analyze)
    vectorindex.build(passages.select("id", "embedding"), f"{fresh}/vectors")
    now.write.parquet(f"{fresh}/ids")
    _set_state(spark, root, version + 1, "ready")
    delete(spark, at)
    return "built"


def search_stored(
    spark: SparkSession,
    root: str,
    queries: DataFrame,
    mode: str = "hybrid",
    k: int = 5,
    embed: Callable[[DataFrame], DataFrame] = hash_embed,
    analyze: Callable[[Column], Column] = stemmed_terms,
    scorer: Callable[[Column, Column], Column] = overlap_score,
    exact: bool = False,
) -> DataFrame:
    """query_id, id, rank, score, episode_id, title, start_s, end_s, text of the best stored passages for
    queries(query_id, question), by the stored index alone: the modes of retrieval.search. The index must be up to date
    (refresh_search). exact: the vector leg reads all cells that may hold a nearer passage."""
    at = f"{root}/search/v{_state(spark, root)[0]}"
    titles = load(spark, root, "episodes").select(F.col("id").alias("episode_id"), "title")

    def keyword() -> DataFrame:
        return written(textindex.search(f"{at}/text", queries, analyze=analyze))

    def vector() -> DataFrame:
        asked = embed(queries.select(F.col("query_id").alias("id"), F.col("question").alias("text"))).withColumnRenamed("id", "query_id")
        return written(vectorindex.nearest(f"{at}/vectors", asked, exact=exact))

    if mode in ("keyword", "vector"):
        found = single_leg(keyword() if mode == "keyword" else vector(), k)
    elif mode in ("hybrid", "rerank"):
        found = fused(keyword(), vector(), limit=k if mode == "hybrid" else SHORTLIST)
    else:
        raise ValueError(f"unknown mode: {mode}")
    found = written(found)
    # only the passages found are read in full, by a bounded list of ids where they are few
    few = [r.id for r in found.select("id").distinct().limit(LISTED + 1).collect()]
    passages = load(spark, root, "passages").select("id", "episode_id", "start_s", "end_s", "text")
    passages = passages.filter(F.col("id").isin(few)) if len(few) <= LISTED else passages.join(found.select("id").distinct(), "id", "left_semi")
    out = hydrate(found, passages).join(titles, "episode_id", "left")
    if mode == "rerank":
        out = rerank(out, queries, k, scorer)
    return out.select("query_id", "id", "rank", "score", "episode_id", "title", "start_s", "end_s", "text")


def timed_searches(
    spark: SparkSession, root: str, queries: DataFrame, modes: tuple[str, ...] = ("keyword", "vector", "hybrid", "rerank"), most: int = 20, clock: Callable[[], float] = time.perf_counter, **options
) -> DataFrame:
    """mode, query_id, seconds of searches for one question at a time, as a user asks them: the first `most` of queries by id.
    evaluation.median_seconds gives the median of each mode."""
    asked = queries.orderBy("query_id").limit(most).select("query_id", "question").collect()
    rows = []
    for mode in modes:
        for r in asked:
            one = spark.createDataFrame([tuple(r)], queries.select("query_id", "question").schema)
            start = clock()
            search_stored(spark, root, one, mode, **options).collect()
            rows.append((mode, r.query_id, clock() - start))
    return spark.createDataFrame(rows, "mode string, query_id bigint, seconds double")


#: Ids that are handed to the scan as a list.
LISTED = 2_000
