"""Questions to verified answers, set-at-a-time: search, prompt, generate, verify, prune, repair, account."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import extractive
from ..operators import quotes as Q
from ..operators import retrieval as R
from ..operators.sequence import make_passages
from ..session import written
from ..sources.index import PASSAGE_BITS
from . import corpus as C
from .base import query

REPLY = "found boolean, answer string, citations array<struct<n:int,quote:string>>"


def attempt(prompts: DataFrame, hits: DataFrame, transcripts: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, verdicts) of one round of generation.

    answers: question_id, found, text, kept, removed, rejected; verdicts as of quotes.verdicts.
    """
    replies = generate(prompts).withColumn("r", F.from_json("reply", REPLY)).select("question_id", "r.*")
    cited = replies.select("question_id", F.posexplode_outer("citations").alias("ord", "c")).filter("ord IS NOT NULL").select("question_id", "ord", "c.n", "c.quote")
    judged = Q.verdicts(cited, hits, transcripts)
    good = judged.groupBy("question_id").agg(F.collect_set(F.when(F.col("reason").isNull(), F.col("n"))).alias("ok"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    rows = replies.join(good, "question_id", "left").withColumn("ok", F.coalesce("ok", F.array().cast("array<int>")))
    rows = rows.withColumn("s", Q.supported(F.coalesce("answer", F.lit("")), F.col("ok")))
    return rows.select("question_id", "found", F.col("answer").alias("text"), "s.kept", "s.removed", F.coalesce("rejected", F.lit(0)).alias("rejected")), judged


def ask(questions: DataFrame, hits: DataFrame, transcripts: DataFrame, generate: Callable[[DataFrame], DataFrame] = extractive, repair: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """question_id, answer, refusal, repaired, rejected, citations of questions(question_id, question).

    hits: question_id, n, episode_id, title, start_ms, end_ms, text. A question without hits is refused and sent nowhere;
    a repair generator is asked once for the questions with rejected citations.
    """
    prompts = Q.prompt_blocks(hits).join(questions, "question_id")
    first, judged = attempt(prompts, hits.select("question_id", "n", "episode_id", "start_ms", "end_ms"), transcripts, generate)
    chosen = first.withColumn("repaired", F.lit(False))
    if repair is not None:
        again = prompts.join(first.filter("rejected > 0").select("question_id"), "question_id", "left_semi")
        second, _ = attempt(again, hits.select("question_id", "n", "episode_id", "start_ms", "end_ms"), transcripts, repair)
        best = Q.choose_attempt(first.select("question_id", "kept", "rejected"), second.select("question_id", "kept", "rejected"))
        chosen = first.drop("kept", "rejected").join(best, "question_id")
    counted = hits.groupBy("question_id").agg(F.count("*").alias("n_hits"))
    out = questions.join(chosen, "question_id", "left").join(counted, "question_id", "left")
    why = Q.refused(F.col("n_hits"), F.col("found"), F.col("text"), F.col("kept"))
    times = judged.filter("reason IS NULL").groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("n", "episode_id", "at_ms"))).alias("citations"))
    return out.join(times, "question_id", "left").select(
        "question_id", F.when(why.isNull(), F.col("kept")).alias("answer"), why.alias("refusal"), F.coalesce("repaired", F.lit(False)).alias("repaired"), F.coalesce("rejected", F.lit(0)).cast("bigint").alias("rejected"), "citations"
    )


def passage_pool(spark, sf_dir):
    """All passages with an id of their own: the episode's number above the passage's."""
    passages = make_passages(C.transcripts(spark, sf_dir))
    return written(passages.withColumn("id", F.shiftleft(F.col("episode_id"), PASSAGE_BITS) + F.col("idx")))


def asked(spark, sf_dir):
    """questions and hits: each benchmark text asks about its best passages by keyword."""
    pool, q = passage_pool(spark, sf_dir), C.questions(spark, sf_dir)
    found = R.hydrate(R.keyword_search(pool, q).filter("rank <= 5"), pool)
    titles = C.episodes(spark, sf_dir).select(F.col("id").alias("episode_id"), "title")
    hits = written(found.join(titles, "episode_id").select(F.col("query_id").alias("question_id"), F.col("rank").alias("n"), "episode_id", "title", "start_ms", "end_ms", "text"))
    return q.withColumnRenamed("query_id", "question_id"), hits


@query("ask")
def ask_all(spark, sf_dir):
    questions, hits = asked(spark, sf_dir)
    return ask(questions, hits, C.transcripts(spark, sf_dir))
