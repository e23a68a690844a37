"""Quote matching, the citation critic, sentence pruning, and the choice between answer attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MIN_QUOTE_TOKENS, clock, contains_phrase, folded, folded_words, phrase_index, quote_tokens
from ..session import written
from .location import in_time_order, places_of

#: Reasons of the critic.
NO_PASSAGE, QUESTION, NOT_FOUND = "no such passage", "quote is a question, not a statement", "quote not found verbatim in passage"
#: Words this far outside a passage still count as inside.
SLACK_MS = 1_000


def find_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quote_id, text_id of all texts(text_id, text) that hold a quote(quote_id, quote) token for token.

    An inverted index on runs of four tokens proposes the pairs: the first run of each quote is joined with every run
    of the texts, so the cost follows the matches and no pair without a common run is formed.
    """
    enough = lambda words: F.size(words) >= MIN_QUOTE_TOKENS
    run = lambda words, i: F.xxhash64(*[F.get(words, i + j) for j in range(MIN_QUOTE_TOKENS)])
    q = quotes.select("quote_id", quote_tokens(folded(F.col("quote"))).alias("needle"))
    firsts = q.select("quote_id", "needle", F.explode(F.when(enough(F.col("needle")), F.array(run(F.col("needle"), F.lit(0))))).alias("gram"))
    words = lambda rows: rows.withColumn("hay", quote_tokens(folded(F.col("text"))))
    hay = words(texts.select("text_id", "text"))
    grams = F.transform(F.sequence(F.lit(0), F.size("hay") - MIN_QUOTE_TOKENS), lambda i: run(F.col("hay"), i))
    # runs that begin no quote go before anything is shuffled (quotes that are many meet the runs in a shuffled join)
    runs = hay.select("text_id", F.explode(F.when(enough(F.col("hay")), F.array_distinct(grams))).alias("gram"))
    # written, so that their size is known: where they are few, no text moves to meet them
    pairs = written(runs.join(firsts, "gram").select("quote_id", "text_id", "needle").distinct())
    both = words(texts.select("text_id", "text").join(pairs, "text_id"))
    return both.filter(contains_phrase(F.col("hay"), F.col("needle"))).select("quote_id", "text_id")


def locate(needle: Column, tokens: Column, starts: Column, low: Column, high: Column) -> Column:
    """Start of the word where the first match of needle begins, among words that start in [low, high]; else NULL.

    A word may hold several tokens; all of them have its start.
    """
    inside = F.filter(F.arrays_zip(tokens.alias("w"), starts.alias("s")), lambda x: (x["s"] >= low) & (x["s"] <= high))
    parts = F.flatten(F.transform(inside, lambda x: F.transform(quote_tokens(x["w"]), lambda t: F.struct(t.alias("t"), x["s"].alias("s")))))
    return F.get(F.transform(parts, lambda p: p["s"]), phrase_index(F.transform(parts, lambda p: p["t"]), needle))


def located(quotes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """quotes(…, episode_id, quote, start_ms, end_ms) with at_ms, the start of the quote's first word in its interval, or NULL.

    Each different question is looked up once in the positional index of its episode's runs. Episodes whose starts go back,
    where an interval's words need not be neighbours, are searched word by word instead.
    """
    keys = ["episode_id", "quote", "start_ms", "end_ms"]
    ask = F.md5(F.to_json(F.struct(*keys)).cast("binary"))
    asks = written(quotes.select(*keys).dropna().distinct().withColumn("ask", ask))
    t = transcripts.select("episode_id", "tokens", "starts").join(asks.select("episode_id").distinct(), "episode_id", "left_semi")
    # only the episodes asked about are looked at, once
    t = written(t.withColumn("orderly", in_time_order(F.col("starts"))))
    found = places_of(asks, t.filter("orderly"), SLACK_MS)
    if not t.filter("NOT orderly").isEmpty():
        found = found.unionByName(located_by_words(asks, t.filter("NOT orderly")).select("ask", "at_ms"))
    return quotes.withColumn("ask", ask).join(found, "ask", "left").drop("ask")


def located_by_words(quotes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """quotes with at_ms by filtering an episode's words for each quote; quotes of other episodes are left out."""
    t = transcripts.select("episode_id", folded_words(F.col("tokens")).alias("tokens"), "starts")
    low, high = F.col("start_ms") - SLACK_MS, F.col("end_ms") + SLACK_MS
    at = locate(quote_tokens(folded(F.col("quote"))), F.col("tokens"), F.col("starts"), low, high)
    return quotes.join(t, "episode_id").withColumn("at_ms", at).drop("tokens", "starts")


def verdicts(citations: DataFrame, hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    """question_id, ord, n, quote, reason, at_ms: the first failing rule of each citation, or no reason.

    citations: question_id, ord, n, quote (n NULL: malformed); hits: question_id, n, episode_id, start_ms, end_ms.
    """
    joined = citations.join(hits, ["question_id", "n"], "left")
    found = located(joined, transcripts)
    reason = (
        F.when(F.col("n").isNull() | F.col("quote").isNull() | F.col("episode_id").isNull(), NO_PASSAGE)
        .when(F.contains("quote", F.lit("?")), QUESTION)
        .when(F.col("at_ms").isNull(), NOT_FOUND)
    )
    return found.select("question_id", "ord", "n", "quote", "episode_id", reason.alias("reason"), F.when(reason.isNull(), F.col("at_ms")).alias("at_ms"))


def parse_citations(raw: DataFrame) -> DataFrame:
    """question_id, ord, n, quote of raw(question_id, citations JSON); a citation of a wrong shape has NULLs."""
    items = F.from_json("citations", "array<struct<n:int,quote:string>>")
    return raw.select("question_id", F.posexplode_outer(items).alias("ord", "c")).select("question_id", "ord", "c.n", "c.quote")


def marker_texts(text: Column) -> Column:
    """The digits of each [n] marker."""
    return F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1)


def markers(text: Column) -> Column:
    """The numbers of the [n] markers; those too large for any passage are left out."""
    return F.filter(F.transform(marker_texts(text), lambda m: m.try_cast("int")), lambda n: n.isNotNull())


def supported(text: Column, ok: Column) -> Column:
    """struct<kept, removed>: the sentences with a marker in ok, less their other markers; the number of others."""
    # white space of any kind at the ends does not count
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    sentences = F.split(bare(text), r"(?<=[.!?])\s+")
    backed = lambda s: F.arrays_overlap(markers(s), ok)

    def clean(s: Column) -> Column:
        wrong = F.filter(F.array_distinct(marker_texts(s)), lambda m: ~F.coalesce(F.array_contains(ok, m.try_cast("int")), F.lit(False)))
        left = F.aggregate(wrong, s, lambda acc, m: F.replace(acc, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
        return F.replace(left, F.lit("  "), F.lit(" "))

    kept = F.array_join(F.transform(F.filter(sentences, backed), clean), " ")
    dropped = F.size(F.filter(sentences, lambda s: (s != "") & ~backed(s)))
    return F.struct(bare(kept).alias("kept"), dropped.alias("removed"))


def used_citations(citations: DataFrame, answers: DataFrame) -> DataFrame:
    """The citations whose marker is still in their answer's text. answers: question_id, kept."""
    used = answers.select("question_id", F.explode(F.array_distinct(markers(F.col("kept")))).alias("n"))
    return citations.join(used, ["question_id", "n"], "left_semi")


def choose_attempt(first: DataFrame, second: DataFrame) -> DataFrame:
    """question_id, kept, repaired, rejected of first and second(question_id, kept, rejected).

    The second attempt counts only after a rejection in the first, and only if its kept text is strictly longer;
    rejections of both add up.
    """
    two = second.select("question_id", F.col("kept").alias("kept2"), F.col("rejected").alias("rejected2"))
    both = first.join(two, "question_id", "left")
    tried = (F.col("rejected") > 0) & F.col("kept2").isNotNull()
    better = tried & (F.length("kept2") > F.length("kept"))
    return both.select(
        "question_id",
        F.when(better, F.col("kept2")).otherwise(F.col("kept")).alias("kept"),
        better.alias("repaired"),
        (F.col("rejected") + F.when(tried, F.col("rejected2")).otherwise(0)).alias("rejected"),
    )


def refused(hits: Column, found: Column, text: Column, kept: Column) -> Column:
    """Why a question gets no answer; NULL if it gets one."""
    return (
        F.when(F.coalesce(hits, F.lit(0)) == 0, "no passages")
        .when(~F.coalesce(found, F.lit(False)) | (F.trim(F.coalesce(text, F.lit(""))) == ""), "not found")
        .when(F.coalesce(kept, F.lit("")) == "", "nothing supported")
    )


def prompt_blocks(passages: DataFrame) -> DataFrame:
    """question_id, prompt of passages(question_id, n, title, start_ms, text), in order of n."""
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit('] Episode: "'), F.col("title"), F.lit('" (from '), clock(F.col("start_ms") / 1000), F.lit(")\n"), F.col("text"))
    rows = passages.select("question_id", "n", head.alias("block"))
    packed = rows.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("n", "block"))).alias("b"))
    return packed.select("question_id", F.array_join(F.col("b.block"), "\n\n").alias("prompt"))


def stop_early(rows: DataFrame, group: str, order: list[str], failed: Column) -> DataFrame:
    """The rows of each group before its first failed one."""
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("__hit", F.max(failed.cast("int")).over(upto)).filter("__hit = 0").drop("__hit")
