"""Where quotes are said: a positional index of four-token runs, joined with passages by binned intervals.

An episode's words become one row for each run of four tokens that some quote asks that episode for, with its number and the
starts of its first and last token. A quote asks for the runs at its tokens 0, 4, 8 … and for its last one, in the bins of
time that its passage covers. It stands where all of its runs meet at one place, so the work grows with the words of the
episodes and with the matches; no episode's arrays meet a quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MIN_QUOTE_TOKENS, folded, quote_text, quote_tokens
from ..session import written

#: Milliseconds of a bin; an interval of more bins than MOST_BINS is joined without bins.
BIN_MS, MOST_BINS = 60_000, 64
RUN = MIN_QUOTE_TOKENS


def word_tokens(words: Column) -> Column:
    """array<array<string>>: the comparable tokens of each word, all words of the array normalised in one pass."""
    joined = F.array_join(F.transform(words, lambda w: F.translate(F.coalesce(w, F.lit("")), "\n", " ")), "\n")
    return F.transform(F.split(quote_text(folded(joined)), "\n"), lambda w: F.filter(F.split(w, " +"), lambda t: t != ""))


def in_time_order(starts: Column) -> Column:
    """True if the starts are all there and none goes back."""
    return F.coalesce((F.sort_array(starts) == starts) & ~F.array_contains(F.transform(starts, lambda s: s.isNull()), True), F.lit(False))


def token_runs(transcripts: DataFrame, wanted: DataFrame) -> DataFrame:
    """episode_id, run, at, from_ms, to_ms of transcripts(episode_id, tokens, starts): the runs of four tokens that
    wanted(episode_id, run) names, each with the number of its first token and the starts of its first and last one."""
    parts = transcripts.select("episode_id", word_tokens(F.col("tokens")).alias("parts"), "starts")
    flat = parts.select(
        "episode_id",
        F.flatten("parts").alias("t"),
        F.flatten(F.transform("parts", lambda ts, i: F.transform(ts, lambda _: F.get(F.col("starts"), i)))).alias("s"),
    )
    every = F.transform(F.sequence(F.lit(0), F.size("t") - RUN), lambda i: F.struct(_run("t", i).alias("run"), i.alias("at"), F.get("s", i).alias("from_ms"), F.get("s", i + RUN - 1).alias("to_ms")))
    runs = flat.select("episode_id", F.explode(F.when(F.size("t") >= RUN, every)).alias("r")).select("episode_id", "r.*")
    return runs.join(wanted.select("episode_id", "run").distinct(), ["episode_id", "run"], "left_semi")


def _run(tokens: str, i: Column) -> Column:
    """The run at token i; tokens hold no blank, so that equal runs are equal strings."""
    return F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(RUN)])


def quote_runs(asks: DataFrame) -> DataFrame:
    """asks(…, quote) once for each run that it asks for: k, the run's place in the quote, and runs, their number. Quotes of
    fewer tokens than a run ask for none."""
    needle = asks.withColumn("needle", quote_tokens(folded(F.col("quote"))))
    last = F.size("needle") - RUN
    places = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(RUN)), F.array(last)))
    some = needle.withColumn("places", F.when(last >= 0, places)).withColumn("runs", F.size("places"))
    each = some.withColumn("k", F.explode("places"))
    return each.withColumn("run", _run("needle", F.col("k"))).drop("needle", "places")


def places_of(asks: DataFrame, transcripts: DataFrame, slack_ms: int) -> DataFrame:
    """asks(ask, episode_id, quote, start_ms, end_ms) with at_ms, the start of the word where the quote is first said in full
    among the words that start within the interval, give or take slack_ms. Asks without such a place are left out."""
    bin_of = lambda ms: F.floor(ms / BIN_MS)
    low, high = F.col("start_ms") - slack_ms, F.col("end_ms") + slack_ms
    wanted = quote_runs(asks.withColumn("low", low).withColumn("high", high).filter("low <= high"))
    wanted = written(wanted.withColumn("bins", bin_of(F.col("high")) - bin_of(F.col("low"))))
    runs = token_runs(transcripts, wanted).withColumn("bin", bin_of(F.col("from_ms")))
    inside = (F.col("from_ms") >= F.col("low")) & (F.col("to_ms") <= F.col("high"))
    columns = ["ask", "k", "runs", "at", "from_ms"]
    binned = wanted.filter(F.col("bins") < MOST_BINS).withColumn("bin", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high")))))
    met = binned.join(runs, ["episode_id", "run", "bin"]).filter(inside).select(columns)
    wide = wanted.filter(F.col("bins") >= MOST_BINS)
    if not wide.isEmpty():
        met = met.unionByName(wide.join(runs, ["episode_id", "run"]).filter(inside).select(columns))
    whole = met.groupBy("ask", (F.col("at") - F.col("k")).alias("at")).agg(F.count("*").alias("n"), F.max("runs").alias("runs"), F.min("from_ms").alias("at_ms"))
    return whole.filter("n = runs").groupBy("ask").agg(F.min_by("at_ms", "at").alias("at_ms"))
