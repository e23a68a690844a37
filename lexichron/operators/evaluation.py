"""Retrieval and answer metrics, word error rates, alignment, sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_total

#: A hit is right if the answer's time lies in it, give or take this.
SLACK_MS = 500


def first_correct(results: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """mode, query_id, rank (first right hit within k, or NULL), offset_ms (of a right first hit), for every mode and query.

    results: mode, query_id, rank, episode_id, start_ms, end_ms; golden: query_id, episode_id, answer_ms.
    """
    g = golden.select("query_id", F.col("episode_id").alias("g_episode"), "answer_ms")
    modes = results.select("mode").distinct()
    right = (F.col("episode_id") == F.col("g_episode")) & (F.col("start_ms") - SLACK_MS <= F.col("answer_ms")) & (F.col("answer_ms") <= F.col("end_ms") + SLACK_MS)
    judged = results.filter(F.col("rank") <= k).join(g, "query_id").withColumn("right", right)
    found = judged.groupBy("mode", "query_id").agg(
        F.min(F.when(F.col("right"), F.col("rank"))).alias("rank"), F.max(F.when(F.col("right") & (F.col("rank") == 1), F.col("answer_ms") - F.col("start_ms"))).alias("offset_ms")
    )
    every = modes.crossJoin(g.select("query_id"))  # modes are a handful of names
    return every.join(found, ["mode", "query_id"], "left")


def lookup_golden(golden: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """golden(…, feed_url, guid) with the episode_id of its feed and guid in episodes(id, feed_url, guid), and one row with
    the number of questions found and missing. Missing ones take no part in an evaluation."""
    e = episodes.select(F.col("id").alias("episode_id"), "feed_url", "guid")
    both = golden.join(e, ["feed_url", "guid"], "left")
    return both.filter("episode_id IS NOT NULL"), both.agg(F.count("episode_id").alias("found"), F.count_if(F.col("episode_id").isNull()).alias("missing"))


def generate_golden(sampled: DataFrame, replies: DataFrame, located: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Golden rows of sampled(episode_id, idx, start_ms, end_ms, feed_url, guid) and a model's replies(episode_id, idx, skip,
    question, evidence), and one row sampled, skipped, unlocated.

    located(episode_id, quote, start_ms, end_ms, …) -> the same with at_ms finds where the evidence is said (quotes.located);
    a question without question, evidence or place is left out and counted.
    """
    rows = sampled.join(replies, ["episode_id", "idx"], "left")
    asked = ~F.coalesce("skip", F.lit(False)) & (F.coalesce("question", F.lit("")) != "") & (F.coalesce("evidence", F.lit("")) != "")
    found = located(rows.withColumn("asked", asked).withColumn("quote", F.col("evidence")))
    stats = found.agg(
        F.count("*").alias("sampled"), F.count_if(~F.col("asked")).alias("skipped"), F.count_if(F.col("asked") & F.col("at_ms").isNull()).alias("unlocated")
    )
    good = found.filter(F.col("asked") & F.col("at_ms").isNotNull())
    return good.select(F.trim("question").alias("question"), "feed_url", "guid", F.round(F.col("at_ms") / 1000, 2).alias("answer_time")), stats


def median_seconds(timings: DataFrame, *by: str) -> DataFrame:
    """p50_seconds of timings(…, seconds) for each of `by`."""
    return timings.groupBy(*by).agg(F.median("seconds").alias("p50_seconds"))


def retrieval_metrics(firsts: DataFrame, within_ms: int = 15_000) -> DataFrame:
    """Per mode: queries, recall at 1, 5, 10, mean reciprocal rank, median offset of right first hits, and the share of all
    queries whose first hit starts at most within_ms before the answer."""
    share = lambda c: F.avg(F.coalesce(c.cast("int"), F.lit(0)))
    return firsts.groupBy("mode").agg(
        F.count("*").alias("queries"),
        *[share(F.col("rank") <= k).alias(f"recall_{k}") for k in (1, 5, 10)],
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.median("offset_ms").alias("median_offset_ms"),
        share(F.col("offset_ms") <= within_ms).alias("within"),
    )


def answer_metrics(answers: DataFrame, citations: DataFrame, golden: DataFrame) -> DataFrame:
    """One row over all questions. answers: question_id, found, repaired, removed, rejected, tokens, seconds; citations:
    question_id, episode_id, at_ms; golden: question_id, episode_id, answer_ms."""
    g = golden.select("question_id", F.col("episode_id").alias("g_episode"), "answer_ms")
    c = citations.join(g, "question_id")
    right = F.col("episode_id") == F.col("g_episode")
    best = c.groupBy("question_id").agg(F.count("*").alias("cited"), F.max(right).alias("right"), F.min(F.when(right, F.abs(F.col("at_ms") - F.col("answer_ms")))).alias("off_ms"))
    rows = answers.join(best, "question_id", "left")
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("int"))
    all_cited, all_rejected = F.coalesce(F.sum("cited"), F.lit(0)), F.sum("rejected")
    return rows.agg(
        F.count("*").alias("questions"),
        share(F.col("found")).alias("answered"),
        share(F.col("right")).alias("right_episode"),
        share(F.col("repaired")).alias("repaired"),
        share(F.col("off_ms") <= 15_000).alias("within_15s"),
        share(F.col("off_ms") <= 60_000).alias("within_60s"),
        F.when(all_cited + all_rejected > 0, all_rejected / (all_rejected + all_cited)).otherwise(0.0).alias("rejected_rate"),
        F.count_if(F.col("removed") > 0).alias("lost_sentences"),
        F.avg("tokens").alias("mean_tokens"),
        F.median("seconds").alias("p50_seconds"),
    )


# --- word error rates -----------------------------------------------------------------------------------------------


def wer_words(text: Column) -> Column:
    """The default normaliser: lower case, marks gone but apostrophes inside words, hyphens as gaps."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[-–—]", " "), r"[^\p{L}\p{N}\s']", "")
    return F.filter(F.split(F.regexp_replace(plain, r"(?<!\S)'+|'+(?!\S)", ""), r"\s+"), lambda w: w != "")


def normalized_pairs(pairs: DataFrame, normalize: Callable[[Column], Column] = wer_words) -> DataFrame:
    """pairs(pair_id, ref, hyp) of texts as word arrays, by any normaliser (also a pandas function of a text); pairs whose
    reference has no word left are dropped."""
    rows = pairs.select("pair_id", normalize(F.col("ref")).alias("ref"), normalize(F.col("hyp")).alias("hyp"))
    return rows.filter(F.size("ref") > 0)


#: Distinct words of a pair that have a character each (those of two bytes, below the surrogates).
CODES = 0xD700


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edits between two word arrays: each distinct word becomes one character, and the built-in distance, which keeps two
    rows of its table, does the rest. NULL for pairs of more than CODES distinct words."""
    names = F.array_distinct(F.concat(reference, hypothesis))
    number = lambda w: F.lpad(F.hex(F.array_position(names, w) + 0xFF), 4, "0")
    code = lambda words: F.decode(F.unhex(F.array_join(F.transform(words, number), "")), "UTF-16BE")
    return F.when(F.size(names) <= CODES, F.levenshtein(code(reference), code(hypothesis)))


def pooled_wer(pairs: DataFrame) -> DataFrame:
    """edits, words, wer over pairs(ref, hyp) of word arrays with a non-empty ref: one rate of all errors and all words."""
    rows = pairs.filter(F.size("ref") > 0).withColumn("edits", word_edits(F.col("ref"), F.col("hyp")))
    exact = rows.withColumn("edits", F.coalesce("edits", edits_of("ref", "hyp")))
    total = exact.agg(F.sum("edits").cast("bigint").alias("edits"), F.sum(F.size("ref")).cast("bigint").alias("words"))
    return total.withColumn("wer", F.col("edits") / F.col("words"))


#: Cells of a table of steps that is kept whole, and the width that a search for a distance starts with.
CELLS, WIDTH = 1 << 20, 64


def last_row(r: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Edits between r and each beginning of h, for places at most width off the diagonal (far too many for others): one row of
    the table of costs at a time, and of that the band alone. Costs up to width are right."""
    n, m = len(r), len(h)
    lo, hi = 0, min(m, width)
    row = np.arange(hi + 1)
    for i in range(1, n + 1):
        left, right = max(0, i - width), min(m, i + width)
        if right < left:
            return np.full(m + 1, n + m + 1)
        # before[x]: the last row at column left - 1 + x
        before = np.full(right - left + 2, n + m + 1)
        a, b = max(lo, left - 1), min(hi, right)
        before[a - left + 1 : b - left + 2] = row[a - lo : b - lo + 1]
        best = before[1:] + 1
        skip = left == 0
        both = before[skip:-1] + (h[left - 1 + skip : right] != r[i - 1])
        best[skip:] = np.minimum(best[skip:], both)
        # a step along the hypothesis adds one a column: a running minimum of costs less their column
        columns = np.arange(right - left + 1)
        row, lo, hi = np.minimum.accumulate(best - columns) + columns, left, right
    out = np.full(m + 1, n + m + 1)
    out[lo : hi + 1] = row
    return out


def distance(r: np.ndarray, h: np.ndarray) -> int:
    """Edits between two arrays of codes: bands of doubled width until the cost fits into one, so about n times the edits."""
    width = max(WIDTH, abs(len(r) - len(h)))
    while (cost := int(last_row(r, h, width)[-1])) > width:
        width *= 2
    return cost


def _codes(ref: list[str], hyp: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = {w: k for k, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    return np.array([codes[w] for w in ref], np.int64), np.array([codes[w] for w in hyp], np.int64)


def align(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int]]:
    """Steps (equal, sub, del, ins; index in ref; index in hyp) of a cheapest alignment, in order.

    Divide and conquer in linear memory: a cheapest way passes the middle of the reference where the costs of both halves, each
    a band as wide as the known cost, sum to least. Parts of at most CELLS cells keep a table of steps, one byte a cell.
    """
    r, h = _codes(ref, hyp)
    steps: list[tuple[str, int, int]] = []
    todo: list[tuple[int, int, int, int, int | None]] = [(0, len(r), 0, len(h), None)]
    while todo:
        i, k, j, m, cost = todo.pop()
        if cost == 0:
            steps += [("equal", i + x, j + x) for x in range(k - i)]
        elif (k - i + 1) * (m - j + 1) <= CELLS or k - i < 2:
            steps += [(kind, i + x, j + y) for kind, x, y in _steps(r[i:k], h[j:m])]
        else:
            cost = distance(r[i:k], h[j:m]) if cost is None else cost
            half = (i + k) // 2
            width = max(cost, abs(k - i - m + j))
            upper, lower = last_row(r[i:half], h[j:m], width), last_row(r[half:k][::-1], h[j:m][::-1], width)[::-1]
            at = int((upper + lower).argmin())
            todo += [(half, k, j + at, m, int(lower[at])), (i, half, j, j + at, int(upper[at]))]
    return steps


def _steps(r: np.ndarray, h: np.ndarray) -> list[tuple[str, int, int]]:
    """A cheapest alignment by a table of steps, made row by row."""
    n, m = len(r), len(h)
    columns = np.arange(m + 1)
    row, moves = columns, np.full((n + 1, m + 1), 2, np.uint8)  # 0: both, 1: ref alone, 2: hyp alone
    for i in range(1, n + 1):
        both, alone = row[:-1] + (h != r[i - 1]), row + 1
        best = alone.copy()
        best[1:] = np.minimum(best[1:], both)
        now = np.minimum.accumulate(best - columns) + columns
        moves[i, now == alone] = 1
        moves[i, 1:][now[1:] == both] = 0
        row = now
    steps, i, j = [], n, m
    while i or j:
        move = moves[i, j]
        if move == 0:
            i, j = i - 1, j - 1
            steps.append(("equal" if r[i] == h[j] else "sub", i, j))
        elif move == 1:
            i -= 1
            steps.append(("del", i, j))
        else:
            j -= 1
            steps.append(("ins", i, j))
    return steps[::-1]


def edits_of(ref: str, hyp: str) -> Column:
    """Edits between two word-array columns, by bands in Python; for pairs the JVM form does not cover."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance(*_codes(list(x), list(y))) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])

    skip = F.size(F.array_distinct(F.concat(F.col(ref), F.col(hyp)))) <= CODES  # those pairs send nothing to Python
    return run(F.when(~skip, F.col(ref)), F.when(~skip, F.col(hyp)))


def alignments(pairs: DataFrame) -> DataFrame:
    """pair_id, step, kind, ref_word, hyp_word of pairs(pair_id, ref, hyp): row-wise, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for pair, ref, hyp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for k, (kind, i, j) in enumerate(align(ref or [], hyp or [])):
                    for c, v in zip(out, (pair, k, kind, ref[i] if kind != "ins" else None, hyp[j] if kind != "del" else None), strict=True):
                        c.append(v)
            types = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["pair_id", "step", "kind", "ref_word", "hyp_word"])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", "ref", "hyp").mapInArrow(run, f"pair_id {kind}, step int, kind string, ref_word string, hyp_word string")


def error_counts(steps: DataFrame) -> DataFrame:
    """pair_id with substitutions, deletions, insertions of alignments()."""
    kinds = (("sub", "substitutions"), ("del", "deletions"), ("ins", "insertions"))
    return steps.groupBy("pair_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in kinds])


def top_substitutions(steps: DataFrame, k: int = 8) -> DataFrame:
    """The k commonest (ref_word, hyp_word) pairs; equal counts by the words."""
    n = steps.filter("kind = 'sub'").groupBy("ref_word", "hyp_word").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "ref_word", "hyp_word").limit(k)


def uncorrected(edits: Column, words: Column) -> Column:
    """A reference that differs from its draft in under a hundredth of its words was probably not corrected."""
    return F.coalesce(edits / words < 0.01, F.lit(True))


def outside_seconds(mid: Column, start: Column, end: Column) -> Column:
    """How far a word's middle lies outside its utterance; 0 inside."""
    return F.greatest(start - mid, F.lit(0.0), mid - end)


def timing_summary(offsets: DataFrame) -> DataFrame:
    """n, inside_rate, p95, worst of offsets(outside): p95 is the value at index floor(0.95 (n - 1)) in sorted order.

    Equal values are counted before they meet; the running count over the distinct ones is taken range by range.
    """
    counted = offsets.filter("outside IS NOT NULL").groupBy("outside").agg(F.count("*").alias("c"))
    placed = running_total(counted, "c", ["outside"], name="upto")
    total = placed.agg(F.max("upto").alias("n"))  # one row
    p95 = F.min(F.when(F.col("upto") > F.floor(0.95 * (F.col("n") - 1)), F.col("outside")))
    inside = F.sum(F.when(F.col("outside") <= 0, F.col("c")).otherwise(0)) / F.max("n")
    return placed.crossJoin(F.broadcast(total)).agg(F.max("n").alias("n"), inside.alias("inside_rate"), p95.alias("p95"), F.max("outside").alias("worst"))


def golden_sample(passages: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """passages(episode_id, idx, …) drawn for a golden set: max(1, total / episodes) an episode, in an order that the seed
    and the passage fix."""
    n = passages.agg(F.count_distinct("episode_id").alias("episodes"))
    each = F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("episodes")))
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("episode_id").cast("string"), F.col("idx").cast("string")).cast("binary"))
    place = Window.partitionBy("episode_id").orderBy("key", "idx")
    drawn = passages.withColumn("key", key).withColumn("r", F.row_number().over(place))
    return drawn.crossJoin(F.broadcast(n)).filter(F.col("r") <= each).drop("key", "r", "episodes")  # n is one row


def session_words(sessions: DataFrame) -> DataFrame:
    """session_id, utterance, kind, outside of sessions(session_id, ref, hyp, spans).

    ref: array<struct<word, utterance>> in order; hyp: array<struct<word, start, end>>; spans: array<struct<utterance,
    start, end>>. One row a step of the alignment: an inserted word belongs to the utterance seen last; a right word has the
    distance of its middle from its utterance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for session, ref, hyp, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                span = {s["utterance"]: (s["start"], s["end"]) for s in spans}
                seen = ref[0]["utterance"] if ref else None
                for kind, i, j in align([r["word"] for r in ref], [h["word"] for h in hyp]):
                    seen = ref[i]["utterance"] if kind != "ins" else seen
                    off = None
                    if kind == "equal":
                        mid = (hyp[j]["start"] + hyp[j]["end"]) / 2
                        off = max(span[seen][0] - mid, 0.0, mid - span[seen][1])
                    for c, v in zip(out, (session, seen, kind, off), strict=True):
                        c.append(v)
            types = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["session_id", "utterance", "kind", "outside"])

    kind = sessions.schema["session_id"].dataType.simpleString()
    return sessions.select("session_id", "ref", "hyp", "spans").mapInArrow(run, f"session_id {kind}, utterance bigint, kind string, outside double")


def worst_utterances(steps: DataFrame, k: int = 5) -> DataFrame:
    """session_id, utterance, errors of the k worst of each session_words(); equal counts by utterance."""
    n = steps.groupBy("session_id", "utterance").agg(F.count_if(F.col("kind") != "equal").alias("errors"))
    place = Window.partitionBy("session_id").orderBy(F.desc("errors"), "utterance")
    return n.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k).drop("r")


def clip_report(pairs: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row a pair of pairs(pair_id, ref, hyp, audio_s, took_s) and drafts(pair_id, draft): error rate, speed in times of
    real time, and whether the reference was hardly changed from its draft."""
    counted = error_counts(alignments(pairs)).select("pair_id", (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("edits"))
    changed = pairs.join(drafts, "pair_id").select("pair_id", F.col("draft").alias("hyp"), "ref")
    fixes = error_counts(alignments(changed)).select("pair_id", (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("fixes"))
    both = pairs.join(counted, "pair_id", "left").join(fixes, "pair_id", "left").withColumn("words", F.size("ref"))
    return both.select(
        "pair_id", "words", (F.coalesce("edits", F.lit(0)) / F.col("words")).alias("wer"), (F.col("audio_s") / F.col("took_s")).alias("speed"), uncorrected(F.coalesce("fixes", F.lit(0)), F.col("words")).alias("uncorrected")
    )
