"""Operators over ordered word streams and speech spans.

The order of a transcript is (chunk, position), never the time stamp: times may step back a little. Times are integer
milliseconds. Scans whose next step depends on the last one (passages, chunk plans, repeated phrases), and whatever looks at
an episode's neighbouring words, run as one pass over an episode's arrays in an Arrow map, without a shuffle where an
episode is one row; everything else is windows and array functions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signal_norm
from .prefix import running_total
from .scan import scanned


def in_order():
    """An episode's words by position."""
    return Window.partitionBy("episode_id").orderBy("pos")



def flatten_chunks(chunks: DataFrame) -> DataFrame:
    """episode_id, pos, text of chunks(episode_id, idx, words): positions run on through the chunks in order of idx."""
    before = F.coalesce(F.sum(F.size("words")).over(Window.partitionBy("episode_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("first", before).select("episode_id", "first", F.posexplode("words").alias("p", "text")).select("episode_id", (F.col("first") + F.col("p")).alias("pos"), "text")


def shift_words(words: Column, by: Column) -> Column:
    """array<struct<text,start,end>> moved by a number of seconds, rounded to milliseconds."""
    return F.transform(words, lambda w: F.struct(w["text"].alias("text"), F.round(w["start"] + by, 3).alias("start"), F.round(w["end"] + by, 3).alias("end")))


# --- passages -------------------------------------------------------------------------------------------------------


def passage_bounds(starts: np.ndarray, ends: np.ndarray, window: int, stride: int) -> list[tuple[int, int, int]]:
    """(first, stop, end) of every passage: words [first, stop), and the largest end among them.

    Where words start is looked up in the running maximum of starts, which is sorted; only where an earlier word starts
    later than the anchor (times step back) are the words behind it searched one by one.
    """
    n, highest = len(starts), np.maximum.accumulate(starts)

    def later(i: int, time: int) -> int:
        """The first word after i that starts at time or later; n if there is none."""
        if highest[i] < time:
            return int(np.searchsorted(highest, time))
        rest = np.flatnonzero(starts[i + 1 :] >= time)
        return i + 1 + int(rest[0]) if len(rest) else n

    out, anchor, stop = [], 0, 0
    while stop < n:
        stop = later(anchor, starts[anchor] + window)
        out.append((anchor, stop, int(ends[anchor:stop].max())))
        anchor = min(stop, later(anchor, starts[anchor] + stride))
    return out


def make_passages(transcripts: DataFrame, window_ms: int = 45_000, stride_ms: int = 30_000) -> DataFrame:
    """episode_id, idx, start_ms, end_ms, n_words, text of transcripts(episode_id, tokens, starts, ends).

    Windows are anchored at words, so the next anchor depends on the last: one pass an episode, in a row-wise map.
    """
    if not 0 < stride_ms <= window_ms:
        raise ValueError("0 < stride <= window is required")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, starts, ends = (batch.column(i) for i in (1, 2, 3))
            bounds = tokens.offsets.to_numpy()
            s_all, e_all = starts.values.to_numpy(), ends.values.to_numpy()
            s_bounds = starts.offsets.to_numpy()
            rows, idxs, spans, takes = [], [], [], []
            for r in range(batch.num_rows):
                at, stop, base = s_bounds[r], s_bounds[r + 1], bounds[r]
                for idx, (i, j, end) in enumerate(passage_bounds(s_all[at:stop], e_all[at:stop], window_ms, stride_ms)):
                    rows.append(r)
                    idxs.append(idx)
                    spans.append((int(s_all[at + i]), end, j - i))
                    takes.append(np.arange(base + i, base + j))
            # texts are joined from the batch's own words, without a Python string a word
            offsets = np.concatenate([[0], np.cumsum([n for _, _, n in spans])]).astype(np.int32)
            picked = tokens.values.take(pa.array(np.concatenate(takes) if takes else np.zeros(0, np.int64)))
            texts = pc.binary_join(pa.ListArray.from_arrays(offsets, picked), " ")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(idxs, pa.int32()),
                    pa.array([s for s, _, _ in spans], pa.int64()),
                    pa.array([e for _, e, _ in spans], pa.int64()),
                    pa.array([n for _, _, n in spans], pa.int32()),
                    texts,
                ],
                names=["episode_id", "idx", "start_ms", "end_ms", "n_words", "text"],
            )

    kind = transcripts.schema["episode_id"].dataType.simpleString()
    source = transcripts.select("episode_id", "tokens", "starts", "ends")
    return source.mapInArrow(run, f"episode_id {kind}, idx int, start_ms bigint, end_ms bigint, n_words int, text string")


def gather_transcripts(words: DataFrame) -> DataFrame:
    """words(episode_id, pos, text, start_ms, end_ms) as one row of arrays an episode, in order of pos."""
    packed = words.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "start_ms", "end_ms"))).alias("w"))
    return packed.select("episode_id", F.col("w.text").alias("tokens"), F.col("w.start_ms").alias("starts"), F.col("w.end_ms").alias("ends"))


# --- speech spans ---------------------------------------------------------------------------------------------------


def split_long_spans(spans: DataFrame, max_ms: int) -> DataFrame:
    """spans(…, start_ms, end_ms) with those over max_ms cut to pieces of max_ms and a rest; adds piece."""
    pieces = F.greatest(F.lit(1), F.ceil((F.col("end_ms") - F.col("start_ms")) / F.lit(max_ms)))
    cut = spans.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    start = F.col("start_ms") + F.col("piece") * max_ms
    end = F.least("end_ms", start + max_ms)
    return cut.withColumn("e", end).withColumn("start_ms", start).withColumn("end_ms", F.col("e")).drop("e")


def chunk_plan(spans: DataFrame, max_ms: int = 600_000) -> DataFrame:
    """episode_id, idx, start_ms, end_ms, n_spans: speech spans packed to chunks of at most max_ms, long ones cut first."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        idx, chunk = 0, None  # episode, first start, last end, spans
        for episode, start, end in rows:
            fits = chunk is not None and end - chunk[1] <= max_ms
            if chunk is not None and not fits:
                yield chunk[0], idx, *chunk[1:]
                idx += 1
            chunk = (episode, chunk[1], end, chunk[3] + 1) if fits else (episode, start, end, 1)
        yield chunk[0], idx, *chunk[1:]

    cut = split_long_spans(spans.select("episode_id", "start_ms", "end_ms"), max_ms).select("episode_id", "start_ms", "end_ms")
    return scanned(cut, "episode_id", ["start_ms", "end_ms"], run, "episode_id bigint, idx int, start_ms bigint, end_ms bigint, n_spans int")


def utterance_offsets(items: DataFrame, gap: int) -> DataFrame:
    """start, end of items(group_id, ord, length) joined one after another with a gap. ord tells a group's items apart; a
    group of any size is added up range by range."""
    whole = running_total(items.withColumn("end", F.coalesce("length", F.lit(0)) + gap), "end", ["ord"], "group_id", "end_at")
    start = F.col("end_at") - F.coalesce("length", F.lit(0))
    return whole.withColumn("start", start).withColumn("end", F.col("start") + F.col("length")).select(*items.columns, "start", "end")


# --- signals --------------------------------------------------------------------------------------------------------


def compressed_runs(words: DataFrame, below_ms: int = 50, least: int = 3) -> DataFrame:
    """episode_id, a, b: maximal runs [a, b) of words shorter than below_ms, of at least `least` words."""
    tiny = words.filter(F.col("end_ms") - F.col("start_ms") < below_ms)
    island = F.col("pos") - F.row_number().over(in_order())
    runs = tiny.withColumn("island", island).groupBy("episode_id", "island").agg(F.min("pos").alias("a"), (F.max("pos") + 1).alias("b"), F.count("*").alias("n"))
    return runs.filter(F.col("n") >= least).select("episode_id", "a", "b")


def backward_jumps(words: DataFrame, more_than_ms: int = 500) -> DataFrame:
    """episode_id, pos of words that start more than more_than_ms before their predecessor."""
    back = F.lag("start_ms").over(in_order()) - F.col("start_ms")
    return words.withColumn("back", back).filter(F.col("back") > more_than_ms).select("episode_id", "pos", F.col("back").alias("back_ms"))


def phrase_candidates(transcripts: DataFrame, shortest: int = 3, longest: int = 8) -> DataFrame:
    """episode_id, pos, n: at each place the longest n whose n words are said again at once. Array functions only."""
    t = F.transform(F.col("tokens"), signal_norm)

    def at(i: Column) -> Column:
        found = F.lit(0)
        for n in range(shortest, longest + 1):
            a, b = F.slice("t", i + 1, n), F.slice("t", i + 1 + n, n)
            found = F.when((F.size(b) == n) & (a == b) & ~F.array_contains(a, ""), F.lit(n)).otherwise(found)
        return F.struct(i.alias("pos"), found.alias("n"))

    # a repeat needs the same word again within `longest` places: most places are ruled out by one comparison each
    near = lambda i: F.exists(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.get(F.col("t"), i) == F.get(F.col("t"), i + n))
    places = F.when(F.size("t") >= 2 * shortest, F.filter(F.sequence(F.lit(0), F.size("t") - 1), near)).otherwise(F.array().cast("array<int>"))
    out = transcripts.select("episode_id", t.alias("t")).select("episode_id", F.explode(F.transform(places, at)).alias("c"))
    return out.select("episode_id", "c.pos", "c.n").filter("n > 0")


def repeated_phrases(transcripts: DataFrame) -> DataFrame:
    """episode_id, pos, n of immediately repeated phrases that do not overlap, from left to right."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        free = 0
        for episode, pos, n in rows:
            if pos >= free:
                yield episode, pos, n
                free = pos + 2 * n

    return scanned(phrase_candidates(transcripts), "episode_id", ["pos"], run, "episode_id bigint, pos int, n int")


def phrases_of(words: np.ndarray, empty: int, shortest: int = 3, longest: int = 8) -> list[tuple[int, int]]:
    """(pos, n) of repeated phrases of one episode's words, given as numbers; `empty` is that of a word without letters."""
    size = len(words)
    best = np.zeros(size, np.int64)
    blank = np.concatenate([[0], np.cumsum(words == empty)])
    for n in range(shortest, min(longest, size // 2) + 1):
        again = np.concatenate([[0], np.cumsum(words[:-n] == words[n:])])
        at = np.arange(size - 2 * n + 1)
        best[at[(again[at + n] - again[at] == n) & (blank[at + n] == blank[at])]] = n
    out, free = [], 0
    for pos in np.flatnonzero(best).tolist():
        if pos >= free:
            out.append((pos, int(best[pos])))
            free = pos + 2 * int(best[pos])
    return out


def signals_of(starts: np.ndarray, ends: np.ndarray, words: np.ndarray, empty: int, below_ms: int = 50, least: int = 3, jump_ms: int = 500) -> list[tuple[str, int, int]]:
    """(kind, a, b) of all signals of one episode in order of a: a run of short words [a, b), a jump back (i - 1, i + 1), a
    repeated phrase (s, s + 2n)."""
    tiny = np.diff(np.concatenate([[0], (ends - starts < below_ms).astype(np.int8), [0]]))
    found = [("compressed", a, b) for a, b in zip(np.flatnonzero(tiny == 1).tolist(), np.flatnonzero(tiny == -1).tolist(), strict=True) if b - a >= least]
    found += [("jump", i, i + 2) for i in np.flatnonzero(starts[:-1] - starts[1:] > jump_ms).tolist()]
    found += [("phrase", pos, pos + 2 * n) for pos, n in phrases_of(words, empty)]
    return sorted(found, key=lambda x: x[1])


def suspects(transcripts: DataFrame, context: int = 4) -> DataFrame:
    """episode_id, ord, kind, a, b, at_ms, at, snippet of all signals of transcripts(episode_id, tokens, starts, ends), in
    order of place. A row-wise map: an episode's words are in one row, so nothing is shuffled."""
    made = transcripts.select("episode_id", "tokens", F.transform("tokens", signal_norm).alias("t"), "starts", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            episode, tokens, plain, starts, ends = batch.columns
            coded = pc.dictionary_encode(plain.values)
            empty = pc.index(coded.dictionary, "").as_py()
            words, s_all, e_all = coded.indices.to_numpy(zero_copy_only=False), starts.values.to_numpy(), ends.values.to_numpy()
            bounds = [x.offsets.to_numpy() for x in (tokens, plain, starts, ends)]
            rows: list[list] = [[] for _ in range(8)]
            for r in range(batch.num_rows):
                (t, t_end), (w, w_end), (s, s_end), (e, e_end) = ((b[r], b[r + 1]) for b in bounds)
                mine = s_all[s:s_end]
                for i, (kind, a, b) in enumerate(signals_of(mine, e_all[e:e_end], words[w:w_end], empty)):
                    low, high = max(0, a - context), min(int(t_end - t), b + context)
                    ms = int(mine[a])
                    snippet = " ".join(tokens.values.slice(t + low, high - low).to_pylist())
                    for column, value in zip(rows, (r, i, kind, a, b, ms, f"{ms // 60_000}:{ms // 1_000 % 60:02d}", snippet), strict=True):
                        column.append(value)
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string())
            arrays = [episode.take(pa.array(rows[0], pa.int64())), *(pa.array(c, t) for c, t in zip(rows[1:], types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["episode_id", "ord", "kind", "a", "b", "at_ms", "at", "snippet"])

    kind = transcripts.schema["episode_id"].dataType.simpleString()
    return made.mapInArrow(run, f"episode_id {kind}, ord int, kind string, a int, b int, at_ms bigint, at string, snippet string")


def signal_summary(transcripts: DataFrame, found: DataFrame) -> DataFrame:
    """episode_id, span_ms, counts by kind, and suspects an hour of transcript (0 without duration)."""
    span = transcripts.filter(F.size("starts") > 0).select("episode_id", (F.element_at("ends", -1) - F.element_at("starts", 1)).alias("span_ms"))
    kinds = found.groupBy("episode_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("compressed", "jump", "phrase")])
    both = span.join(kinds, "episode_id", "left").fillna(0, ["compressed", "jump", "phrase"])
    total = F.col("compressed") + F.col("jump") + F.col("phrase")
    return both.withColumn("per_hour", F.when(F.col("span_ms") > 0, total * 3_600_000.0 / F.col("span_ms")).otherwise(0.0))


def clock_text(ms: int) -> str:
    s = max(0, ms // 1_000)
    return f"{s // 3_600}:{s // 60 % 60:02d}:{s % 60:02d}" if s >= 3_600 else f"{s // 60}:{s % 60:02d}"


#: Words of the episodes that are looked at together, unless one has more.
WORDS_AT_ONCE = 200_000


def sliced(batches: Iterable[pa.RecordBatch], column: int, most: int = WORDS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose lists of that column hold at most `most` values together, or a row each; a slice
    has lists of its own, which begin at 0."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy())
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
            yield batch.take(pa.array(np.arange(lo, hi)))
            lo = hi


def draft_lines(transcripts: DataFrame, every_s: int = 30) -> DataFrame:
    """episode_id, line, text of a draft of transcripts(episode_id, tokens, starts): a line ends after . ? or !, and a
    "# m:ss" line goes before the first word past each time boundary. A row-wise map without a shuffle, over slices of
    episodes of about as many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            episode, tokens, starts = batch.columns
            t, s = tokens.offsets.to_numpy(), starts.offsets.to_numpy()
            ended = pc.match_substring_regex(tokens.values, r"[.?!]$").to_numpy(zero_copy_only=False)
            s_all, first, marks, rows = starts.values.to_numpy(), [], [], []
            for r in range(batch.num_rows):
                mine = s_all[s[r] : s[r + 1]]
                if not len(mine):
                    continue
                block = mine // (every_s * 1_000)
                marked = np.concatenate([[True], block[1:] > np.maximum.accumulate(block)[:-1]])
                at = np.flatnonzero(marked | np.concatenate([[True], ended[t[r] : t[r + 1] - 1]]))
                first.append(t[r] + at)
                marks += [clock_text(int(mine[i])) if marked[i] else None for i in at.tolist()]
                rows += [r] * len(at)
            cuts = np.concatenate([*first, [t[-1]]]) if first else np.zeros(1, np.int64)
            # texts are joined from the batch's own words; words of an episode follow one another without gaps
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), tokens.values), " ").to_pylist()
            out: list[list] = [[], [], []]
            line, last = 0, None
            for r, mark, text in zip(rows, marks, texts, strict=True):
                line, last = (line if r == last else 0), r
                for x in ([f"# {mark}"] if mark else []) + [text]:
                    line += 1
                    for column, value in zip(out, (r, line, x), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([episode.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["episode_id", "line", "text"])

    kind = transcripts.schema["episode_id"].dataType.simpleString()
    return transcripts.select("episode_id", "tokens", "starts").mapInArrow(run, f"episode_id {kind}, line int, text string")
