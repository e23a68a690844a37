"""Operator 12: periodic runs by recompression.

The word sequences of a slice of documents, with a sign of its own before, between and after them, are compressed in turns:
blocks of one symbol become one symbol each, then neighbours from two classes of symbols become pairs, with the same symbol
for the same content wherever it stands. The levels are a run-length grammar of the slice. Two places are compared by climbing
while their symbols agree and descending where they part, so an extension costs a few steps a level, for all places at once,
forwards and (on the mirrored levels) backwards; no suffix array is made.

A run of period q and length at least max(SHORTEST, EXPONENT * q) holds a place j of any grid of step max(SHORTEST, EXPONENT * q) - q
at which the words j and j + q agree, along with the whole stretch around it. For each period the places of its grid where
the two words agree are candidates (harmonic, so O(n log n) in all), and the grammar extends them exactly. A run is also
found under multiples of its period, then with the same ends; the smallest period stays.

Results: a null or empty text has no words and no runs, and its collapsed text is empty; very long texts are handled whole;
repeated rows repeat their result; runs that share ends or start come by start, then period; an empty table gives an empty
table. Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: Words of a run at least, and its length over its period at least.
SHORTEST, EXPONENT = 6, 4
#: Candidates that are compared together.
TOGETHER = 500_000
#: Drawn classes of symbols a level tries, of which the one with most pairs is taken.
TRIES = 4


@dataclass
class Level:
    """Symbols of one level; parent[i]: the next level's symbol over symbol i, start[p]: the first symbol below p."""

    symbols: np.ndarray
    parent: np.ndarray
    start: np.ndarray
    block: bool

    def mirrored(self) -> Level:
        n, above = len(self.symbols), len(self.start) - 1
        return Level(self.symbols[::-1], above - 1 - self.parent[::-1], n - self.start[::-1], self.block)


def recompress(words: np.ndarray, fence: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Levels of the grammar from the words up, and the symbols on top. fence marks signs that stand once and never merge."""
    levels: list[Level] = []
    symbols, fresh, draw = words.astype(np.int64), int(words.max(initial=-1)) + 1, 0

    def climb(starts: np.ndarray, above: np.ndarray, block: bool) -> None:
        nonlocal symbols, fence
        over = np.zeros(len(symbols), np.int64)
        over[starts] = 1
        levels.append(Level(symbols, np.cumsum(over) - 1, np.append(starts, len(symbols)), block))
        symbols, fence = above, fence[starts]

    while True:
        starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(symbols) else np.zeros(0, np.int64)
        if len(starts) < len(symbols):
            sizes, above = np.diff(np.append(starts, len(symbols))), symbols[starts]
            many = sizes > 1
            kinds, which = np.unique(above[many] * (len(symbols) + 1) + sizes[many], return_inverse=True)
            above[many] = fresh + which
            fresh += len(kinds)
            climb(starts, above, True)
        free = ~fence
        if not (free[1:] & free[:-1]).any():
            return levels, symbols
        pairs = np.zeros(0, bool)
        while not pairs.any():
            for _ in range(TRIES):
                draw += 1
                mix = (symbols.astype(np.uint64) + np.uint64(draw << 40)) * np.uint64(0x9E3779B97F4A7C15)
                side = ((mix ^ mix >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)
                drawn = (side & free)[:-1] & (~side & free)[1:]
                if drawn.sum() > pairs.sum():
                    pairs = drawn
        second = np.append(False, pairs)
        starts = np.flatnonzero(~second)
        first = np.flatnonzero(pairs)
        kinds, which = np.unique(symbols[first] * fresh + symbols[first + 1], return_inverse=True)
        made = symbols.copy()
        made[first] = fresh + which
        fresh += len(kinds)
        climb(starts, made[starts], False)


def agreement(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For how many words the sequences from places a and from places b on agree."""
    begin, rows = a, np.arange(len(a))
    parted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in levels:
        over_a, over_b = level.parent[a], level.parent[b]
        inside = (level.start[over_a] != a) | (level.start[over_b] != b)
        same = level.symbols[a] == level.symbols[b]
        if level.block:
            rest_a, rest_b = level.start[over_a + 1] - a, level.start[over_b + 1] - b
            step, goes = np.minimum(rest_a, rest_b), rest_a == rest_b
        else:
            step, goes = 1, True
        step = np.where(inside & same, step, 0)
        a, b = a + step, b + step
        up = ~inside | (same & goes)
        parted.append((rows[~up], a[~up], b[~up]))
        rows, a, b = rows[up], level.parent[a[up]], level.parent[b[up]]
    for level, (more, more_a, more_b) in zip(reversed(levels), reversed(parted), strict=True):
        left, right = a, b
        a, b = level.start[left], level.start[right]
        same = level.symbols[a] == level.symbols[b]
        step = np.where(same, np.minimum(level.start[left + 1] - a, level.start[right + 1] - b) if level.block else 1, 0)
        rows, a, b = np.append(rows, more), np.append(a + step, more_a), np.append(b + step, more_b)
    out = np.empty(len(begin), np.int64)
    out[rows] = a
    return out - begin


def candidates(first: np.ndarray, count: np.ndarray, words: np.ndarray, shortest: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods whose words agree, grid by grid, about TOGETHER grid places at a time."""
    most = np.where(count >= shortest, count // exponent, 0)
    for lo, hi in _parts(most, TOGETHER):
        doc = np.repeat(np.arange(lo, hi), most[lo:hi])
        period = np.arange(len(doc)) - np.repeat(np.cumsum(most[lo:hi]) - most[lo:hi], most[lo:hi]) + 1
        step = np.maximum(shortest, exponent * period) - period
        places = -(-(count[doc] - period) // step)
        for x, y in _parts(places, TOGETHER):
            n = places[x:y]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q = np.repeat(period[x:y], n)
            j = np.repeat(first[doc[x:y]], n) + nth * np.repeat(step[x:y], n)
            agree = words[j] == words[j + q]
            if agree.any():
                yield j[agree], q[agree]


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of sizes that sum to about most, or hold one that is larger."""
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def runs_of(rows: list[list[bytes]], shortest: int = SHORTEST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Runs (sequence, start, length, period) of sequences of words, in order; and which words stay once runs are collapsed."""
    count = np.array([len(r) for r in rows], np.int64)
    first = np.cumsum(count + 1) - count
    total = int(count.sum())
    ids, known = pd.factorize(np.array([w for r in rows for w in r], object)) if total else (np.zeros(0, np.int64), [])
    fence = np.zeros(total + len(rows) + 1, bool)
    fence[np.append(first - 1, len(fence) - 1)] = True
    words = np.empty(len(fence), np.int64)
    words[~fence], words[fence] = ids, len(known) + np.arange(len(rows) + 1)
    levels, _ = recompress(words, fence)
    back = [x.mirrored() for x in levels]
    found = np.zeros((0, 3), np.int64)
    for j, q in candidates(first, count, words, shortest, exponent):
        start = j - agreement(back, len(words) - j, len(words) - j - q)
        end = j + q + agreement(levels, j, j + q)
        fits = end - start >= np.maximum(shortest, exponent * q)
        found = np.concatenate([found, np.stack([start, end, q], 1)[fits]])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        found = found[np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(1))] if len(found) else found
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    start, end, period = found.T
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    stay = np.cumsum(change)[:-1] == 0
    doc = np.searchsorted(first, start, "right") - 1
    return np.stack([doc, start - first[doc], end - start, period], 1), stay[~fence]


def cut_words(text: str) -> list[bytes]:
    """Words between blanks and the controls U+0009 to U+000D."""
    return text.encode().split()


def _found(rows: list[list[bytes]], shortest: int, exponent: int) -> tuple[list[np.ndarray], list[str]]:
    """Of each sequence its runs (start, length, period), and its words once they are collapsed."""
    runs, stay = runs_of(rows, shortest, exponent)
    edges = np.searchsorted(runs[:, 0], np.arange(len(rows) + 1))
    of, kept, at = [], [], 0
    for r, words in enumerate(rows):
        of.append(runs[edges[r] : edges[r + 1], 1:])
        on = stay[at : at + len(words)]
        kept.append(b" ".join(words if on.all() else [words[i] for i in np.flatnonzero(on).tolist()]).decode())
        at += len(words)
    return of, kept


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs (start, length, period, by start and period) and the collapsed text of every row of docs."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def score(texts: list[str]) -> dict[str, pa.Array]:
        of, kept = _found([cut_words(t) for t in texts], shortest, exponent)
        runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x in of]
        return {"runs": pa.array(runs, kind), "collapsed": pa.array(kept, pa.string())}

    return map_texts(docs, score, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def repeated_tail(doc_id: int | None, words: list) -> list:
    """The query's words of a document: of every tenth id by hash, a tail repeats itself. A null id leaves its words alone."""
    if doc_id is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return words
    n = len(words)
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * -(-(n - a) // len(unit)))[: n - a]


def run_digest(docs: DataFrame, words_of: Callable[[int | None, list], list] = repeated_tail, shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, the number of runs, the longest one, and digests of all runs and of the collapsed text."""

    def score(ids: list, texts: list[str]) -> dict[str, pa.Array]:
        of, kept = _found([words_of(i, cut_words(t)) for i, t in zip(ids, texts, strict=True)], shortest, exponent)
        best = [min(x.tolist(), key=lambda r: (-r[1], r[0], r[2])) if len(x) else None for x in of]
        lines = ["".join(f"{a},{n},{p}\n" for a, n, p in x.tolist()) for x in of]
        longest = {name: pa.array([b and b[k] for b in best], pa.int64()) for k, name in enumerate(("start", "length", "period"))}
        return {
            "n_runs": pa.array([len(x) for x in of], pa.int64()),
            **longest,
            "exponent_milli": pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
            "runs_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines]),
            "collapsed_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept]),
        }

    longs = ", ".join(f"{c} bigint" for c in ("n_runs", "start", "length", "period", "exponent_milli"))
    return map_texts(docs, score, f"{longs}, runs_sha256 string, collapsed_sha256 string", with_ids=True)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(table(spark, sf_dir, "documents"))
