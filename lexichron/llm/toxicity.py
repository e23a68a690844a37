"""Operator 7: toxicity by noisy-channel deobfuscation.

A trigram character model is counted over every document, in the corpus's own letters: what it holds grows with the
scripts and letter sequences of the input. Words of a text that look disguised (digits or signs next to letters, doubled
letters, letters of two scripts, letters set apart) become character lattices: each sign may stand for itself or for the
letters of the word's script that it imitates, a repeated letter may be dropped, a gap between single letters may be
closed. Viterbi finds the likeliest restored text under the character model; the restored text is then scored by a lexicon
of words and word beginnings, learnt from labelled rows, and a logistic curve over its strongest hits.

Bounds: the fit uses at most SAMPLE labelled rows (those of smallest hash, however often a doc_id is repeated); the
lexicon has at most 2**FEATURE_BITS entries. The character model has a count for each trigram of letters seen; letters of
scripts without look-alikes and with thousands of signs (all beyond U+2E80) share one symbol, so it is bounded by the
letter sequences of alphabets (a few MB for a dozen languages). Both are broadcast. Scoring is row-wise over whole texts.

Results: a null or empty text gets the score of a text without hits; very long texts and words are read whole, in linear
time; repeated rows repeat their result; an empty table gives an empty table. Labels that are null, or whose document is
missing, are not used; without any toxic label every score is 0. Of several labels of a document the largest counts.
Columns of docs other than doc_id and text, whatever their names, are not read by toxicity_scores and carried along by
drop_toxic.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, any_names, held_out, labelled, map_texts, sampled_rows, slices, table

SAMPLE = 30_000
FEATURE_BITS = 20
#: No feature.
NONE = 1 << FEATURE_BITS
#: Letters that a sign may stand for, by script (fixed values).
IMITATES = {
    "latin": {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "*": "aeiou"},
    "cyrillic": {"0": "о", "1": "і", "3": "з", "4": "ч", "6": "б", "8": "в", "9": "д", "@": "а", "$": "с", "!": "і", "|": "іл", "+": "т", "*": "аеиоу"},
    "greek": {"0": "ο", "1": "ι", "3": "ε", "4": "α", "5": "σ", "7": "τ", "8": "β", "9": "ρ", "@": "α", "$": "σ", "!": "ι", "|": "ιλ", "+": "τ", "*": "αειου"},
}
#: Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = str.maketrans("аеіјкмнорсѕтухԁαειορυ", "aeijkmhopcstyxdaeiopu")
SIGNS = "01345789@$!|+*6"
SIGN_COST, DROP_COST, JOIN_COST, ODD_COST = math.log(0.2), math.log(0.3), math.log(0.7), math.log(0.02)
TWICE_COST = ODD_COST
#: Punctuation after a word's last letter mostly stands for itself.
CLOSING_COST = math.log(0.5)
#: Tokens up to this length are remembered, and about so many characters of them (with 50 more a token).
REMEMBERED, REMEMBERED_CHARS = 200, 16_000_000

WORD = re.compile(r"\w+")
#: What is restored at once: a run of letters, digits and signs.
TOKEN = re.compile(r"[\w@$!|+*]+")
LETTER, SIGN = r"[^\W\d_]", r"[013456789@$!|+*]"
#: Stretches of a token that hold letters and signs in any order, or a doubled letter; tried at starts of words only: linear.
DISGUISED = re.compile(rf"(?<!{LETTER})(?<!{SIGN})(?:{LETTER}++{SIGN}|{SIGN}++{LETTER})(?:{LETTER}|{SIGN})*+|(?<!{LETTER}){LETTER}*({LETTER})\1{LETTER}*")
ODD = re.compile(rf"{SIGN}{LETTER}|{LETTER}{SIGN}|({LETTER})\1")
APART = re.compile(r"(?<!\w)[^\W_](?:[ .\-_*][^\W_](?!\w)){2,}")
LATIN, OTHER = re.compile(r"[a-zß-öø-ÿ]"), re.compile(r"[\u0370-\u052f]")
#: Letters from here on share one symbol.
WIDE = 0x2E80


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 is a gap, WIDE any letter from there on, and other letters are themselves."""
    narrow = np.array([i if chr(i).isalpha() else 0 for i in range(WIDE)], np.int64)
    wide = np.array([WIDE if chr(i).isalpha() else 0 for i in range(WIDE, 0x110000)], np.int64)
    return np.concatenate([narrow, wide])


@lru_cache(maxsize=10_000)
def symbol(c: str) -> int:
    return min(ord(c), WIDE) if c.isalpha() else 0


@lru_cache(maxsize=10_000)
def itself(c: str) -> list[tuple[str, float]]:
    """The one choice of a letter that stands for itself."""
    return [(c, 0.0)]


BITS = 14
#: The letters of Latin-1 have small numbers too, by which most trigrams are counted without sorting; 0 is a gap, SMALL - 1 any other.
SMALL = 64


@lru_cache(maxsize=1)
def small_table() -> tuple[np.ndarray, np.ndarray]:
    """The small number of each symbol, and the symbol of each small number."""
    letters = [i for i in range(256) if chr(i).isalpha() and chr(i) == chr(i).lower()][: SMALL - 2]
    number = np.full(WIDE + 1, SMALL - 1, np.int64)
    number[0] = 0
    number[letters] = np.arange(1, len(letters) + 1)
    return number, np.array([0, *letters, *[0] * (SMALL - 1 - len(letters))], np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """key, n over all characters of all texts; each task sums its part first, so that only distinct trigrams are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rare = np.zeros(SMALL**3, np.int64), []
        number, back = small_table()
        for _, texts in slices(batches):
            raw = np.frombuffer(plain("  ".join(["", *texts, ""])).encode("utf-32-le", "replace"), "<u4")
            s = symbol_table()[raw]
            t = number[s]
            total += np.bincount((t[:-2] * SMALL + t[1:-1]) * SMALL + t[2:], minlength=SMALL**3)
            other = t == SMALL - 1
            if other.any():
                at = np.flatnonzero(other[:-2] | other[1:-1] | other[2:])
                rare.append(np.unique((s[at] << 2 * BITS) | (s[at + 1] << BITS) | s[at + 2], return_counts=True))
                if sum(len(k) for k, _ in rare) > 1_000_000:
                    rare = [added(rare)]
        at = np.flatnonzero(total)
        a, b, c = at // SMALL**2, at // SMALL % SMALL, at % SMALL
        whole = (a < SMALL - 1) & (b < SMALL - 1) & (c < SMALL - 1)  # the others are among the rare ones
        keys = (back[a] << 2 * BITS) | (back[b] << BITS) | back[c]
        rare_keys, rare_n = added(rare) if rare else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[whole], rare_keys])), pa.array(np.concatenate([total[at][whole], rare_n]))], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in counts]), len(keys)).astype(np.int64)


class CharModel:
    """log P(c | a, b) of symbols, smoothed by the bigram and unigram shares. Keys pack symbols in BITS bits each."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]
        self.known: dict[int, float] = {}

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "n": self.n}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["keys"], state["n"])

    def _counts(self) -> None:
        mask, n = (1 << BITS) - 1, self.n.tolist()

        def sums(keys: np.ndarray) -> dict[int, int]:
            k, total = added([(keys, self.n)])
            return dict(zip(k.tolist(), total.tolist(), strict=True))

        self.three = dict(zip(self.keys.tolist(), n, strict=True))
        self.first_two, self.last_two = sums(self.keys >> BITS), sums(self.keys & ((1 << 2 * BITS) - 1))
        self.middle, self.last = sums((self.keys >> BITS) & mask), sums(self.keys & mask)
        self.total = sum(n)

    def log(self, key: int) -> float:
        """log P of the last symbol of a packed triple after the other two."""
        got = self.known.get(key)
        if got is None:
            if not self.known:
                self._counts()
            elif len(self.known) > 500_000:
                self.known.clear()
            mask = (1 << BITS) - 1
            one = (self.last.get(key & mask, 0) + 1) / (self.total + len(self.last) + 1)
            two = (self.last_two.get(key & ((1 << 2 * BITS) - 1), 0) + 20 * one) / (self.middle.get(key >> BITS & mask, 0) + 20)
            got = self.known[key] = math.log((self.three.get(key, 0) + 10 * two) / (self.first_two.get(key >> BITS, 0) + 10))
        return got


def language_model(docs: DataFrame) -> CharModel:
    got = trigram_counts(docs).toPandas()
    return CharModel(got["key"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def plain(text: str) -> str:
    """Lower case; letters of compatibility forms (wide, mathematical, ligatures) as plain ones."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def script(span: str) -> str:
    """The script of a span's letters (Latin where there are several)."""
    if LATIN.search(span):
        return "latin"
    letter = OTHER.search(span)
    return "latin" if letter is None else "greek" if letter.group() < "\u0400" else "cyrillic"


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """The choices (output, log probability) of every input character."""
    out, last, imitates = [], len(span.rstrip("!|+*")), IMITATES[script(span)]
    for i, c in enumerate(span):
        prev = span[i - 1] if i else ""
        if c != prev and c.isalpha():
            out.append(itself(c))
            continue
        # most letters that stand twice are spelled so
        drop = DROP_COST if (i > 1 and span[i - 2] == c) or span[i + 1 : i + 2] == c else TWICE_COST
        if c.isalpha():
            choices = [(c, ODD_COST / 2 if i > 1 and span[i - 2] == c else 0.0), ("", drop)]
        elif c in imitates:
            closing = c in "!|+*" and i >= last
            choices = [(c, CLOSING_COST if closing else ODD_COST), *((x, SIGN_COST - math.log(len(imitates[c]))) for x in imitates[c])]
            if c == prev:
                choices.append(("", drop))
            if c == "*":
                choices.append(("", ODD_COST))
        elif c.isdigit():
            choices = [(c, 0.0)]
        else:
            choices = [(c, 0.0), ("", JOIN_COST)] if 0 < i < len(span) - 1 else [(c, 0.0)]
        out.append(choices)
    return out


def restore_span(span: str, model: CharModel) -> str:
    """Likeliest reading of one disguised stretch, by Viterbi over states of two output symbols.

    Readings are chains of cells that share their beginnings, so time and memory are linear in the stretch.
    """
    low, log, known = (1 << BITS) - 1, model.log, model.known
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by two packed symbols
    for choices in lattice(span):
        if len(choices) == 1 and len(best) == 1:  # most letters of a word: one state, one way on
            ((ab, (score, cell)),), ((c, cost),) = best.items(), choices
            key = ab << BITS | symbol(c)
            p = known.get(key)
            best = {key & (1 << 2 * BITS) - 1: (score + cost + (log(key) if p is None else p), (cell, c))}
            continue
        steps = [(c, symbol(c) if c else 0, cost) for c, cost in choices]
        after: dict[int, tuple[float, tuple | None]] = {}
        for ab, (score, cell) in best.items():
            row, state_low = ab << BITS, (ab & low) << BITS
            for c, s, cost in steps:
                if c:
                    p = known.get(row | s)
                    state, value = state_low | s, score + cost + (log(row | s) if p is None else p)
                else:
                    state, value = ab, score + cost
                if state not in after or value > after[state][0]:
                    after[state] = (value, (cell, c) if c else cell)
        best = after
    cell = max(((v + log(ab << BITS), cell) for ab, (v, cell) in best.items()), key=lambda x: x[0])[1]
    out = []
    while cell:
        cell, c = cell
        out.append(c)
    return "".join(reversed(out))


class Reader:
    """Words of texts with every disguise undone.

    What stands between white space is read once and remembered as its words, joined by spaces, in two generations: when
    the young one is full it becomes the old one, and what is met again moves back. Hot words stay, and memory is bounded.
    """

    def __init__(self, model: CharModel):
        self.model = model
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.chars = 0

    def restored(self, token: str) -> str:
        """A token of a text in plain form, with its disguised stretches restored."""
        if not token.isascii() and LATIN.search(token) and OTHER.search(token):
            token = token.translate(LOOKALIKES)
        return DISGUISED.sub(lambda m: restore_span(m.group(), self.model), token) if ODD.search(token) else token

    def spans(self, text: str) -> str:
        """The text in plain form, with letters that are set apart joined where that reads likelier."""
        return APART.sub(lambda m: restore_span(m.group(), self.model), plain(text))

    def read(self, chunk: str) -> str:
        """The words of a chunk, joined by spaces."""
        made = " ".join([w for token in TOKEN.findall(chunk) for w in WORD.findall(self.restored(token))])
        return chunk if made == chunk else made

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        chunks = list(set(self.spans(text).split()))
        found = list(map(self.young.get, chunks))
        if None in found:
            for i, chunk in enumerate(chunks):
                if found[i] is None:
                    found[i] = self.old.get(chunk)
                    if found[i] is None:
                        found[i] = self.read(chunk)
                    if len(chunk) <= REMEMBERED:
                        self.remember(chunk, found[i])
        words = set(" ".join(found).split(" "))
        words.discard("")
        return words

    def remember(self, chunk: str, words: str) -> None:
        self.chars += len(chunk) + 50
        if self.chars > REMEMBERED_CHARS // 2:
            self.young, self.old, self.chars = {}, self.young, len(chunk) + 50
        self.young[chunk] = words


def restore(text: str, model: CharModel) -> str:
    """The text in plain form with every disguised stretch restored."""
    reader = Reader(model)
    return TOKEN.sub(lambda m: reader.restored(m.group()), reader.spans(text))


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings of five and seven letters; NONE where it is shorter."""
    mask = (1 << FEATURE_BITS) - 1
    raw = word.encode("utf-8", "replace")
    if len(word) < 5:
        return [zlib.crc32(raw + b"$") & mask, NONE, NONE]
    five = zlib.crc32(word[:5].encode("utf-8", "replace")) & mask
    return [zlib.crc32(raw + b"$") & mask, five, zlib.crc32(word[:7].encode("utf-8", "replace")) & mask if len(word) >= 7 else NONE]


class Lexicon:
    """Counts of features in toxic and clean labelled texts, as arrays by feature; the last place stands for NONE."""

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int):
        self.toxic, self.clean, self.n_toxic, self.n_clean = toxic, clean, n_toxic, n_clean
        self.least = max(3, round(0.002 * n_toxic))
        self.strong = self.strength(toxic, clean) > 0

    def strength(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log odds of features; 0 for weak and rare ones."""
        odds = np.log((np.maximum(t, 0) + 0.5) / (self.n_toxic + 1)) - np.log((np.maximum(c, 0) + 0.5) / (self.n_clean + 1))
        return np.where((t >= self.least) & (odds > 1.5), odds, 0.0)

    def by_feature(self) -> dict[int, float]:
        at = np.flatnonzero(self.strong)
        return dict(zip(at.tolist(), self.strength(self.toxic[at], self.clean[at]).tolist(), strict=True))

    def hits(self, features: np.ndarray, toxic: bool) -> list[float]:
        """Strengths of the words of a labelled text, of three features each, as if the text had not been counted."""
        f = features.reshape(-1, 3)
        own = self.strength(self.toxic[f] - toxic, self.clean[f] - (not toxic)) * self.strong[f]
        best = own.max(1) if len(f) else np.zeros(0)
        return best[best > 0].tolist()


def summary(hits: list[float], n_words: int) -> list[float]:
    top = sorted(hits, reverse=True)[:4] + [0.0] * 4
    return [1.0, top[0], top[1], top[2] + top[3], math.log1p(n_words) / 10]


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Toxicity:
    """What scoring needs on every executor."""

    def __init__(self, model: CharModel, strengths: dict[int, float], curve: list[float] | None):
        self.model, self.strengths, self.curve = model, strengths, curve
        self.forget()

    def forget(self) -> None:
        """Starts with empty memories."""
        self.reader = Reader(self.model)
        # words met before, and the strengths of those that hit
        self.seen: set[str] = set()
        self.hot: dict[str, float] = {}
        self.chars = 0

    def __getstate__(self) -> tuple:
        return self.model, self.strengths, self.curve

    def __setstate__(self, state: tuple) -> None:
        self.model, self.strengths, self.curve = state
        self.forget()

    def hits(self, text: str) -> tuple[list[float], int]:
        """Strengths of the distinct words that hit, and the number of distinct words."""
        words = self.reader.words(text)
        if self.chars > REMEMBERED_CHARS:
            self.seen, self.hot, self.chars = set(), {}, 0
        new = words - self.seen
        for w in new:
            s = max([self.strengths.get(f, 0.0) for f in word_features(w)])
            if s:
                self.hot[w] = s
        self.chars += sum(map(len, new)) + 50 * len(new)
        self.seen |= new
        return [self.hot[w] for w in words & self.hot.keys()], len(words)

    def score(self, text: str) -> float:
        if self.curve is None:
            return 0.0
        z = sum(a * b for a, b in zip(self.curve, summary(*self.hits(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """Character model over all docs, lexicon and curve over at most `sample` labelled rows."""
    spark = docs.sparkSession
    model = language_model(docs)
    shared = spark.sparkContext.broadcast(model)
    shelf = Shelf(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for part, texts in slices(batches):
            made = [np.array([f for w in reader.words(t) for f in word_features(w)], np.int32) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.int32())), part.column(part.schema.get_field_index("label"))], names=["features", "label"])

    # sample rows, read once: the features of their restored words serve the lexicon and the curve
    sampled = sampled_rows(docs, labelled(labels, "toxic", sample), sample)
    rows = shelf.put(sampled.select("text", "label").mapInArrow(read, "features array<int>, label int"))

    def each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        flat, ends = batch.column(0).values.to_numpy(), batch.column(0).offsets.to_numpy()
        for a, b, label in zip(ends, ends[1:], batch.column(1).to_pylist(), strict=False):
            yield flat[a:b], label

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, texts = np.zeros((2, NONE + 1), np.int32), np.zeros(2, np.int32)
        for batch in batches:
            for features, label in each(batch):
                n[label, np.unique(features)] += 1
                texts[label] += 1
        n[:, NONE] = texts  # the place of no feature holds the number of texts
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1, at]), pa.array(n[0, at])], names=["feature", "t", "c"])

    counted = rows.mapInArrow(count, "feature bigint, t int, c int").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    got = counted.filter((F.col("t") >= 3) | (F.col("feature") == NONE)).toPandas()
    toxic, clean = np.zeros(NONE + 1), np.zeros(NONE + 1)
    at = got["feature"].to_numpy(np.int64)
    toxic[at], clean[at] = got["t"].to_numpy(), got["c"].to_numpy()
    n_toxic, n_clean = int(toxic[NONE]), int(clean[NONE])
    toxic[NONE] = clean[NONE] = 0
    if not n_toxic or not n_clean:
        return Toxicity(model, {}, None)
    lexicon = Lexicon(toxic, clean, n_toxic, n_clean)
    lex = spark.sparkContext.broadcast(lexicon)

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(summary(lex.value.hits(features, bool(label)), len(features) // 3), label) for features, label in each(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.list_(pa.float64())), pa.array([y for _, y in made], pa.int32())], names=["x", "y"])

    got = rows.mapInArrow(summarize, "x array<double>, y int").toPandas()
    order = sorted(range(len(got)), key=lambda i: (int(got["y"].iloc[i]), *got["x"].iloc[i]))  # sums do not depend on the order of tasks
    curve = fit_curve(np.stack(got["x"].to_numpy())[order], got["y"].to_numpy(float)[order])
    shelf.drop(rows)
    return Toxicity(model, lexicon.by_feature(), [float(w) for w in curve])


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def score(texts: list[str]) -> dict[str, pa.Array]:
        tox = shared.value
        return {"score": pa.array([tox.score(t) for t in texts], pa.float64())}

    scored = map_texts(docs, score, "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@any_names
def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tox = shared.value
        for part, texts in slices(batches):
            yield part.filter(pa.array([tox.score(t) < threshold for t in texts], pa.bool_()))
        tox.forget()  # the worker goes on to other stages

    return docs.mapInArrow(keep, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
