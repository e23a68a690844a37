"""Column functions over text: tokens, phrases, keys, times, request fields. All of them but `nfkc`, `stems` and
`vector_literal` stay in the JVM. A phrase is matched as a space-padded substring of space-joined tokens, which is exact since no token holds a
space."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English function words left out of keyword search: the stop words of the Snowball project (fixed values).
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: A quote of fewer tokens proves nothing.
MIN_QUOTE_TOKENS = 4
STRAIGHT = ("‘’", "''")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; the JVM has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: Characters that their compatibility form leaves alone: ASCII, letters with marks, dashes and quotation marks.
STABLE = r"^[\x00-\x7FÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-žƀ-ǃ\u0400-\u04FF–—‘’“”„«»…]*$"


def folded(text: Column) -> Column:
    """A text in compatibility form; those of stable characters alone, nearly all, send nothing to Python."""
    return F.coalesce(nfkc(F.when(~text.rlike(STABLE), text)), text)


def folded_words(words: Column) -> Column:
    """An array of words, each in compatibility form."""
    joined = F.array_join(words, "\n")
    return F.coalesce(F.split(nfkc(F.when(~joined.rlike(STABLE), joined)), "\n"), words)


def split_words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def quote_text(text: Column) -> Column:
    """A folded text as its comparable tokens with white space between: straight apostrophes, lower case, other signs as
    gaps, apostrophes stripped at the ends."""
    straight = F.replace(F.replace(text, F.lit(STRAIGHT[0][0]), F.lit("'")), F.lit(STRAIGHT[0][1]), F.lit("'"))
    plain = F.regexp_replace(F.lower(straight), r"[^\p{L}\p{N}_\s']+", " ")
    # apostrophes at the ends of words go in one pass over the text rather than one a word
    return F.regexp_replace(plain, r"(?<!\S)'+|'+(?!\S)", "")


def quote_tokens(text: Column) -> Column:
    """The comparable tokens of a folded text."""
    return F.filter(F.split(quote_text(text), r"\s+"), lambda w: w != "")


def phrase(tokens: Column) -> Column:
    """Tokens as one padded string."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def contains_phrase(hay: Column, needle: Column) -> Column:
    """True if the needle's tokens stand consecutively in hay's and are enough to prove something."""
    return F.coalesce((F.size(needle) >= MIN_QUOTE_TOKENS) & F.contains(phrase(hay), phrase(needle)), F.lit(False))


def phrase_index(hay: Column, needle: Column) -> Column:
    """Token index of the first match, NULL without one: the number of gaps before the place of the match."""
    at = F.instr(phrase(hay), phrase(needle))
    before = F.substring(phrase(hay), F.lit(1), at)
    gaps = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    return F.when((F.size(needle) >= MIN_QUOTE_TOKENS) & (at > 0), gaps - 1)


def signal_norm(word: Column) -> Column:
    """A word in lower case without signs, for comparing neighbours."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}_']", "")


def keyword_terms(text: Column) -> Column:
    """Search terms of a text in order: alphanumeric runs in lower case without function words, not stemmed."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(runs, lambda w: ~w.isin(STOPWORDS))


def dedup_key(feed_url: Column, guid: Column) -> Column:
    return F.sha2(F.concat(feed_url, F.lit("\n"), guid), 256)


def duration_seconds(raw: Column) -> Column:
    """Seconds of "3600", "62:03" or "1:02:03"; NULL if any part is no number, or the total is negative or too large."""
    parts = F.split(F.trim(raw), ":")
    number = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    fine = F.forall(parts, lambda p: p.rlike(number))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p.try_cast("double").try_cast("bigint"))
    return F.when(fine & (total >= 0), total.try_cast("int"))


def clock(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else m:ss; fractions are cut, negatives are 0:00."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60), s % 60
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m % 60, r)).otherwise(F.format_string("%d:%02d", m, r))


@F.arrow_udf(T.StringType())
def _literals(vectors: pa.Array) -> pa.Array:
    made = (None if v is None else ",".join(["%.6f" % x for x in v if x is not None]) for v in vectors.to_pylist())
    return pa.array([None if x is None else f"[{x}]" for x in made], pa.string())


def vector_literal(v: Column) -> Column:
    """[x, …] with six decimals a number, rounded from its exact value, ties to even; nulls in a vector are left out. The JVM
    formats a number's shortest decimal form and rounds ties up."""
    return _literals(v.cast("array<double>"))


def snippet(text: Column, length: int = 300) -> Column:
    return F.substring(text, 1, length)


def client_key(peer: Column, forwarded: Column, hops: Column, trusted: Column) -> Column:
    """Identity for rate limits: the entry `hops` from the right of a trusted forwarding header, else the peer."""
    entries = F.filter(F.transform(F.split(forwarded, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(trusted & (F.size(entries) > 0), F.get(entries, F.greatest(F.size(entries) - hops, F.lit(0)))).otherwise(peer)


def citation_parts(text: Column) -> Column:
    """array<struct<kind, value>>: texts between [n] markers, and the markers' numbers, in order; empty texts left out."""
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1)
    texts = F.split(text, r"\[\d+\]")
    pairs = F.arrays_zip(texts.alias("t"), marks.alias("m"))
    both = F.transform(
        pairs,
        lambda p: F.array(
            F.struct(F.lit("text").alias("kind"), F.coalesce(p["t"], F.lit("")).alias("value")), F.struct(F.lit("marker").alias("kind"), F.coalesce(p["m"], F.lit("")).alias("value"))
        ),
    )
    return F.filter(F.flatten(both), lambda x: x["value"] != "")


def valid_request(question: Column, k: Column) -> Column:
    return F.coalesce(F.length(question).between(3, 300) & F.coalesce(k, F.lit(5)).between(1, 10), F.lit(False))


def failure_class(status: Column, retry_after: Column, default_wait: float) -> Column:
    """struct<kind, wait> of a response status; NULL status is a network failure."""
    wait = F.greatest(F.lit(0.0), F.coalesce(F.when(retry_after.rlike(r"^\s*[+-]?[0-9.]+\s*$"), retry_after.try_cast("double")), F.lit(float(default_wait))))
    kind = F.when(status.isNull() | (status >= 500), "retryable").when(status == 429, "rate_limited").when(status >= 400, "permanent").otherwise("ok")
    return F.struct(kind.alias("kind"), F.when(status == 429, wait).alias("wait"))


# --- Porter's stemmer (1980), as a vectorised function -------------------------------------------------------------

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


#: Endings of the steps, the longest first, and whether an ASCII character is a vowel or not, y aside.
_ENDS2, _ENDS3, _ENDS4 = (tuple(sorted(t, key=len, reverse=True)) for t in (_STEP2, _STEP3, _STEP4))
_KINDS = {i: "v" if chr(i) in "aeiou" else "c" for i in range(128)}


def _shape(stem: str) -> str:
    """c and v for every letter of an ASCII word."""
    if "y" not in stem:
        return stem.translate(_KINDS)
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _cvc(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


@functools.lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of one lower-case English word; a worker keeps those of the words it saw last."""
    if len(word) < 3 or not word.isascii():
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                cut = word[: -len(end)]
                break
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "aeioulsz":
            cut = cut[:-1]
        elif _measure(cut) == 1 and _cvc(cut):
            cut += "e"
        word = cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table, ends in ((_STEP2, _ENDS2), (_STEP3, _ENDS3)):
        for end in ends if word.endswith(ends) else ():
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + table[end]
                break
    for end in _ENDS4 if word.endswith(_ENDS4) else ():
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _cvc(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Stems of arrays of words; each different word of a batch is stemmed once."""
    coded = words.flatten().dictionary_encode()
    made = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    upto = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy()))
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), made.take(coded.indices), mask=pc.is_null(words))
