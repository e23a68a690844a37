"""English as it is said and as it is written, brought to one form before word error rates.

A text becomes tokens, contractions and titles are written out, and a small machine with the state of one number reads the
tokens once: number words, digits, scales, decimals, ordinals, currencies and percentages become one token each. Counting words
in a row become one number, as digits read out do, so denominators of error rates count them as one word.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English number words, scales, titles, contractions, fillers and signs.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1_000, "million": 10**6, "billion": 10**9, "trillion": 10**12}
ORDINALS = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}
TITLES = {"mr": "mister", "mrs": "missus", "dr": "doctor", "prof": "professor", "capt": "captain", "gov": "governor", "gen": "general", "sen": "senator", "rep": "representative", "st": "saint", "jr": "junior", "sr": "senior", "rev": "reverend", "hon": "honorable"}
WHOLE = {"won't": "will not", "can't": "can not", "let's": "let us", "ain't": "aint", "y'all": "you all", "gonna": "going to", "gotta": "got to", "wanna": "want to", "ma'am": "madam"}
ENDINGS = {"n't": "not", "'re": "are", "'s": "is", "'d": "would", "'ll": "will", "'ve": "have", "'m": "am"}
FILLERS = {"hmm", "mm", "mhm", "mmm", "uh", "um"}
UNITS = {"dollar": "$", "dollars": "$", "pound": "£", "pounds": "£", "euro": "€", "euros": "€", "cent": "¢", "cents": "¢"}
REPEATS = {"double": 2, "triple": 3}

VALUES = {w: i for i, w in enumerate(SMALL)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
ORDINAL_VALUES = ORDINALS | {(w[:-1] + "ie" if w.endswith("y") else w) + "th": v for w, v in VALUES.items() if v not in ORDINALS.values() and v}
TOKEN = re.compile(r"[$£€¢]?\d[\d,]*(?:\.\d+)?(?:st|nd|rd|th|s)?%?|[^\W\d_]+(?:'[^\W\d_]+)*|%")
WRITTEN = re.compile(r"([$£€¢]?)(\d[\d,]*)(\.\d+)?(st|nd|rd|th|s)?(%?)$")


def plain_tokens(text: str) -> list[str]:
    """Tokens in lower case: no remarks in brackets, no fillers, no accents, contractions and titles written out."""
    text = re.sub(r"[<\[][^>\]]*[>\]]|\([^)]*\)", " ", text.lower().replace("’", "'"))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    out: list[str] = []
    for t in TOKEN.findall(text):
        if t in FILLERS:
            continue
        end = next((e for e in ENDINGS if t.endswith(e) and len(t) > len(e)), None)
        if t in WHOLE:
            out += WHOLE[t].split()
        elif end:
            out += [t[: -len(end)], ENDINGS[end]]
        else:
            out.append(TITLES.get(t, t.replace("'", "")))
    return out


def _suffix(n: int) -> str:
    return "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


class Number:
    """The number read so far: digits that stand before it, the sum of its closed groups, and its open group."""

    def __init__(self) -> None:
        self.before, self.sum, self.group, self.decimals, self.least = "", 0, None, None, None

    def value(self) -> str:
        whole = "" if self.group is None and not self.sum else str(self.sum + (self.group or 0))
        return self.before + whole + ("." + self.decimals if self.decimals else "")

    def add(self, v: int) -> None:
        """A number word below 100: added where it fits under what was said, else put behind it as digits."""
        if self.decimals is not None:
            self.decimals += str(v)
            return
        fits = self.least is not None and v < self.least and v > 0
        if self.group is None and not self.sum:
            self.group = v
        elif fits:
            self.group = (self.group or 0) + v
        else:
            self.before, self.sum, self.group = self.value(), 0, v
        self.least = 10 if v >= 20 and v % 10 == 0 else None

    def scale(self, s: int) -> bool:
        """A scale multiplies the open group, and larger ones close all that was said."""
        if self.decimals is not None or (self.group is None and not self.sum):
            return False
        if s == 100:
            self.group = (self.group or 1) * 100
        else:
            self.sum, self.group = (self.sum + (self.group or 0)) * s if self.sum < s else self.sum + (self.group or 1) * s, None
        self.least = s
        return True


def spoken_form(text: str) -> list[str]:
    """The tokens of a text in the common form."""
    tokens, out, i = plain_tokens(text), [], 0
    number: Number | None = None

    def close(mark: str = "", end: str = "") -> None:
        nonlocal number
        if number is not None:
            out.append(mark + number.value() + end)
            number = None

    while i < len(tokens):
        t, after = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else ""
        written = WRITTEN.match(t)
        if t in VALUES:
            number = number or Number()
            number.add(VALUES[t])
        elif t in REPEATS and VALUES.get(after, 99) < 10:
            number = number or Number()
            for _ in range(REPEATS[t]):
                number.add(VALUES[after])
            i += 1
        elif t in SCALES and number is not None and number.scale(SCALES[t]):
            pass
        elif t == "point" and number is not None and number.decimals is None and VALUES.get(after, 99) < 10:
            number.decimals = ""
        elif t == "and" and number is not None and number.least in SCALES.values() and after in VALUES:
            pass
        elif t in ORDINAL_VALUES and number is not None and (t != "second" or number.least):
            number.add(ORDINAL_VALUES[t])
            close(end=_suffix(int(number.value())))
        elif t in ORDINAL_VALUES and t != "second":
            close()
            out.append(f"{ORDINAL_VALUES[t]}{_suffix(ORDINAL_VALUES[t])}")
        elif t in UNITS and number is not None:
            close(mark=UNITS[t])
        elif t in ("percent", "%") and number is not None:
            close(end="%")
        elif written:
            close()
            mark, whole, decimals, end, percent = written.groups("")
            whole = whole.replace(",", "")
            if mark or end or percent or decimals and after not in SCALES:
                number = None
                unit = UNITS.get(after) if not (mark or end or percent) else None
                out.append(f"{unit or mark}{whole}{decimals}{end}{percent}")
                i += unit is not None
            elif decimals:  # 2.5 million
                shift = len(decimals) - 1
                out.append(str(int(whole + decimals[1:]) * SCALES[after] // 10**shift))
                i += 1
            else:
                number = Number()
                number.before, number.group, number.least = "0" * (len(whole) - len(whole.lstrip("0")) - (not whole.strip("0"))), int(whole), None
        else:
            close()
            if t != "%":
                out.append(t)
        i += 1
    close()
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def spoken_words(text: pd.Series) -> pd.Series:
    """spoken_form of a column of texts; the normaliser of word error rates."""
    return text.map(lambda x: None if x is None else spoken_form(x))
