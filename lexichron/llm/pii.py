"""Operator 10: surrogates for personal data.

Detected entities: e-mail addresses, access key ids, IP addresses, card-like numbers, phone numbers, US social security numbers,
IBANs, keys assigned to secret-like names, keys and tokens of known prefixes, and personal names: after a title, as a listed given and family name in a
pair, and wherever else in the text a name so found stands. Each is replaced by a keyed surrogate
of its own type and format: digits stay digits, letters stay letters of their alphabet and case, separators stay,
titled names keep their gender.

Surrogates come from keyed bijections: a string of m symbols over an alphabet of b is enciphered to another such
string, one step along a keyed cycle through all of them (an alternating Feistel network over Z(b**m), a step, and the
network's inverse), so that none is its own surrogate. One entity gets one surrogate everywhere (coreference), and two
entities never get the same (distinctness), with no table of entities and no shuffle. The collision check is a cycle
walk: while a surrogate is not a valid one of its type, it is enciphered again, which keeps the mapping one-to-one.

- Names: one mapping for given and family names, so that a name is the same wherever it stands. Listed ones are permuted
  within their list (of a gender, or of family names); others are enciphered letter by letter in their alphabet (Latin,
  Greek or Cyrillic) and walked until they are on no list, so that none meets a listed name's surrogate. The parts of a
  hyphenated name are names of their own.
- Phones: the national number is enciphered, so that a number with and without its country code stays one; country and
  separators stay. E-mails: the mapping is that of the address in lower case, and capitals stay where they are.
- Digits in one run are a card only if their check digit is right; in groups of a card's form they are one anyhow.
- Cards and IBANs with right check digits get a new body with right check digits, others stay invalid; social security
  numbers stay possible or impossible ones; IP addresses stay in their private range, or public.

The key comes from the caller (at least 16 bytes, kept secret): whoever has it can undo the mapping, nobody else can.

Results: null texts stay null and empty ones empty; very long texts and entities are replaced whole, in linear time;
repeated rows get equal results; an empty table gives an empty table; texts without entities are unchanged. Other
columns, whatever their names, are carried along by replace_pii and not read; pii_spans reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_names, bounded_batches, map_texts, slices, table

ROUNDS = 8
#: The key of the test query alone, so that its reruns agree.
QUERY_KEY = b"not a secret: op10 on public rows"
LEAST_KEY = 16
#: Longer strings are enciphered in blocks of this many symbols, in linear time.
BLOCK = 200
#: Given names by gender; a titled name from one list is replaced by another of the same list.
FEMALE = "Anna Maria Laura Julia Sarah Emma Olivia Sophie Claire Elena Carmen Lucia Ingrid Heidi Amélie Chloé Grace Hannah Alice Nora Marta Irene Ruth Eva Helen Diana Monica Paula Rosa Teresa".split()
MALE = "John James Peter Paul Thomas Martin Lukas Felix Hans Karl Pierre Louis Antoine Hugo Carlos Miguel Pablo Jorge David Daniel Robert George Henry Oscar Samuel Simon Victor Walter Adam Bruno".split()
FAMILY = "Smith Jones Brown Taylor Wilson Walker Wright Green Baker Carter Müller Schmidt Weber Wagner Becker Hoffmann Bernard Dubois Moreau Laurent Garcia Lopez Sanchez Romero Torres Navarro Molina Ortega Castro".split()
LISTED = frozenset((*FEMALE, *MALE, *FAMILY))
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа", "Κυρία")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "Κύριος")
PLAIN_TITLES = ("Dr", "Prof")

_TITLES = "|".join((*FEMALE_TITLES, *MALE_TITLES, *PLAIN_TITLES))
#: Words that stand between a given and a family name.
_PARTICLES = "van|von|de|der|den|di|da|del|dos|la|le|bin|al|ter|zu"
#: One alternative a type; the first that matches at a place wins.
_MAIL, _LABEL = r"A-Za-z0-9À-ÖØ-öø-ÿͰ-ϿЀ-ӿ_%+\-'!#$&*^`{|}~", "[A-Za-z0-9À-ÖØ-öø-ÿͰ-ϿЀ-ӿ]"
_CAPITAL, _SMALL = "[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω]", "[a-zß-öø-ÿа-яёά-ώ]"
#: A name in capitals and small letters, as Neill, O'Neill or McNeill, or in capitals alone.
_WORD = rf"(?:(?:{_CAPITAL}['’]|Mc|Mac)?{_CAPITAL}{_SMALL}++|{_CAPITAL}(?:['’]?{_CAPITAL})++)"
ENTITY = re.compile(
    # an address is looked for only where a run of its letters starts: linear in the text
    rf"""(?<![{_MAIL}.])\.*+(?P<email>[{_MAIL}][{_MAIL}.]*+@(?:{_LABEL}(?:(?:{_LABEL}|-){{0,61}}{_LABEL})?\.)+(?:[A-Za-z]{{2,24}}|[а-яё]{{2,10}})(?![A-Za-zа-яё]))"""
    r"""
    |(?P<secret>(?<![A-Za-z])(?i:(?:[a-z]{1,20}[_-])?(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?[ ]{0,2}[:=][ ]{0,2}["']?)(?P<value>(?!(?i:bearer|basic)\s)(?:[^\s"'<>,;]{12,}+|(?=[^\s"'<>,;\d]{0,11}\d)[^\s"'<>,;]{6,11}+)))
    |(?P<key>(?<![A-Za-z0-9])(?:(?P<mark>eyJ|(?:sk|pk|rk)[_\-](?:(?:live|test|proj)[_\-])?|gh[pousr]_|xox[abprs]-|(?i:bearer)\s)(?P<body>(?=[A-Za-z_.\-]{0,60}\d)[A-Za-z0-9_.\-]{16,}+)))
    |(?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,30}\d)(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:]))
    |(?P<access>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))
    |(?P<iban>(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?:[ ]?[a-z0-9]{4}){3,7}(?:[ ]?[a-z0-9]{1,3})?)(?![A-Za-z0-9]))
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))
    |(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))
    |(?P<card>(?<![\d\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\d\-]))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|(?<=[ .\-])\d{2,4}[ .\-]|\d{3}[.\-])\d{3,4}[ .\-]\d{3,4}(?![\d\-])|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?![\d\-]))
    """
    rf"""|(?P<name>(?<!\w)(?P<title>{_TITLES}|{_TITLES.upper()})\.?\s{{1,3}}(?P<given>{_WORD})(?:\s{{1,3}}(?:(?:{_PARTICLES})\s{{1,3}}){{0,3}}(?P<family>{_WORD}(?:-{_WORD})*+))?(?!\w))""",
    re.X,
)
KINDS = ("email", "access", "iban", "ip", "ip6", "ssn", "card", "phone", "secret", "key")
#: A text without any of these holds no entity.
HINT = re.compile(rf"[\d@]|token|secret|passw|key|a[ks]ia|(?<!\w)(?:{_TITLES})\.?\s", re.I)

#: Listed names in a pair, with or without a title; what stands before is looked at afterwards, so that the search can skip.
PAIR = re.compile(rf"(?P<given>{'|'.join(sorted({*FEMALE, *MALE}))})[ ](?P<family>{'|'.join(sorted(FAMILY))})(?!\w)")
#: Words that may mention a name found elsewhere in the text; hyphenated ones first as a whole.
MENTION = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
LATIN_LOWER = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
CYRILLIC, GREEK = "".join(map(chr, range(0x430, 0x450))), "".join(c for c in map(chr, range(0x3B1, 0x3CA)) if c != "ς")
ALPHABETS = (DIGITS, LOWER, UPPER, LATIN_LOWER, LATIN_LOWER.upper(), CYRILLIC, CYRILLIC.upper(), GREEK, GREEK.upper())
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}


class Cipher:
    """Keyed bijections of numbers below a bound."""

    def __init__(self, key: bytes):
        self.key = key

    def noise(self, tweak: bytes, r: int, x: int, bound: int) -> int:
        raw = hmac.digest(self.key, b"%b|%d|%d|%d" % (tweak, r, x, bound), "sha256")
        if bound.bit_length() > 120:
            raw = hashlib.shake_256(raw).digest(bound.bit_length() // 8 + 16)
        return int.from_bytes(raw, "little") % bound

    def number(self, x: int, bound: int, tweak: bytes) -> int:
        """A permutation of 0..bound-1 without fixed points: one step along a keyed cycle through all of them."""
        if bound < 2:
            return x
        a = b = max(2, _root(bound))
        while a * b < bound:
            b += 1
        x = (self._mix(x, a, b, bound, tweak, forward=True) + 1) % bound
        return self._mix(x, a, b, bound, tweak, forward=False)

    def _mix(self, x: int, a: int, b: int, bound: int, tweak: bytes, forward: bool) -> int:
        """Feistel steps over two near-square factors, or their inverse, walked back into the range."""
        sign = 1 if forward else -1
        while True:
            left, right = divmod(x, b)
            for r in range(ROUNDS) if forward else reversed(range(ROUNDS)):
                if r % 2:
                    right = (right + sign * self.noise(tweak, r, left, b)) % b
                else:
                    left = (left + sign * self.noise(tweak, r, right, a)) % a
            x = left * b + right
            if x < bound:
                return x

    def string(self, text: str, alphabet: str, tweak: bytes) -> str:
        """Another string of the same length over alphabet. Long ones go block by block, each keyed by all before it."""
        if len(text) > BLOCK:
            out, before = [], hashlib.sha256(tweak)
            for at in range(0, len(text), BLOCK):
                part = text[at : at + BLOCK]
                out.append(self.string(part, alphabet, b"%b|%d|%b" % (tweak, at, before.digest())))
                before.update(part.encode())
            return "".join(out)
        base, x = len(alphabet), 0
        for c in text:
            x = x * base + alphabet.index(c)
        x = self.number(x, base ** len(text), b"%b|%d|%d" % (tweak, base, len(text)))
        out = []
        for _ in text:
            x, i = divmod(x, base)
            out.append(alphabet[i])
        return "".join(reversed(out))

    def shaped(self, text: str, tweak: bytes) -> str:
        """Enciphers the characters of each alphabet as one string; all other characters, and the pattern, stay."""
        groups: dict[str, list[int]] = {}
        for i, c in enumerate(text):
            if c in ALPHABET_OF:
                groups.setdefault(ALPHABET_OF[c], []).append(i)
        out = list(text)
        for alphabet, at in groups.items():
            for i, c in zip(at, self.string("".join(text[i] for i in at), alphabet, tweak), strict=True):
                out[i] = c
        return "".join(out)

    def listed(self, name: str, names: list[str], tweak: bytes) -> str | None:
        if name not in names:
            return None
        return names[self.number(names.index(name), len(names), tweak)]


def _root(n: int) -> int:
    from math import isqrt

    return isqrt(n)


def walk(entity: str, step: Callable[[str], str], valid: Callable[[str], bool]) -> str:
    """Applies the bijection step until the outcome is valid; the entity itself is the last resort of a closed cycle."""
    now = step(entity)
    for _ in range(10_000):
        if now == entity or valid(now):
            break
        now = step(now)
    return now


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _with_digits(text: str, digits: str) -> str:
    """text with its digits replaced by those given, in order."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in text)


def check_digits(country: str, body: str) -> str:
    """The two check digits of an IBAN (ISO 7064, 97-10)."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in f'{body}{country}00')) % 97:02d}"


def country_digits(digits: str) -> int:
    """How many digits the country code takes at the start of an international number (zones of the numbering plan)."""
    if digits[0] in "17":
        return 1
    two = {"2": "07", "3": "0123469", "4": "013456789", "5": "12345678", "6": "0123456", "8": "1246", "9": "0123458"}
    return 2 if digits[1:2] and digits[1] in two.get(digits[0], "") else 3


def possible_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


#: Reserved ranges of addresses, (first, number): each is enciphered within itself.
RANGES = [(10 << 24, 1 << 24), ((172 << 24) + (16 << 16), 1 << 20), ((192 << 24) + (168 << 16), 1 << 16), (127 << 24, 1 << 24)]


def address_class(number: int) -> int:
    """Which of RANGES an address is in; -1 for other usual ones and -2 for the rest."""
    for i, (first, n) in enumerate(RANGES):
        if first <= number < first + n:
            return i
    return -1 if 0 < number >> 24 < 224 else -2


def sure(kind: str, text: str) -> bool:
    """Digits in one run are a card, and small letters an IBAN, only with the right check digits."""
    if kind == "card" and text.isdigit():
        return luhn(text)
    if kind == "iban" and text.islower():
        plain = text.replace(" ", "").upper()
        return plain[2:4] == check_digits(plain[:2], plain[4:])
    return True


class Replacer:
    """Finds and replaces entities; remembers surrogates within a worker only to save time."""

    def __init__(self, key: bytes):
        if not isinstance(key, bytes) or len(key) < LEAST_KEY:
            raise ValueError(f"a secret key of at least {LEAST_KEY} bytes is required")
        self.cipher = Cipher(key)
        self.cached = lru_cache(50_000)(self._surrogate)
        self.name = lru_cache(50_000)(self._name)

    def surrogate(self, kind: str, text: str) -> str:
        """The surrogate of an entity. The outcome depends on key, kind and text alone; long ones are not remembered."""
        return self.cached(kind, text) if len(text) <= BLOCK else self._surrogate(kind, text)

    def _surrogate(self, kind: str, text: str) -> str:
        c, tweak = self.cipher, kind.encode()
        if kind == "email":
            local, _, domain = text.lower().rpartition("@")
            host, _, top = domain.rpartition(".")
            made = f"{walk(local, lambda x: c.shaped(x, b'local'), lambda x: x != local)}@{c.shaped(host, b'host')}.{top}"
            return "".join(new.upper() if old.isupper() else new for old, new in zip(text, made, strict=True))
        if kind == "secret":
            if set(text) <= set(HEX):
                return c.string(text, HEX, tweak)
            return walk(text, lambda x: c.shaped(x, tweak), lambda x: not set(x) <= set(HEX))
        if kind == "access":
            return text[:4] + c.string(text[4:], UPPER + DIGITS, tweak)
        if kind == "key":
            return walk(text, lambda x: c.shaped(x, tweak), lambda x: x != text)
        if kind == "ip6":  # the kind of address, its first digit, stays
            at = [i for i, x in enumerate(text) if x != ":"]
            plain, out = "".join(text[i] for i in at).lower(), list(text)
            made = walk(plain, lambda x: c.string(x, HEX, tweak), lambda x: x[0] == plain[0])
            for i, x in zip(at, made, strict=True):
                out[i] = x.upper() if text.isupper() else x
            return "".join(out)
        if kind == "ip":
            number = sum(int(x) << 8 * (3 - i) for i, x in enumerate(text.split(".")))
            group = address_class(number)
            first, size = RANGES[group] if group >= 0 else (0, 1 << 32)
            now = first + c.number(number - first, size, tweak)
            while now != number and address_class(now) != group:
                now = c.number(now, size, tweak)
            return ".".join(str(now >> s & 255) for s in (24, 16, 8, 0))
        if kind == "card":
            digits = _only_digits(text)
            zero = digits[0] == "0"
            if luhn(digits):  # a new body, with the check digit that makes it right
                body = walk(digits[:-1], lambda x: c.string(x, DIGITS, b"card body"), lambda x: (x[0] == "0") == zero)
                return _with_digits(text, body + next(d for d in DIGITS if luhn(body + d)))
            return _with_digits(text, walk(digits, lambda x: c.string(x, DIGITS, tweak), lambda x: not luhn(x) and (x[0] == "0") == zero))
        if kind == "phone":
            digits = _only_digits(text)
            # the country stays, and so does the zero that stands before the area
            keep = min(country_digits(digits), len(digits) - 1) if text[0] == "+" else int(digits[0] == "0")
            keep += text[0] == "+" and digits[keep] == "0" and keep + 1 < len(digits)
            number = digits[keep:]
            made = walk(number, lambda x: c.string(x, DIGITS, tweak), lambda x: (x[0] == "0") == (number[0] == "0"))
            return _with_digits(text, digits[:keep] + made)
        if kind == "iban":
            if text.islower():
                return self._surrogate(kind, text.upper()).lower()
            plain = text.replace(" ", "")
            country, body = plain[:2], plain[4:]
            if plain[2:4] == check_digits(country, body):
                made = c.shaped(body, b"iban body " + country.encode())
                made = iter(country + check_digits(country, made) + made)
            else:
                wrong = lambda x: x[:2] != check_digits(country, x[2:])
                made = iter(country + walk(plain[2:], lambda x: c.shaped(x, tweak + country.encode()), wrong))
            return "".join(" " if x == " " else next(made) for x in text)
        digits = _only_digits(text)  # a social security number
        right = possible_ssn(digits)
        return _with_digits(text, walk(digits, lambda x: c.string(x, DIGITS, tweak), lambda x: possible_ssn(x) == right))

    def _name(self, name: str) -> str:
        """The surrogate of a given or family name."""
        if "-" in name:
            return "-".join(self.name(x) for x in name.split("-"))
        if len(name) > 1 and name.isupper():  # the same name as in small letters
            return self.name(name[0] + name[1:].lower()).upper()
        c = self.cipher
        for tweak, names in ((b"female", FEMALE), (b"male", MALE), (b"family", FAMILY)):
            if name in names:
                return c.listed(name, names, tweak)
        return walk(name, lambda x: c.shaped(x, b"name"), lambda x: x not in LISTED)

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with surrogates, and its entities as (kind, start, end, surrogate) in order of place."""
        found, named = [], []
        for m in ENTITY.finditer(text) if HINT.search(text) else ():
            kind = next((k for k in KINDS if m.group(k) is not None), "name")
            if kind == "name":
                named.append(m)
            elif sure(kind, m.group()):
                group = {"secret": "value", "key": "body"}.get(kind, kind)
                found.append((kind, m.start(group), m.end(group), self.surrogate(kind, m.group(group))))
        pairs = [m for m in PAIR.finditer(text) if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"))]
        if named or pairs:
            found = self._with_names(text, found, named, pairs)
        out, last = [], 0
        for _, a, b, new in found:
            out += [text[last:a], new]
            last = b
        return ("".join([*out, text[last:]]), found) if found else (text, [])

    def _with_names(self, text: str, found: list, named: list[re.Match], pairs: list[re.Match]) -> list:
        """found, with the names after titles, listed pairs, and every other mention of those names in the text."""
        placed, taken, known = list(found), set(), {}
        for m in (*named, *pairs):
            for group in ("given", "family"):
                if m.group(group) is not None and m.start(group) not in taken:
                    for part in (m.group(group), *m.group(group).split("-")):
                        known[part] = self.name(part)
                    placed.append(("name", m.start(group), m.end(group), known[m.group(group)]))
                    taken.add(m.start(group))
        placed.sort(key=lambda x: (x[1], x[0] == "name"))
        out, last = [], 0
        for kind, a, b, new in [*placed, ("", len(text), len(text), "")]:
            if a < last:  # a listed pair inside another entity
                continue
            out += [("name", x, y, known[text[x:y]]) for x, y in _mentions(text, last, a, known)]
            if kind:
                out.append((kind, a, b, new))
            last = b
        return out


def _mentions(text: str, start: int, end: int, known: dict[str, str]) -> Iterator[tuple[int, int]]:
    """Places from start to end where a known name stands as a word or a part of a hyphenated one."""
    for m in MENTION.finditer(text, start, end):
        a, b = m.span()
        if a and a == start and (text[a - 1].isalnum() or text[a - 1] == "_") or text[b : b + 1].isalnum():
            continue
        if m.group() in known:
            yield a, b
        elif "-" in m.group():
            for part in m.group().split("-"):
                if part in known:
                    yield a, a + len(part)
                a += len(part) + 1


@lru_cache(maxsize=4)
def replacer(key: bytes) -> Replacer:
    return Replacer(key)


def pii_spans(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (with surrogates; null stays null), n_entities, entities (kind, start, end, surrogate) of every row."""
    Replacer(key)

    def score(texts: list[str]) -> dict[str, pa.Array]:
        made = [replacer(key).replace(t) for t in texts]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
        spans = [[dict(zip(("kind", "start", "end", "surrogate"), s, strict=True)) for s in found] for _, found in made]
        return {"clean": pa.array([t for t, _ in made], pa.string()), "n_entities": pa.array([len(f) for _, f in made], pa.int64()), "entities": pa.array(spans, kind)}

    rows = docs.select("doc_id", "text", F.col("text").isNull().alias("gone"))
    made = map_texts(rows, score, "clean string, n_entities bigint, entities array<struct<kind:string,start:int,end:int,surrogate:string>>", keep=("doc_id", "gone"))
    return made.select("doc_id", F.when(~F.col("gone"), F.col("clean")).alias("text"), "n_entities", "entities")


@any_names
def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates in text; all other columns stay."""
    Replacer(key)  # a missing key fails here, before any job runs
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            nulls = part.column(at).is_null().to_pylist()
            new = pa.array([None if gone else replacer(key).replace(t)[0] for t, gone in zip(texts, nulls, strict=True)], part.schema.field(at).type)
            columns = [new if i == at else part.column(i) for i in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the whole text with surrogates, the number of entities and their kinds in order of place."""
    made = pii_spans(table(spark, sf_dir, "documents"), QUERY_KEY)
    return made.selectExpr("doc_id", "text", "n_entities", "array_join(transform(entities, e -> e.kind), ',') AS kinds")
