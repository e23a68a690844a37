"""Operator 8: BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf of the tree holds ``rank * leaves + position`` of the pair that starts at that symbol, so the root is
the leftmost pair of lowest rank. A merge changes three leaves (the pair itself, its left neighbour and the
absorbed right symbol), each a logarithmic point update. Short pre-tokens of a slice of texts are encoded
together, one tree a row of a matrix; long ones use one tree each, so a pre-token of n bytes costs O(n log n).

Where the standard library knows a character, texts are normalised and lower-cased by it, else by the tokenizer library.

Results: a null or empty text has no tokens; rows are independent, so repeated rows repeat their result and an
empty table gives an empty table. Texts are never cut, however long. Columns other than doc_id and text, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: Unicode white space, which separates pre-tokens.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^{space}{l}{n}]+"
#: For texts within Latin-1.
PRE_TOKEN = regex.compile(PIECES.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}", space=SPACE))
SPECIAL = regex.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: Pre-tokens of more bytes than this get a tree of their own.
LONG = 64
#: Characters of pre-tokens remembered by a Python worker, each with ENTRY more for its entry; beyond them it starts afresh.
REMEMBERED, ENTRY = 12_000_000, 60
NEVER = np.int64(2**62)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _class_of(codes: list[int]) -> str:
    """The inside of a character class that holds the given code points."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=1)
def wide_pre_token() -> tuple[regex.Pattern, regex.Pattern]:
    """For texts beyond Latin-1: the pre-tokens, and the characters that the standard library does not know.

    Letters and numbers of Unicode versions after that of the tokenizer library's engine count as signs. Which they are is
    asked of that engine, for the code points that the standard library does not know yet.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    known = regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in range(0x100, 0x110000) if unicodedata.category(chr(c)) == "Cn"]
    unsure = [c for c in new if known.match(chr(c))]
    theirs = Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(" ".join(map(chr, unsure)))
    late = _class_of(sorted(set(unsure) - {ord(x) for x, _ in theirs}))
    letter, number = (rf"[\p{{{x}}}--[{late}]]" if late else rf"\p{{{x}}}" for x in "LN")
    return regex.compile("(?V1)" + PIECES.format(L=letter, N=number, l=letter, n=number, space=SPACE)), regex.compile(f"[{_class_of(new)}]")


@lru_cache(maxsize=1)
def their_normal_form() -> Callable[[str], str]:
    """The tokenizer library's own normal form and lower-casing, for texts with characters newer than the standard library."""
    from tokenizers.normalizers import NFC, Lowercase, Sequence

    return Sequence([NFC(), Lowercase()]).normalize_str


def cut(text: str) -> list[str]:
    """Pre-tokens of a text without special tokens."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        pieces, new = wide_pre_token()
        if new.search(text):
            return pieces.findall(their_normal_form()(text))
        return pieces.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
    return PRE_TOKEN.findall(text.lower())  # Latin-1 is in normal form


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, fresh = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], fresh = chr(fresh), fresh + 1
    return out


class Encoder:
    """Encodes texts to ids; keeps what it learnt about pre-tokens between calls."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        self.end = model["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * self.base
        for name, i in (*vocab.items(), *self.special.items()):
            self.names[i] = name
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + self.end] for x in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self._hash(keys)
        self.rank_of = dict(zip(keys.tolist(), range(len(merges)), strict=True))
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        for text, i in self.special.items():
            self.ids[text], self.shown[text] = int(i).to_bytes(4, "little"), text
        self.chars = 0

    def _hash(self, keys: np.ndarray) -> None:
        """Open-addressing table from pair key to rank; probes are counted so that lookups know when to stop."""
        bits = 18
        self.mask, self.shift = (1 << bits) - 1, 64 - bits
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at, rank, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(at):
            self.probes += 1
            free = self.slot_key[at] == -1
            first = np.unique(at[free], return_index=True)[1]
            take = np.flatnonzero(free)[first]
            self.slot_key[at[take]], self.slot_rank[at[take]] = keys[rank[take]], rank[take]
            left = np.ones(len(at), bool)
            left[take] = False
            at, rank = (at[left] + 1) & self.mask, rank[left]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray, size: int, pos: np.ndarray) -> np.ndarray:
        """rank * size + pos of each pair; NEVER where the pair does not merge (a symbol -1 never does)."""
        key = a * self.base + b
        key[(a < 0) | (b < 0)] = -2
        at = self._slot(key)
        out = np.full(len(key), NEVER)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            found = self.slot_key[at]
            hit = found == key[todo]
            rows = todo[hit]
            out[rows] = self.slot_rank[at[hit]] * size + pos[rows]
            go = ~hit & (found != -1)
            if not go.any():
                break
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out

    def _together(self, words: list[bytes], size: int) -> list[np.ndarray]:
        """Ids of words of at most size + 1 symbols each: row r of every matrix belongs to words[r]."""
        n, wide = len(words), size + 1
        lens = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        row, col = np.repeat(np.arange(n), lens), np.arange(len(raw)) - np.repeat(np.cumsum(lens) - lens, lens)
        sym = np.full((n, wide + 1), -1, np.int64)  # the last column stays -1: "no symbol"
        sym[row, col] = self.inner[raw]
        ends = np.cumsum(lens) - 1
        sym[np.arange(n), lens - 1] = self.last[raw[ends]]
        tree = np.full((n, 2 * size), NEVER)
        pos = np.tile(np.arange(size), n)
        tree[:, size:] = self._rank(sym[:, :size].ravel(), sym[:, 1 : size + 1].ravel(), size, pos).reshape(n, size)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        nxt = np.tile(np.arange(1, wide + 2), (n, 1))
        nxt[:, -1] = wide
        nxt[np.arange(n), lens - 1] = wide
        prv = np.tile(np.arange(-1, wide), (n, 1))
        prv[:, 0] = wide
        s, t, x, p = sym.ravel(), tree.ravel(), nxt.ravel(), prv.ravel()
        act = np.arange(n)
        while len(act := act[t[act * 2 * size + 1] < NEVER]):
            rank, at = np.divmod(t[act * 2 * size + 1], size)
            o = act * (wide + 1)
            right = x[o + at]
            after, before = x[o + right], p[o + at]
            new = self.made[rank]
            s[o + at], s[o + right] = new, -1
            x[o + at] = after
            p[o + after] = at
            leaf = act * 2 * size
            none = np.full(len(act), NEVER)
            inside = right < size
            for where, value in (
                (np.where(inside, right, at), none),
                (at, self._rank(new, s[o + after], size, at)),
                (np.where(before < size, before, at), self._rank(s[o + before], new, size, before)),
            ):
                if where is not at and value is not none:  # no left neighbour: nothing to write there
                    value = np.where(before < size, value, t[leaf + size + at])
                node = where + size
                t[leaf + node] = value
                while node[0] > 1:
                    node = node >> 1
                    t[leaf + node] = np.minimum(t[leaf + 2 * node], t[leaf + 2 * node + 1])
        alive = sym >= 0
        return np.split(sym[alive], np.cumsum(alive.sum(1))[:-1])

    def _alone(self, word: bytes) -> np.ndarray:
        """Ids of one long pre-token, with one tree in plain lists."""
        sym = self.inner[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        n, size, rank_of, base = len(sym), 1, self.rank_of, self.base
        while size < n:
            size *= 2
        never = int(NEVER)
        tree = [never] * (2 * size)

        def value(i: int, j: int) -> int:
            r = rank_of.get(sym[i] * base + sym[j]) if i >= 0 and j < n else None
            return never if r is None else r * size + i

        for i in range(n - 1):
            tree[size + i] = value(i, i + 1)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, v: int) -> None:
            i += size
            tree[i] = v
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        nxt, prv, made = list(range(1, n + 1)), list(range(-1, n - 1)), self.made
        while tree[1] < never:
            rank, at = divmod(tree[1], size)
            right = nxt[at]
            after, before = nxt[right], prv[at]
            sym[at], sym[right], nxt[at] = int(made[rank]), -1, after
            if after < n:
                prv[after] = at
            put(right, never)
            put(at, value(at, after))
            if before >= 0:
                put(before, value(before, at))
        return np.array([x for x in sym if x >= 0], np.int64)

    def learn(self, words: set[str]) -> None:
        """Encode pre-tokens not seen so far."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            n = len(w.encode())
            by_size.setdefault(0 if n > LONG else max(2, 1 << (n - 2).bit_length()) if n > 2 else 2, []).append(w)
        for size, group in by_size.items():
            raw = [w.encode() for w in group]
            found = [self._alone(w) for w in raw] if not size else self._together(raw, size)
            names = self.names
            for w, ids in zip(group, found, strict=True):
                self.ids[w] = ids.astype("<u4").tobytes()
                self.shown[w] = " ".join([names[i] for i in ids.tolist()])

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        if "<|" not in text:
            return cut(text)
        out: list[str] = []
        for k, piece in enumerate(SPECIAL.split(text)):
            out += [piece] if k % 2 else cut(piece)
        return out

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        rows = [self.pre_tokens(t) for t in texts]
        new = {w for words in rows for w in words} - self.ids.keys()
        if self.chars > REMEMBERED:
            held = [*self.special]
            self.ids, self.shown, self.chars = {k: self.ids[k] for k in held}, {k: self.shown[k] for k in held}, 0
            new = {w for words in rows for w in words} - self.ids.keys()
        if new:
            self.learn(new)
            self.chars += sum(map(len, new)) + ENTRY * len(new)
        ids, shown = self.ids, self.shown
        return [b"".join([ids[w] for w in words]) for words in rows], [" ".join([shown[w] for w in words]) for words in rows]


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def read_spec(path: str | None = None) -> str:
    """The tokenizer file as text. It is read on the driver and sent along (about 4 MB whatever the input)."""
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row of docs."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def score(texts: list[str]) -> dict[str, pa.Array]:
        ids, shown = encoder(spec.value).encode(texts)
        return {"ids": pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), "decoded": pa.array(shown, pa.string())}

    return map_texts(docs, score, "ids array<int>, decoded string")


def bpe_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: bpe_encode's results as digests, made where the ids are."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def score(texts: list[str]) -> dict[str, pa.Array]:
        ids, shown = encoder(spec.value).encode(texts)
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown]),
        }

    return map_texts(docs, score, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))
