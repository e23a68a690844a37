"""Operator 13: alignment of two tokenizers over the same bytes, by diagonal run skipping.

The ends of both tokenizers' tokens, in bytes, are two rising arrays. While token i of one and token i + shift of the other end
together, a stretch is one-to-one: it is probed in windows of doubled length at the current shift, and its end is found by
halving the window that differs. Where the ends part, the array that is behind moves on until both meet again, which makes
one irregular group and the next shift. Only irregular groups are written down; all else is one-to-one.

How many documents link an id pair is counted by Spark over the distinct pairs of each document. Pairs are then looked up in
two ways: the most frequent ones, at most FREQUENT by a count threshold taken from counts of counts, are broadcast; all others
occur in fewer documents than the threshold, so no key of their shuffled join is hot.

Results: texts that are null, empty, or whose tokens do not spell their bytes have no tokens: zeros and ''; very long texts
are aligned whole; repeated rows are documents of their own and each counts; pairs that tie for an id's highest count are
all its best; an empty table gives an empty table. Columns other than doc_id and text, whatever their names, are not read.
A group's links are all pairs of its tokens, counted without making each where a group is large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_spec
from .bytebpe import byte_bpe, default_path
from .common import Shelf, map_texts, table

#: Id pairs that may be broadcast with their counts (24 bytes each).
FREQUENT = 100_000
#: Links that are made together, and above which a group's links are counted by its distinct ids.
TOGETHER, LARGE = 2_000_000, 4_096


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def irregular_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Rows (first a, behind last a, first b, behind last b) of the groups that are not one-to-one; both arrays end together."""
    a, b = memoryview(np.ascontiguousarray(ends_a, np.int64)), memoryview(np.ascontiguousarray(ends_b, np.int64))
    raw_a, raw_b = a.tobytes(), b.tobytes()
    out: list[int] = []
    i, j, n = 0, 0, len(a)
    while i < n:
        x, y = a[i], b[j]
        if x != y:
            out += (i, j)
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i += 1
            j += 1
            out += (i, j)
            continue
        width, at, to = 8, 8 * i + 8, 8 * j + 8
        while (got := raw_a[at : at + width]) and got == raw_b[to : to + len(got)]:
            at, to, width = at + len(got), to + len(got), 2 * width
        while got and width > 8:  # the window differs somewhere: halve it
            width //= 2
            got = raw_a[at : at + width]
            if got == raw_b[to : to + width]:
                at, to = at + width, to + width
        i, j = at >> 3, to >> 3
    return np.array(out, np.int64).reshape(-1, 4)[:, [0, 2, 1, 3]]


def _starts(n: int, groups: np.ndarray) -> np.ndarray:
    """First tokens of all groups, one-to-one ones included, given the irregular ones as (first, behind last)."""
    change = np.zeros(n + 1, np.int64)
    change[groups[:, 0] + 1] += 1
    np.add.at(change, groups[:, 1], -1)
    return np.flatnonzero(np.cumsum(change)[:n] == 0)


class Aligner:
    """Encodes texts with both tokenizers and aligns them."""

    def __init__(self, spec: str, model: bytes):
        import sentencepiece

        self.a = byte_bpe(spec, False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = self.a.bytes_of
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.length_a, self.length_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        signs = [f"{s}{i}" for s, size in ((";", self.size_a), (",", self.size_a), ("|", self.size_b), (",", self.size_b)) for i in range(size)]
        self.signs = np.array(signs, object)

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers for each text; None where a text has no tokens."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        full = [t for t in texts if t]
        encoded = iter(self.b.encode(full, num_threads=1) if full else [])
        for text in texts:
            out.append(None)
            if not text:
                continue
            raw, b = (" " + text).encode(), next(encoded)
            if b"".join([self.bytes_b[i] for i in b]) != raw:
                continue
            a = self.a.ids(" " + text).astype(np.int64)
            if b"".join([self.bytes_a[i] for i in a.tolist()]) == raw:
                out[-1] = a, np.array(b, np.int64)
        return out

    def aligned(self, texts: list[str], with_groups: bool) -> dict[str, np.ndarray | list]:
        """For each text its numbers of tokens, groups and links, its groups as text (or their digest), its distinct linked
        id pairs (a * size_b + b) and how often it links each."""
        found = self.tokens(texts)
        rows = np.array([r for r, x in enumerate(found) if x is not None], np.int64)
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate([none, *(x[k] for x in found if x is not None)]) for k in (0, 1))
        n_a, n_b = (np.array([0 if x is None else len(x[k]) for x in found], np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        odd = irregular_groups(ends_a, ends_b)
        first_a, first_b = _starts(len(a), odd[:, :2]), _starts(len(b), odd[:, 2:])
        k_a, k_b = np.diff(np.append(first_a, len(a))), np.diff(np.append(first_b, len(b)))
        edge = np.searchsorted(first_a, np.cumsum(n_a) - n_a)  # groups never reach over documents
        n_groups = np.diff(np.append(edge, len(first_a)))
        doc = np.repeat(np.arange(len(texts)), n_groups)
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, doc, k_a * k_b)
        keys, times = self._links(a, b, first_a, first_b, k_a, k_b, doc)
        pair_doc = keys // (self.size_a * self.size_b)
        pair_edges = np.searchsorted(pair_doc, np.arange(len(texts) + 1))
        pairs = keys - pair_doc * (self.size_a * self.size_b)
        # every token's text with the sign before it, in the order of the groups
        code_a, code_b = a + self.size_a, b + 2 * self.size_a + self.size_b
        code_a[first_a] -= self.size_a
        code_b[first_b] -= self.size_b
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.repeat(first_b, k_a)] = code_a
        line[np.arange(len(b)) + np.repeat(first_a + k_a, k_b)] = code_b
        edges = np.cumsum(n_a + n_b) - n_a - n_b
        shown = [""] * len(texts)
        for r in rows.tolist():
            shown[r] = "".join(self.signs[line[edges[r] : edges[r] + n_a[r] + n_b[r]]].tolist())[1:]
            if not with_groups:
                shown[r] = hashlib.sha256(shown[r].encode()).hexdigest()
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": shown, "edges": pair_edges, "pairs": pairs, "times": times}

    def _links(self, a, b, first_a, first_b, k_a, k_b, doc) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, id pair) keys in order, and how often each is linked."""
        product = k_a * k_b
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.flatnonzero(product <= LARGE)
        upto, at = np.cumsum(product[small]), 0
        while at < len(small):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER, "right")))
            g = small[at:end]
            of = np.repeat(g, product[g])
            nth = np.arange(len(of)) - np.repeat(np.cumsum(product[g]) - product[g], product[g])
            left, right = a[first_a[of] + nth // k_b[of]], b[first_b[of] + nth % k_b[of]]
            made = np.unique((doc[of] * self.size_a + left) * self.size_b + right, return_counts=True)
            keys.append(made[0])
            times.append(made[1])
            at = end
        for g in np.flatnonzero(product > LARGE).tolist():
            (x, n_x), (y, n_y) = (np.unique(ids[f[g] : f[g] + k[g]], return_counts=True) for ids, f, k in ((a, first_a, k_a), (b, first_b, k_b)))
            keys.append((((doc[g] * self.size_a + x) * self.size_b)[:, None] + y).ravel())
            times.append((n_x[:, None] * n_y).ravel())
        if len(keys) == 2:
            return keys[1], times[1]
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(which, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)


@lru_cache(maxsize=2)
def aligner(spec: str, model: bytes) -> Aligner:
    return Aligner(spec, model)


def align_tokens(docs: DataFrame, path: str | None = None, piece_path: str | None = None, with_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`; or its SHA-256, groups_sha256, without with_groups), and
    pairs with times: the distinct linked id pairs (a * size of B + b) of a row and how often it links each."""
    context = docs.sparkSession.sparkContext
    with open(piece_path or default_piece_path(), "rb") as f:
        sent = context.broadcast((read_spec(path or default_path()), f.read()))
    shown = "groups" if with_groups else "groups_sha256"

    def score(texts: list[str]) -> dict[str, pa.Array]:
        made = aligner(*sent.value).aligned(texts, with_groups)
        edges = pa.array(made["edges"], pa.int32())
        out = {c: pa.array(made[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
        lists = {c: pa.ListArray.from_arrays(edges, pa.array(made[c], pa.int64())) for c in ("pairs", "times")}
        return out | {shown: pa.array(made["groups"], pa.string())} | lists

    return map_texts(docs, score, f"n_a bigint, n_b bigint, n_groups bigint, n_links bigint, {shown} string, pairs array<bigint>, times array<bigint>")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, its A id a, n: how many rows of aligned link each id pair (pairs are distinct within a row)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    return counts.withColumn("a", F.floor(F.col("pair") / size_b))


def link_counts(aligned: DataFrame, size_b: int, shelf: Shelf, frequent: int = FREQUENT) -> DataFrame:
    """Each row of aligned(uid, pairs, times), by uid: n_best, links whose count is their A id's highest, and count_sum, the
    sum of all links' counts. Rows without links are left out."""
    counts = shelf.put(pair_counts(aligned, size_b))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row an A id: at most the vocabulary
    counts = counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    # counts of counts, by powers of 2 in 16 steps each: under 1,100 rows whatever the input
    step = F.floor(F.log2("n") * 16)
    seen = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect(), reverse=True)
    least, total = 1 << 20, 0
    for r in seen:
        total += r.pairs
        if total > frequent:
            break
        least = r.step
    often, rare = counts.filter(step >= least), counts.filter(step < least)
    links = aligned.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    often = F.broadcast(often)
    both = links.join(often, "pair").unionByName(links.join(often.select("pair"), "pair", "left_anti").join(rare, "pair"))
    return both.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))


def aligned_counts(docs: DataFrame, path: str | None = None, piece_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=piece_path or default_piece_path()).get_piece_size()
    shelf = Shelf(docs.sparkSession)
    made = align_tokens(docs, path, piece_path, with_groups=False)
    kept = shelf.put(made.withColumn("uid", F.monotonically_increasing_id()))
    sums = link_counts(kept.select("uid", "pairs", "times"), size_b, shelf, frequent)
    zero = F.lit(0).cast("bigint")
    out = kept.join(sums, "uid", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op13_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_counts(table(spark, sf_dir, "documents"))
