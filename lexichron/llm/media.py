"""Operator 5: chroma audio fingerprints for media columns.

A recording (16-bit mono samples) is cut into overlapping frames; each frame's spectrum is folded into the twelve pitch
classes. Over an integral image of the frames, sixteen box filters each give a number that is quantised to two bits, so
every place yields one packed 32-bit integer. Recordings that share integers meet in buckets. A pair is linked if at any
offset with VOTES equal integers (all places vote) the aligned fingerprints overlap enough and differ in few bits. A
bucket first gives candidates in the shape of a star; then, in buckets that hold several components, the recordings of
different components are compared on whole fingerprints, in blocks of bounded size, so that no pair that shares VOTES
integers at an offset goes untested. Linked recordings form groups.

The test tables hold no audio, so op5 renders every embedding as a melody of one note a number and treats that as its
media column; fingerprint() and aligned_groups() take any recordings.

Results: no samples, or fewer than one filter's width of frames, give an empty fingerprint, a group of its own and no
links; equal fingerprints are one class before any join, so copies do not multiply; repeated rows get equal results; an
empty table gives an empty table; null, empty or non-finite embeddings give no samples. A group's id is its smallest
rec_id. Recordings are read whole, however long. Columns other than rec_id and audio (op5: vec_id and embedding), whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, table
from .graph import components

RATE, FRAME, HOP = 4_000, 1_024, 512
WIDTH = 8
#: Links need this many shared integers at one offset, this share of bits equal, and this overlap of the shorter one.
VOTES, BIT_ERRORS, OVERLAP = 3, 0.15, 0.75
#: Outsiders and members of a bucket that meet in one block; larger buckets are dealt into more blocks.
OUTSIDE, INSIDE = 500, 500
#: Beyond so many offsets a pair, the unequal bits of all offsets are counted at once.
DIRECT = 64
LOW, HIGH = 55.0, 1_760.0


def pitch_bins() -> np.ndarray:
    """Pitch class of each bin of a spectrum, 12 for bins outside LOW..HIGH."""
    f = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.full(len(f), 12)
    use = (f >= LOW) & (f <= HIGH)
    out[use] = np.round(12 * np.log2(f[use] / 440.0)).astype(int) % 12
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, height, width) of the sixteen filters, spread evenly over shapes, places and sizes."""
    out = []
    for i in range(16):
        height = (2, 3, 4, 6)[i % 4]
        out.append((i % 4, (5 * i) % (12 - height + 1), height, (2, 4, 6, 8)[(i // 4 + i) % 4]))
    return out


PITCH, FILTERS = pitch_bins(), filters()
#: Cuts between the four levels of a filter's log ratio.
CUTS = (-0.35, 0.0, 0.35)
GRAY = np.array([0, 1, 3, 2], np.uint32)
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of unit length (silence: zeros)."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if not n:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    out = np.stack([power[:, PITCH == c].sum(1) for c in range(12)], 1)
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed integers, one for each place where WIDTH frames start."""
    c = chroma(samples.astype(np.float64))
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(c) + 1, 13))
    total[1:, 1:] = c.cumsum(0).cumsum(1)

    def box(t: int, w: int, p: int, h: int) -> np.ndarray:
        """Sum over frames t..t+w and classes p..p+h for every place."""
        a, b = total[t : t + n], total[t + w : t + w + n]
        return b[:, p + h] - a[:, p + h] - b[:, p] + a[:, p]

    out = np.zeros(n, np.uint32)
    for shape, p, h, w in FILTERS:
        if shape == 0:  # above against below
            a, b = box(0, w, p, h // 2), box(0, w, p + h // 2, h - h // 2)
        elif shape == 1:  # earlier against later
            a, b = box(0, w // 2, p, h), box(w // 2, w - w // 2, p, h)
        elif shape == 2:  # one diagonal against the other
            x, y = w // 2, h // 2
            a = box(0, x, p, y) + box(x, w - x, p + y, h - y)
            b = box(0, x, p + y, h - y) + box(x, w - x, p, y)
        else:  # the band against all classes
            a, b = box(0, w, p, h) * 12 / h, box(0, w, 0, 12)
        level = np.searchsorted(CUTS, np.log((a + 0.05) / (b + 0.05)))
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def melody(numbers: np.ndarray) -> np.ndarray:
    """Sixteen-bit samples of a tune with one eighth-second note a number; larger numbers are higher."""
    pitch = 220.0 * 2.0 ** (np.round(np.clip(numbers, -1, 1) * 60) / 12)
    pitch = 110.0 * 2.0 ** (np.log2(pitch / 110.0) % 4)
    phase = np.cumsum(np.repeat(pitch, RATE // 8)) * (2 * np.pi / RATE)
    return np.round(12_000 * np.sin(phase)).astype(np.int16)


def rendered(vectors: DataFrame) -> DataFrame:
    """rec_id, audio (16-bit little-endian samples) of vectors(vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # keeps a few MB of samples at a time
                part, audio = batch.slice(at, 64), []
                for v in part.column(1).to_pylist():
                    x = np.array([np.nan if e is None else e for e in v or []], float)
                    audio.append(melody(x).astype("<i2").tobytes() if len(x) and np.isfinite(x).all() else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], names=["rec_id", "audio"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"rec_id {kind}, audio binary")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """rec_id, cls (key of the fingerprint; null if empty), ints of recordings(rec_id, audio)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = [fingerprint(np.frombuffer(a[: len(a) // 2 * 2], "<i2")).view(np.int32) if a else np.zeros(0, np.int32) for a in batch.column(1).to_pylist()]
            cls = [int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64)) if len(x) else None for x in ints]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(ints, pa.list_(pa.int32()))], names=["rec_id", "cls", "ints"])

    kind = recordings.schema["rec_id"].dataType.simpleString()
    return recordings.select("rec_id", "audio").mapInArrow(run, f"rec_id {kind}, cls bigint, ints array<int>")


def error_rate(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of unequal bits where a[i + offset] meets b[i], and the number of places that meet."""
    lo, hi = max(0, -offset), min(len(b), len(a) - offset)
    if hi <= lo:
        return 1.0, 0
    x = (a[lo + offset : hi + offset] ^ b[lo:hi]).view(np.uint8)
    return float(POP[x].sum()) / (32 * (hi - lo)), hi - lo


def offset_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of places with a[i + offset] == b[i] for each offset from 1 - len(b) to len(a) - 1; all places vote."""
    n, m = len(a), len(b)
    keys, at, ca = np.unique(a, return_inverse=True, return_counts=True)
    own = np.minimum(np.searchsorted(keys, b), len(keys) - 1)
    meets = np.flatnonzero(keys[own] == b)
    cb = np.bincount(own[meets], minlength=len(keys))
    often = ca * cb > n + m  # as in silence and drones: counted as a correlation, not place by place
    some = meets[~often[own[meets]]]
    order, first, times = np.argsort(at, kind="stable"), np.cumsum(ca) - ca, ca[own[some]]
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    places = order[np.repeat(first[own[some]], times) + step]
    out = np.bincount(places - np.repeat(some, times) + m - 1, minlength=n + m - 1)
    for k in np.flatnonzero(often):
        out += correlation((at == k)[:, None], (b == keys[k])[:, None])
    return out


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the products of the rows a[i + offset] and b[i], whole numbers, for each offset from 1 - len(b) to len(a) - 1."""
    size = 1 << (len(a) + len(b) - 2).bit_length()
    total = sum(np.fft.rfft(x.astype(float), size) * np.fft.rfft(y[::-1].astype(float), size) for x, y in zip(a.T, b.T, strict=True))
    return np.rint(np.fft.irfft(total, size)[: len(a) + len(b) - 1]).astype(np.int64) if size > 1 else np.array([int((a * b).sum())])


def signs(x: np.ndarray) -> np.ndarray:
    """Each integer's 32 bits as 1 and -1."""
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8)).reshape(-1, 32).astype(np.int8) * 2 - 1


def aligned(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether at some offset a and b share VOTES integers, overlap enough and have few unequal bits."""
    offsets = np.arange(1 - len(b), len(a))
    met = np.minimum(len(b), len(a) - offsets) - np.maximum(0, -offsets)
    votes = np.where(met >= OVERLAP * min(len(a), len(b)), offset_votes(a, b), 0)
    at = np.flatnonzero(votes >= VOTES)
    if len(at) > DIRECT:
        wrong = (32 * met - correlation(signs(a), signs(b))) // 2
        return bool((wrong[at] / (32 * met[at]) <= BIT_ERRORS).any())
    return any(error_rate(a, b, int(offsets[i]))[0] <= BIT_ERRORS for i in at[np.argsort(-votes[at], kind="stable")])


def star_links(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v) of linked classes, one of which is the smallest of a bucket. met: key, cls, n (places)."""
    hubs = met.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("hub"))
    pairs = met.join(hubs, "key").filter(F.col("cls") != F.col("hub.cls"))
    # no offset has more votes of an integer than the side with fewer of its places
    most = pairs.groupBy(F.col("hub.cls").alias("u"), F.col("cls").alias("v")).agg(F.sum(F.least("hub.n", "n")).alias("most")).filter(F.col("most") >= VOTES)
    both = most.join(classes.select(F.col("cls").alias("v"), F.col("ints").alias("b")), "v").join(classes.select(F.col("cls").alias("u"), F.col("ints").alias("a")), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [aligned(np.array(a.as_py(), np.int32), np.array(b.as_py(), np.int32)) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def links_of_block(key: int, cls: np.ndarray, root: np.ndarray, outside: np.ndarray, inside: np.ndarray, ints: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links between the outsiders and the members of other components of one block of a bucket."""
    members = np.flatnonzero(inside)
    for o in np.flatnonzero(outside == 1):
        # of two outsiders each meets the other
        at = members[(root[members] != root[o]) & ((outside[members] == 0) | (cls[members] > cls[o]))]
        if not len(at):
            continue
        mine, theirs = np.unique(ints[o]), [ints[i] for i in at]
        sizes = np.array([len(x) for x in theirs])
        flat = np.concatenate(theirs)
        shared = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        starts = np.cumsum(sizes) - sizes
        # a pair is compared in its first common bucket only
        first = np.minimum.reduceat(np.where(shared, flat, np.iinfo(np.int32).max), starts) == key
        for i in at[first & (np.add.reduceat(shared.astype(np.int64), starts) >= VOTES)]:
            if aligned(ints[i], ints[o]):
                yield int(cls[o]), int(cls[i])


def missed_links(met: DataFrame, roots: DataFrame, classes: DataFrame, shelf: Shelf) -> DataFrame:
    """(u, v) of linked classes in different components that share a bucket. met: key, cls; roots: node, root.

    Classes outside a bucket's largest component meet the members of the others in blocks of bounded size; a bucket
    of one block sends each class once. Only links leave a task.
    """
    placed = met.join(roots, met["cls"] == roots["node"], "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("size"))
    several = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("all")).filter("parts > 1")
    rows = placed.join(several, "key")
    out_blocks = F.ceil((F.col("all") - F.col("main.size")) / OUTSIDE).cast("int")
    rows = shelf.put(rows.select("key", "cls", "root", (F.col("root") != F.col("main.root")).cast("int").alias("out"), out_blocks.alias("ob"), F.ceil(F.col("all") / INSIDE).cast("int").alias("ib")))
    own_out, own_in = F.pmod(F.xxhash64("cls"), F.col("ob")).cast("int"), F.pmod(F.xxhash64("cls"), F.col("ib")).cast("int")
    # outside: 1 for an outsider that looks for links, -1 for one that is only looked at, 0 for the main component
    one = rows.filter("ob = 1 AND ib = 1").select("key", "cls", "root", F.col("out").alias("outside"), F.lit(1).alias("inside"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    more = rows.filter("ob > 1 OR ib > 1")
    outsiders = more.filter("out = 1").select("key", "cls", "root", F.lit(1).alias("outside"), F.lit(0).alias("inside"), own_out.alias("i"), F.explode(F.sequence(F.lit(0), F.col("ib") - 1)).alias("j"))
    insiders = more.select("key", "cls", "root", (-F.col("out")).alias("outside"), F.lit(1).alias("inside"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("i"), own_in.alias("j"))
    full = one.union(outsiders).union(insiders).join(classes.select("cls", "ints"), "cls").select("key", "i", "j", "cls", "root", "outside", "inside", "ints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            held += [] if batch is None else [batch]
            if not sum(x.num_rows for x in held):
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key, i, j, cls, root, outside, inside = (rows.column(c).to_numpy() for c in range(7))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = [0, *edges.tolist(), *([len(key)] if batch is None else [])]  # the last block may go on in the next batch
            prints = rows.column(7)
            ends, flat = prints.offsets.to_numpy(), prints.values.to_numpy()
            found = []
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a > 1:
                    found += links_of_block(int(key[a]), cls[a:b], root[a:b], outside[a:b], inside[a:b], [flat[ends[x] : ends[x + 1]] for x in range(a, b)])
            held = [] if batch is None else [rows.slice(edges[-1])]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["u", "v"])

    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u bigint, v bigint")


def class_roots(classes: DataFrame, shelf: Shelf) -> DataFrame:
    """node, root of the linked fingerprint classes. classes: cls, ints."""
    keys = classes.select("cls", F.explode("ints").alias("key")).groupBy("key", "cls").agg(F.count("*").alias("n"))
    several = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    met = shelf.put(keys.join(several, "key", "left_semi"))
    roots = shelf.put(components(shelf.put(star_links(met, classes)), shelf))
    missed = shelf.put(missed_links(met, roots, classes, shelf))
    shelf.drop(met)
    if missed.isEmpty():
        return roots
    root_u = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
    root_v = roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    bridges = missed.join(root_u, "u", "left").join(root_v, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    # a bridge's ends are roots or classes without a star link
    merged = shelf.put(components(bridges, shelf)).select("node", F.col("root").alias("top"))
    moved = roots.join(merged.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    lone = merged.join(roots.select("node"), "node", "left_anti").select("node", F.col("top").alias("root"))
    return moved.union(lone)


def aligned_groups(recordings: DataFrame) -> DataFrame:
    """rec_id, n_ints, print_sha256, group_id of every row of recordings(rec_id, audio)."""
    shelf = Shelf(recordings.sparkSession)
    rows = shelf.put(fingerprints(recordings))
    classes = shelf.put(rows.filter("cls is not null").groupBy("cls").agg(F.min("rec_id").alias("rec_id"), F.first("ints").alias("ints")))
    roots = shelf.put(class_roots(classes.select("cls", "ints"), shelf))
    labelled = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "rec_id", F.coalesce("root", "cls").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rec_id").alias("group_id"))
    ids = labelled.join(least, "root").select("cls", "group_id")
    digest = F.sha2(F.array_join("ints", ",").cast("binary"), 256)
    out = rows.select("rec_id", "cls", F.size("ints").cast("bigint").alias("n_ints"), digest.alias("print_sha256")).join(ids, "cls", "left")
    group = F.when(F.col("cls").isNull(), F.col("rec_id")).otherwise(F.col("group_id"))
    return out.select("rec_id", "n_ints", "print_sha256", group.alias("group_id"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_ints, print_sha256, group_id of every embedding, rendered as a recording."""
    return aligned_groups(rendered(table(spark, sf_dir, "embeddings"))).withColumnRenamed("rec_id", "vec_id")
