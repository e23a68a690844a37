"""Operator 11: best-fit packing with certified bounds.

Documents become tokens with an end mark each; longer ones than a sequence are cut into full pieces behind one shorter first
piece, and a full piece is a sequence by itself. The other pieces, one a document at most, are numbered by size through a range
sort and dealt in turns into groups of about GROUP, all of the same mix of sizes, and packed by best-fit decreasing. Of a family of dual-feasible functions, the one with the greatest bound on
all pieces (from their counts by size) then bounds each group from below, so that the groups' bounds add up to that of the
table. A group that meets its bound is certified: its sequences are final but for the least filled one. A group with a gap,
by chance of its sizes or by best fit's choices, hands out all sequences with room, the least filled first, up to GROUP pieces. What FAN groups hand out meets in a new group and is
packed again, which is kept where it takes fewer sequences (or as many, with one emptier), until one group is left; so a
group never holds more than about FAN * GROUP pieces, and levels grow with the logarithm of the input.

Results: a null or empty text is one piece that holds the end mark alone; very long texts are cut, none of their tokens is
lost; repeated rows, also of one doc_id, are documents of their own; ties between equal pieces fall by the order of rows in
their files; an empty table gives an empty table. Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import read_spec
from .bytebpe import byte_bpe, default_path
from .common import Shelf, bounded_batches, slices, table

#: Tokens of a sequence, and the id behind each document.
CAPACITY, END = 1024, 2
#: Pieces of a group, and groups that meet a level up.
GROUP, FAN = 2_048, 8


@lru_cache(maxsize=4)
def dual_feasible(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Numerators f[r, size] and denominators of functions r: pieces that fit one sequence sum to at most 1 under each.

    Three published families (Martello and Toth, 1990; Fekete and Schepers, 2001), in whole numbers: sizes rounded to 0 and 1
    outside a margin; multiples of 1/(k+1) rounded down to multiples of 1/k; large sizes by what fits beside them.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    rows, below = [], []
    for e in range(capacity // 2 + 1):
        rows.append(np.where(x > capacity - e, capacity, np.where(x >= e, x, 0)))
        below.append(capacity)
    for k in range(1, 65):
        whole = (k + 1) * x % capacity == 0
        rows.append(np.where(whole, x * k, (k + 1) * x // capacity * capacity))
        below.append(k * capacity)
    for e in range(1, capacity // 2 + 1):
        fit = capacity // e
        large = 2 * (fit - (capacity - x) // e)
        rows.append(np.where(2 * x > capacity, large, np.where(2 * x == capacity, fit, np.where(x >= e, 2, 0))))
        below.append(2 * fit)
    return np.array(rows), np.array(below, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, by: int | None = None) -> int:
    """Sequences that pieces of the given sizes need at least, by the best function or the one given."""
    f, below = dual_feasible(capacity)
    if by is not None:
        return int(-(-f[by][sizes].sum() // below[by]))
    return int((-(-(f @ np.bincount(sizes, minlength=capacity + 1)) // below)).max()) if len(sizes) else 0


def best_function(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The function with the greatest bound on pieces of which counts[size] have each size."""
    f, below = dual_feasible(capacity)
    return int(((f @ counts) / below).argmax())


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence of each piece, numbered from 0: the largest first, each where it leaves the least room."""
    out = np.empty(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0  # bit r of rooms: some sequence has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        w = int(sizes[i])
        fit = rooms >> w
        if fit:
            room = w + (fit & -fit).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at, made = capacity, made, made + 1
        out[i] = at
        with_room[room - w].append(at)
        rooms |= 1 << (room - w)
    return out


def _fill(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=sizes).astype(np.int64)


def pack_group(sizes: np.ndarray, before: np.ndarray | None, capacity: int, hand_out: int, by: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece of a group, and which pieces are handed out to the next level.

    before: the sequences that the pieces came in, kept if packing anew is no better. hand_out: pieces that a group with a
    gap may hand out; 0 at the top, where nothing is handed out. by: the function that certifies.
    """
    bins = best_fit_decreasing(sizes, capacity)
    if before is not None:
        old, new = _fill(before, sizes), _fill(bins, sizes)
        if (len(old), -(old**2).sum()) < (len(new), -(new**2).sum()):
            bins = before
    fill, held = _fill(bins, sizes), np.bincount(bins)
    if not hand_out:
        return bins, np.zeros(len(sizes), bool)
    order = np.argsort(fill, kind="stable")
    order = order[fill[order] < capacity]
    if len(fill) == lower_bound(sizes, capacity, by):
        order = order[:1]
    taken = np.zeros(len(fill), bool)
    taken[order[np.cumsum(held[order]) <= max(hand_out, held[order[0]] if len(order) else 0)]] = True
    return bins, taken[bins]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids themselves, if asked for) of the pieces of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = spark.sparkContext.broadcast(read_spec(path or default_path()))
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(spec.value, True)
        for part, texts in slices(batches):
            row, cuts, sums, kept = [], [], [], []
            for r, text in enumerate(texts):
                of = np.append(coder.ids(text).astype("<u4"), np.uint32(end)).astype("<u4")
                edges = [0, *range(len(of) % capacity or capacity, len(of) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    row.append(r)
                    cuts.append((k, a, b - a))
                    sums.append(zlib.crc32(of[a:b].tobytes()))
                    if ids:
                        kept.append(of[a:b].astype("<i4"))
            piece, start, length = np.array(cuts, np.int64).reshape(-1, 3).T
            columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if ids else ""))


def _shape(rows: DataFrame, more: str) -> T.StructType:
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(more)])


def dealt(rows: DataFrame, shelf: Shelf, teams: int) -> DataFrame:
    """rows(row, size, uid) with a team each: in order of size and uid, every teams-th row goes to the same team."""
    from pyspark import TaskContext

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for b in batches:
            number = pa.array(np.arange(nth, nth + b.num_rows))
            nth += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), number], names=["row", "size", "uid", "part", "nth"])

    in_order = rows.select("row", "size", "uid").repartitionByRange("size", "uid").sortWithinPartitions("size", "uid")
    numbered = shelf.put(in_order.mapInArrow(count, _shape(rows, "size bigint, uid bigint, part bigint, nth bigint")))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part of the sort
    upto = numbered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(upto), "part").select("row", "size", "uid", F.pmod(F.col("before") + F.col("nth"), F.lit(teams)).cast("bigint").alias("team"))


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """The rows of cut(…, length) with sequence_id and offset: pieces of 1 to capacity tokens in few sequences.

    The method's helper columns are named apart from those of cut, which are all kept.
    """
    shelf = Shelf(cut.sparkSession)
    rows = shelf.put(cut.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in cut.columns]).alias("row"), F.col("length").alias("size"), F.monotonically_increasing_id().alias("uid")))
    whole = F.col("size") == capacity
    done = rows.filter(whole).select("row", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in rows.filter(~whole).groupBy("size").count().collect():  # fewer rows than tokens in a sequence
        counts[size] = n
    teams, by = max(1, -(-int(counts.sum()) // group)), best_function(counts, capacity)
    left = dealt(rows.filter(~whole), shelf, teams).withColumn("sequence_id", F.lit(None).cast("bigint"))
    shape = _shape(rows, "size bigint, uid bigint, team bigint, sequence_id bigint, offset bigint, up boolean")
    level = 0
    while True:
        last = teams == 1
        met = shelf.put(left.groupBy("team").applyInArrow(_packer(capacity, 0 if last else group, level, by), shape))
        done = done.union(met.filter(~F.col("up")).select("row", "sequence_id", "offset"))
        if last:
            return done.select("row.*", "sequence_id", "offset")
        left = met.filter("up").select("row", "size", "uid", F.floor(F.col("team") / fan).alias("team"), "sequence_id")
        teams, level = -(-teams // fan), level + 1


def _packer(capacity: int, hand_out: int, level: int, by: int):
    """Packs one group; sequences are numbered by level, group and place."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("uid")
        sizes, team = rows["size"].to_numpy(), rows["team"][0].as_py()
        before = None if rows["sequence_id"].null_count else pd.factorize(rows["sequence_id"].to_numpy())[0].astype(np.int64)
        bins, up = pack_group(sizes, before, capacity, hand_out, by)
        order = np.argsort(bins, kind="stable")
        filled = np.cumsum(sizes[order]) - sizes[order]
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = filled - np.repeat(filled[first], np.diff(first, append=len(order)))
        number = ((level << 36 | team) << 22) | bins
        made = {"uid": rows["uid"], "team": rows["team"], "sequence_id": pa.array(number), "offset": pa.array(offset), "up": pa.array(up)}
        return pa.table({"row": rows["row"], "size": rows["size"], **made})

    return run


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
