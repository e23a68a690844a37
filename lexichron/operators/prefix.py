"""Running totals over rows in order, spread over all tasks however few keys there are.

Rows are dealt into ranges of (key, order), so a hot key, or none at all, spans many ranges. Each range is one sorted stream
that adds up as it goes and starts afresh at each key. A range can only continue the key that the one before ended with, so
what is carried over is one number a range: the running total of the ranges before that end with that key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def running_total(df: DataFrame, value: str, order: list[str], by: str | None = None, name: str = "running") -> DataFrame:
    """df with name, a whole number: the sum of the whole numbers in value (null: 0) over the row and all before it in the given
    order, among the rows with an equal `by` (null: a key of its own). order must tell rows apart, unless they are equal;
    nulls in it come first."""
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    sort = [quoted(c) for c in ([by] if by else []) + order]
    row = F.struct(*[quoted(c) for c in df.columns])
    # a key is told by two hashes of 64 bits
    marks = [F.xxhash64(F.lit(i), quoted(by)) if by else F.lit(0).cast("bigint") for i in (1, 2)]
    ranges = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    dealt = ranges.select(row.alias("row"), F.coalesce(quoted(value).cast("bigint"), F.lit(0)).alias("v"), marks[0].alias("k1"), marks[1].alias("k2"))
    names = ["row", "here", "part", "opening", "closing", "first1", "first2", "k1", "k2"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, total, held = TaskContext.get().partitionId(), None, None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            v, k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            upto = np.cumsum(v)
            starts = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            before = np.where(starts > 0, upto[starts - 1], 0)
            if (k1[0], k2[0]) == last:
                before[0] -= total
            here = upto - np.repeat(before, np.diff(np.append(starts, len(v))))
            first = first or (k1[0], k2[0])
            last, total = (k1[-1], k2[-1]), here[-1]
            if held is not None:
                yield _batch(held, names)
            n = len(v)
            held = [b.column(0), here, np.full(n, part), (k1 == first[0]) & (k2 == first[1]), np.zeros(n, bool), np.full(n, first[0]), np.full(n, first[1]), k1, k2]
        if held is not None:
            held[4][-1] = True
            yield _batch(held, names)

    kinds = [dealt.schema["row"].dataType, *[T.LongType()] * 2, *[T.BooleanType()] * 2, *[T.LongType()] * 4]
    made = written(dealt.mapInArrow(add, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])))
    # windows over one row a range
    ends = made.filter("closing").withColumn("upto", F.sum("here").over(Window.partitionBy("k1", "k2").orderBy("part")))
    earlier = lambda c: F.lag(c).over(Window.orderBy("part"))
    goes_on = (earlier("k1") == F.col("first1")) & (earlier("k2") == F.col("first2"))
    carried = ends.select("part", F.when(goes_on, earlier("upto")).alias("carried")).filter("carried IS NOT NULL")
    total: Column = F.col("here") + F.when(F.col("opening"), F.coalesce("carried", F.lit(0))).otherwise(0)
    return made.join(F.broadcast(carried), "part", "left").select("row.*", total.alias(name))


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
