"""One pass over each key's rows in order, for results whose next row depends on the last one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame

TYPES = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "date": pa.date32(), "string": pa.string()}
#: Rows of a batch that a scan sends back.
ROWS = 10_000


def scanned(df: DataFrame, key: str, order: list[str | Column], scan: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that scan(rows of one key in order, as tuples of df's columns) yields; schema: "name type, …".

    Rows are dealt by key and sorted by Spark, which spills, and pass the scan as a stream: a hot key takes time, not
    memory.
    """
    at = df.columns.index(key)
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    names, types = [f[0] for f in fields], [TYPES[f[1]] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = (made for _, group in groupby(rows, key=lambda row: row[at]) for made in scan(group))
        while part := list(islice(out, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
