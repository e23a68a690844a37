"""Helpers shared by the training-data operators: table loading, row-wise Arrow maps, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import functools
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, spread

#: Characters of text handled together inside one Python worker.
SLICE_CHARS = 1_000_000
BATCH = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; a small one whose files hold few row groups is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of texts of at most BATCH, where the session keeps Spark's default: rows of any length then take
    bounded memory on both sides of a Python worker's pipe."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(key, BATCH)


class _Open(threading.local):
    """Shelves whose tables may still be read, of each thread: runs beside each other never clear each other's."""

    def __init__(self):
        self.shelves: list[Shelf] = []


_OPEN = _Open()
#: All threads' open shelves, for the end of the driver.
_EVERY: set[Shelf] = set()


def clear_shelves(since: int = 0) -> None:
    """Deletes the intermediate tables of all operators run so far in this thread (from the since-th open shelf on); call it when
    their results have been written or collected. What is left goes when the driver ends."""
    while len(_OPEN.shelves) > since:
        _OPEN.shelves.pop().clear()


def open_shelves() -> int:
    return len(_OPEN.shelves)


def _clear_all() -> None:
    for shelf in list(_EVERY):
        shelf.clear()


class Shelf:
    """Written intermediate tables of one operator run, in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/shelf-{uuid.uuid4().hex}"
        self.n = 0
        _OPEN.shelves.append(self)
        _EVERY.add(self)

    def clear(self) -> None:
        """Delete all tables."""
        _EVERY.discard(self)
        with contextlib.suppress(Exception):  # the session may have gone first, and its folder with it
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def put(self, df: DataFrame) -> DataFrame:
        """Write df and read it back, which cuts its lineage; lost executors only cost a re-read."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = getattr(df, "_shelf_path", None)
        if path:
            self._delete(path)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch cut into runs of rows of about SLICE_CHARS characters, with the texts (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        start = chars = 0
        for i, value in enumerate(texts):
            chars += len(value or "")
            if chars >= SLICE_CHARS or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), [x or "" for x in texts[start : i + 1]]
                start, chars = i + 1, 0


def map_texts(df: DataFrame, score: Callable[..., dict[str, pa.Array]], columns: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Row-wise map: score(texts), or score(values of keep's first column, texts) with_ids, gives the new columns; the
    columns in keep are carried along. One row out per row in."""
    bounded_batches(df.sparkSession)
    out_names = [c.split()[0] for c in columns.split(", ")]
    source = df.select(*keep, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            made = score(part.column(0).to_pylist(), texts) if with_ids else score(texts)
            arrays = [part.column(part.schema.get_field_index(k)) for k in keep] + [made[n] for n in out_names]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *out_names])

    return source.mapInArrow(run, f"{types}, {columns}")


#: Columns that operators on documents may read by name.
READ = ("doc_id", "text", "source")


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that gives back the columns of its documents, whatever their names: all that it does not read travel under
    plain names of their own, so that none meets a helper column or needs quoting."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        plain = [c if c in READ else f"carried_{i}" for i, c in enumerate(docs.columns)]
        return operator(docs.toDF(*plain), *args, **options).toDF(*docs.columns)

    return run


def held_out(doc_id: str = "doc_id"):
    """True for rows whose label must not be learnt from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))



def labelled(labels: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` rows (doc_id, label) that may be learnt from, those of smallest hash."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sampled_rows(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """text and the columns of ids (one row a doc_id, bounded in number) of at most `most` documents of those ids.

    The bound holds however often a doc_id is repeated: texts of an id are told apart by hash, equal ones count once, and
    those of smallest hash are taken before any text is moved.
    """
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("__mark")).join(F.broadcast(ids), "doc_id")
    taken = marked.select("doc_id", "__mark").distinct().orderBy(F.xxhash64("doc_id", "__mark"), "doc_id", "__mark").limit(most)
    return marked.join(F.broadcast(taken), ["doc_id", "__mark"], "left_semi").dropDuplicates(["doc_id", "__mark"]).drop("__mark")


atexit.register(_clear_all)
