"""Session factory and table loading."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "lexichron", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution (skew joins, coalescing) and Arrow; conf overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | conf
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of a scan that keep one core busy; larger tables have splits enough by themselves.
SPLIT = 128 << 20
#: Bytes that spread() deals anew at most, however many cores there are.
SPREAD_MOST = 2 << 30


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is small and its row groups leave more than half of the cores idle, else df itself.

    A small table is often one row group, so that one task would do all the work on its rows. A job over the footers of such
    tables, without any column, counts the partitions that hold rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size >= min(cores * SPLIT, SPREAD_MOST) or 2 * df.select(F.spark_partition_id()).distinct().count() > cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; a missing path fails here, before any job runs."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder all executors share: spark.checkpoint.dir, or a temporary one when that is unset in a local session."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        known = tempfile.mkdtemp(prefix="lexichron-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Tables written() has made; results may read them until clear_written().
_WRITTEN: list[tuple[SparkSession, str]] = []


def clear_written() -> None:
    """Deletes the intermediate tables of all plans so far; call it when their results have been written or collected. What
    is left goes when the driver ends."""
    while _WRITTEN:
        with contextlib.suppress(Exception):  # the session may have gone first, and its folder with it
            delete(*_WRITTEN.pop())


atexit.register(clear_written)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted like the tables of written()."""
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: made once however often a plan uses it, and safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
