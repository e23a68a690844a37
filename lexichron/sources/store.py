"""The stored tables as parquet folders: creation, schema checks, appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.catalogue import episode_folder
from ..operators.usage import next_id, wide_fingerprint
from ..schemas import SCHEMAS


#: Tables whose rows an episode's rebuild replaces.
REBUILT = ("passages",)


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def apply_schema(spark: SparkSession, root: str) -> None:
    """Creates the tables that are missing; raises if a present one has another schema. May be repeated."""
    for name, schema in SCHEMAS.items():
        path = f"{root}/{name}"
        if not exists(spark, path):
            spark.createDataFrame([], schema).write.parquet(path)
        elif [x for x in _shape(spark.read.parquet(path).schema) if x[0] != "bucket"] != _shape(schema):
            raise ValueError(f"{path} has another schema")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}").select(SCHEMAS[name].names)


def save(df: DataFrame, root: str, name: str, mode: str) -> None:
    """Writes rows of a table in its layout: tables that are rebuilt episode by episode lie in folders by episode."""
    if name in REBUILT:
        df.withColumn("bucket", episode_folder()).hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(f"{root}/{name}")
    else:
        df.write.mode(mode).parquet(f"{root}/{name}")


def write_once(df: DataFrame, path: str) -> None:
    """Writes df unless path is there already; an edited reference is never overwritten."""
    df.write.mode("ignore").parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written on the first call: slow inference runs once."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Evaluation results as JSON, one file a run."""
    df.coalesce(1).write.mode("overwrite").json(path)


#: Parents before children.
COPY_ORDER = ("episodes", "jobs", "chunks", "passages")


def copy_all(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """Copies the tables with their ids to a target that must hold none, verifies each by an order-free fingerprint, and
    returns the next free id of the tables that have ids. The search index is made anew from the copy when it is next asked for."""
    taken = [name for name in COPY_ORDER if exists(spark, f"{target}/{name}") and not load(spark, target, name).isEmpty()]
    if taken:
        raise ValueError(f"{target} is not empty: {', '.join(taken)}")
    free = {}
    for name in COPY_ORDER:
        rows = load(spark, source, name)
        save(rows, target, name, "overwrite")
        back = load(spark, target, name)
        if wide_fingerprint(rows, *rows.columns).first() != wide_fingerprint(back, *back.columns).first():
            raise ValueError(f"the copy of {name} differs from its source")
        if "id" in back.columns:
            free[name] = next_id(back).first().next_id
    return free


def append(df: DataFrame, root: str, name: str) -> None:
    """Appends rows in the declared column order and types."""
    save(df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]), root, name, "append")
