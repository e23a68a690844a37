"""Catalogue writes: insert if absent, checkpoints, atomic replacement, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import delete, written
from .jobs import enqueue


def insert_if_absent(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to append: the first of each key in the given order, unless existing has the key."""
    first = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n").join(existing.select(key).distinct(), key, "left_anti")


def ingest_counts(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """new, skipped: rows that insert_if_absent appends, and all others (also repeats within rows)."""
    total = rows.agg(F.count("*").alias("total"))
    new = insert_if_absent(rows, existing, key, order).agg(F.count("*").alias("new"))
    return new.crossJoin(total).select("new", (F.col("total") - F.col("new")).alias("skipped"))  # one row each


def checkpoint_diff(saved: DataFrame, plan: DataFrame) -> DataFrame:
    """episode_id, idx of the plan's chunks that must be made (again).

    saved and plan: episode_id, idx, start_ms, end_ms, sha256. If any saved chunk of an episode is not in the plan by
    exact place, or has another digest, none of the episode's chunks survive.
    """
    keys = ["episode_id", "idx", "start_ms", "end_ms"]
    p = plan.withColumnRenamed("sha256", "plan_sha256")
    judged = saved.join(p, keys, "left").withColumn("bad", F.coalesce(F.col("sha256") != F.col("plan_sha256"), F.lit(True)))
    stale = judged.groupBy("episode_id").agg(F.max("bad").alias("stale")).filter("stale")
    kept = saved.join(stale, "episode_id", "left_anti")
    return plan.join(kept, keys, "left_anti").select("episode_id", "idx")


def to_index(jobs: DataFrame, passages: DataFrame) -> DataFrame:
    """episode_id of finished transcriptions without passages."""
    done = jobs.filter("status = 'done' AND kind = 'transcribe'").select("episode_id").distinct()
    return done.join(passages.select("episode_id"), "episode_id", "left_anti")


def searchable(episodes: DataFrame, passages: DataFrame) -> DataFrame:
    """Episodes that have passages."""
    return episodes.join(passages.select(F.col("episode_id").alias("id")), "id", "left_semi")


def cascade(children: DataFrame, deleted: DataFrame, key: str = "episode_id") -> DataFrame:
    """The children that stay when their parents in deleted(id) go."""
    return children.join(deleted.select(F.col("id").alias(key)), key, "left_anti")


def save_episodes(rows: DataFrame, episodes: DataFrame, jobs: DataFrame, order: str = "ord", kind: str = "transcribe") -> tuple[DataFrame, DataFrame]:
    """(episodes to append, jobs to append) of a feed's rows(id, dedup_key, …): an episode that is new gets its job in the
    same step; one that is there already gets neither."""
    new = insert_if_absent(rows, episodes, "dedup_key", order)
    return new, enqueue(jobs, new.select(F.col("id").alias("episode_id"), F.lit(kind).alias("kind")))


def update_durations(episodes: DataFrame, measured: DataFrame) -> DataFrame:
    """episodes with the duration that was measured in measured(episode_id, duration_seconds), where there is one."""
    m = measured.groupBy(F.col("episode_id").alias("id")).agg(F.max("duration_seconds").alias("__measured"))
    both = episodes.join(m, "id", "left")
    return both.withColumn("duration_seconds", F.coalesce("__measured", "duration_seconds")).select(episodes.columns)


#: Episodes of a folder of a table whose rows are replaced episode by episode.
FOLDER_EPISODES = 4_096


def episode_folder(size: int = FOLDER_EPISODES) -> Column:
    """Neighbouring episodes share a folder, so new ones fill the last folders and the table's size sets their number."""
    return F.floor(F.col("episode_id") / size)


def rebuild_rows(made: DataFrame, rebuilt: DataFrame, path: str, schema: StructType, size: int = FOLDER_EPISODES) -> int:
    """Puts the rows made for the episodes in rebuilt(episode_id) in place of all they had, also where none were made; returns
    the number of folders that were written anew.

    Rows of episodes that had none are appended, and no stored file changes. Only folders that hold rows of a rebuilt episode
    are written anew, each swapped whole, and one that is left without rows goes.
    """
    spark = made.sparkSession
    folder = episode_folder(size)
    ids = rebuilt.select("episode_id").distinct()
    stored = spark.read.schema(schema).parquet(path)
    stale = [r[0] for r in stored.select("episode_id").join(ids, "episode_id", "left_semi").select(folder.alias("f")).distinct().collect()]  # folders, not episodes
    made = made.select(*schema.names, folder.alias("bucket"))
    if stale:
        made = written(made)
        before = stored.withColumn("bucket", folder).filter(F.col("bucket").isin(stale))
        kept = before.join(ids, "episode_id", "left_anti").select(*schema.names, "bucket")
        after = written(kept.unionByName(made.filter(F.col("bucket").isin(stale))))
        after.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        filled = {r[0] for r in after.select("bucket").distinct().collect()}
        for f in sorted(set(stale) - filled):
            delete(spark, f"{path}/bucket={f}")
    new = made.filter(~F.col("bucket").isin(stale)) if stale else made
    new.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return len(stale)
