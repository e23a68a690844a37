"""Command line: python -m lexichron COMMAND.

Commands over a store (--store, a folder of the library's own tables) read and write it: ingest, index, search, worker,
status, copy-data. The others print the rows of registered queries over a folder of parquet tables (--data).
"""

from __future__ import annotations

import argparse
import importlib
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import registry
from .operators import catalogue, jobs
from .operators.transcribe import drain
from .schemas import SCHEMAS
from .session import clear_written, session, written
from .sources import index, store
from .sources.feeds import newest
from .sources.feedsource import read_feeds

#: Commands and the registered queries behind them.
COMMANDS = {
    "ask": ["ask"],
    "eval-retrieval": ["retrieval_eval"],
    "eval-answers": ["answers_eval"],
    "eval-signals": ["signal_summary"],
    "eval-wer": ["wer_pooled", "top_substitutions"],
    "usage": ["usage_daily"],
}


def numbered(rows: DataFrame, table: DataFrame, *order: str) -> DataFrame:
    """rows with ids behind those of table; rows are a feed's new ones, a bounded number."""
    free = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    return rows.crossJoin(F.broadcast(free)).withColumn("id", F.col("last") + F.row_number().over(Window.orderBy(*order))).drop("last")


def ingest(spark: SparkSession, root: str, urls: list[str], limit: int | None = None) -> dict[str, int]:
    """Stores the newest episodes of feeds that are not there yet, with a job each."""
    found, failed = read_feeds(spark, urls)
    episodes, queue = store.load(spark, root, "episodes"), store.load(spark, root, "jobs")
    rows = written(numbered(newest(found, limit), episodes, "feed_url", "ord"))
    new, wanted = catalogue.save_episodes(rows, episodes, queue, order="id")
    new, wanted = written(new), written(numbered(wanted, queue, "episode_id"))
    none = F.lit(None)
    job = wanted.withColumns({"status": F.lit("queued"), "attempts": F.lit(0), "lease": F.lit(0), "max_attempts": F.lit(3), "run_after": F.current_timestamp(), "locked_at": none, "locked_by": none, "last_error": none})
    store.append(new, root, "episodes")
    store.append(job, root, "jobs")
    return {"new": new.count(), "skipped": rows.count() - new.count(), "failed_feeds": failed.count()}


def worker(spark: SparkSession, root: str, run: str, workers: int, until_empty: bool) -> None:
    """Drains the stored queue; run names a function module:name that takes claimed jobs and returns id, error, retry_after,
    and stores what it makes."""
    module, _, name = run.partition(":")
    work = getattr(importlib.import_module(module), name)

    def save(after: DataFrame) -> DataFrame:
        kept = written(after.select(SCHEMAS["jobs"].names))
        store.save(kept, root, "jobs", "overwrite")
        return store.load(spark, root, "jobs")

    drain(store.load(spark, root, "jobs"), workers, work, save, lambda: F.current_timestamp(), time.sleep, until_empty)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexichron")
    parser.add_argument("command", choices=[*COMMANDS, "query", "ingest", "index", "search", "worker", "status", "copy-data"])
    parser.add_argument("names", nargs="*", help="query names; for ingest feed URLs, for search a question, for copy-data the target")
    parser.add_argument("--data", help="folder of the parquet tables")
    parser.add_argument("--store", help="folder of the library's own tables; made where it is missing")
    parser.add_argument("--rows", type=int, default=20, help="rows to print")
    parser.add_argument("--mode", default="hybrid", choices=["keyword", "vector", "hybrid", "rerank"])
    parser.add_argument("--limit", type=int, help="newest episodes a feed")
    parser.add_argument("--run", help="for worker: module:function that handles claimed jobs")
    parser.add_argument("--workers", type=int, default=1)
    parser.add_argument("--until-empty", action="store_true")
    args = parser.parse_args(argv)
    stored = args.command in ("ingest", "index", "search", "worker", "status", "copy-data")
    if not (args.store if stored else args.data):
        parser.error(f"{args.command} needs {'--store' if stored else '--data'}")
    spark = spark or session()
    if stored:
        store.apply_schema(spark, args.store)
    if args.command == "ingest":
        print(ingest(spark, args.store, args.names, args.limit))
    elif args.command == "index":
        print(index.index_new(spark, args.store))
    elif args.command == "search":
        q = spark.createDataFrame([(1, " ".join(args.names))], "query_id long, question string")
        index.search_stored(spark, args.store, q, args.mode, args.rows).orderBy("rank").drop("query_id").show(args.rows, truncate=80)
    elif args.command == "worker":
        worker(spark, args.store, args.run, args.workers, args.until_empty)
    elif args.command == "status":
        jobs.status_report(store.load(spark, args.store, "jobs")).show()
        jobs.unfinished(store.load(spark, args.store, "jobs")).show()
    elif args.command == "copy-data":
        print(store.copy_all(spark, args.store, args.names[0]))
    else:
        known = registry.queries()
        for name in COMMANDS.get(args.command, args.names):
            known[name](spark, args.data).show(args.rows, truncate=60)
    clear_written()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
