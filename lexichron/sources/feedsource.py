"""A data source of feeds: one partition a URL, fetched and parsed on the executors, as a batch or as a stream.

    spark.dataSource.register(FeedSource)
    spark.read.format("feeds").option("urls", json.dumps([...])).load()
    spark.readStream.format("feeds").option("list", path).load()

urls: a JSON array of URLs. list: a text file of URLs, one a line, that only grows; a stream's offset is the number of its
lines, so that a restarted stream goes on behind the last one it took. A feed that cannot be fetched or read is one row that
holds its URL and the error, and the other feeds go on. A feed is parsed item by item as it arrives, and is never whole in memory.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feeds import ITEM, episodes_of

SCHEMA = T.StructType([T.StructField("feed_url", T.StringType()), T.StructField("item_pos", T.LongType()), *ITEM.fields, T.StructField("error", T.StringType())])
#: Fixed value: the namespace of a feed's duration.
ITUNES = "{http://www.itunes.com/dtds/podcast-1.0.dtd}"
TIMEOUT_S, TRIES = 20.0, 3


class Url(InputPartition):
    def __init__(self, url: str):
        self.url = url


def items_of(url: str, timeout: float = TIMEOUT_S) -> Iterator[tuple]:
    """The items of one feed as rows of SCHEMA."""
    text = lambda item, name: getattr(item.find(name), "text", None)
    with urllib.request.urlopen(url, timeout=timeout) as got:  # noqa: S310
        n = 0
        for _, item in ET.iterparse(got, events=("end",)):  # noqa: S314
            if item.tag != "item":
                continue
            audio = [(e.get("url"), e.get("type")) for e in item.findall("enclosure")]
            yield url, n, text(item, "title"), text(item, "guid"), text(item, "pubDate"), audio, text(item, f"{ITUNES}duration"), None
            item.clear()
            n += 1


def fetched(url: str, timeout: float = TIMEOUT_S, tries: int = TRIES, sleep=time.sleep) -> Iterator[tuple]:
    """items_of, tried again after network and server errors before the first item has come; else a row with the error."""
    for turn in range(tries):
        some = False
        try:
            for row in items_of(url, timeout):
                some = True
                yield row
            return
        except (OSError, ET.ParseError, ValueError) as e:
            final = isinstance(e, (ET.ParseError, ValueError)) or (isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code != 429)
            if some or final or turn == tries - 1:
                yield url, None, None, None, None, None, None, f"{type(e).__name__}: {e}"
                return
            sleep(2**turn)


class _Read:
    def __init__(self, options: dict):
        self.timeout = float(options.get("timeout", TIMEOUT_S))

    def read(self, partition: Url) -> Iterator[tuple]:
        return fetched(partition.url, self.timeout)


class _Batch(_Read, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.urls = json.loads(options["urls"])

    def partitions(self) -> list[InputPartition]:
        return [Url(u) for u in self.urls]


class _Stream(_Read, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.list = options["list"]

    def _urls(self) -> list[str]:
        with open(self.list, encoding="utf-8") as f:
            return [x.strip() for x in f if x.endswith("\n")]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"lines": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"lines": len(self._urls())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Url(u) for u in self._urls()[start["lines"] : end["lines"]] if u]

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def read_feeds(spark: SparkSession, urls: list[str], timeout: float = TIMEOUT_S) -> tuple[DataFrame, DataFrame]:
    """The episodes of many feeds, as feeds.read_feed gives them, and feed_url, error of the feeds that failed."""
    spark.dataSource.register(FeedSource)
    rows = spark.read.format("feeds").option("urls", json.dumps(urls)).option("timeout", timeout).load()
    return episodes_of(rows.filter("error IS NULL"), F.col("feed_url")), rows.filter("error IS NOT NULL").select("feed_url", "error")


def stream_feeds(spark: SparkSession, path: str, timeout: float = TIMEOUT_S) -> DataFrame:
    """The items of the feeds in a growing list, as a stream."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("feeds").option("list", path).option("timeout", timeout).load()
