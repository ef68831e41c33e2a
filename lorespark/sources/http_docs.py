"""Library documentation from a two-step HTTP service (search, then fetch), as a Spark data source.

    spark.dataSource.register(HttpDocs)
    spark.read.format("http_docs").option("base", url).option("topics", "lib:topic,lib:other").load()

Each topic is one partition, so requests run on the executors; any failure gives a null document, never an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "library string, topic string, doc string"
Fetch = Callable[[str], bytes]


def get(url: str, timeout: float = 10.0) -> bytes:
    with urlopen(url, timeout=timeout) as r:
        return r.read()


def fetch_doc(base: str, library: str, topic: str, fetch: Fetch = get) -> str | None:
    """The text of the first hit for a library, on a topic; null if there is none or anything fails."""
    try:
        hits = json.loads(fetch(f"{base}/search?query={quote(library)}")).get("results") or []
        return fetch(f"{base}/{quote(str(hits[0]['id']).strip('/'))}?topic={quote(topic)}").decode() if hits else None
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return None


class Topic(InputPartition):
    def __init__(self, library: str, topic: str) -> None:
        self.library, self.topic = library, topic


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.base = options.get("base", "")
        self.topics = [t.partition(":")[::2] for t in options.get("topics", "").split(",") if t]

    def partitions(self) -> list[Topic]:
        return [Topic(lib, topic or "general") for lib, topic in self.topics]

    def read(self, partition: Topic) -> Iterator[tuple]:
        yield partition.library, partition.topic, fetch_doc(self.base, partition.library, partition.topic)


class HttpDocs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_docs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)
