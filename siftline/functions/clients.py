"""What callers plug in: page fetchers, shard clients, index persistence; bounded retries; shard maps."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame

from ..operators.index import Index


class Fetcher(Protocol):
    """Gets a page's HTML; raises if it can't be had. It is sent to tasks, so it is to be picklable."""

    def fetch(self, url: str) -> str: ...


class ShardSearchClient(Protocol):
    """Searches one shard: doc_id, score rows."""

    shard_id: str

    def search(self, query: str, limit: int) -> DataFrame: ...

    def semantic_search(self, vector: list[float], limit: int) -> DataFrame: ...

    def health(self) -> bool: ...


class ShardIndexClient(Protocol):
    """Takes one shard's mutations."""

    shard_id: str

    def index_documents(self, rows: DataFrame) -> int: ...

    def delete(self, doc_id: int) -> None: ...


class IndexPersistence(Protocol):
    """Keeps generations of shards; sources.storage.Store is one."""

    def publish(self, shard_id: str, index: Index) -> Any: ...

    def load(self, shard_id: str) -> Index | None: ...


@dataclass(frozen=True)
class HttpFetcher:
    """GET with a user agent and a time-out; any status but 2xx raises."""

    user_agent: str = "siftline/1.0"
    timeout: float = 10.0

    def fetch(self, url: str) -> str:
        request = urllib.request.Request(url, headers={"User-Agent": self.user_agent})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            if not 200 <= answer.status < 300:
                raise OSError(f"status {answer.status}")
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


class Retryable(Exception):
    """A failure that another try may mend."""


@dataclass(frozen=True)
class RetryPolicy:
    """Tries again after retryable failures, each time after a longer pause."""

    retries: int = 0
    backoff: float = 0.05

    def __post_init__(self):
        if self.retries < 0 or self.backoff < 0:
            raise ValueError("retries and backoff are not to be negative")

    def total_backoff(self) -> float:
        """Seconds of all pauses, at most: the n-th is n times the backoff."""
        return self.backoff * self.retries * (self.retries + 1) / 2

    def run(self, call: Callable[[], Any], sleep: Callable[[float], None] = time.sleep) -> Any:
        for attempt in range(1, self.retries + 1):
            try:
                return call()
            except Retryable:
                sleep(self.backoff * attempt)
        return call()


def shard_map(text: str) -> dict[str, str]:
    """Shards and their addresses from `id=url,id=url`; empty entries are passed over."""
    out = {}
    for entry in filter(None, map(str.strip, text.split(","))):
        name, equals, url = (x.strip() for x in entry.partition("="))
        if not (name and equals and url):
            raise ValueError(f"not an entry of the form id=url: {entry!r}")
        out[name] = url
    if not out:
        raise ValueError("no shard is named")
    return out
