"""One stored shard: validated mutations, each a new segment, and searches."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexical, vectors
from .index import Index, from_terms
from ..sources.storage import Store

#: Documents in one bulk mutation, and results of one search.
BULK, RESULTS = 500, 100
BATCH = "doc_id long, tokens array<string>, embedding array<double>"


def checked_limit(limit: int) -> int:
    if type(limit) is not int or not 1 <= limit <= RESULTS:
        raise ValueError(f"the limit is to be between 1 and {RESULTS}")
    return limit


def duplicates(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n of the keys that several rows have."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked_batch(rows: DataFrame, most: int = BULK) -> int:
    """How many rows (BATCH) a mutation has; raises unless it has 1 to most, with positive ids that are all different."""
    n, bad = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("doc_id") > 0, 0).otherwise(1))).first()
    if not 1 <= n <= most:
        raise ValueError(f"a mutation has 1 to {most} documents, not {n}")
    if bad:
        raise ValueError("document ids are to be positive")
    if duplicates(rows).limit(1).count():
        raise ValueError("document ids are to be different")
    return n


@dataclass
class ShardService:
    """A shard's mutations, one at a time, each published as a segment; a bulk mutation is one publication."""

    store: Store
    shard_id: str
    lock: threading.Lock = field(default_factory=threading.Lock)

    def index(self) -> Index:
        found = self.store.load(self.shard_id)
        if found is None:
            raise LookupError(f"{self.shard_id} has nothing published")
        return found

    def index_documents(self, rows: DataFrame) -> int:
        """Add or replace documents; one without an embedding loses its old vector."""
        n = checked_batch(rows)
        new = from_terms(rows.select(F.lit(self.shard_id).alias("shard_id"), "doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("terms")))
        new.vectors = vectors.checked(rows.where("embedding IS NOT NULL").select(F.lit(self.shard_id).alias("shard_id"), "doc_id", "embedding"))
        with self.lock:
            self.store.append(self.shard_id, new)
        return n

    def delete(self, doc_id: int) -> None:
        with self.lock:
            if not self.contains(doc_id):
                raise KeyError(f"no document {doc_id} in {self.shard_id}")
            self.store.append(self.shard_id, None, self.store.spark.createDataFrame([(doc_id,)], "doc_id long"))

    def clear(self) -> None:
        with self.lock:
            self.store.delete(self.shard_id)

    def contains(self, doc_id: int) -> bool:
        return self.store.manifest(self.shard_id) is not None and self.index().docs.where(F.col("doc_id") == doc_id).limit(1).count() > 0

    def count(self) -> int:
        return self.index().docs.count()

    def health(self, shard_id: str | None = None) -> bool:
        """Whether the shard is ready, and the one that was asked for."""
        return shard_id in (None, self.shard_id) and self.store.is_ready(self.shard_id)

    def search(self, terms: list[str], limit: int = 10) -> DataFrame:
        return lexical.search(self.index(), terms, checked_limit(limit))

    def semantic_search(self, vector: list[float], limit: int = 10) -> DataFrame:
        return vectors.nearest(self.index().vectors, vector, checked_limit(limit))
