"""Search over published generations: opened once, or built from documents and published, then searched many times."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ring
from ..functions import text as T
from ..operators.coordinator import Coordinator, WindowPolicy
from ..operators.index import Index, build
from ..operators.reconcile import batches, missing
from ..operators.service import checked_limit
from ..operators.vectors import EmbeddingModel, embedded
from ..sources.storage import Store

MODES = ("lexical", "semantic", "hybrid")


def joined(parts: list[Index]) -> Index:
    """One index of several shards'."""
    union = lambda tables: reduce(lambda a, b: a.unionByName(b), tables) if tables else None
    return Index(union([p.postings for p in parts]), union([p.docs for p in parts]), union([p.vectors for p in parts if p.vectors is not None]))


@dataclass
class Engine:
    """Searches over stored postings: the query's terms are predicates that reach the scan of files sorted by term."""

    index: Index
    stems: bool = True
    model: EmbeddingModel | None = None
    policy: WindowPolicy = WindowPolicy()
    scope: str = "global"

    @classmethod
    def open(cls, spark: SparkSession, root: str, documents: Callable[[], DataFrame], shards: tuple[str, ...] = ("shard-0",), vectors: DataFrame | None = None, stems: bool = True, **options) -> Engine:
        """The published generations under root; shards without one are built from documents (doc_id, title, content) and
        vectors (doc_id, embedding), and published."""
        store = Store(spark, root)
        lacking = [s for s in shards if not store.is_ready(s)]
        if lacking:
            own = ring.shard_of(F.col("doc_id"), list(shards))
            new = build(documents(), T.lexical_text(F.col("title"), F.col("content")), stems, shard=own)
            if vectors is not None:
                new.vectors = vectors.select(own.alias("shard_id"), "doc_id", "embedding")
            store.publish_all(lacking, new)
        return cls(joined([store.load(s) for s in shards]), stems, **options)

    def search(self, query: str, mode: str = "hybrid", limit: int = 10, vector: list[float] | None = None) -> DataFrame:
        """doc_id, score. A blank query has no results; without a vector the model embeds the query."""
        if mode not in MODES:
            raise ValueError(f"the mode is to be one of {', '.join(MODES)}")
        checked_limit(limit)
        c = Coordinator(self.index, self.policy, scope=self.scope)
        if mode == "lexical":
            return c.lexical(query, T.analyze(query, self.stems), limit)
        if query.strip() and vector is None:
            if self.model is None:
                raise ValueError("a query without a vector needs a model")
            vector = self.model.embed(query)
        return c.semantic(query, vector, limit) if mode == "semantic" else c.hybrid(query, T.analyze(query, self.stems), vector, limit)


def complete(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents of ids (doc_id); raises if there is an id without one."""
    lost = ids.join(documents.select("doc_id"), "doc_id", "left_anti").limit(5).collect()
    if lost:
        raise LookupError(f"no document for ids such as {[r['doc_id'] for r in lost]}")
    return documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def bootstrap(store: Store, documents: DataFrame, shards: tuple[str, ...], batch: int = 100, model: EmbeddingModel | None = None, stems: bool = True) -> DataFrame:
    """Index what each shard lacks of documents (doc_id, title, content), as one segment a shard.

    shard_id, n_missing, n_batches (of batch documents), n_embedded for every shard. Versions aren't compared. Documents
    with blank content have no vector; without a model none has.
    """
    own = ring.shard_of(F.col("doc_id"), list(shards))
    stored = [store.load(s) for s in shards if store.is_ready(s)]
    spark = store.spark
    have = joined(stored) if stored else Index(spark.createDataFrame([], "shard_id string, term string, doc_id long"), spark.createDataFrame([], "shard_id string, doc_id long, doc_len int"))
    lacking = store.landed(missing(documents, have, own), "bootstrap-missing")
    new = build(lacking, T.lexical_text(F.col("title"), F.col("content")), stems, shard=F.col("shard_id"))
    if model is not None:
        new.vectors = store.landed(embedded(lacking, model).withColumn("shard_id", own), "bootstrap-vectors")
    counts = batches(lacking, batch).groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_missing"), F.countDistinct("batch").alias("n_batches"))
    todo = [r["shard_id"] for r in lacking.select("shard_id").distinct().collect()]  # shards
    new = store.prepared(new)
    for shard in todo:
        store.append(shard, new)
    n = new.vectors.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_embedded")) if new.vectors is not None else spark.createDataFrame([], "shard_id string, n_embedded long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return spark.createDataFrame([(s,) for s in shards], "shard_id string").join(counts, "shard_id", "left").join(n, "shard_id", "left").select("shard_id", *map(zero, ("n_missing", "n_batches", "n_embedded")))
