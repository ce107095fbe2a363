"""Search over shards: per-shard windows, merging by the best score, partial results as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hybrid, lexical, vectors
from .index import Index


@dataclass(frozen=True)
class WindowPolicy:
    """How many candidates each shard gives for a final limit."""

    factor: int = 5
    least: int = 50
    most: int | None = None

    def __post_init__(self):
        if self.factor <= 0 or self.least <= 0 or self.most is not None and self.most < max(1, self.least):
            raise ValueError("factor and bounds are to be positive, and the upper bound not below the lower")

    def window(self, limit: int) -> int:
        if limit <= 0:
            raise ValueError("the limit is to be positive")
        wanted = max(limit * self.factor, self.least)
        return wanted if self.most is None else min(wanted, self.most)


def shard_window(scores: DataFrame, size: int) -> DataFrame:
    """Each shard's best rows, ties by doc_id; Spark cuts each task's rows before the exchange."""
    best = Window.partitionBy("shard_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("_row", F.row_number().over(best)).where(F.col("_row") <= size).drop("_row")


def best_of_shards(scores: DataFrame) -> DataFrame:
    """doc_id, score: of a document on several shards the best."""
    return scores.groupBy("doc_id").agg(F.max("score").alias("score"))


def answering(scores: DataFrame, status: DataFrame | None, source: str) -> DataFrame:
    """Rows of the shards whose status for the source is ok; without status all are."""
    if status is None:
        return scores
    ok = status.where((F.col("source") == source) & (F.col("status") == "ok")).select("shard_id")
    return scores.join(F.broadcast(ok), "shard_id", "left_semi")  # a row for each shard


def shard_summary(status: DataFrame) -> DataFrame:
    """total, successful, failed, timed_out shards and partial. A shard counts once: timed out before failed before ok."""
    each = status.groupBy("shard_id").agg(F.max(F.when(F.col("status") == "timed_out", 2).when(F.col("status") == "failed", 1).otherwise(0)).alias("worst"))
    count = lambda k: F.coalesce(F.sum((F.col("worst") == k).cast("long")), F.lit(0).cast("long"))
    return each.agg(F.count(F.lit(1)).alias("total_shards"), count(0).alias("successful_shards"), count(1).alias("failed_shards"), count(2).alias("timed_out_shards")).withColumn("partial", F.col("successful_shards") < F.col("total_shards"))


@dataclass
class Coordinator:
    """Three searches over an index whose rows carry their shard. status: (shard_id, source, status) as data, or None."""

    index: Index
    policy: WindowPolicy = WindowPolicy()
    allow_partial: bool = True
    status: DataFrame | None = None
    scope: str = "shard"
    lexical_weight: float = 0.5
    semantic_weight: float = 0.5

    def _check(self, limit: int) -> None:
        if limit <= 0:
            raise ValueError("the limit is to be positive")
        if self.status is not None and not self.allow_partial and self.status.where("status <> 'ok'").limit(1).count():
            raise RuntimeError("a shard did not answer")

    def _none(self) -> DataFrame:
        return self.index.docs.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))

    def lexical(self, query: str, terms: list[str], limit: int = 10) -> DataFrame:
        if not query.strip():
            return self._none()
        self._check(limit)
        scores = answering(lexical.bm25(self.index, terms, self.scope), self.status, "lexical")
        return lexical.top(best_of_shards(shard_window(scores, limit)), limit)

    def semantic(self, query: str, vector, limit: int = 10) -> DataFrame:
        if not query.strip():
            return self._none()
        self._check(limit)
        scores = answering(vectors.cosine_scores(self.index.vectors, vector).select("shard_id", "doc_id", "score"), self.status, "semantic")
        return lexical.top(best_of_shards(shard_window(scores, limit)), limit)

    def hybrid(self, query: str, terms: list[str], vector, limit: int = 10) -> DataFrame:
        if not query.strip():
            return self._none()
        self._check(limit)
        window = self.policy.window(limit)
        lex = answering(lexical.bm25(self.index, terms, self.scope), self.status, "lexical")
        sem = answering(vectors.cosine_scores(self.index.vectors, vector).select("shard_id", "doc_id", "score"), self.status, "semantic")
        return hybrid.rank(best_of_shards(shard_window(lex, window)), best_of_shards(shard_window(sem, window)), limit, self.lexical_weight, self.semantic_weight)
