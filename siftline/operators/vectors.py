"""Embeddings: validation, cosine similarity, exact nearest neighbours, pluggable models."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bound_batches


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def is_valid(v: Column, dimension: int | None = None) -> Column:
    """Not empty, finite, not zero and, if given, of the dimension."""
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(as_doubles(v)) > 0)
    return F.coalesce(ok if dimension is None else ok & (F.size(v) == dimension), F.lit(False))


def checked(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """vectors (doc_id, embedding) of doubles; a bad one raises when it is read."""
    good = is_valid(F.col("embedding"), dimension) & (F.col("doc_id") > 0)
    return vectors.withColumn("embedding", F.when(good, as_doubles(F.col("embedding"))).otherwise(F.raise_error(F.lit("ids are to be positive, embeddings finite, not zero and of one dimension"))))


def normalised(v: Column) -> Column:
    return F.transform(as_doubles(v), lambda x: x / norm(as_doubles(v)))


def query_vector(values) -> list[float]:
    out = [float(x) for x in values]
    if not out or not all(map(math.isfinite, out)):
        raise ValueError("an embedding is to be finite and not empty")
    if not any(out):
        raise ValueError("cosine similarity with a zero vector is not defined")
    return out


def cosine_scores(vectors: DataFrame, query) -> DataFrame:
    """vectors (doc_id, embedding, ...) with score. The query is a literal in the plan, as wide as one vector: no join, no
    shuffle. Vectors of another dimension raise; zero vectors have no score."""
    q = query_vector(query)
    length = math.sqrt(sum(x * x for x in q))
    literal = F.array(*map(F.lit, q))
    v = as_doubles(F.col("embedding"))
    same = F.when(F.size("embedding") == len(q), v).otherwise(F.raise_error(F.lit("the query's dimension differs from the index's")))
    return vectors.withColumn("score", F.try_divide(dot(same, literal), norm(v) * F.lit(length)))


def nearest(vectors: DataFrame, query, limit: int = 10) -> DataFrame:
    """doc_id, score of the nearest vectors, ties by doc_id. Each task keeps its own best before they meet."""
    if limit <= 0:
        raise ValueError("the limit is to be positive")
    return cosine_scores(vectors, query).select("doc_id", "score").where("score IS NOT NULL").orderBy(F.desc("score"), "doc_id").limit(limit)


class EmbeddingModel(Protocol):
    dimension: int

    def embed(self, text: str) -> list[float]: ...


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


class HashingModel:
    """A deterministic stand-in for a trained model: signed hashes of words, at unit length. Its vectors carry word overlap
    only."""

    def __init__(self, dimension: int = 64):
        if dimension <= 0:
            raise ValueError("the dimension is to be positive")
        self.dimension = dimension

    def embed(self, text: str) -> list[float]:
        if not text or not text.strip():
            raise ValueError("a blank text has no embedding")
        out = [0.0] * self.dimension
        for w in text.lower().split():
            h = _word_hash(w)
            out[h % self.dimension] += 1.0 if h >> 63 else -1.0
        length = math.sqrt(sum(x * x for x in out))
        return [x / length for x in out] if length else [1.0, *out[1:]]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


def embedded(docs: DataFrame, model: EmbeddingModel, content: str = "content") -> DataFrame:
    """doc_id, embedding of the documents whose content isn't blank; an Arrow UDF runs the model a batch at a time."""

    @F.pandas_udf("array<double>")
    def run(s):
        return s.map(model.embed)

    bound_batches(docs.sparkSession)
    return docs.where(F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)\s+", " ")) != "").select("doc_id", run(content).alias("embedding"))
