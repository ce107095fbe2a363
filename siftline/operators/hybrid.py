"""Fusion of lexical and semantic scores: min-max normalisation over the candidates, weights, full outer join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top


def weights(lexical: float, semantic: float) -> tuple[float, float]:
    if not all(map(math.isfinite, (lexical, semantic))) or min(lexical, semantic) < 0 or lexical + semantic <= 0:
        raise ValueError("weights are to be finite, not negative and not both zero")
    return lexical / (lexical + semantic), semantic / (lexical + semantic)


def normalised(scores: DataFrame) -> DataFrame:
    """doc_id, score between 0 and 1. A single candidate has 1; equal scores of several have 0. A score that isn't finite
    raises."""
    finite = F.when(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score")).otherwise(F.raise_error(F.lit("scores are to be finite")).cast("double"))
    x = scores.select("doc_id", finite.alias("score"))
    bounds = x.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("n"))  # one row
    flat = F.when(F.col("n") == 1, 1.0).otherwise(0.0)
    return x.join(F.broadcast(bounds)).select("doc_id", F.when(F.col("low") == F.col("high"), flat).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).alias("score"))


def fused(lexical: DataFrame, semantic: DataFrame, lexical_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    """doc_id, score of every candidate of either side; a missing side counts 0."""
    a, b = weights(lexical_weight, semantic_weight)
    left = normalised(lexical).withColumnRenamed("score", "x")
    right = normalised(semantic).withColumnRenamed("score", "y")
    return left.join(right, "doc_id", "full_outer").select("doc_id", (F.lit(a) * F.coalesce("x", F.lit(0.0)) + F.lit(b) * F.coalesce("y", F.lit(0.0))).alias("score"))


def rank(lexical: DataFrame, semantic: DataFrame, limit: int, lexical_weight: float = 0.5, semantic_weight: float = 0.5) -> DataFrame:
    return top(fused(lexical, semantic, lexical_weight, semantic_weight), limit)
