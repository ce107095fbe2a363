"""Repair: what the index lacks, in batches for each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import Index


def missing(documents: DataFrame, index: Index, shard: Column) -> DataFrame:
    """documents with shard_id that their own shard lacks; versions aren't compared."""
    x = documents.withColumn("shard_id", shard)
    return x.join(index.docs.select("shard_id", "doc_id"), ["shard_id", "doc_id"], "left_anti").select(*documents.columns, "shard_id")


def orphans(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Vectors whose document isn't there."""
    return vectors.join(docs.select("doc_id"), "doc_id", "left_anti")


def batches(missing_docs: DataFrame, size: int = 100) -> DataFrame:
    """shard_id, doc_id, batch: runs of size documents of a shard in the order of ids.

    Ranges of ids come first and are counted, so that no task orders a whole shard.
    """
    if size <= 0:
        raise ValueError("the batch size is to be positive")
    ranged = missing_docs.select("shard_id", "doc_id").withColumn("_range", F.floor(F.col("doc_id") / F.lit(65536)))
    before = Window.partitionBy("shard_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("shard_id", "_range").agg(F.count(F.lit(1)).alias("_n")).select("shard_id", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    at = F.row_number().over(Window.partitionBy("shard_id", "_range").orderBy("doc_id")) - 1 + F.col("_base")
    return ranged.join(base, ["shard_id", "_range"]).select("shard_id", "doc_id", F.floor(at / size).cast("long").alias("batch"))
