"""Training-data pipeline over the documents table.

Five stages, each an operator of siftline.llm over all that the stage before it kept: quality rules (rejected documents
go), near copies by SimHash (one document of each group stays), benchmark decontamination (documents with a window of any
item go), the mix of sources to their target weights (a row for each document, pass and shard, with the words taken, in the
shards' order), and token ids written as Parquet in that order and read back.

Null texts, sources and ids, empty tables, repeated rows and extra columns have in each stage the result that its
operator's docstring states; a row with a null doc_id is kept by all but the quality rules' and decontamination's verdict on
its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm.decontamination import decontaminate
from siftline.llm.mixing import mixed_documents
from siftline.llm.quality_rules import kept_documents
from siftline.llm.shared import land, shared_path, table
from siftline.llm.simhash import without_near_copies
from siftline.llm.token_output import as_stored, token_digest, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "pipeline-tokens")
    write_tokens(docs, path, order=as_stored(docs))  # shards stay whole, and in the order that the mix gave them
    return token_digest(spark, path)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", benchmark), ("mix_sources", mix), ("token_output", tokens)]

#: SQL expresses none of learned rules, fingerprints and the vocabulary's ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what the one before it wrote to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = land(docs, f"pipeline-{name}")
    return docs
