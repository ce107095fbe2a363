"""Result pages: metadata, snippets, response envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def with_metadata(results: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """results (doc_id, score) with title, url and snippet; a result without a document keeps its row, with nulls.

    results are a page of top-k rows, of the size that was asked for; documents are the large side and only scanned.
    """
    page = results.select("doc_id", "score")
    found = documents.select("doc_id", "title", "url", "content").join(F.broadcast(page.select("doc_id")), "doc_id", "left_semi")
    found = found.select("doc_id", "title", "url", T.snippet(F.col("content"), query).alias("snippet"), F.lit(True).alias("_found"))
    x = page.join(found, "doc_id", "left")  # two small sides by now
    return x.select("doc_id", "score", "title", "url", F.when(F.col("_found"), F.col("snippet")).alias("snippet"))


def as_json(results: DataFrame) -> DataFrame:
    """A JSON object for each row, without null fields."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("json"))
