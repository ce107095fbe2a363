"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import default_tokenizer, encoder
from .shared import land, table, text_of

#: Lengths in one bucket of the two-level sums.
BUCKET = 1024


def with_token_count(docs: DataFrame, tokenizer: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of ids of each whole text, however long, in a column out (one of that name is replaced). A null
    or empty text has 0; repeated rows stay; an empty table gives no rows."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with encoder(path) as e:
            for texts in batches:
                yield pd.Series(e.counts(pa.array(texts, pa.large_string(), from_pandas=True)), index=texts.index)

    return docs.withColumn(out, counts(text_of(text)))


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs: how many rows have each length; rows without a length are one with a null length. Partial counts are
    made before the shuffle, so no length is hot."""
    return lengths.groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit: n_docs of just that length, docs_at_least and tokens_at_least
    (suffix sums, L included), truncated_tokens (all texts cut to L ids), cut_docs (longer than L) and quantile (the share
    of documents of at most L ids). Sums are in two levels, lengths within buckets and buckets, so that no task needs all.
    An empty histogram gives no rows.
    """
    h = histogram.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    buckets = buckets.select("bucket", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("d", "t")), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    within = Window.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    x = h.join(buckets, "bucket").withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("d_after")).withColumn("tokens_at_least", F.sum("tokens").over(within) + F.col("t_after"))
    return x.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("docs_at_least") - F.col("n_docs")).alias("cut_docs"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_tokens, cut_docs for limits that need not occur as lengths; one pass over the histogram."""
    h = histogram.withColumn("limit", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))))
    return h.groupBy("limit").agg(F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_tokens"), F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("cut_docs"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every context limit's figures over all documents."""
    return context_totals(land(length_histogram(with_token_count(table(spark, sf_dir, "documents").select("text"))), "lengths"))
