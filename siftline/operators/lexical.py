"""Candidate retrieval and BM25 over the index tables."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import Index

K1, B = 1.2, 0.75


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def weight(tf: Column, doc_len: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * doc_len / avg_len))


def matching(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the query's terms. The list becomes a predicate that reaches the Parquet scan, and postings are sorted
    by term, so other terms' row groups are not read."""
    return index.postings.where(F.col("term").isin(*sorted(set(terms)))) if terms else index.postings.where(F.lit(False))


def term_counts(index: Index, terms: list[str]) -> DataFrame:
    """shard_id, doc_id, doc_len and tfs (how often each of terms occurs) of every document of an index that is computed from
    its documents. Dealt by document, so that the two uses below share one shuffle of these few numbers instead of analysing
    all texts twice."""
    times = lambda t: F.size(F.filter("found", lambda x: x == t))
    x = index.analysed.select("shard_id", "doc_id", F.size("terms").alias("doc_len"), F.filter("terms", lambda t: t.isin(*terms)).alias("found"))
    return x.select("shard_id", "doc_id", "doc_len", F.array(*map(times, terms)).alias("tfs")).repartition("doc_id")


def candidates(index: Index, terms: list[str]) -> DataFrame:
    """doc_id of the documents that have any of the terms."""
    if index.analysed is None or not terms:
        return matching(index, terms).select("doc_id").distinct()
    return index.analysed.where(F.arrays_overlap("terms", F.array(*map(F.lit, sorted(set(terms)))))).select("doc_id").distinct()


def _stored(index: Index, terms: list[str], own: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits (shard_id, term, doc_id, tf, doc_len), of which the scan reads the terms' postings, and for each term (own, term)
    df, n_docs, avg_len: small by the query's length and the shards, not by the corpus."""
    hits = matching(index, terms).select("shard_id", "term", "doc_id", "tf").join(index.docs, ["shard_id", "doc_id"])
    stats = index.docs.groupBy(*own).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    found = hits.groupBy(*own, "term").agg(F.count(F.lit(1)).alias("df"))
    return hits, found.join(stats, "shard_id") if own else found.join(F.broadcast(stats))


def _computed(index: Index, terms: list[str], own: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same of an index that is computed from its documents."""
    x = term_counts(index, terms)
    each = F.array(*(F.struct(F.lit(t).alias("term"), F.col("tfs")[k].alias("tf")) for k, t in enumerate(terms)))
    # An outer explode, because the filter that Spark infers from another one would go below the shuffle and part the two uses.
    hits = x.select("shard_id", "doc_id", "doc_len", F.explode_outer(each).alias("t")).select("shard_id", "t.term", "doc_id", "t.tf", "doc_len").where("tf > 0")
    has = [F.sum((F.col("tfs")[k] > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))]
    stats = x.groupBy(*own).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"), *has)
    dfs = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"df{k}").alias("df")) for k, t in enumerate(terms)))
    return hits, stats.select(*own, "n_docs", "avg_len", F.explode(dfs).alias("t")).select(*own, "n_docs", "avg_len", "t.*").where("df > 0")


def bm25(index: Index, terms: list[str], scope: str = "global", k1: float = K1, b: float = B) -> DataFrame:
    """shard_id, doc_id, score of all candidates; a term counts as often as the query repeats it.

    scope: whether document counts, frequencies and the average length are those of all documents or of each shard.
    """
    if scope not in ("global", "shard"):
        raise ValueError(f"unknown scope: {scope}")
    own = ["shard_id"] if scope == "shard" else []
    times = Counter(terms)
    hits, frequency = (_stored if index.analysed is None or not times else _computed)(index, sorted(times), own)
    n = F.coalesce(*(F.when(F.col("term") == t, F.lit(float(k))) for t, k in times.items()), F.lit(0.0)) if times else F.lit(0.0)
    frequency = frequency.where("avg_len > 0").withColumn("factor", idf(F.col("n_docs"), F.col("df")) * n)
    scored = hits.join(F.broadcast(frequency), [*own, "term"])  # at most terms x shards rows
    scored = scored.withColumn("w", F.col("factor") * weight(F.col("tf"), F.col("doc_len"), F.col("avg_len"), k1, b))
    return scored.groupBy("shard_id", "doc_id").agg(F.sum("w").alias("score"))


def top(scores: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The best rows, ties by doc_id. A limit of 0 or less gives none."""
    return scores.orderBy(F.desc(score), "doc_id").limit(max(0, limit))


def search(index: Index, terms: list[str], limit: int = 10) -> DataFrame:
    """doc_id, score of the best documents over all shards with statistics of all."""
    return top(bm25(index, terms).select("doc_id", "score"), limit if terms else 0)
