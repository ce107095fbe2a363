"""The inverted index as tables: postings, document statistics, shard statistics; replace, remove, merge."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import bound_batches

#: Texts that one task turns into postings are a few MB each; postings are sorted by term so that row groups prune.
POSTING = ("shard_id", "term", "doc_id", "tf", "positions")


@dataclass
class Index:
    """postings(shard_id, term, doc_id, tf, positions), docs(shard_id, doc_id, doc_len), vectors(shard_id, doc_id, embedding),
    and, of an index that isn't stored, analysed(shard_id, doc_id, terms), which it is computed from; gone(doc_id) are
    documents of earlier segments that a stored segment removes."""

    postings: DataFrame
    docs: DataFrame
    vectors: DataFrame | None = None
    analysed: DataFrame | None = None
    gone: DataFrame | None = None
    prepared: bool = False  # analysed is a table that was written

    def __setattr__(self, name, value):
        object.__setattr__(self, name, value)
        if name in ("postings", "docs"):  # other tables than those made from the documents
            object.__setattr__(self, "analysed", None)

    def shards(self) -> DataFrame:
        """shard_id, n_docs, total_len, avg_len; documents without terms count."""
        return self.docs.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("total_len")).withColumn("avg_len", F.col("total_len") / F.col("n_docs"))

    def document_frequency(self) -> DataFrame:
        if self.analysed is not None:  # positions aren't needed
            return self.analysed.select(F.explode(F.array_distinct("terms")).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def vocabulary_size(self) -> DataFrame:
        return self.document_frequency().agg(F.count(F.lit(1)).alias("n_terms"))

    def contains(self, doc_ids: DataFrame) -> DataFrame:
        return doc_ids.join(self.docs.select("doc_id"), "doc_id", "left_semi")


def with_terms(docs: DataFrame, text: Column, stems: bool = False, normalise: bool = True, shard: Column | None = None) -> DataFrame:
    """shard_id, doc_id, terms of each document."""
    bound_batches(docs.sparkSession)
    found = T.stemmed(text, normalise) if stems else T.terms(text, normalise)
    return docs.select((F.lit("shard-0") if shard is None else shard).alias("shard_id"), "doc_id", found.alias("terms"))


def _cut(terms: pa.Array, late: pa.Array | None = None) -> pa.Array:
    """(term, positions) of each document's terms, but those that late has. Words are numbered once a batch; a stable sort of
    (document, word) brings each posting's positions together, in order."""
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = terms.flatten().dictionary_encode()
    codes = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    blank = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    kept = np.flatnonzero((codes >= 0) & (codes != blank))
    key = row[kept] * max(1, len(words.dictionary)) + codes[kept]
    order = np.argsort(key, kind="stable")
    key, kept = key[order], kept[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(kept)), pa.int32()), pa.array(place[kept], pa.int32()))
    entries = pa.StructArray.from_arrays([words.dictionary.take(pa.array(codes[kept[starts]])), positions], ["term", "positions"])
    entry_row = row[kept[starts]]
    if late is not None:
        sizes = pc.fill_null(pc.list_value_length(late), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        other = pc.fill_null(pc.index_in(late.flatten(), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        gone = (np.repeat(np.arange(len(sizes)), sizes) * max(1, len(words.dictionary)) + other)[other >= 0]
        stay = ~np.isin(key[starts], gone)
        entries, entry_row = entries.filter(pa.array(stay)), entry_row[stay]
    ends = np.searchsorted(entry_row, np.arange(len(lengths) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


def _postings(terms: Column, late: Column | None = None) -> Column:
    """An array of (term, positions) of one document's terms, without the terms of the list late."""
    kind = "array<struct<term: string, positions: array<int>>>"

    def each(terms: pa.Array) -> pa.Array:
        return _cut(terms)

    def less(terms: pa.Array, late: pa.Array) -> pa.Array:
        return _cut(terms, late)

    return F.arrow_udf(each, kind)(terms) if late is None else F.arrow_udf(less, kind)(terms, late)


def build(docs: DataFrame, text: Column, stems: bool = False, normalise: bool = True, shard: Column | None = None) -> Index:
    """Index of docs (doc_id and what text and shard refer to), without a shuffle: all postings of a document are made from
    its own row, in the time that sorting its terms takes."""
    return from_terms(with_terms(docs, text, stems, normalise, shard))


def _exploded(analysed: DataFrame, entries: Column) -> DataFrame:
    postings = analysed.select("shard_id", "doc_id", F.explode(entries).alias("p"))
    return postings.select("shard_id", "p.term", "doc_id", F.size("p.positions").alias("tf"), "p.positions").select(*POSTING)


def from_terms(analysed: DataFrame) -> Index:
    """Index of analysed documents (shard_id, doc_id, terms; doc_len, if it is there, is the number of terms)."""
    bound_batches(analysed.sparkSession)
    return Index(_exploded(analysed, _postings(F.col("terms"))), analysed.select("shard_id", "doc_id", F.col("doc_len") if "doc_len" in analysed.columns else F.size("terms").alias("doc_len")), analysed=analysed)


def removed(index: Index, doc_ids: DataFrame) -> Index:
    """The index without some documents; terms that no document has any more go by themselves."""
    gone = doc_ids.select("doc_id").distinct()
    drop = lambda df: df.join(gone, "doc_id", "left_anti").select(*df.columns)
    return Index(drop(index.postings), drop(index.docs), None if index.vectors is None else drop(index.vectors))


def replaced(index: Index, new: Index) -> Index:
    """The index with new's documents added or put in place of their old ones. A document without a new vector loses its
    old one."""
    old = removed(index, new.docs)
    vectors = old.vectors if new.vectors is None else new.vectors if old.vectors is None else old.vectors.unionByName(new.vectors)
    return Index(old.postings.unionByName(new.postings), old.docs.unionByName(new.docs), vectors)


def merge(segments: list[Index], mode: str = "replace") -> Index:
    """One index of several, later ones winning.

    replace: a document's postings, length and vector all come from the last segment that has it. legacy: the last writer
    wins for each (term, document) and each length, so that old terms of a redefined document stay.
    """
    if mode not in ("replace", "legacy"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "replace":
        out = segments[0]
        for s in segments[1:]:
            out = replaced(out if s.gone is None else removed(out, s.gone), s)
        return out

    def last(tables: list[DataFrame], keys: list[str]) -> DataFrame:
        union = None
        for k, t in enumerate(tables):
            t = t.withColumn("_at", F.lit(k))
            union = t if union is None else union.unionByName(t)
        rest = [c for c in tables[0].columns if c not in keys]
        return union.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("r")).select(*keys, "r.*").select(*tables[0].columns)

    def latest(tables: list[DataFrame]) -> DataFrame:
        """Postings of analysed documents: a document's later terms meet its earlier ones, so that no posting is shuffled."""
        union = None
        for k, t in enumerate(tables):
            entries = _postings(F.col("terms"))
            if later := tables[k + 1 :]:
                rest = reduce(DataFrame.unionByName, (x.select("shard_id", "doc_id", "terms") for x in later))
                rest = rest.groupBy(F.col("shard_id").alias("_shard"), F.col("doc_id").alias("_doc")).agg(F.flatten(F.collect_list("terms")).alias("_late"))
                t = t.join(rest, F.col("shard_id").eqNullSafe(F.col("_shard")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
                entries = _postings(F.col("terms"), F.col("_late"))
            out = _exploded(t, entries)
            union = out if union is None else union.unionByName(out)
        return union

    vectors = [s.vectors for s in segments if s.vectors is not None]
    analysed = [s.analysed for s in segments if s.analysed is not None]
    postings = latest(analysed) if len(analysed) == len(segments) else last([s.postings for s in segments], ["shard_id", "term", "doc_id"])
    return Index(postings, last([s.docs for s in segments], ["shard_id", "doc_id"]), last(vectors, ["shard_id", "doc_id"]) if vectors else None)
