"""Index generations as Parquet folders with a manifest that is replaced atomically; JSON segments in and out."""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, from_terms, merge
from .shared import landed

STATES = ("new", "loading", "persisting", "ready", "failed")
SEGMENT = "format_version int, segment_id string, terms map<string,map<string,struct<term_frequency:int,positions:array<int>>>>, document_lengths map<string,int>, vectors map<string,array<double>>"


@dataclass(frozen=True)
class Manifest:
    shard_id: str
    generation: int
    state: str
    active_segments: tuple[str, ...]
    document_count: int
    format_version: int = 1

    def __post_init__(self):
        ok = self.format_version == 1 and isinstance(self.shard_id, str) and self.shard_id and type(self.generation) is int and self.generation >= 0
        ok = ok and self.state in STATES and self.active_segments and all(isinstance(s, str) and s for s in self.active_segments)
        if not ok or type(self.document_count) is not int or self.document_count < 0:
            raise ValueError(f"not a manifest: {self}")

    @classmethod
    def loads(cls, text: str) -> Manifest:
        d = json.loads(text)
        if not isinstance(d, dict) or not isinstance(d.get("active_segments"), list):
            raise ValueError("not a manifest")
        return cls(d.get("shard_id"), d.get("generation"), d.get("state"), tuple(d["active_segments"]), d.get("document_count"), d.get("format_version"))


def checked_id(shard_id: str) -> str:
    if not shard_id or shard_id in (".", "..") or re.search(r"[/\\\x00]", shard_id):
        raise ValueError(f"not a shard id: {shard_id!r}")
    return shard_id


class Store:
    """Shards under one root on any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _at(self, shard_id: str, *parts: str) -> str:
        return "/".join([self.root, checked_id(shard_id), *parts])

    def _read_text(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put_text(self, path: str, text: str) -> None:
        """Written beside, then renamed over the old file."""
        new = self._path(path + ".new")
        stream = self._fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(self._path(path)), options)

    def manifest(self, shard_id: str) -> Manifest | None:
        text = self._read_text(self._at(shard_id, "manifest.json"))
        if text is None:
            return None
        m = Manifest.loads(text)
        if m.shard_id != shard_id:
            raise ValueError("the manifest is another shard's")
        return m

    def segments(self, shard_id: str) -> list[str]:
        p = self._path(self._at(shard_id))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if s.isDirectory()) if self._fs.exists(p) else []

    def _write(self, shard_id: str, segment: str, index: Index | None, gone: DataFrame | None = None) -> None:
        mine = lambda df: df.where(F.col("shard_id") == shard_id)
        if index is None:
            empty = lambda ddl: self.spark.createDataFrame([], ddl)
            index = Index(empty("shard_id string, term string, doc_id long, tf int, positions array<int>"), empty("shard_id string, doc_id long, doc_len int"))
        docs = mine(index.docs)
        docs.write.mode("overwrite").parquet(self._at(shard_id, segment, "docs"))
        # Sorted by term: of each file a query's terms touch few pages. Postings of documents are sorted where they are made;
        # those of stored segments, as in a compaction, are dealt by ranges of terms, which reads them twice.
        rows = mine(index.postings) if index.analysed is not None else mine(index.postings).repartitionByRange("term", "doc_id")
        rows.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(self._at(shard_id, segment, "postings"))
        if index.vectors is not None:
            stray = mine(index.vectors).join(docs.select("doc_id"), "doc_id", "left_anti").limit(1).count()
            if stray:
                raise ValueError("a vector's document isn't in the shard")
            mine(index.vectors).write.mode("overwrite").parquet(self._at(shard_id, segment, "vectors"))
        if gone is not None:
            gone.select("doc_id").distinct().write.mode("overwrite").parquet(self._at(shard_id, segment, "gone"))

    def _point(self, shard_id: str, generation: int, segments: tuple[str, ...]) -> Manifest:
        """The manifest over segments; what fails before this leaves the generation that was there."""
        count = merge([self.read_segment(shard_id, s) for s in segments]).docs.count()
        m = Manifest(shard_id, generation, "ready", segments, count)
        self._put_text(self._at(shard_id, "manifest.json"), json.dumps(asdict(m), sort_keys=True))
        self.collect_garbage(shard_id)
        return m

    def _next(self, shard_id: str) -> tuple[int, str, Manifest | None]:
        old = self.manifest(shard_id)
        generation = old.generation + 1 if old else 0
        return generation, f"segment-{generation:06d}", old

    def prepared(self, index: Index) -> Index:
        """An index that is computed from its documents, their terms written first, once for all shards and passes, each
        shard's in a folder of its own."""
        if index.analysed is None or index.prepared:
            return index
        out = from_terms(landed(index.analysed.withColumn("doc_len", F.size("terms")), "analysed", by=("shard_id",)))
        out.vectors, out.prepared = index.vectors, True
        return out

    def publish(self, shard_id: str, index: Index) -> Manifest:
        """Write the shard's rows as the next generation, point the manifest at it, remove what nothing refers to."""
        generation, segment, _ = self._next(shard_id)
        self._write(shard_id, segment, self.prepared(index))
        return self._point(shard_id, generation, (segment,))

    def publish_all(self, shards: list[str], index: Index) -> None:
        """publish for several shards of one index, some at a time."""
        index = self.prepared(index)
        with ThreadPoolExecutor(min(8, max(1, len(shards)))) as pool:
            list(pool.map(lambda s: self.publish(s, index), shards))

    def append(self, shard_id: str, index: Index | None, gone: DataFrame | None = None) -> Manifest:
        """The next generation: the last one's segments and one more, with the shard's rows of index and the documents (doc_id)
        that go. Only these rows are written."""
        generation, segment, old = self._next(shard_id)
        self._write(shard_id, segment, index if index is None else self.prepared(index), gone)
        return self._point(shard_id, generation, (*(old.active_segments if old else ()), segment))

    def compact(self, shard_id: str) -> Manifest:
        """All segments of a shard written as one."""
        return self.publish(shard_id, self.load(shard_id))

    def landed(self, df: DataFrame, tag: str) -> DataFrame:
        return landed(df, tag)

    def collect_garbage(self, shard_id: str) -> list[str]:
        m = self.manifest(shard_id)
        gone = [s for s in self.segments(shard_id) if m and s not in m.active_segments]
        for s in gone:
            self._fs.delete(self._path(self._at(shard_id, s)), True)
        return gone

    def read_segment(self, shard_id: str, segment: str) -> Index:
        read = lambda kind: self.spark.read.parquet(self._at(shard_id, segment, kind))
        has = lambda kind: self._fs.exists(self._path(self._at(shard_id, segment, kind)))
        return Index(read("postings"), read("docs"), read("vectors") if has("vectors") else None, gone=read("gone") if has("gone") else None)

    def load(self, shard_id: str) -> Index | None:
        """The published generation, or None; the document count is to be the manifest's."""
        m = self.manifest(shard_id)
        if m is None:
            return None
        index = merge([self.read_segment(shard_id, s) for s in m.active_segments])
        if index.docs.count() != m.document_count:
            raise ValueError("the generation's documents aren't those of its manifest")
        return index

    def is_ready(self, shard_id: str) -> bool:
        m = self.manifest(shard_id)
        return m is not None and m.state == "ready"

    def delete(self, shard_id: str) -> None:
        self._fs.delete(self._path(self._at(shard_id)), True)


def import_segments(spark: SparkSession, path: str, shard_id: str = "shard-0") -> Index:
    """JSON segments of format 1 (lexical) or 2 (with vectors), one object a file."""
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", SEGMENT).alias("s")).select("s.*")
    x = x.withColumn("ok", F.when(F.col("format_version").isin(1, 2), True).otherwise(F.raise_error(F.lit("not a segment of format 1 or 2")).cast("boolean"))).where("ok")
    shard = F.lit(shard_id).alias("shard_id")
    entries = x.select(F.explode("terms").alias("term", "docs")).select("term", F.explode("docs").alias("doc", "p"))
    postings = entries.select(shard, "term", F.col("doc").cast("long").alias("doc_id"), F.col("p.term_frequency").alias("tf"), F.col("p.positions").alias("positions"))
    docs = x.select(F.explode("document_lengths").alias("doc", "doc_len")).select(shard, F.col("doc").cast("long").alias("doc_id"), "doc_len")
    vectors = x.select(F.explode("vectors").alias("doc", "embedding")).select(shard, F.col("doc").cast("long").alias("doc_id"), "embedding")
    return Index(postings, docs, vectors)


def export_segment(index: Index, segment_id: str) -> DataFrame:
    """One row of JSON, format 2. A single object holds the whole segment, so this is for small ones, to exchange."""
    key = F.col("doc_id").cast("string")
    by_term = index.postings.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct(F.col("tf").alias("term_frequency"), "positions")))).alias("docs"))
    terms = by_term.agg(F.map_from_entries(F.collect_list(F.struct("term", "docs"))).alias("terms"))
    lengths = index.docs.agg(F.map_from_entries(F.collect_list(F.struct(key, "doc_len"))).alias("document_lengths"))
    out = terms.join(F.broadcast(lengths))
    if index.vectors is not None:
        out = out.join(F.broadcast(index.vectors.agg(F.map_from_entries(F.collect_list(F.struct(key, "embedding"))).alias("vectors"))))
    return out.select(F.to_json(F.struct(F.lit(2).alias("format_version"), F.lit(segment_id).alias("segment_id"), *out.columns)).alias("value"))
