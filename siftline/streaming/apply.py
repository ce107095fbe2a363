"""Change events applied to the index by micro-batches: dedupe, classify, split, publish, record."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ring
from ..functions import text as T
from ..operators import changes
from ..operators.index import build
from ..sources import events as E
from ..sources.storage import Store

PROCESSED = "event_id string, document_id long, event_version int"
LEDGER = "document_id long, event_version int, event_id string, indexed_at timestamp"


def classified(events: DataFrame, documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """Decoded events with action (apply, delete, ignore, dead) and reason.

    A delete needs neither document nor version. An event of an older version than the document's or not newer than the
    indexed one is ignored, unless it is a bootstrap event; a newer one, one without a document and one whose hash isn't
    the document's go to the dead letters.
    """
    doc = documents.select(F.col("doc_id").alias("document_id"), F.col("version").alias("_version"), F.col("content_hash").alias("_hash"))
    done = ledger.select("document_id", F.col("event_version").alias("_indexed"))
    x = events.join(doc, "document_id", "left").join(done, "document_id", "left")
    boot = F.coalesce(F.lower(F.element_at("metadata", "bootstrap")) == "true", F.lit(False))
    state = changes.version_state(F.col("event_version"), F.when(~boot, F.col("_indexed")), F.col("_version"))
    why = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("event_type") == "deleted", F.lit(None)).when(F.col("_version").isNull(), "no document").when(state == "future", "future version").when((state == "current") & ~F.col("content_hash").eqNullSafe(F.col("_hash")), "other content")
    x = x.withColumn("_state", state).withColumn("reason", why)
    action = F.when(F.col("reason").isNotNull(), "dead").when(F.col("event_type") == "deleted", "delete").when(F.col("_state") == "stale", "ignore").otherwise("apply")
    return x.withColumn("action", action).drop("_version", "_hash", "_indexed", "_state")


def processed_directly(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Decoded events with applied: whether an event, on its own and without a ledger, changes the index; action and reason
    say why."""
    none = events.sparkSession.createDataFrame([], LEDGER)
    return classified(events, documents, none).withColumn("applied", F.col("action").isin("apply", "delete"))


@dataclass
class Applier:
    """foreachBatch sink. Events that fail are tried again, with the documents as they are then; those that still fail go to
    the dead letters. State is in Parquet folders under root, one a batch, so that a repeated batch overwrites what its
    first try left. Documents come from a function, to be read anew for each batch."""

    spark: SparkSession
    root: str
    documents: object
    shards: tuple[str, ...] = ("shard-0",)
    virtual_nodes: int = ring.VIRTUAL_NODES
    stems: bool = True
    max_retries: int = 3
    retry_delay: float = 1.0
    dead_sink: Callable[[DataFrame], None] | None = None  # takes key, value rows; KafkaOptions.write is one, with a topic
    most_segments: int = 16

    def _table(self, name: str, schema: str, below: int | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        x = self.spark.read.schema(schema + ", batch long").parquet(path)
        return (x if below is None else x.where(F.col("batch") < below)).drop("batch")

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def processed(self, below: int | None = None) -> DataFrame:
        return self._table("processed", PROCESSED, below)

    def ledger(self, below: int | None = None) -> DataFrame:
        rows = self._table("ledger", LEDGER, below)
        return changes.latest_versions(rows.limit(0), rows)

    def dead_letters(self) -> DataFrame:
        return self._table("dead", "value string, reason string")

    def __call__(self, messages: DataFrame, batch: int) -> None:
        x = E.decoded(messages.select("value", *(c for c in ("partition", "offset") if c in messages.columns)))
        order = [c for c in ("partition", "offset") if c in x.columns]
        bad = x.where("reason IS NOT NULL")
        good = changes.deduplicated(x.where("reason IS NULL"), self.processed(batch))
        docs = self.documents()
        seen = classified(good, docs, self.ledger(batch)).persist()
        for _ in range(self.max_retries):  # what fails may find its document a little later
            if not seen.where("action = 'dead'").limit(1).count():
                break
            time.sleep(self.retry_delay)
            seen.unpersist()
            docs = self.documents()
            seen = classified(good, docs, self.ledger(batch)).persist()
        try:
            if self.dead_sink is not None:  # if it fails so does the batch, which then comes again
                self.dead_sink(seen.where("action = 'dead'").select(F.col("document_id").cast("string").alias("key"), "value"))
            self._put(bad.select("value", "reason").unionByName(seen.where("action = 'dead'").select("value", "reason")), "dead", batch)
            use = seen.where("action IN ('apply', 'delete')")
            # One action a document: the last by its offset; without offsets a delete comes after what it deletes.
            rank = F.struct(*order, (F.col("action") == "delete").cast("int"), "event_version") if order else F.struct((F.col("action") == "delete").cast("int"), F.col("event_version"))
            last = use.groupBy("document_id").agg(F.max_by("action", rank).alias("action"))
            fresh = docs.join(last.where("action = 'apply'").select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")
            new = build(fresh, T.lexical_text(F.col("title"), F.col("content")), self.stems, shard=ring.shard_of(F.col("doc_id"), list(self.shards), self.virtual_nodes))
            gone = last.select(F.col("document_id").alias("doc_id"))
            store = Store(self.spark, f"{self.root}/index")
            new = store.prepared(new)
            for shard in self.shards:
                m = store.append(shard, new, gone)
                if len(m.active_segments) > self.most_segments:
                    store.compact(shard)
            self._put(use.where("action = 'apply'").select("document_id", "event_version", "event_id", F.current_timestamp().alias("indexed_at")), "ledger", batch)
            self._put(seen.where("action <> 'dead'").select("event_id", "document_id", "event_version"), "processed", batch)
        finally:
            seen.unpersist()

    def start(self, messages: DataFrame, checkpoint: str, **trigger):
        """A running query over a stream of messages (value)."""
        return messages.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
