"""Change detection, change events, version states, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import landed

DOCUMENT = "doc_id long, url string, title string, content string, content_type string, content_hash string, version int"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def detect(existing: DataFrame, incoming: DataFrame, arrival: str | None = None) -> DataFrame:
    """incoming (url, title, content, content_type) with change_type, doc_id (null if created), version, content_hash and
    arrival.

    By url and hash of the content: a new title alone changes nothing, and the stored one stays. A url that comes several
    times is compared each time with what came before, in the order of the column arrival (else in that of the rows).
    """
    old = existing.select("url", "doc_id", F.col("title").alias("_title"), F.col("content_hash").alias("_hash"), F.col("version").alias("_version"))
    at = F.monotonically_increasing_id() if arrival is None else F.col(arrival)
    x = incoming.select("url", "title", "content", "content_type", at.alias("arrival")).withColumn("content_hash", content_hash(F.col("content"))).join(old, "url", "left")
    w = Window.partitionBy("url").orderBy("arrival", "content_hash")
    before = F.coalesce(F.lag("content_hash").over(w), F.col("_hash"))
    x = x.withColumn("change_type", F.when(before.isNull(), "created").when(before == F.col("content_hash"), "unchanged").otherwise("updated"))
    changed = F.col("change_type") != "unchanged"
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    version = F.coalesce("_version", F.lit(0)) + F.sum(changed.cast("int")).over(so_far)
    title = F.when(changed, F.col("title")).otherwise(F.coalesce(F.last(F.when(changed, F.struct("title")), True).over(so_far)["title"], F.col("_title")))
    return x.select("url", "doc_id", title.alias("title"), "content", "content_type", "content_hash", version.cast("int").alias("version"), "change_type", "arrival")


def upserted(existing: DataFrame, detected: DataFrame, next_id: int) -> DataFrame:
    """The documents after the changes; created ones get ids from next_id in the order of their urls.

    A url's last change is what stays. Ids are dealt by ranges of url, with no single task over all created rows: the ranges
    are written once, and a row for each of them, with its rows, says where it begins.
    """
    keys = [c.split()[0] for c in DOCUMENT.split(", ")]
    rest = [k for k in keys if k not in ("url", "doc_id")]
    last = detected.where("change_type <> 'unchanged'").groupBy("url").agg(F.max("doc_id").alias("doc_id"), F.max_by(F.struct(*rest), F.struct("arrival", "version")).alias("r")).select("url", "doc_id", "r.*")
    last = landed(last, "upsert-changes")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = landed(last.where("doc_id IS NULL").select("url").repartitionByRange("url").sortWithinPartitions("url").select("url", F.spark_partition_id().alias("part"), within.alias("at")), "upsert-order")
    starts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for each partition
    named = ordered.join(F.broadcast(starts), "part").select("url", (F.lit(next_id) + F.col("start") + F.col("at")).cast("long").alias("_id"))
    new = last.join(named, "url", "left").withColumn("doc_id", F.coalesce("doc_id", "_id"))
    return existing.join(last.select("url"), "url", "left_anti").select(*keys).unionByName(new.select(*keys))


def by_url(documents: DataFrame, url: str) -> DataFrame:
    """The document of a url, of which there is one; the predicate reaches the scan."""
    return documents.where(F.col("url") == url).limit(1)


def change_events(detected: DataFrame) -> DataFrame:
    """An event for each changed document; its id follows from document and version, so that a repeat is the same event."""
    return detected.where("change_type <> 'unchanged'").select(
        F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("version").cast("string")), 256).alias("event_id"),
        F.col("version").alias("event_version"), F.col("change_type").alias("event_type"), F.col("doc_id").alias("document_id"), "url", "content_hash", F.current_timestamp().alias("occurred_at"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def version_state(event: Column, indexed: Column, document: Column) -> Column:
    """stale: not newer than what is indexed, or older than the document; future: newer than the document; else current."""
    return F.when(event <= indexed, "stale").when(document > event, "stale").when(document < event, "future").otherwise("current")


def deduplicated(events: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """One row for each event_id that isn't among the processed ones."""
    once = events.dropDuplicates(["event_id"])
    return once if processed is None else once.join(processed.select("event_id"), "event_id", "left_anti")


def latest_versions(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, event_version, event_id, indexed_at: the newest version of each document; of equals the one that was
    there; indexed_at stays that of the first."""
    both = ledger.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct("event_version", "event_id"), F.struct(F.col("event_version"), -F.col("_new")))
    return both.groupBy("document_id").agg(best.alias("b"), F.min_by("indexed_at", F.struct("_new", "event_version")).alias("indexed_at")).select("document_id", "b.event_version", "b.event_id", "indexed_at")


def recorded(processed: DataFrame, new: DataFrame) -> DataFrame:
    """processed with the events that it lacks."""
    return processed.unionByName(new.dropDuplicates(["event_id"]).join(processed.select("event_id"), "event_id", "left_anti"))


def deleted(documents: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return documents.join(doc_ids.select("doc_id"), "doc_id", "left_anti").select(*documents.columns)
