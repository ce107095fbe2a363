"""Change events: Kafka options, decoding with reasons, encoding."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id string, event_version int, event_type string, document_id long, url string, content_hash string, occurred_at string, metadata map<string,string>"
FIELDS = tuple(x.split()[0] for x in EVENT.split(", "))
TYPES = ("created", "updated", "deleted")


@dataclass(frozen=True)
class KafkaOptions:
    servers: str = "localhost:9092"
    topic: str = "document-events"
    group: str = "indexer-workers"
    dead_letters: str = "document-events-dlq"

    def __post_init__(self):
        if not all(x.strip() for x in (self.servers, self.topic, self.group, self.dead_letters)):
            raise ValueError("Kafka options are not to be empty")

    @classmethod
    def from_environment(cls, env=os.environ) -> KafkaOptions:
        return cls(*(env.get(k, d) for k, d in (("KAFKA_BOOTSTRAP_SERVERS", cls.servers), ("KAFKA_DOCUMENT_EVENTS_TOPIC", cls.topic), ("KAFKA_CONSUMER_GROUP", cls.group), ("KAFKA_DLQ_TOPIC", cls.dead_letters))))

    def stream(self, spark: SparkSession) -> DataFrame:
        """value of each message from the earliest offset; offsets are the checkpoint's."""
        return spark.readStream.format("kafka").option("kafka.bootstrap.servers", self.servers).option("subscribe", self.topic).option("kafka.group.id", self.group).option("startingOffsets", "earliest").load().selectExpr("CAST(value AS STRING) AS value", "partition", "offset")

    def write(self, rows: DataFrame, topic: str) -> None:
        """rows (key, value) to a topic."""
        rows.write.format("kafka").option("kafka.bootstrap.servers", self.servers).option("topic", topic).save()


def problem() -> Column:
    """Why a decoded event is not to be used, or null. Columns: value, has (its keys) and the fields."""
    time = F.col("occurred_at")
    checks = [(F.col("value").isNull(), "no value"), (F.col("has").isNull(), "not a JSON object"), *((~F.array_contains("has", f), f"no {f}") for f in FIELDS)]
    checks += [(F.coalesce(F.col("event_id"), F.lit("")) == "", "no event_id"), (F.coalesce(F.col("event_version"), F.lit(0)) < 1, "bad event_version"), (~F.coalesce(F.col("event_type"), F.lit("")).isin(*TYPES), "bad event_type"), (F.coalesce(F.col("document_id"), F.lit(0)) <= 0, "bad document_id"), (F.trim(F.coalesce(F.col("url"), F.lit(""))) == "", "no url")]
    checks += [((F.col("event_type") != "deleted") & (F.coalesce(F.col("content_hash"), F.lit("")) == ""), "no content_hash"), (F.col("occurred_at_ts").isNull() | ~time.rlike(r"(Z|[+-]\d\d:?\d\d)$"), "bad occurred_at")]
    out = None
    for bad, why in checks:
        out = F.when(bad, why) if out is None else out.when(bad, why)
    return out


def decoded(messages: DataFrame) -> DataFrame:
    """messages (value, ...) with the event's fields and reason: null for a good event, else what is wrong with it."""
    x = messages.withColumn("has", F.json_object_keys("value")).withColumn("_e", F.from_json("value", EVENT)).select(*messages.columns, "has", "_e.*").withColumn("occurred_at_ts", F.try_to_timestamp("occurred_at"))
    return x.withColumn("reason", problem()).drop("has", "occurred_at").withColumnRenamed("occurred_at_ts", "occurred_at")


def encoded(events: DataFrame) -> DataFrame:
    """key, value: compact JSON with sorted keys, keyed by the document."""
    time = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    fields = {f: F.col(f) for f in FIELDS} | {"occurred_at": time}
    return events.select(F.col("document_id").cast("string").alias("key"), F.to_json(F.struct(*(fields[f].alias(f) for f in sorted(fields))), {"ignoreNullFields": "false"}).alias("value"))


def url_list(spark: SparkSession, path: str | None = None, given: tuple[str, ...] = ()) -> list[str]:
    """Start urls given and from a file, in order and once each; blank lines and lines that begin with # don't count. A list
    for the driver: what a person names to crawl."""
    lines = [*given, *(spark.read.text(path, wholetext=True).first()[0].splitlines() if path else [])]
    out = list(dict.fromkeys(s for x in lines if (s := x.strip()) and not s.startswith("#")))
    if not out:
        raise ValueError("no url to crawl")
    return out
