"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session on one machine, as in tests, keeps what it writes if it names no folder.
LOCAL = "/tmp/checkpoints"

#: Rows and bytes of a batch that goes to a Python worker, at most (one row may be larger).
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches, so that a few thousand long texts don't meet in a worker's memory."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_folder(spark: SparkSession) -> str:
    """Our folder under spark.checkpoint.dir. A cluster is to name it; on one machine a folder of our own serves."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
    return (named or LOCAL).rstrip("/") + "/siftline"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes with the session."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def landed(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df written to the shared folder and read again: what follows sees one run's rows. by: columns that have folders of
    their own, so that what asks for one value reads its rows alone."""
    path = shared_path(df.sparkSession, tag)
    bound_batches(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
