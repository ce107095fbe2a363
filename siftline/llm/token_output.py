"""Token-ID output: Parquet files of id lists in document order, read back selectively.

Layout: one row a document with doc_id, part (number of the file in order), row_in_part, start_in_part (ids before it in
its file), n_tokens and ids. Files follow the order asked for (doc_id, unless a caller says otherwise); within one, rows
are sorted, so row groups and the page index bound doc_id tightly. ids are dictionary encoded (16 bits an id for this
vocabulary), other integers are delta encoded (format 2 pages); row groups and pages are bounded by the parameters.
Metadata reads touch no page of ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import default_tokenizer, encoder
from .shared import bound_batches, pieces, shared_path, table, text_of

SCHEMA = "doc_id long, part int, row_in_part long, start_in_part long, n_tokens long, ids array<int>"
END_ID = 1


def _encode(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, row, start = TaskContext.get().partitionId(), 0, 0
        with encoder(path) as e:
            for batch in pieces(batches, "text"):
                n = batch.num_rows
                values, offsets = e.ids(batch.column(1))
                values, offsets = np.insert(values, offsets[1:], end_id), offsets + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))],
                    ["doc_id", "part", "row_in_part", "start_in_part", "n_tokens", "ids"],
                )
                row += n
                start += int(offsets[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, order: tuple = ("doc_id",)) -> None:
    """Encode every whole text of docs (doc_id, text; null: empty), end each with end_id, and write the files at path.

    Texts are dealt by ranges of order (columns or expressions) in one shuffle, nulls first; rows that are equal in it are
    ordered, and dealt to several tasks if they are many, by a hash of the text. An empty table gives no rows. Other
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    keys = [f"_order{k}" for k in range(len(order))]
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), *((F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(order, keys)))
    x = x.withColumn("_hash", F.xxhash64("text")).repartitionByRange(*keys, "_hash").sortWithinPartitions(*keys, "_hash")
    x = x.select("doc_id", "text").mapInArrow(_encode(tokenizer or default_tokenizer(), end_id), SCHEMA)
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.dictionary.page.size": 1 << 20, "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#row_in_part": "false", "parquet.enable.dictionary#start_in_part": "false", "compression": "zstd"}
    x.write.options(**options).parquet(path)


def as_stored(docs: DataFrame) -> tuple:
    """Order of write_tokens that keeps rows as they lie: in the files of a stored table, in the order of their names, or in
    the partitions of any other."""
    stored = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        docs.select(*stored)
    except AnalysisException:
        return (F.monotonically_increasing_id(),)
    return stored


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def part_starts(tokens: DataFrame) -> DataFrame:
    """part, part_start: ids in all files before each. It has a row for each file, which bounds what may be broadcast."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))


def _checked(batches):
    for batch in batches:
        lists = batch.column(3)
        if not len(lists):
            continue
        values = np.asarray(lists.flatten()).astype("<u4", copy=False)
        ends = np.cumsum(np.asarray(lists.value_lengths()))
        sums = [zlib.crc32(values[b:e].tobytes()) for b, e in zip(np.concatenate([[0], ends[:-1]]), ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of the files at path, from the ids as they are read back."""
    tokens = read_tokens(spark, path)
    rows = tokens.select("doc_id", "part", "start_in_part", "ids").mapInArrow(_checked, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(part_starts(tokens)), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as id lists and read back."""
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)
