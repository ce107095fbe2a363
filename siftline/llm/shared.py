"""What several operators need: tables in the shared folder, and words of whole Arrow batches as NumPy arrays."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import bound_batches, shared_folder

#: Regular expression of a word (ASCII white space ends it), as Spark and DuckDB read it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop, _ = _hadoop(spark, path)
    hadoop.deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Hadoop understands it."""
    fs, p = _hadoop(spark, path)
    full = fs.makeQualified(p).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def land(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    bound_batches(df.sparkSession)
    path = shared_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._landed = path
    return out


def drop_landed(df: DataFrame) -> None:
    """Remove the files of a landed table that nothing reads any more."""
    if path := getattr(df, "_landed", None):
        remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def schema_of(fields: list, more: str) -> T.StructType:
    """Fields of a schema, then those of a DDL string."""
    return T.StructType([*fields, *T.StructType.fromDDL(more).fields])


def text_of(column: str):
    """A text column as a string, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# ---- words of a batch -------------------------------------------------------------------------------------------

_BYTES = np.arange(256)
#: Bytes of words that end at ASCII white space.
SPACED = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Bytes of words of digits, letters and all that isn't ASCII.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and where each of its values begins (one more: the end); null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in data, and the number of the first word of each value (one more: how many there are)."""
    inside = kind[data]
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    begins, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, for each element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Masks of the lowest 0 to 8 bytes.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, lower: bool, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: its bytes, eight at a time, mixed in turn with its length. Memory is a few bytes for each
    byte of data, and then goes by words; words of more than 64 bytes are hashed by XXH64."""
    import xxhash

    if not len(begins):
        return np.empty(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    lengths = ends - begins
    out = mixed(eight[begins] & _LOWEST[np.minimum(lengths, 8)] ^ (lengths + (seed << 32)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more = np.flatnonzero(lengths > 8)
    for k in range(8, _LONG, 8):
        left = lengths[more] - k
        out[more] = mixed(out[more] * np.uint64(0xD6E8FEB86659FD93) ^ eight[begins[more] + k] & _LOWEST[np.minimum(left, 8)])
        more = more[left > 8]
    bytes_ = memoryview(padded)
    out[more] = [xxhash.xxh64_intdigest(bytes_[b:e], seed) for b, e in zip(begins[more].tolist(), ends[more].tolist())]
    return out


def release() -> None:
    """Give freed memory back to the system, at the end of a worker's task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc: nothing to give back by hand
        pass


def pieces(batches, text: str, most: int = 512 << 10):
    """Record batches again, each with about `most` bytes of text or one row, so that what NumPy needs stays bounded. At the
    end of the task freed memory goes back to the system."""
    for batch in batches:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release()
