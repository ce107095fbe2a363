"""Benchmark decontamination by suffix arrays of the training text.

Each task cuts its documents into shards of a few MB and makes a suffix array of each over word numbers: the suffixes
whose first words can match at all (runs of words that the benchmark has), sorted by as many words as a window has. Every
test suffix is binary-searched in every shard; the equal range gives all places of its window. Windows that follow one
another on a diagonal join to the longest verbatim matches, with their places. The benchmark goes to the tasks in blocks
of a bounded number of words, one after the other: the driver and each executor hold one block, and what each block found
is written before the next. No document is shuffled.

Words are told apart by 64-bit multilinear hashes of their bytes: two different words of a benchmark of a million words
and of a corpus of 10**13 meet with a chance under 10**-5 a word of the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import ALNUM, land, pieces, schema_of, split_words, table, text_of, utf8, word_hashes

WINDOW = 8
#: A word of any case, as Spark's expressions read it; ALNUM says the same of bytes.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of the benchmark in one block; an item of more is a block of its own.
BLOCK_WORDS = 1_000_000
#: A document with windows of so many items is contaminated.
MIN_ITEMS = 2


@dataclass
class Block:
    """Some items: numbers of their words in the block's vocabulary (from 1), and where each item begins."""

    items: list[str]
    words: np.ndarray
    starts: np.ndarray
    vocabulary: np.ndarray  # sorted hashes
    window: int

    @classmethod
    def of(cls, rows: list[tuple[str, str]], window: int) -> Block:
        data, offsets = utf8(pa.array([t for _, t in rows], pa.large_string()))
        begins, ends, starts = split_words(data, offsets, ALNUM)
        vocabulary, words = np.unique(word_hashes(data, begins, ends, True), return_inverse=True)
        return cls([i for i, _ in rows], words.astype(np.int64) + 1, starts, vocabulary, window)

    def __post_init__(self):
        self.bits = int(len(self.vocabulary)).bit_length()
        self.per_key = 63 // self.bits if self.bits else 1
        sizes = np.diff(self.starts)
        lengths = np.where(sizes >= self.window, self.window, sizes)
        counts = np.where(sizes >= self.window, sizes - self.window + 1, (sizes > 0).astype(np.int64))
        #: Test suffixes: item, place in it, and the words of its window.
        self.item = np.repeat(np.arange(len(sizes)), counts)
        self.place = np.arange(len(self.item)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.length = lengths[self.item]
        self.at = self.starts[:-1][self.item] + self.place
        self.least = int(lengths[lengths > 0].min()) if (lengths > 0).any() else 0

    def keys(self, words: np.ndarray, at: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """The first length words from each place, packed into integers of per_key words; zeros beyond."""
        out = []
        for d in range(0, self.window, self.per_key):
            key = np.zeros(len(at), np.int64)
            for k in range(d, d + self.per_key):
                key <<= self.bits
                if k < self.window:
                    key |= np.where(k < length, words[np.minimum(at + k, len(words) - 1)], 0)
            out.append(key)
        return out

    def find(self, numbers: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, place) of each occurrence of a window. numbers: the shard's words; left: words that each run still has."""
        none = np.empty(0, np.int64)
        places = np.flatnonzero(left >= max(1, self.least))
        if not len(places) or not self.least:
            return none, none
        have = self.keys(numbers, places, left[places])
        order = np.lexsort(have[::-1])  # the suffix array, to the depth of a window
        sorted_ = [k[order] for k in have]
        low, high = self.keys(self.words, self.at, self.length), self.keys(self.words, self.at, self.length)
        for d, key in enumerate(high):  # above what the window fixes, anything may follow
            free = np.clip((d + 1) * self.per_key - self.length, 0, self.per_key)
            key |= (np.int64(1) << (free * self.bits)) - 1
        first, last = self._bound(sorted_, low, False), self._bound(sorted_, high, True)
        n = last - first
        suffix = np.repeat(np.arange(len(n)), n)
        return suffix, places[order[first[suffix] + np.arange(len(suffix)) - np.repeat(np.cumsum(n) - n, n)]]

    @staticmethod
    def _bound(have: list[np.ndarray], want: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all wanted keys at once."""
        low, high = np.zeros(len(want[0]), np.int64), np.full(len(want[0]), len(have[0]))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            m = np.minimum(mid, len(have[0]) - 1)
            less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
            for h, w in zip(have, want):
                less |= same & (h[m] < w)
                same &= h[m] == w
            up = open_ & (less | same if after else less)
            low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
        return low

    def occurrences(self, array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For an Arrow array of texts: number of the first word of each, test suffixes found, and at which words."""
        data, offsets = utf8(array)
        begins, ends, firsts = split_words(data, offsets, ALNUM)
        if not len(begins) or not len(self.vocabulary):
            return firsts, np.empty(0, np.int64), np.empty(0, np.int64)
        h = word_hashes(data, begins, ends, True)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        numbers = np.where(self.vocabulary[at] == h, at + 1, 0)
        breaks = np.union1d(np.flatnonzero(numbers == 0), firsts[1:])  # a run ends at a foreign word or at a text's end
        here = np.arange(len(numbers))
        left = np.where(numbers > 0, breaks[np.minimum(np.searchsorted(breaks, here, "right"), len(breaks) - 1)] - here, 0)
        return firsts, *self.find(numbers, left)


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[tuple[int, Block]]:
    """How many blocks the benchmark's distinct rows make, and each of them: the driver holds one at a time. Rows are dealt
    to blocks by hash, so that a block has about block_words words or fewer; an item of more is in a block whole. A null
    item_id counts as an item with an empty id; items without words have no window."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of("text").alias("text")).distinct()
    words = rows.agg(F.sum(F.floor(F.length("text") / 2) + 1)).first()[0] or 0  # at most so many words
    n = max(1, -(-words * 5 // (block_words * 4)))
    if n > 1:
        rows = land(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition(min(n, 200), "block"), "benchmark")
    for k in range(n):
        mine = (rows if n == 1 else rows.where(F.col("block") == k)).select("item", "text").collect()
        yield n, Block.of(sorted(map(tuple, mine)), window)


def _hits(block: Block, array) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Number of the first word of each text, whether each word is hit, and the items found in each text."""
    firsts, suffix, at = block.occurrences(array)
    n = int(firsts[-1])
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + block.length[suffix], -1)
    doc = np.searchsorted(firsts, at, "right") - 1
    items: list[set[str]] = [set() for _ in range(len(firsts) - 1)]
    for pair in np.unique(doc * len(block.items) + block.item[suffix]).tolist():
        items[pair // len(block.items)].add(block.items[pair % len(block.items)])
    return firsts, np.cumsum(edges[:-1]) > 0, items


DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(items: list[set[str]], min_items: int) -> list[pa.Array]:
    shown = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return [pa.array([len(x) for x in items], pa.int64()), pa.array(shown, pa.string()), pa.array([len(x) >= min_items for x in items], pa.bool_())]


def _scan(shared, text: str, min_items: int, drop: bool):
    """Of rows with a text either those of few items, or all with DIGEST instead of the text."""

    def run(batches):
        for batch in pieces(batches, text):
            names, columns = batch.schema.names, batch.columns
            firsts, hit, items = _hits(shared.value, columns[names.index(text)])
            if drop:
                yield batch.filter(pa.array([len(x) < min_items for x in items], pa.bool_()))
                continue
            total = np.concatenate([[0], np.cumsum(hit)])
            out = [pa.array(np.diff(firsts)), pa.array(total[firsts[1:]] - total[firsts[:-1]]), *_digest(items, min_items)]
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(columns, names) if n != text), *out], [*(n for n in names if n != text), *(x.split()[0] for x in DIGEST.split(", "))])

    return run


def _found(shared):
    """row, bits (one for each word) and items of the rows (row, text) that have a window of the block."""

    def run(batches):
        for batch in pieces(batches, "text"):
            firsts, hit, items = _hits(shared.value, batch.column(1))
            rows = [k for k, x in enumerate(items) if x]
            bits = [np.packbits(hit[firsts[k] : firsts[k + 1]]).tobytes() for k in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(bits, pa.binary()), pa.array([sorted(items[k]) for k in rows], pa.list_(pa.string()))], ["row", "bits", "items"])

    return run


@F.arrow_udf(LongType())
def _either(bits: pa.Array) -> pa.Array:
    """How many bits are set in any of a row's bit strings, which are of one length."""
    return pa.array([int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in x])).sum()) for x in bits.to_pylist()], pa.int64())


def _by_blocks(docs: DataFrame, block: Block, more: Iterator[tuple[int, Block]]) -> tuple[DataFrame, DataFrame]:
    """rows (row, doc: a struct of docs' columns, n_words) and found (row, n_hit, items of all blocks)."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    text = text_of("text")
    rows = land(docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc"), text.alias("text"), F.size(F.regexp_extract_all(text, F.lit(ALNUM_WORD), F.lit(0))).cast("long").alias("n_words")), "decontamination-rows")
    sc, found = docs.sparkSession.sparkContext, None
    for b in chain([block], (b for _, b in more)):
        shared = sc.broadcast(b)
        one = land(rows.select("row", "text").mapInArrow(_found(shared), "row long, bits binary, items array<string>"), "decontamination-found")
        shared.destroy()
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("row").agg(F.collect_list("bits").alias("bits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # of a row as many as there are blocks
    return rows, found.select("row", _either("bits").alias("n_hit"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text).

    A null or empty text has no words and no items, like every text if the benchmark is empty. Repeated rows of docs stay;
    of the benchmark they count once. Other columns are ignored. A benchmark of several blocks takes a pass over the
    texts for each, and a table of what each found.
    """
    blocks = blocks_of(benchmark, window, block_words)
    n, block = next(blocks)
    if n == 1:
        x = docs.select("doc_id", text_of("text").alias("text"))
        return x.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), "text", min_items, False), schema_of([x.schema["doc_id"]], DIGEST))
    rows, found = _by_blocks(docs.select("doc_id", "text"), block, blocks)
    items = F.coalesce("items", F.array().cast("array<string>"))
    x = rows.drop("text").join(found, "row", "left").select(F.col("doc.doc_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return x.withColumn("contaminated", F.col("n_items") >= min_items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns as they are, that have windows of fewer than min_items items. Edge cases are those of
    contamination."""
    blocks = blocks_of(benchmark, window, block_words)
    n, block = next(blocks)
    if n == 1:
        return docs.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block), "text", min_items, True), docs.schema)
    rows, found = _by_blocks(docs, block, blocks)
    return rows.join(found.where(F.size("items") >= min_items), "row", "left_anti").select("doc.*")


MATCH = "doc_id long, item_id string, doc_word long, item_word long, n_words long"


def _longest(shared):
    def run(batches):
        block = shared.value
        for batch in pieces(batches, "text"):
            firsts, suffix, at = block.occurrences(batch.column(1))
            if not len(at):
                continue
            item, place = block.item[suffix], block.place[suffix]
            doc = np.searchsorted(firsts, at, "right") - 1
            order = np.lexsort((place, at - place, item, doc))
            key = np.stack([doc, item, at - place])[:, order]
            new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0) | (np.diff(place[order]) != 1)])
            heads = np.flatnonzero(new)
            run_ = np.diff(np.append(heads, len(order)))
            h = order[heads]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc[h])), pa.array(block.items).take(pa.array(item[h])), pa.array(at[h] - firsts[doc[h]]), pa.array(place[h]), pa.array(run_ + block.length[suffix[h]] - 1)],
                [x.split()[0] for x in MATCH.split(", ")],
            )

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every longest verbatim match of at least a window: doc_id, item_id, first word in either, and its words. Edge cases are
    those of contamination; a repeated row has its matches as often."""
    x, sc, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")), docs.sparkSession.sparkContext, None
    for n, block in blocks_of(benchmark, window, block_words):
        shared = sc.broadcast(block)
        found = x.mapInArrow(_longest(shared), MATCH)
        if n > 1:
            found = land(found, "decontamination-matches")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[k + 1 : k + 8], ' ') AS win, least(len(w), 8) AS n FROM (SELECT item, w, unnest(range(greatest(len(w) - 7, 1))) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, k, n, array_to_string(w[k + 1 : k + n], ' ') AS win FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, lens WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, k, dw.n, item FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
