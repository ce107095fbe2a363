"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in a keyed random order and its words are cut into blocks. A source takes whole passes over
its blocks and then a keyed permutation's first blocks, the last one in part, so that it takes its target to the word. The
blocks so taken are quotas; a binary tree over the output shards splits them exactly, each node drawing its left half's
share of every source at once from the multivariate hypergeometric law. A node's draw depends on its place alone, so a
task goes down the tree only where its own blocks go, and no table of shards is made or sent. Shard s then holds a run of
the source's permuted blocks, disjoint from other shards', and orders its blocks by a keyed hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, land, mixed, table, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: A document's words that one shard has in one pass: where the shard puts them, how many, and the runs they lie in.
PIECE = "pass: int, shard: int, shard_order: long, words: long, runs: array<struct<first: long, words: long>>"
#: Nodes of the tree whose draws a worker keeps.
NODES = 100_000
GOLDEN = 0x9E3779B97F4A7C15


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's target: share of all sizes dealt by weight, stopped at most times its size, the excess dealt again."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), {k for k, s in enumerate(sizes) if s > 0}
    while open_:
        total = sum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / total > most * sizes[k]}
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        open_ -= over
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at each x: a Feistel network on the next even number of bits, walked back into range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, out, todo = np.uint64((1 << half) - 1), x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mixed(right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. NumPy draws from fewer than 1e9; from more, the same law by the
    ratio of uniforms (Stadlober 1989)."""
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if total else 0
    few, draws = min(good, bad), min(n, total - n)
    share = few / total
    centre, spread = draws * share + 0.5, math.sqrt((total - draws) * draws * share * (1 - share) / (total - 1) + 0.5)
    width, most = 1.7155277699214135 * spread + 0.8989161620588988, min(draws, few)
    log = lambda k: -sum(map(math.lgamma, (k + 1, few - k + 1, draws - k + 1, total - few - draws + k + 1)))
    best = log((draws + 1) * (few + 1) // (total + 2))
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(centre + width * (v - 0.5) / u)
        if 0 <= k <= most and 2 * math.log(u) <= log(k) - best:
            break
    k = k if draws == n else few - k
    return k if good <= bad else n - k


@dataclass
class Tree:
    """The splitting tree: quotas (blocks of each source) of all shards, dealt to halves down to single shards."""

    quotas: np.ndarray
    shards: int
    seed: int
    known: dict = field(default_factory=dict)

    def left(self, a: int, b: int, quotas: np.ndarray) -> np.ndarray:
        """Quotas of the left half of shards a..b, every half getting its equal part of all blocks (to one block)."""
        if (a, b) not in self.known:
            rng, out, rest = np.random.default_rng([self.seed, a, b]), np.zeros(len(quotas), np.int64), int(quotas.sum())
            draws = rest * ((a + b) // 2 - a) // (b - a)
            for k, q in enumerate(map(int, quotas)):
                rest -= q
                out[k] = hypergeometric(rng, q, rest, draws)
                draws -= int(out[k])
            if len(self.known) >= NODES:
                self.known.clear()
            self.known[a, b] = out
        return self.known[a, b]

    def shard_of(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Shard of each block: a source and a place among its quota."""
        out, stack = np.zeros(len(source), np.int64), [(0, self.shards, self.quotas, np.arange(len(source)))]
        place = place.copy()
        while stack:
            a, b, quotas, rows = stack.pop()
            if b - a == 1 or not len(rows):
                out[rows] = a
                continue
            left = self.left(a, b, quotas)
            goes = place[rows] < left[source[rows]]
            other = rows[~goes]
            place[other] -= left[source[other]]
            stack += [(a, (a + b) // 2, left, rows[goes]), ((a + b) // 2, b, quotas - left, other)]
        return out

    def leaves(self) -> np.ndarray:
        """shards x sources, to look at; as many rows as there are shards."""
        out = np.zeros((self.shards, len(self.quotas)), np.int64)
        for k, q in enumerate(self.quotas):
            np.add.at(out[:, k], self.shard_of(np.full(q, k), np.arange(q)), 1)
        return out


@dataclass
class Recipe:
    """What the driver draws up: a row for each source, never for documents or shards."""

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    block: int
    seed: int
    whole: list[int] = field(default_factory=list)  # whole passes
    drawn: list[int] = field(default_factory=list)  # whole blocks of the last pass
    rest: list[int] = field(default_factory=list)  # words of the block after those
    tree: Tree | None = None

    @classmethod
    def of(cls, totals: list[tuple], weights, share, most, block, words_a_shard, seed) -> Recipe:
        rows = sorted(totals, key=lambda r: (r[0] is None, r[0] or ""))
        sizes = [int(r[1] or 0) for r in rows]
        out = cls([r[0] for r in rows], sizes, targets(sizes, [weights[k % len(weights)] for k in range(len(rows))], share, most), block, seed)
        quotas = []
        for k, (size, t) in enumerate(zip(sizes, out.targets)):
            whole, left = divmod(round(t), size) if size else (0, 0)
            blocks = -(-size // block)
            short, drawn, rest = size - (blocks - 1) * block, 0, 0
            if left:
                at = int(permuted(np.array([blocks - 1]), blocks, out.key(k, whole))[0])  # the short block's place
                words = lambda q, at=at, short=short: q * block - (block - short) * (at < q)
                drawn = left // block
                while drawn < blocks and words(drawn + 1) <= left:
                    drawn += 1
                while words(drawn) > left:
                    drawn -= 1
                rest = left - words(drawn)
            out.whole.append(whole)
            out.drawn.append(drawn)
            out.rest.append(rest)
            quotas.append(whole * blocks + drawn + (rest > 0))
        out.tree = Tree(np.array(quotas, np.int64), max(1, math.ceil(sum(out.targets) / words_a_shard)), seed)
        return out

    def key(self, source: int, turn: int) -> int:
        return (self.seed * 1_000_003 + source) * 64 + turn

    def _taken(self, k: int, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Of source k's documents at start: document, pass, block, place among the quota, first word and words of each block taken."""
        blocks = -(-self.sizes[k] // self.block)
        first, last = start // self.block, (start + size - 1) // self.block
        n = np.where(size > 0, last - first + 1, 0)
        doc = np.repeat(np.arange(len(start)), n)
        at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        got: list[tuple] = []
        quota = int(self.tree.quotas[k])
        for turn in range(self.whole[k] + 1):
            place = permuted(at, blocks, self.key(k, turn)) if len(at) else at
            room = np.full(len(at), self.block) if turn < self.whole[k] else np.where(place < self.drawn[k], self.block, np.where(place == self.drawn[k], self.rest[k], 0))
            begin = np.maximum(start[doc], at * self.block)
            words = np.minimum(start[doc] + size[doc], at * self.block + room) - begin
            use = words > 0
            drawn = permuted(turn * blocks + place[use], quota, self.key(k, 63)) if use.any() else place[use]
            got.append((doc[use], np.full(use.sum(), turn), at[use], drawn, (begin - start[doc])[use], words[use]))
        return [np.concatenate(c) for c in zip(*got)]

    def pieces(self, source: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.ListArray:
        """PIECE of each document: source number, words of its source before it, words."""
        parts = []
        for k in np.unique(source):
            mine = np.flatnonzero(source == k)
            doc, *rest = self._taken(int(k), start[mine], size[mine])
            parts.append([mine[doc], np.full(len(doc), k), *rest])
        doc, k, turn, at, drawn, begin, words = (np.concatenate(c) if parts else np.empty(0, np.int64) for c in (zip(*parts) if parts else [()] * 7))
        shard = self.tree.shard_of(k, drawn)
        # A block's passes stand a golden section of the shard apart, so that repeats aren't neighbours.
        rank = mixed(at.astype(np.uint64) * np.uint64(GOLDEN) ^ mixed(k.astype(np.uint64) + np.uint64(self.seed))) + turn.astype(np.uint64) * np.uint64(GOLDEN)
        order = np.lexsort((begin, shard, turn, doc))
        doc, turn, shard, rank, begin, words = (x[order] for x in (doc, turn, shard, rank, begin, words))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (turn[1:] != turn[:-1]) | (shard[1:] != shard[:-1])
        run = new.copy()
        run[1:] |= begin[1:] != begin[:-1] + words[:-1]
        heads, runs = np.flatnonzero(new), np.flatnonzero(run)
        summed = lambda x, at: np.add.reduceat(x, at) if len(at) else x[:0]
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(runs, heads), len(runs)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin[runs]), pa.array(summed(words, runs))], ["first", "words"]))
        columns = [pa.array(turn[heads].astype(np.int32)), pa.array(shard[heads].astype(np.int32)), pa.array((rank[heads] >> np.uint64(1)).astype(np.int64)), pa.array(summed(words, heads)), lists]
        offsets = np.searchsorted(doc[heads], np.arange(len(source) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(columns, ["pass", "shard", "shard_order", "words", "runs"]))


def _drawn(docs: DataFrame, columns: list[str], light: bool, weights, share, most, block, words_a_shard, seed) -> DataFrame:
    """doc (a struct of columns), size, source_size, target, pieces of every row. light: columns are small enough to be
    written with the sizes, so that texts are read once."""
    spark = docs.sparkSession
    size = F.size(F.regexp_extract_all(text_of("text"), F.lit(WORD), F.lit(0))).cast("long")
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
    sized = land(base if light else base.drop("doc"), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()  # a row for each source
    recipe = Recipe.of([tuple(r) for r in totals], weights, share, most, block, words_a_shard, seed)
    bits = min(20, max(4, math.ceil(math.log2(sum(r[2] for r in totals) / 1024 + 1))))
    placed = lambda x: x.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits)).withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed(sized).groupBy("src", "bucket").agg(F.sum("size").alias("n")).select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("src", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed(sized if light else base).join(bases, ["src", "bucket"]).withColumn("start", F.col("base") + F.sum("size").over(within) - F.col("size"))
    shared = spark.sparkContext.broadcast(recipe)

    @F.arrow_udf(f"struct<source_size: long, target: double, pieces: array<struct<{PIECE}>>>")
    def draw(source: pa.Array, start: pa.Array, size: pa.Array) -> pa.Array:
        r: Recipe = shared.value
        of = {name: k for k, name in enumerate(r.names)}
        k = np.array([of[x] for x in source.to_pylist()], np.int64)
        columns = [pa.array(np.array(r.sizes, np.int64)[k]), pa.array(np.array(r.targets, float)[k]), r.pieces(k, np.asarray(start), np.asarray(size))]
        return pa.StructArray.from_arrays(columns, ["source_size", "target", "pieces"])

    # Not to be pushed or run twice: each Python node of a plan has a worker of its own in every task.
    return rows.select("doc", "size", draw.asNondeterministic()("source", "start", "size").alias("drawn")).select("doc", "size", "drawn.*")


def mix(docs: DataFrame, columns: list[str], weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = 1024, words_a_shard: int = 1 << 22, seed: int = 17) -> DataFrame:
    """columns of docs (doc_id, text, source and any others), size, source_size, target, taken and pieces (PIECE) of every row.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last. Repeated rows
    are documents of their own. An empty table gives no rows. Long texts are cut into pieces like any other. Other columns
    may have any names; asking for one that has the name of a result is an error. The driver holds one row a source.
    """
    if clash := {"size", "source_size", "target", "taken", "pieces"} & {c.lower() for c in columns}:
        raise ValueError(f"columns have the names of results: {sorted(clash)}")
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return _drawn(docs, columns, True, weights, share, most, block, words_a_shard, seed).select("doc.*", "size", "source_size", "target", taken.alias("taken"), "pieces")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = 1024, words_a_shard: int = 1 << 22, seed: int = 17) -> DataFrame:
    """The mix itself: for each document, pass and shard a row of docs' columns whose text has the words that the shard's
    quota takes of it. A partition holds whole shards, one after the other, each in its own order; so do the files that it
    is written to. n_chars, where there is one, is that of the new text. A text taken whole stays as it is; of others, the
    runs of words taken keep the white space between their words. Edge cases are those of mix; rows that aren't taken go.
    """
    drawn = _drawn(docs, docs.columns, False, weights, share, most, block, words_a_shard, seed)
    whole = (F.size("pieces") == F.array_size(F.filter("pieces", lambda p: p["words"] == F.col("size"))))
    x = drawn.where(F.size("pieces") > 0).withColumn("cut", F.when(~whole, _cut(F.col("doc.text").cast("string"), F.col("pieces"))))
    rest = [c for c in docs.columns if c != "text"]
    kept = F.struct(*(F.col(f"doc.`{c}`").alias(c) for c in rest)).alias("doc")
    text = F.when(whole, F.col("doc.text").cast("string"))
    x = x.select(kept, text.alias("whole"), F.explode(F.arrays_zip("pieces", F.coalesce("cut", F.transform("pieces", lambda p: F.lit(None).cast("string"))).alias("cut"))).alias("p"))
    x = x.select("doc", F.coalesce("p.cut", "whole").alias("text"), F.col("p.pieces.shard").alias("shard"), F.col("p.pieces.shard_order").alias("place"), F.col("p.pieces.runs")[0]["first"].alias("first"))
    x = x.repartition("shard").sortWithinPartitions("shard", "place", "first")
    chars = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return x.select(*(F.col("text") if c == "text" else chars[c].alias(c) if c in chars else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def _cut(text, pieces):
    """Of a text the parts that pieces take, an array of texts; runs of a piece that aren't neighbours stand on lines of their own."""
    part = lambda words, r: F.regexp_replace(F.array_join(F.slice(words, (r["first"] + 1).cast("int"), r["words"].cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    cut = lambda words: F.transform(pieces, lambda p: F.array_join(F.transform(p["runs"], lambda r: part(words, r)), "\n"))
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    return F.transform(F.array(words), cut)[0]  # the words are found once, not for each piece


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what the mix takes of each."""
    return mix(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
