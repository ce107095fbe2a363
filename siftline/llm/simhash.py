"""SimHash near-duplicates: fingerprints, exact search within a Hamming radius, bit-sliced comparison, components.

Distinct fingerprints are dealt to tables by all pairs of 6 blocks of their bits. Two fingerprints that differ in 4 bits or
fewer agree in 2 of the blocks, so they meet in one table's bucket at least; no candidate is capped. Of very many
fingerprints more blocks are made and more of them go into a key, so that buckets stay small. A bucket's
fingerprints are stored as bit planes, 64 to a word. One query's distances to the 64 of a word are counted at once by
carry-save adders on bits, and (query, word) pairs in which all lanes exceed the radius are dropped every 8 planes.
Each bucket gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import merged, roots_of
from .shared import fresh, land, mixed, pieces, table, text_of

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a bucket that one task compares; larger buckets are split into pairs of parts.
HOT = 2048
#: Fingerprints of an average bucket, beyond which keys get longer.
CROWD = 512
ONES = np.uint64(2**64 - 1)


def blocks_of(radius: int, share: int = 2) -> list[tuple[int, int]]:
    """Bit ranges (from, width) of radius + share blocks: near fingerprints agree in share of them at least."""
    n = radius + share
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shared_blocks(count: int, radius: int = RADIUS, most: int = CROWD) -> int:
    """How many blocks a table's key has: the fewest, from 2 to 4, by which count fingerprints make buckets of about most or
    fewer. More blocks in a key mean more tables of smaller buckets; every choice finds all near pairs."""
    return next((s for s in (2, 3) if count <= most << (64 * s // (radius + s))), 4)


#: The bits of each byte, lowest first, and where each of a hash's 8 bytes is counted.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    out = np.zeros((8, 256), np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bytes_ = hashes[k : k + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        out += np.bincount((bytes_ + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    return (out @ _BITS).ravel()


def shingle_hashes(text: str, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of that many words, lower-cased (A-Z) and joined by spaces; of all words if they are fewer."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    whole, h = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    begins = np.concatenate([[0], ends[: n - 1] + 1])
    last = ends[min(words, len(parts)) - 1 :]
    return np.fromiter([h(whole[b:e], seed) for b, e in zip(begins.tolist(), last.tolist())], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bit k is set if over half of the hashes have it; 0 without hashes."""
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text; 0 without words."""
    return majority(shingle_hashes(text, words, seed))


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            values = np.array([fingerprint(t or "", words, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for each row of docs; a null text has no words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def near(fps: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which (query, word) pairs hold a near fingerprint, and the lanes in which. fps: rows of one
    or more 64-bit parts; planes: as many times 64 x words; lanes: those to count."""
    live, valid = np.arange(len(query)), lanes.copy()
    rows, columns = query, word
    counters = [np.zeros(len(query), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(query), np.uint64)
    excess = (1 << len(counters)) - 1 - radius  # counters start here, so that a carry out means more than the radius
    for k, c in enumerate(counters):
        c[:] = ONES if excess >> k & 1 else np.uint64(0)
    for b in range(len(planes)):
        if b % 64 == 0:
            bits = fps[rows, b // 64]
        carry = planes[b][columns] ^ (np.uint64(0) - (bits >> np.uint64(b % 64) & np.uint64(1)))
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if b % 8 == 7:
            keep = (valid & ~over) != 0
            if not keep.all():
                live, valid, rows, bits, columns, over = live[keep], valid[keep], rows[keep], bits[keep], columns[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(live):
                    break
    return live, valid & ~over


def linked(fps: np.ndarray, group: np.ndarray, part: np.ndarray | None, radius: int, at_once: int = 1 << 15) -> np.ndarray:
    """Root of each of fps (rows of uint64, with the numbers of their groups, ascending) by links within the radius in its
    group. With part, only links between rows of different parts are sought."""
    fps = fps.reshape(len(fps), -1)
    n = len(fps)
    parent = np.arange(n)
    planes = np.empty((64 * fps.shape[1], -(-n // 64)), np.uint64)
    for b in range(len(planes)):
        column = np.zeros(planes.shape[1] * 64, np.uint8)
        column[:n] = fps[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)
        planes[b] = np.packbits(column, bitorder="little").view("<u8")
    first = np.searchsorted(group, group, "left")
    at = np.arange(n)
    # A query is compared with the rows before it in its group: words first//64 .. at//64.
    low, high = first // 64, at // 64
    counts = np.where(at > first, high - low + 1, 0)
    ends = np.cumsum(counts)
    done = 0
    while done < n:
        until = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + at_once, "right")))
        q = np.repeat(at[done:until], counts[done:until])
        if len(q):
            word = low[q] + np.arange(len(q)) - np.repeat(np.cumsum(counts[done:until]) - counts[done:until], counts[done:until])
            begin, end = np.clip(first[q] - word * 64, 0, 64), np.clip(q - word * 64, 0, 64)
            lanes = _below(end) & ~_below(begin)
            hit, found = near(fps, q, word, lanes, planes, radius)
            while len(hit):
                low_bit = found & (np.uint64(0) - found)
                other = word[hit] * 64 + np.log2(low_bit.astype(np.float64)).astype(np.int64)
                mine = q[hit]
                if part is not None:
                    use = part[mine] != part[other]
                    parent = merged(parent, mine[use], other[use])
                else:
                    parent = merged(parent, mine, other)
                found = found ^ low_bit
                more = found != 0
                hit, found = hit[more], found[more]
        done = until
    return parent


def _below(n: np.ndarray) -> np.ndarray:
    """Words whose n lowest bits are set, n from 0 to 64."""
    return np.where(n >= 64, ONES, (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def _compare(radius: int):
    def links(t: pa.Table):
        key = np.stack([np.asarray(t[c]) for c in ("tab", "key", "pa", "pb")])
        change = np.concatenate([[False], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        nodes = np.asarray(t["node"])
        fps = nodes.view(np.uint64) if "bits" not in t.column_names else np.frombuffer(b"".join(t["bits"].to_pylist()), "<u8").reshape(len(nodes), -1)
        split = key[2] != key[3]
        part = np.where(split, (np.asarray(t["own"]) == key[3]).astype(np.int64), -np.arange(len(nodes)) - 1)
        root = linked(fps, np.cumsum(change), part if split.any() else None, radius)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 16:
                t = pa.Table.from_batches(held).combine_chunks()
                keys = [np.asarray(t[c]) for c in ("tab", "key", "pa", "pb")]
                last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
                if len(last):  # the last bucket may go on in the next batch
                    yield links(t.slice(0, last[-1] + 1))
                    held, rows = t.slice(last[-1] + 1).to_batches(), t.num_rows - last[-1] - 1
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return run


def in_tables(distinct: DataFrame, radius: int = RADIUS, share: int = 2) -> DataFrame:
    """node (a distinct fingerprint fp), tab and key: its bucket in the table of each choice of share blocks."""
    bits = lambda a, w: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1))

    def key(chosen):
        out = bits(*chosen[0])
        for block in chosen[1:]:
            out = F.shiftleft(out, block[1]).bitwiseOR(bits(*block))
        return out

    keys = [F.struct(F.lit(k).alias("tab"), key(c).alias("key")) for k, c in enumerate(combinations(blocks_of(radius, share), share))]
    return distinct.select(F.col("fp").alias("node"), F.explode(F.array(*keys)).alias("k")).select("node", "k.tab", "k.key")


def near_links(dealt: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """a, b: links that connect every two nodes of a bucket within the radius, a spanning forest for each bucket.

    dealt: node, tab, key and, unless the node is its own fingerprint, bits (binary). Buckets of more than hot nodes become
    pairs of parts, compared by tasks of their own.
    """
    columns = [c for c in ("node", "bits") if c in dealt.columns]
    counts = dealt.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = land(dealt.join(counts, ["tab", "key"]), "simhash-buckets")
    parts = F.ceil(F.col("n") / hot).cast("int")
    own = F.pmod(F.xxhash64(F.lit(1), "node"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("pa"), F.greatest(p, F.col("own")).alias("pb")))
    rows = counted.withColumn("own", own).select(*columns, "tab", "key", "own", F.explode(pairs).alias("p")).select(*columns, "tab", "key", "own", "p.pa", "p.pb")
    placed = rows.repartition("tab", "key", "pa", "pb").sortWithinPartitions("tab", "key", "pa", "pb", "node")
    return placed.mapInArrow(_compare(radius), "a long, b long")


def with_components(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id for each row of docs: the smallest doc_id reachable over links of at most radius bits.

    Rows without words have fingerprint 0, linked like any other; very long texts are fingerprinted whole. Rows with a null
    doc_id take part; a component of only such rows has a null id. Repeated rows stay. Other columns are ignored. An empty
    table gives no rows.
    """
    prints = land(fingerprints(docs, words, seed), "simhash-prints")
    distinct = land(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = roots_of(near_links(in_tables(distinct, radius, shared_blocks(distinct.count(), radius)), radius), "simhash")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# ---- near copies by a similarity of shingle sets -----------------------------------------------------------------

#: Parts of 64 bits in a long fingerprint; 512 bits tell a Jaccard similarity to about 0.03, enough to find candidates.
PARTS = 8
#: Smallest shingle hashes by which texts meet: texts of similarity 0.8 share one of 6 with a chance of 0.9999.
MEETINGS = 6


#: Shingle hashes of a group that one task compares; larger groups are split into pairs of parts.
GROUP_HASHES = 1 << 21


def radius_of(similarity: float, bits: int, slack: float = 6) -> int:
    """Bits within which texts of that Jaccard similarity are candidates: the mean difference plus slack deviations.

    Of two large sets of similarity s each bit differs with the chance acos(2s / (1 + s)) / pi; of small ones (4 of 5
    shingles) with 0.19 instead of 0.15, which is why slack is this wide."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def digest_of(hashes: np.ndarray) -> bytes:
    """Of sorted distinct hashes: equal sets, and they alone, have one digest."""
    return hashlib.blake2b(hashes.astype("<u8", copy=False).tobytes(), digest_size=16).digest()


def _sketches(words: int, seed: int):
    salts = mixed(np.arange(1, PARTS + MEETINGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        for batch in pieces(batches, "text"):
            digests, bits, keys, sizes = [], [], [], []
            for t in batch.column(1).to_pylist():
                h = np.unique(shingle_hashes(t or "", words, seed))  # a set: a shingle that repeats counts once
                digests.append(digest_of(h))
                sizes.append(len(h))
                bits.append(np.array([majority(mixed(h ^ s)) for s in salts[:PARTS]], "<u8").tobytes())
                h = h if len(h) else np.zeros(1, np.uint64)
                keys.append([int(mixed(h ^ s).min()) - 2**63 for s in salts[PARTS:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["doc_id", "digest", "bits", "keys", "size"])

    return run


def _sets(words: int, seed: int):
    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            sets = [np.unique(shingle_hashes(t or "", words, seed)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest_of, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "digest", "hashes"])

    return run


def similar(sets: list[np.ndarray], part: np.ndarray | None, similarity: float) -> np.ndarray:
    """Root of each of the sets (sorted distinct hashes) by links of at least that Jaccard similarity. With part, only links
    between sets of different parts are sought. Pairs that are connected already aren't compared."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    parent = np.arange(n)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    have = np.zeros(len(values), np.int8)
    for x in range(n - 1):
        y = np.arange(x + 1, n)
        y = y[(parent[y] != parent[x]) & (np.minimum(sizes[y], sizes[x]) >= similarity * np.maximum(sizes[y], sizes[x]))]
        if part is not None:
            y = y[part[y] != part[x]]
        if not len(y):
            continue
        have[ids[begins[x] : ends[x]]] = 1
        if len(y) > 32:
            total = np.concatenate([[0], np.cumsum(have[ids], dtype=np.int64)])
            both = total[ends[y]] - total[begins[y]]
        else:
            both = np.array([have[ids[begins[k] : ends[k]]].sum(dtype=np.int64) for k in y])
        have[ids[begins[x] : ends[x]]] = 0
        y = y[both >= similarity * (sizes[x] + sizes[y] - both)]
        if len(y):
            parent = merged(parent, np.full(len(y), x), y)
    return parent


GROUP = ("root", "tab", "key", "pa", "pb")


def _verified(similarity: float):
    def links(t: pa.Table):
        keys = np.stack([np.asarray(t[c]) for c in GROUP])
        edges = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(keys[0])]])
        nodes, own = np.asarray(t["node"]), np.asarray(t["own"])
        a, b = [nodes[:0]], [nodes[:0]]
        for lo, hi in zip(edges, edges[1:]):
            sets = [np.frombuffer(x, "<u8") for x in t["hashes"].slice(lo, hi - lo).to_pylist()]
            root = similar(sets, own[lo:hi] if keys[3][lo] != keys[4][lo] else None, similarity)
            moved = np.flatnonzero(root != np.arange(hi - lo))
            a.append(nodes[lo:hi][moved])
            b.append(nodes[lo:hi][root[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= 8 << 20:
                t = pa.Table.from_batches(held)
                keys = [t[c].to_numpy() for c in GROUP]
                last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
                size = 0
                if len(last):  # the last group may go on in the next batch
                    yield links(t.slice(0, last[-1] + 1))
                    held = pa.Table.from_batches(t.slice(last[-1] + 1).to_batches()).combine_chunks().to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def similar_links(docs: DataFrame, distinct: DataFrame, candidates: DataFrame, words: int, similarity: float, seed: int = SEED, most: int = GROUP_HASHES) -> DataFrame:
    """a, b: links of at least that exact Jaccard similarity, a spanning forest for each bucket of each candidate component.

    docs: doc_id, text; distinct: node, digest, keys, size; candidates: node, root. Texts of no candidate aren't read
    again, and of buckets that hold the same members of a component one is compared.
    """
    found = land(distinct.join(candidates, "node").select("node", "digest", "root", "size", F.posexplode("keys").alias("tab", "key")), "near-candidates")
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("digest")).alias("who"), F.sum("size").alias("total")]
    buckets = found.groupBy("root", "tab", "key").agg(*members).where("n > 1")
    buckets = buckets.groupBy("root", "n", "who").agg(F.min(F.struct("tab", "key", "total")).alias("x")).select("root", "x.*")
    parts = F.greatest(F.lit(1), F.ceil(F.col("total") / most)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(2), "digest"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("pa"), F.greatest(p, F.col("own")).alias("pb")))
    dealt = found.drop("size").join(buckets, ["root", "tab", "key"]).withColumn("own", own).select("node", "digest", "root", "tab", "key", "own", F.explode(pairs).alias("p"))
    dealt = land(dealt.select("node", "digest", "root", "tab", "key", "own", "p.pa", "p.pb"), "near-groups")
    needed = dealt.select("node").distinct()
    texts = docs.join(needed, docs["doc_id"] == needed["node"], "left_semi").mapInArrow(_sets(words, seed), "node long, digest binary, hashes binary")
    sets = texts.groupBy("node", "digest").agg(F.first("hashes").alias("hashes"))
    placed = dealt.join(sets, ["node", "digest"]).select(*GROUP, "own", "node", "hashes").repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
    return placed.mapInArrow(_verified(similarity), "a long, b long")


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns as they are, but for each group of near copies that of the smallest doc_id alone.

    Texts meet in a bucket for each of their MEETINGS smallest shingle hashes, and are candidates if their long
    fingerprints, compared bit-sliced, are about as near as those of texts of that similarity are. Within the components of
    candidates, texts of a bucket are linked if the Jaccard similarity of their shingle sets is as high; a group is a
    component of these links. Texts of equal shingle sets are one node, so copies cost nothing. Texts without words are copies of each other. Of repeated rows one
    stays. Rows with a null doc_id all stay: nothing tells them apart from others.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    sketches = land(rows.mapInArrow(_sketches(words, seed), "doc_id long, digest binary, bits binary, keys array<long>, size long"), "near-sketches")
    distinct = land(sketches.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bits").alias("bits"), F.first("keys").alias("keys"), F.first("size").alias("size")), "near-distinct")
    dealt = distinct.select("node", "bits", F.posexplode("keys").alias("tab", "key"))
    candidates = roots_of(near_links(dealt, radius_of(similarity, 64 * PARTS)), "near")
    roots = roots_of(similar_links(rows, distinct, candidates, words, similarity, seed), "near-similar")
    first = distinct.select("node", "digest").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    gone_id, hashed, row = (fresh(docs, n) for n in ("_gone", "_hash", "_row"))
    gone = land(sketches.select("doc_id", "digest").join(first, "digest").where("doc_id <> root").select(F.col("doc_id").alias(gone_id)).distinct(), "near-gone")
    left = docs.join(gone, docs["doc_id"] == F.col(gone_id), "left_anti")
    one = Window.partitionBy("doc_id", hashed).orderBy(hashed)
    numbered = left.withColumn(hashed, F.xxhash64("text")).withColumn(row, F.row_number().over(one))
    return numbered.where((F.col(row) == 1) | F.col("doc_id").isNull()).select(*docs.columns)


def hex_of(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component."""
    return with_components(table(spark, sf_dir, "documents")).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
