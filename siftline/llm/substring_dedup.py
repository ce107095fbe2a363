"""Passages that repeat, nearly or word for word, across documents: compact windows, interval joins, verification.

A document is a sequence of tokens, its runs of SHINGLE words. Under one hash function all subsequences [l, r] of at least
a minimum length whose smallest token is at c form a compact window i <= l <= c <= r <= j; the windows are the nodes of the
Cartesian tree over the token hashes that span the minimum length. Only positions that are the minimum of some stretch of
that length can be such nodes (two passes of sliding minima find them), and their nearest smaller tokens are such nodes
too, so the tree is built over these few positions alone.

Windows that share a minimum meet in one shuffle. A passage of the minimum length around c covers one half of it on either
side at least, so a window also carries the smallest token, under one more hash function, of the half before and of the
half behind c. Those of a minimum that agree in a half's signature, or in both, form a group of their own: each is linked with
the group's first and with the last of the document before its own, never with all others, and such a link counts as two hash
functions. So unlike windows that merely share a frequent token don't come between alike ones. The minimum's whole group is
linked the same way, as one hash function. Groups are in the order of doc_id, so that every holder but the first is linked with
an earlier one. Windows whose minimum no other text has are passed over before that. All groups of minima that are found
frequent in a sample are made as well, dealt by signature and salt and then by the salts' first windows, so that no task has
all windows of a token.

For two documents, windows that overlap and come from enough hash functions give a region in either; the regions' tokens
are fetched and compared: the best-matching stretches of at least the minimum length are reported if the Jaccard similarity
of their token sets is high enough. Copies of a whole text are one text, known by 64 bits of its digest, from the windows
on, and are reported as members of their smallest doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACED, land, mixed, pieces, release, split_words, table, text_of, utf8, word_hashes

SHINGLE = 5
LEAST_WORDS = 50
SIMILARITY = 0.8
HASHES = 5
#: Hash functions whose windows must meet.
COLLISIONS = 2
_SEEDS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def tokens_of(array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of an Arrow array of texts, one after the other, and where each text's begin."""
    data, offsets = utf8(array)
    begins, ends, firsts = split_words(data, offsets, SPACED)
    h = word_hashes(data, begins, ends, True)
    counts = np.maximum(np.diff(firsts) - shingle + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(firsts[:-1], counts)
    out = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
    return mixed(out), starts


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each stretch of that width: prefix and suffix minima of blocks."""
    n = len(values)
    best = np.minimum if least else np.maximum
    padded = np.concatenate([values, np.full(-n % width, np.uint64(2**64 - 1) if least else np.uint64(0))]).reshape(-1, width)
    before = best.accumulate(padded, axis=1).ravel()
    after = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[: n - width + 1], before[width - 1 : n])


def compact_windows(values: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, i, c, j (within all values) of each compact window of at least width tokens. Of equal tokens
    under one parent only the first, whose window holds the others', is given."""
    n = len(values)
    if n < width:
        none = np.empty(0, np.int64)
        return none, none, none, none
    low = _sliding(values, width, True)
    at = np.arange(len(low))
    text = np.searchsorted(starts, at, "right") - 1
    low[at + width > starts[text + 1]] = 0
    edge = np.zeros(width - 1, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), width, False)
    c = np.flatnonzero((high == values) & (high > 0))
    text = np.searchsorted(starts, c, "right") - 1
    left, right, first, stack = [0] * len(c), [0] * len(c), [True] * len(c), []
    ends, begins = starts[text + 1].tolist(), starts[text].tolist()
    found, places = values[c].tolist(), c.tolist()
    end = -1
    for x, v in enumerate(found):
        if ends[x] != end:
            for y in stack:
                right[y] = end
            stack, end = [], ends[x]
        while stack and found[stack[-1]] > v:
            right[stack.pop()] = places[x]
        if stack:
            left[x], first[x] = places[stack[-1]] + 1, found[stack[-1]] < v
        else:
            left[x] = begins[x]
        stack.append(x)
    for y in stack:
        right[y] = end
    i, j = np.array(left, np.int64), np.array(right, np.int64) - 1
    keep = (j - i + 1 >= width) & np.array(first, bool)  # a repeat of the minimum lies in the first one's window
    return text[keep], i[keep], c[keep], j[keep]


def half_signatures(tokens: np.ndarray, starts: np.ndarray, text: np.ndarray, c: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place c of a text, the smallest token (as 32 bits, not 0) of the half of a window before it and of that behind
    it; 0 where the text is too short for the half."""
    g, out = mixed(tokens ^ _SEEDS[-1]), []
    before = (width - 1) // 2
    for size, at in ((before, c - before), (width - 1 - before, c + 1)):
        ok = (at >= starts[text]) & (at + size <= starts[text + 1]) if size else np.zeros(len(c), bool)
        sig = np.zeros(len(c), np.uint64)
        if ok.any():
            sig[ok] = _sliding(g, size, True)[at[ok]] >> np.uint64(32) | np.uint64(1)
        out.append(sig.astype(np.uint32).view(np.int32))
    return out[0], out[1]


def identity(texts: pa.Array) -> np.ndarray:
    """64 bits of each text's digest."""
    return np.array([int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little", signed=True) for t in texts.to_pylist()], np.int64)


WINDOW_ROW = "key long, id long, ci long, j int, before int, behind int"
#: Texts that a task remembers so as not to make the windows of their copies again.
REMEMBERED = 100_000


def _windows(hashes: int, width: int, shingle: int):
    def run(batches):
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            ids = identity(batch.column(0))
            new = [k for k, x in enumerate(ids.tolist()) if x not in seen and not seen.add(x)]
            if len(seen) > REMEMBERED:
                seen.clear()
            ids = ids[new]
            tokens, starts = tokens_of(batch.column(0).take(pa.array(new, pa.int64())), shingle)
            for f in range(hashes):
                values = mixed(tokens ^ _SEEDS[f])
                text, i, c, j = compact_windows(values, starts, width)
                if not len(c):
                    continue
                before, behind = half_signatures(tokens, starts, text, c, width)
                key = (values[c] & ~np.uint64(63) | np.uint64(f)).view(np.int64)
                i, c, j = i - starts[text], c - starts[text], j - starts[text]
                columns = [key, ids[text], c << 32 | i, j.astype(np.int32), before, behind]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in WINDOW_ROW.split(", ")])

    return run


HIT = "a long, b long, f int, ia int, ja int, ib int, jb int"
#: HIT rows, and the first window of each group that a salt may have cut: its id, doc, i, j and c in a, b, ia, ja and jb, f being 0.
LINK = HIT + ", key long, side int, sig int"


def chained(order: np.ndarray, doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of each row with the first row of its group and with the last one of the document before its own, and the groups'
    first rows. order: the rows, sorted by keys and then doc."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    other = new.copy()
    other[1:] |= doc[order[1:]] != doc[order[:-1]]
    firsts, group, begin = np.flatnonzero(new), np.cumsum(new) - 1, np.flatnonzero(other)
    begin = begin[np.cumsum(other) - 1]
    rest = np.flatnonzero(begin > firsts[group])  # not of the group's first document
    return np.concatenate([order[firsts[group[rest]]], order[begin[rest] - 1]]), np.concatenate([order[rest], order[rest]]), order[firsts]


def _by_whole_groups(link, columns: tuple, at_once: int = 1 << 16):
    """Batches sorted by columns through link, a whole number of groups at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, until = 0, at_once
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= until:
                t = pa.Table.from_batches(held).combine_chunks()
                keys = [np.asarray(t[c]) for c in columns]
                last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
                if len(last):
                    yield from link(t.slice(0, last[-1] + 1))
                    held = pa.Table.from_batches(t.slice(last[-1] + 1).to_batches()).combine_chunks().to_batches()
                    rows = t.num_rows - int(last[-1]) - 1
                until = max(at_once, 2 * rows)  # a group that is longer is put together a few times only
        if held:
            yield from link(pa.Table.from_batches(held).combine_chunks())
        release()

    return run


def _shared(t: pa.Table):
    """The windows whose minimum another text has too, or whose minimum is frequent (its salts tell nothing of other texts)."""
    key, salt, ids, ci = (np.asarray(t[c]) for c in ("key", "salt", "id", "ci"))
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
    met = (np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)) | (salt[heads] > 0)
    yield from t.take(np.flatnonzero(np.repeat(met, np.diff(heads, append=len(key))))).combine_chunks().to_batches()


#: What a group of windows is dealt by: side 0 is all of a minimum, 1 and 2 are halves of a frequent one, 3 both halves, 4 all of it.
GROUP = ("key", "side", "sig", "salt")


def _links(t: pa.Table):
    """LINK rows of windows, all of each GROUP."""
    key, side, sig, salt, ids, doc, ci, j, before, behind = (np.asarray(t[c]) for c in (*GROUP, "id", "doc", "ci", "j", "before", "behind"))
    order = np.lexsort((ci, ids, doc, salt, sig, side, key))
    again = np.zeros(len(order), bool)  # of copies one has a window
    for x in (key, side, sig, salt, ids, ci):
        again[1:] |= x[order[1:]] != x[order[:-1]]
    again[:1] = True
    order = order[again]
    whole, parts = order[side[order] == 0], order[side[order] > 0]
    pairs = [(*chained(whole, doc, key)[:2], False)]
    for halves in ((before,), (behind,), (before, behind)):
        by = whole[np.all([s[whole] != 0 for s in halves], axis=0)]
        by = by[np.lexsort((*(s[by] for s in halves), key[by]))]  # stable: by doc within a group
        pairs.append((*chained(by, doc, key, *halves)[:2], True))
    one, two, firsts = chained(parts, doc, key, side, sig, salt)
    pairs.append((one, two, side[two] < 4))
    one, two = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    twice = np.concatenate([np.broadcast_to(p[2], len(p[0])) for p in pairs])
    f = np.left_shift(1, key[one] & 63) * np.where(twice, (1 << 15) + 1, 1)  # hash functions as bits; a half's signature adds one
    use = ids[one] != ids[two]
    one, two, f = one[use], two[use], f[use]
    one, two = np.where(ids[one] > ids[two], two, one), np.where(ids[one] > ids[two], one, two)
    order = np.lexsort((f, two, one))
    one, two, f = one[order], two[order], f[order]
    last = np.ones(len(one), bool)  # a pair of windows once, with the half's signature if it has one
    last[:-1] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    one, two, f = np.concatenate([one[last], firsts]), np.concatenate([two[last], firsts]), np.concatenate([f[last], np.zeros(len(firsts), np.int64)])
    i = (ci & (1 << 32) - 1).astype(np.int32)
    c = (ci >> 32).astype(np.int32)
    columns = [ids[one], np.where(f > 0, ids[two], doc[two]), f.astype(np.int32), i[one], j[one], i[two], np.where(f > 0, j[two], c[two]), key[one], side[one], sig[one]]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in LINK.split(", ")])


def hot_minima(x: DataFrame, windows, rows: int, share: int) -> DataFrame:
    """key of the minima that have about rows windows or more, by one document in share, and one window in MOST_HOT or more: so
    there are MOST_HOT at most, and they may be broadcast. Which minima are in it changes how their windows are dealt, not which
    groups are linked."""
    some = x.where(F.pmod(F.xxhash64(F.lit(3), "doc"), F.lit(share)) == 0).select("text").mapInArrow(windows, WINDOW_ROW).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    some = land(some, "passages-frequent")
    all_ = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return land(some.where(F.col("n") >= max(2, rows // share, -(-all_ // MOST_HOT))).select("key"), "passages-hot")


#: Windows of a minimum from which its groups are dealt apart, documents of which one is looked at to find such minima, parts
#: of a half's group and of all windows of such a minimum, and how many such minima there can be.
HOT, SHARE, SALTS, WHOLE_SALTS, MOST_HOT = 8192, 64, 8, 64, 1 << 18


def window_links(x: DataFrame, groups: DataFrame, hashes: int, width: int, shingle: int, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """HIT rows that connect the windows of x (doc, text) as the module says; a and b are texts' identities. groups: id and rep, the
    doc that a text's windows are put in order by."""
    windows = _windows(hashes, width, shingle)
    frequent = hot_minima(x, windows, hot, share).withColumn("hot", F.lit(True))
    rows = x.select("text").mapInArrow(windows, WINDOW_ROW).join(F.broadcast(frequent), "key", "left")
    salt = F.pmod(F.xxhash64("id"), F.lit(WHOLE_SALTS)).cast("int")
    rows = rows.withColumn("salt", F.when(F.col("hot"), salt + 1).otherwise(0)).drop("hot")
    shared = land(rows.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(_by_whole_groups(_shared, ("key", "salt")), rows.schema), "passages-shared")
    part = lambda k, sig, salts: F.when(sig != 0, F.struct(F.lit(k).alias("side"), sig.alias("sig"), F.pmod("salt", F.lit(salts)).alias("salt")))
    both = F.when((F.col("before") != 0) & (F.col("behind") != 0), F.hash("before", "behind")).otherwise(0)
    all_ = lambda k, salt: F.struct(F.lit(k).alias("side"), F.lit(0).alias("sig"), salt.alias("salt"))
    parts = F.when(F.col("salt") > 0, F.array_compact(F.array(part(1, F.col("before"), SALTS), part(2, F.col("behind"), SALTS), part(3, both, SALTS), all_(4, F.col("salt"))))).otherwise(F.array(all_(0, F.lit(0))))
    window = ("id", "doc", "ci", "j", "before", "behind")
    met = shared.join(groups.select("id", F.col("rep").alias("doc")), "id")
    dealt = met.select("key", *window, F.explode(parts).alias("p")).select("key", "p.*", *window)
    along = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_by_whole_groups(_links, GROUP), LINK)
    links = land(along(dealt), "passages-links")
    none = F.lit(0)
    firsts = links.where("f = 0").select("key", "side", "sig", none.alias("salt"), F.col("a").alias("id"), F.col("b").alias("doc"), F.shiftleft(F.col("jb").cast("long"), 32).bitwiseOR(F.col("ia")).alias("ci"), F.col("ja").alias("j"), none.alias("before"), none.alias("behind"))
    return links.where("f <> 0").unionByName(along(firsts).where("f <> 0")).select(*(x.split()[0] for x in HIT.split(", ")))


def _regions(least: int, collisions: int):
    names = [x.split()[0] for x in HIT.split(", ")]

    def runs(group: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Number of the run of overlapping intervals that each is in, within its group. Rows come by (group, first)."""
        reach = np.maximum.accumulate(last.astype(np.int64) + group * (1 << 33))
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (first[1:] + group[1:] * (1 << 33) > reach[:-1])
        return np.cumsum(new) - 1

    def regions(t: pa.Table):
        a, b, f, ia, ja, ib, jb = (np.asarray(t[n]) for n in names)
        group = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) - 1
        for side in ((ia, ja), (ib, jb)):  # windows that overlap in a, and of these those that overlap in b
            order = np.lexsort((side[0], group))
            group[order] = runs(group[order], side[0][order], side[1][order])
        order = np.argsort(group, kind="stable")
        a, b, f, ia, ja, ib, jb, group = (x[order] for x in (a, b, f, ia, ja, ib, jb, group))
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        met = np.bitwise_or.reduceat(f, heads)
        ok = np.array([int(x).bit_count() for x in met]) >= collisions
        cut = lambda g, x: g.reduceat(x, heads)[ok]
        columns = (a[heads][ok], cut(np.minimum, ia), cut(np.maximum, ja), b[heads][ok], cut(np.minimum, ib), cut(np.maximum, jb))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "fa", "ta", "b", "fb", "tb"])

    return _by_whole_groups(regions, ("a", "b"), 1 << 15)


def _fetch(shingle: int):
    """id, first, last and the tokens of each of a text's ranges. A document's other texts under its id are passed over."""
    names = ["id", "first", "last", "tokens"]

    def run(batches):
        for batch in pieces(batches, "text"):
            tokens, starts = tokens_of(batch.column(1), shingle)
            tokens = tokens.astype(np.uint32).view(np.int32)
            known = identity(batch.column(1))
            for k, ranges in enumerate(batch.column(2)):
                id_, mine, rows, size = batch.column(0)[k].as_py(), tokens[starts[k] : starts[k + 1]], [], 0
                if id_ != known[k]:
                    continue
                for r in ranges:
                    rows.append((r["first"].as_py(), r["last"].as_py()))
                    size += rows[-1][1] - rows[-1][0] + 1
                    if size > 1 << 18:
                        yield cut(id_, mine, rows)
                        rows, size = [], 0
                if rows:
                    yield cut(id_, mine, rows)

    def cut(id_, mine, rows):
        first, last = (np.array(x, np.int32) for x in zip(*rows))
        parts = [mine[x : y + 1] for x, y in rows]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), id_)), pa.array(first), pa.array(last), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))], names)

    return run


def best_stretch(match: np.ndarray, similarity: float) -> tuple[int, int]:
    """First and end of the stretch of highest score, a match counting 1 - similarity and anything else -similarity."""
    total = np.concatenate([[0.0], np.cumsum(np.where(match, 1 - similarity, -similarity))])
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    return int(total[: end + 1].argmin()), end


#: How densely a stretch is to match, tried in turn: near copies first, then their cores word for word.
DENSITIES = (0.6, 0.8, 0.95)


def occurrences(x: np.ndarray, y: np.ndarray, left: list[tuple[int, int]], width: int, similarity: float) -> list[tuple[int, int, float]]:
    """(first, tokens, similarity) of the further stretches of y that match the whole of x, within the ranges that are left."""
    out, match, own = [], np.isin(y, x), len(np.unique(x))
    while left:
        lo, hi = left.pop()
        if match[lo:hi].sum() < width * similarity:
            continue
        for density in DENSITIES:
            c, d = (lo + k for k in best_stretch(match[lo:hi], density))
            both = len(np.intersect1d(x, y[c:d]))
            j = both / (own + len(np.unique(y[c:d])) - both)
            if d - c >= width and j >= similarity:
                out.append((c, d - c, float(j)))
                left += [(lo, c), (d, hi)]
                break
    return out


def alike(x: np.ndarray, y: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(first in x, tokens, first in y, tokens, similarity) of stretches that match: of x none that overlap, each with all
    its occurrences in y.

    If the densest stretch at one density isn't similar enough as a whole, it is sought again at the next."""
    out, open_, level = [], np.isin(x, y), 0
    while level < len(DENSITIES) and open_.sum() >= width * similarity:
        a, b = best_stretch(open_, DENSITIES[level])
        if b - a < width:
            level += 1
            continue
        c, d = best_stretch(np.isin(y, x[a:b]), DENSITIES[level])
        m, n = best_stretch(np.isin(x[a:b], y[c:d]), DENSITIES[level])
        a, b, whole = a + m, a + n, (a, b)
        if b - a >= width and d - c >= width:
            both = len(np.intersect1d(x[a:b], y[c:d]))
            j = both / (len(np.unique(x[a:b])) + len(np.unique(y[c:d])) - both)
            if j >= similarity:
                out.append((a, b - a, c, d - c, float(j)))
                out += [(a, b - a, *found) for found in occurrences(x[a:b], y, [(0, c), (d, len(y))], width, similarity)]
                open_[a:b] = False
                continue
        if level + 1 < len(DENSITIES):
            level += 1
        else:
            open_[whole[0] : whole[1]] = False
    return out


PASSAGE = "doc_id long, first_word long, n_words long, rep_doc_id long, rep_first_word long, rep_n_words long, similarity double"


def _verify(width: int, shingle: int, similarity: float):
    def run(batches):
        for batch in batches:
            rows = []
            a, fa, b, fb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "fa", "b", "fb"))
            xa, xb = (batch.column(batch.schema.get_field_index(c)) for c in ("xa", "xb"))
            for k in range(batch.num_rows):
                for p, n, c, m, s in alike(np.asarray(xa[k].values), np.asarray(xb[k].values), width, similarity):
                    rows.append((b[k], fb[k] + c, m + shingle - 1, a[k], fa[k] + p, n + shingle - 1, s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [x.split()[0] for x in PASSAGE.split(", ")])
        release()

    return run


def _known(batches):
    for batch in pieces(batches, "text"):
        _, _, firsts = split_words(*utf8(batch.column(1)), SPACED)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(identity(batch.column(1))), pa.array(np.diff(firsts))], ["doc", "id", "words"])


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, collisions: int = COLLISIONS, shingle: int = SHINGLE, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """PASSAGE rows: a passage of doc_id and the passage of an earlier rep_doc_id that it repeats.

    Pairs between representatives of equal texts, and one row of similarity 1 over the whole text for each further copy of
    at least least_words words. Links are to the first and the preceding holder by doc_id, so a passage that m documents share gives
    about m rows, and each of them but the first has one. Null and short texts have no passages. Rows without a doc_id take no part, and repeated rows count once;
    texts under one doc_id aren't compared with each other. Of an empty table nothing comes. Other columns are ignored.
    """
    width = least_words - shingle + 1
    x = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), text_of("text").alias("text"))
    known = land(x.mapInArrow(_known, "doc long, id long, words long").where(F.col("words") >= least_words), "passages-texts")
    groups = known.groupBy("id").agg(F.min("doc").alias("rep"), F.max("doc").alias("other"))
    groups = land(groups, "passages-groups")
    copies = known.join(groups.where("rep < other").select("id", "rep"), "id").where("doc <> rep").select("doc", "rep", "words").distinct()

    placed = window_links(x, groups, hashes, width, shingle, hot, share).repartition("a", "b").sortWithinPartitions("a", "b")
    regions = placed.mapInArrow(_regions(width, collisions), "a long, fa int, ta int, b long, fb int, tb int")
    for end in ("a", "b"):
        regions = regions.join(groups.select(F.col("id").alias(end), F.col("rep").alias(f"doc_{end}")), end)
    swap, names = F.col("doc_a") > F.col("doc_b"), ("a", "fa", "ta", "doc_a", "b", "fb", "tb", "doc_b")
    regions = land(regions.where("doc_a <> doc_b").select(*(F.when(swap, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in zip(names, names[4:] + names[:4]))), "passages-regions")

    wanted = regions.select(F.col("a").alias("id"), F.col("fa").alias("first"), F.col("ta").alias("last"), F.col("doc_a").alias("doc")).union(regions.select("b", "fb", "tb", "doc_b")).distinct()
    ranges = wanted.groupBy("doc", "id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))  # two integers a range
    fetched = land(x.join(ranges.hint("shuffle_hash"), "doc").select("id", "text", "ranges").mapInArrow(_fetch(shingle), "id long, first int, last int, tokens array<int>").dropDuplicates(["id", "first", "last"]), "passages-tokens")
    side = lambda p: fetched.select(F.col("id").alias(p), F.col("first").alias(f"f{p}"), F.col("last").alias(f"t{p}"), F.col("tokens").alias(f"x{p}"))
    pairs = regions.join(side("a"), ["a", "fa", "ta"]).join(side("b"), ["b", "fb", "tb"]).select(F.col("doc_a").alias("a"), "fa", "xa", F.col("doc_b").alias("b"), "fb", "xb")
    near = pairs.mapInArrow(_verify(width, shingle, similarity), PASSAGE)
    zero = F.lit(0).cast("long")
    return near.distinct().unionByName(copies.select(F.col("doc").alias("doc_id"), zero.alias("first_word"), F.col("words").alias("n_words"), F.col("rep").alias("rep_doc_id"), zero.alias("rep_first_word"), F.col("words").alias("rep_n_words"), F.lit(1.0).alias("similarity")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))
