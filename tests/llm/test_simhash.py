import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm.components import roots_of
from siftline.llm.simhash import digest_of, fingerprint, in_tables, linked, near_links, op9_simhash, shingle_hashes, similar_links, with_components, without_near_copies


def plain(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in low).split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near(fps, radius=4):
    u = sorted(set(fps))
    return [(a, b) for k, a in enumerate(u) for b in u[:k] if (a ^ b).bit_count() <= radius]


@pytest.mark.parametrize("t", ["", "  ", "One", "a b c", "A b\tC d\x1ce", "é É ß 日本 x y z", "the cat sat on the mat " * 30, "\x85a b\xa0c d e f"])
def test_fingerprint(t):
    assert fingerprint(t) == plain(t)


@pytest.mark.parametrize("parts", [1, 3])
def test_bit_sliced_comparison(parts):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, parts), dtype=np.uint64)
    fps = np.repeat(base, 8, axis=0)
    for row in fps:
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            row[b % parts] ^= np.uint64(1) << np.uint64(b)
    group = np.sort(rng.integers(0, 6, len(fps)))
    ints = [int("".join(f"{int(x):064b}" for x in row), 2) for row in fps]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if group[a] == group[b] and (ints[a] ^ ints[b]).bit_count() <= 5]
    assert linked(fps, group, None, 5, at_once=50).tolist() == list(groups(range(len(fps)), pairs).values())
    part = rng.integers(0, 2, len(fps))
    assert linked(fps, group, part, 5).tolist() == list(groups(range(len(fps)), [(a, b) for a, b in pairs if part[a] != part[b]]).values())


@pytest.mark.parametrize("hot", [16384, 7])
def test_links_lose_nothing(spark, hot):
    random.seed(2)
    fps = {random.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for b in random.sample(range(64), random.randrange(6)):
                g ^= 1 << b
            fps.add(g)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    found = near_links(in_tables(spark.createDataFrame([(f,) for f in signed], "fp long")), hot=hot).collect()
    assert all((signed[r["a"]] ^ signed[r["b"]]).bit_count() <= 64 for r in found)
    assert groups(signed, [(r["a"], r["b"]) for r in found]) == groups(signed, [(a - (a >> 63 << 64), b - (b >> 63 << 64)) for a, b in near(fps)])


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)] + [(200, 200 + k) for k in range(1, 30)] + [(300 - k, 299 - k) for k in range(20)]
    random.seed(1)
    random.shuffle(edges)
    got = {r["node"]: r["root"] for r in roots_of(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == groups(nodes, edges)
    assert roots_of(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def rows(spark):
    random.seed(4)
    base = [" ".join(f"{random.choice('abcdefgh')}{random.randrange(500)}" for _ in range(120)) for _ in range(12)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(50 + k, base[k % 3] + f" extra{k}") for k in range(20)] + [(90, base[0].upper()), (91, base[0]), (92, None), (93, ""), (94, " \n"), (None, base[5]), (None, "alone"), (95, "Word"), (96, "word"), (3, base[3]), (97, "z " * 30_000)]
    return spark.createDataFrame(out, "doc_id long, text string").withColumn("fp", F.lit("c")).withColumn("_gone", F.lit(1)).withColumn("_hash", F.lit(2)).repartition(3)


def test_against_brute_force(spark):
    d = rows(spark)
    got = with_components(d).collect()
    data = [(r["doc_id"], plain(r["text"])) for r in d.collect()]
    top = groups({f for _, f in data}, near([f for _, f in data]))
    least = defaultdict(list)
    for i, f in data:
        least[top[f]].append(i)
    expected = [(i, f, min((x for x in least[top[f]] if x is not None), default=None)) for i, f in data]
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == sorted(expected, key=str)


def test_query(spark, sf):
    data = [(r["doc_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    top = groups({f for _, f in data}, near([f for _, f in data]))
    least = {}
    for i, f in data:
        least[top[f]] = min(i, least.get(top[f], i))
    assert sorted(map(tuple, op9_simhash(spark, sf).collect())) == sorted((i, f"{f:016x}", least[top[f]]) for i, f in data)


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def test_near_copies_go_and_others_stay(spark):
    d = rows(spark)
    left = without_near_copies(d)
    assert left.columns == d.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [*range(12), 92, 95, 97] and ids.count(None) == 2


def test_near_copies_by_similarity(spark):
    random.seed(9)
    data, expected = [], set()
    for k in range(60):
        w = [f"w{random.randrange(4000)}" for _ in range(random.randrange(60, 400))]
        data.append((10 * k, " ".join(w)))
        for c in range(1, 4):
            v = list(w)
            for p in random.sample(range(len(v)), max(1, int(len(v) * random.choice([0.005, 0.01, 0.02, 0.2])))):
                v[p] = f"n{random.randrange(10**6)}"
            data.append((10 * k + c, " ".join(v)))
            a, b = shingles(" ".join(v)), shingles(" ".join(w))
            expected.add((10 * k + c, len(a & b) / len(a | b)))
    left = {r["doc_id"] for r in without_near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {i for i, _ in data if i % 10 == 0} <= left
    gone = [i not in left for i, j in expected if j >= 0.8]
    assert np.mean(gone) > 0.97
    assert all(i in left for i, j in expected if j < 0.6)


def test_texts_that_share_a_repeated_run_alone_stay(spark):
    random.seed(12)
    new = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    data = [(k, f"{new(400)} {'ha ' * 200}{new(400)}") for k in range(20)]
    assert without_near_copies(spark.createDataFrame(data, "doc_id long, text string")).count() == 20


def test_near_copies_are_decided_exactly(spark):
    random.seed(13)
    data, pairs = [], []
    for k in range(120):
        w = [f"w{random.randrange(10**6)}" for _ in range(304)]
        n = random.randrange(18, 56)  # a changed end of n words: similarity (300 - n) / (300 + n), from 0.69 to 0.89
        v = w[: 304 - n] + [f"n{random.randrange(10**6)}" for _ in range(n)]
        data += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        a, b = shingles(data[-1][1]), shingles(data[-2][1])
        pairs.append(len(a & b) / len(a | b))
    left = {r["doc_id"] for r in without_near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert left == {2 * k for k in range(120)} | {2 * k + 1 for k, j in enumerate(pairs) if j < 0.8} and 30 < sum(j < 0.8 for j in pairs) < 90


@pytest.mark.parametrize("most", [1 << 21, 400])
def test_links_by_exact_similarity(spark, most):
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    data = [(k, " ".join(base[p : p + 60])) for k, p in enumerate(rng.sample(range(340), 40))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    digests = {k: digest_of(np.unique(shingle_hashes(t, 5))) for k, t in data}
    distinct = spark.createDataFrame([(k, bytes(d), [1, 2, 3], 56) for k, d in digests.items()], "node long, digest binary, keys array<long>, size long")
    candidates = spark.createDataFrame([(k, 0) for k in range(40)], "node long, root long")
    s = {k: shingles(t) for k, t in data}
    expected = groups(s, [(a, b) for a in s for b in range(a) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.8])
    found = [(r["a"], r["b"]) for r in similar_links(docs, distinct, candidates, 5, 0.8, most=most).collect()]
    assert groups(s, found) == expected and 1 < len(set(expected.values())) < 40


def test_empty(spark):
    assert with_components(rows(spark).limit(0)).count() == 0 and without_near_copies(rows(spark).limit(0)).count() == 0


@pytest.mark.parametrize("share", [2, 3, 4])
def test_near_fingerprints_meet_in_a_table(spark, share):
    from siftline.llm.simhash import in_tables, shared_blocks

    rng = np.random.default_rng(share)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = a.copy()
    for k in range(300):
        for bit in rng.choice(64, 4, replace=False):
            b[k] ^= np.uint64(1 << int(bit))
    d = spark.createDataFrame([(int(x),) for x in np.concatenate([a, b]).view(np.int64)], "fp long")
    met = {(r["x"], r["y"]) for r in in_tables(d, 4, share).groupBy("tab", "key").agg(F.collect_list("node").alias("n")).where("size(n) > 1").select(F.explode("n").alias("x"), "n").select("x", F.explode("n").alias("y")).collect()}
    assert all((int(x), int(y)) in met for x, y in zip(a.view(np.int64), b.view(np.int64)))
    assert [shared_blocks(n) for n in (0, 10**6, 10**10, 10**12)] == [2, 2, 3, 4]
