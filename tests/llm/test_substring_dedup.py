import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from siftline.llm.substring_dedup import alike, compact_windows, op4_substring_dedup, repeated_passages


def test_compact_windows_against_brute_force():
    random.seed(1)
    for _ in range(40):
        sizes = [random.randrange(0, 40) for _ in range(4)]
        values = np.array([random.randrange(1, 30) for _ in range(sum(sizes))], np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        width = random.randrange(2, 9)
        text, i, c, j = compact_windows(values, starts, width)
        covered = defaultdict(set)
        for t, a, m, b in zip(text, i, c, j):
            assert starts[t] <= a <= m <= b < starts[t + 1] and values[a : b + 1].min() == values[m] and b - a + 1 >= width
            covered[t].add((int(a), int(b), int(values[m])))
        # Every long subsequence lies in a window of its own minimum.
        for t in range(4):
            for a in range(starts[t], starts[t + 1]):
                for b in range(a + width - 1, starts[t + 1]):
                    assert any(x <= a and b <= y and v == values[a : b + 1].min() for x, y, v in covered[t])


def words(n, tag):
    return [f"{tag}{random.randrange(10**6)}" for _ in range(n)]


def case(spark):
    random.seed(5)
    passage, other = words(60, "p"), words(55, "q")
    docs = {k: words(150, f"d{k}.") for k in range(30)}
    for k in range(5):
        docs[k] = docs[k][:40] + passage + docs[k][40:]
    for k in (7, 9):
        docs[k] = other + docs[k]
    near = list(docs[12])
    for p in random.sample(range(150), 3):
        near[p] = "changed"
    docs[40] = near
    short = words(45, "s")  # shorter than a passage
    docs[20] += short
    docs[21] += short
    rows = [(k, " ".join(w)) for k, w in docs.items()] + [(60, " ".join(docs[15])), (61, " ".join(docs[15])), (70, None), (71, ""), (72, "few words"), (73, "few words"), (None, " ".join(docs[0])), (15, " ".join(docs[15])), (80, "same " * 9000), (81, "same " * 7000)]
    return passage, spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("rep", F.lit(1)).repartition(4)


def test_planted_passages(spark):
    passage, d = case(spark)
    got = repeated_passages(d).collect()
    links = {(r["rep_doc_id"], r["doc_id"]) for r in got}
    assert {(0, 1), (7, 9), (12, 40), (15, 60), (15, 61)} <= links
    touched = {x for e in links for x in e}
    assert touched - {80, 81} == {0, 1, 2, 3, 4, 7, 9, 12, 40, 15, 60, 61}
    for r in got:
        if r["rep_doc_id"] == 0:
            assert abs(r["first_word"] - 40) <= 4 and abs(r["n_words"] - 60) <= 8 and r["similarity"] >= 0.8
    assert all(r["n_words"] >= 50 and r["rep_doc_id"] < r["doc_id"] for r in got)


def test_empty(spark):
    assert repeated_passages(case(spark)[1].limit(0)).count() == 0


def test_two_passages_of_one_pair():
    random.seed(2)
    a, b = (np.array([random.randrange(10**6) for _ in range(60)]) for _ in "ab")
    x = np.concatenate([a, np.arange(-300, -100), b])
    y = np.concatenate([b, np.arange(-900, -700), a])
    assert sorted((p[0], p[1], p[2]) for p in alike(x, y, 46, 0.8)) == [(0, 60, 260), (260, 60, 0)]


def test_query_finds_long_verbatim_repeats(spark, sf):
    docs = {r["doc_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    holders = defaultdict(set)
    for i, w in docs.items():
        for k in range(len(w) - 54):
            holders[tuple(w[k : k + 55])].add(i)
    got = op4_substring_dedup(spark, sf).collect()
    parent = {i: i for i in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        parent[top(r["doc_id"])] = top(r["rep_doc_id"])
    repeated = [h for h in holders.values() if len(h) > 1]
    assert repeated and all(len({top(i) for i in h}) == 1 for h in repeated)


def test_every_occurrence_in_the_later_text():
    from siftline.llm.substring_dedup import alike

    rng = np.random.default_rng(8)
    new = lambda n: rng.integers(1000, 2**31, n)
    p = np.arange(60)
    x, y = np.concatenate([new(30), p, new(30)]), np.concatenate([new(20), p, new(100), p, new(50), p])
    assert sorted((a, c) for a, _, c, _, s in alike(x, y, 46, 0.8) if s == 1) == [(30, 20), (30, 180), (30, 290)]


def brute_links(docs, width=46, similarity=0.8):
    """Pairs of documents with stretches of width tokens or more, around any common token, that are similar enough."""
    tokens = {k: [hash(" ".join(w[x : x + 5])) for x in range(len(w) - 4)] for k, w in docs.items()}
    out = set()
    for a in tokens:
        for b in tokens:
            if a < b and alike(np.array(tokens[a]), np.array(tokens[b]), width, similarity):
                out.add((a, b))
    return out


def recall(spark, seed, holders, passage, stock, **options):
    """Share of the pairs that brute force finds and that the operator connects, and the pairs of unlike texts that it links."""
    random.seed(seed)
    line = words(stock, "stock")
    docs, group = {}, {}
    for g, n in enumerate(holders):
        common = words(passage - stock, f"g{g}.")
        common[len(common) // 2 : len(common) // 2] = line
        for k in range(n):
            mine = list(common)
            if k % 2:
                mine[random.randrange(passage)] = "changed"
            group[len(docs)] = g
            docs[len(docs)] = words(random.randrange(30, 80), f"x{len(docs)}.") + mine + words(random.randrange(30, 80), f"y{len(docs)}.")
    for _ in range(150):  # the line alone, in unlike texts
        docs[len(docs)] = words(60, f"z{len(docs)}.") + line + words(60, f"v{len(docs)}.")
    got = repeated_passages(spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string").repartition(4), **options).collect()
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        parent[top(r["doc_id"])] = top(r["rep_doc_id"])
    wanted = brute_links(docs)
    return sum(top(a) == top(b) for a, b in wanted) / len(wanted), {(a, b) for a, b in ((r["rep_doc_id"], r["doc_id"]) for r in got) if a not in group or group[a] != group.get(b)}


def test_recall_of_groups_against_brute_force(spark):
    found, wrong = zip(*(recall(spark, k, [2] * 25 + [8, 30], n, 0) for k, n in enumerate((60, 80))))
    assert min(found) >= 0.95 and not any(wrong), (found, wrong)


def test_recall_around_a_frequent_line(spark):
    """A line of 24 words stands in all texts; alike passages hold it, and so do 150 unlike texts. Its tokens are frequent minima in
    the second case."""
    found, wrong = zip(*(recall(spark, 3, [2] * 20 + [10], 80, 24, **o) for o in ({}, {"hot": 40, "share": 1})))
    assert min(found) >= 0.95 and not any(wrong), (found, wrong)


def test_every_later_holder_has_a_row(spark):
    """Passages that 12 unlike texts hold, dealt whole and in parts: each holder but the first repeats it from an earlier one."""
    random.seed(11)
    passages = [words(60, f"p{g}.") for g in range(8)]
    docs = [words(random.randrange(20, 60), f"x{k}.") + passages[k % 8] + words(random.randrange(20, 60), f"y{k}.") for k in range(96)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string").repartition(4)
    lost = []
    for options in ({}, {"hot": 2, "share": 1}):
        got = repeated_passages(d, **options).collect()
        assert all(r["rep_doc_id"] < r["doc_id"] and (r["doc_id"] - r["rep_doc_id"]) % 8 == 0 for r in got)
        whole = {r["doc_id"] for r in got if r["first_word"] <= docs[r["doc_id"]].index(passages[r["doc_id"] % 8][0]) + 4 and r["n_words"] >= 56}
        lost.append(sorted(set(range(8, 96)) - whole))
    assert lost == [[], []]


def test_frequent_minima_lose_no_link(spark):
    """Passages with a changed word under one hash function: the pairs that meet don't hang on which minima are held to be frequent."""
    random.seed(12)
    docs = []
    for g in range(120):
        common = words(64, f"g{g}.")
        near = list(common)
        near[32] = "changed"
        docs += [words(20, f"x{g}.") + w + words(20, f"y{g}.{k}.") for k, w in enumerate((common, near))]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string").repartition(4)
    met = [{(r["rep_doc_id"], r["doc_id"]) for r in repeated_passages(d, hashes=1, collisions=1, **o).collect()} for o in ({}, {"hot": 2, "share": 1})]
    assert len(met[0]) > 40 and met[0] == met[1]
