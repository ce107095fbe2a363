import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm.mixing import Recipe, Tree, hypergeometric, mix, mixed_documents, op3_mixing, permuted, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 1025])
def test_permutation(n):
    assert sorted(permuted(np.arange(n), n, 7)) == list(range(n))
    assert n < 10 or (permuted(np.arange(n), n, 7) != permuted(np.arange(n), n, 8)).any()


def test_tree_splits_quotas_exactly():
    q = np.array([1000, 0, 37, 5])
    out = Tree(q, 7, 3).leaves()
    assert (out.sum(axis=0) == q).all() and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= 2
    assert (out == Tree(q, 7, 3).leaves()).all()


def test_tree_follows_the_hypergeometric_law():
    draws = np.array([Tree(np.array([30, 70]), 2, s).left(0, 2, np.array([30, 70]))[0] for s in range(2000)])
    assert abs(draws.mean() - 15) < 0.3 and abs(draws.var() - 50 * 0.3 * 0.7 * 50 / 99) < 0.6


@pytest.mark.parametrize("good,bad,n", [(300_000_000, 900_000_000, 500_000_000), (900_000_000, 300_000_000, 700_000_000), (5, 2_000_000_000, 1_000_000_000)])
def test_draws_from_many(good, bad, n):
    rng, total = np.random.default_rng(5), good + bad
    draws = np.array([hypergeometric(rng, good, bad, n) for _ in range(4000)], float)
    mean, var = n * good / total, n * good / total * bad / total * (total - n) / (total - 1)
    assert abs(draws.mean() - mean) < 4 * (var / 4000) ** 0.5 and 0.9 < draws.var() / var < 1.1
    assert draws.min() >= 0 and draws.max() <= min(good, n)


def brute_targets(sizes, weights, share=1.5, most=2):
    """A source's excess is dealt again until none is above, one source at a time."""
    fixed = {}
    while True:
        left = share * sum(sizes) - sum(fixed.values())
        open_ = [k for k, n in enumerate(sizes) if n and k not in fixed]
        goal = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if goal[k] > most * sizes[k]]
        if not over:
            return [float(fixed.get(k, goal.get(k, 0.0))) for k in range(len(sizes))]
        fixed |= {k: most * sizes[k] for k in over}


def test_targets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = (rng.random(6) ** 4 * 1000).astype(int).tolist()
        assert targets(sizes, [3, 1, 2] * 2) == pytest.approx(brute_targets(sizes, [3, 1, 2] * 2))
    assert targets([100, 100], [3, 1]) == [200.0, 100.0]
    assert targets([10, 1000, 0], [3, 1, 2]) == [20.0, 1495.0, 0.0]
    assert targets([], []) == []


def rows(spark):
    data = [(i, " ".join(f"w{i}.{k}" for k in range(i % 37)), ["a", "b", None, "é", ""][i % 5] if i % 3 else "a") for i in range(400)]
    data += [(1000, "big " * 20_000, "b"), (1001, None, "c"), (1002, "", None), (1003, " \n\t ", "a"), (5, data[5][1], data[5][2]), (None, "x y", "b")]
    return spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("_start", F.lit(1))


def test_words_taken_meet_targets(spark):
    d = rows(spark)
    got = mix(d, ["doc_id"], block=16, words_a_shard=3000).collect()
    size = defaultdict(int)
    for r in d.collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = targets([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])
    assert len(got) == d.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[(r["source_size"], r["target"])] += r["taken"]
        assert r["taken"] == sum(s["words"] for s in r["pieces"])
    for s, g in zip(names, goal):
        assert abs(by_target[(size[s], g)] - g) <= 1
    again = mix(d.repartition(7), ["doc_id"], block=16, words_a_shard=3000).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["pieces"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_pieces_are_disjoint_and_follow_quotas(spark):
    got = mix(rows(spark), ["doc_id"], block=16, words_a_shard=3000).collect()
    for r in got:
        for p in {s["pass"] for s in r["pieces"]}:
            spans = sorted((x["first"], x["first"] + x["words"]) for s in r["pieces"] if s["pass"] == p for x in s["runs"])
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(e <= r["size"] for _, e in spans)
    words = defaultdict(int)
    for r in got:
        for s in r["pieces"]:
            assert s["words"] == sum(x["words"] for x in s["runs"])
            words[s["shard"], r["source_size"], r["target"]] += s["words"]
    size = defaultdict(int)
    for r in rows(spark).collect():
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    recipe = Recipe.of([(k, n, 0) for k, n in size.items()], (3, 1, 2), 1.5, 2, 16, 3000, 17)
    leaves = recipe.tree.leaves()
    assert len(leaves) > 10 and (leaves.sum(axis=0) == recipe.tree.quotas).all()
    for shard, leaf in enumerate(leaves):  # of each source a shard has just its leaf's blocks; short ones are two a pass
        for k, n in enumerate(leaf):
            have = words[shard, recipe.sizes[k], recipe.targets[k]]
            assert 16 * (n - 3) < have <= 16 * n or not n == have


def test_written_shards_hold_their_quotas_and_part_repeats(spark, tmp_path):
    d = spark.createDataFrame([(i, " ".join([f"w{i}"] * 16), "ab"[i % 2]) for i in range(3000)], "doc_id long, text string, source string")
    mixed_documents(d, block=16, words_a_shard=6000).write.parquet(f"file://{tmp_path}/mix")
    leaves = Recipe.of([("a", 24_000, 0), ("b", 24_000, 0)], (3, 1, 2), 1.5, 2, 16, 6000, 17).tree.leaves()
    stored = spark.read.parquet(f"file://{tmp_path}/mix").select("*", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    counted = sorted(tuple(map(int, leaf)) for leaf in leaves)
    files = defaultdict(list)
    for r in stored:
        files[r["file_name"]].append((r["doc_id"], r["source"]))
    for f in files.values():
        assert all(a[0] != b[0] for a, b in zip(f, f[1:]))
    assert sum(map(len, files.values())) == sum(map(sum, counted)) == 72_000 // 16


def test_texts_of_the_mix(spark):
    d = rows(spark)
    out = mixed_documents(d, block=16, words_a_shard=3000)
    assert out.columns == d.columns
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mix(d, ["doc_id"], block=16, words_a_shard=3000).collect()}
    seen = defaultdict(int)
    texts = {r["doc_id"]: WORD.findall(r["text"] or "") for r in d.collect()}
    for r in out.collect():
        w = WORD.findall(r["text"])
        seen[r["doc_id"]] += len(w)
        assert w and set(w) <= set(texts[r["doc_id"]]) and r["size"] == "clash"
    assert sum(seen.values()) == sum(r["taken"] for r in mix(d, ["doc_id"], block=16, words_a_shard=3000).collect())
    assert all(seen[k] == v for (k, _), v in taken.items() if k not in (5, None))


def test_empty(spark):
    assert mix(rows(spark).limit(0), ["doc_id"]).count() == 0 and mixed_documents(rows(spark).limit(0)).count() == 0
    assert mix(rows(spark).where("text IS NULL"), ["doc_id"]).first()["taken"] == 0


def test_query(spark, sf):
    got = op3_mixing(spark, sf).collect()
    sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(sizes.values())) <= 20


def test_recipe_of_one_source_alone():
    r = Recipe.of([("a", 100, 3)], (3,), 1.5, 2, 16, 1000, 1)
    assert r.whole == [1] and r.targets == [150.0]
