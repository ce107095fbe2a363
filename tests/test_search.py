import math
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import ring
from siftline.operators import hybrid, lexical, vectors
from siftline.operators import index as X
from siftline.operators.coordinator import Coordinator, WindowPolicy, best_of_shards, shard_summary

ENGINE = [(1, "python python search engine"), (2, "python database"), (3, "distributed systems"), (4, "python search")]


def built(spark, rows, shards=None):
    d = spark.createDataFrame(rows, "doc_id long, content string")
    return X.build(d, F.col("content"), normalise=False, shard=None if shards is None else ring.shard_of(F.col("doc_id"), shards))


def pairs(df, *columns):
    return [tuple(r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in columns or ("doc_id", "score")) for r in df.collect()]


def test_postings_and_statistics(spark):
    x = built(spark, [(1, "python quick powerful python"), (2, ""), (3, "database search")])
    assert {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in x.postings.collect()}[("python", 1)] == (2, [0, 3])
    assert {r["doc_id"]: r["doc_len"] for r in x.docs.collect()} == {1: 4, 2: 0, 3: 2}
    assert x.vocabulary_size().first()[0] == 5 and x.shards().first()["n_docs"] == 3
    assert pairs(x.contains(spark.createDataFrame([(2,), (9,)], "doc_id long")), "doc_id") == [(2,)]


@pytest.mark.parametrize(
    "terms, expected",
    [
        (["python"], [(1, 0.419617581), (2, 0.388457860), (4, 0.388457860)]),
        (["python", "search"], [(4, 1.143370631), (1, 0.976159113), (2, 0.388457860)]),
        (["python", "python"], [(1, 0.839235162), (2, 0.776915719), (4, 0.776915719)]),
        ([], []),
        (["absent"], []),
    ],
)
def test_bm25_golden(spark, terms, expected):
    assert pairs(lexical.search(built(spark, ENGINE), terms)) == expected


def test_limits(spark):
    x = built(spark, ENGINE)
    assert lexical.search(x, ["python"], 0).count() == 0 and lexical.search(x, ["python"], 1).count() == 1
    with pytest.raises(ValueError):
        vectors.nearest(x.docs, [1.0], 0)


def bm25(docs, terms):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for t in terms:
        df = sum(t in w for w in docs.values())
        for i, w in docs.items():
            if t in w:
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg))
    return out


def test_random_corpora_global_and_by_shard(spark):
    random.seed(11)
    docs = {k: random.choices(["alpha", "beta", "gamma", "delta", "omega"], k=random.randrange(1, 12)) for k in range(60)}
    shards = ["s0", "s1", "s2"]
    x = built(spark, [(k, " ".join(w)) for k, w in docs.items()], shards)
    terms = ["alpha", "gamma", "alpha"]
    got = {r["doc_id"]: r["score"] for r in lexical.bm25(x, terms).collect()}
    assert got == pytest.approx(bm25(docs, terms))
    home = {r["doc_id"]: r["shard_id"] for r in x.docs.collect()}
    local = {}
    for s in shards:
        local |= bm25({k: w for k, w in docs.items() if home[k] == s}, terms)
    assert {r["doc_id"]: r["score"] for r in lexical.bm25(x, terms, "shard").collect()} == pytest.approx(local)


def test_replace_remove_merge(spark):
    a, b = built(spark, [(1, "python python search"), (2, "old text")]), built(spark, [(1, "database search")])
    terms = lambda x: sorted((r["doc_id"], r["term"]) for r in x.postings.collect())
    assert terms(X.replaced(a, b)) == terms(X.merge([a, b])) == [(1, "database"), (1, "search"), (2, "old"), (2, "text")]
    assert (1, "python") in terms(X.merge([a, b], "legacy"))
    assert terms(X.removed(a, spark.createDataFrame([(1,)], "doc_id long"))) == [(2, "old"), (2, "text")]


def emb(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>")


def test_nearest(spark):
    v = emb(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])
    assert pairs(vectors.nearest(v, [1, 0], 3)) == [(1, 1.0), (3, round(math.sqrt(0.5), 9)), (2, 0.0)]
    assert pairs(vectors.nearest(emb(spark, [(2, [0.0, 1.0]), (1, [0.0, 1.0])]), [0, 1], 2), "doc_id") == [(1,), (2,)]
    for bad in ([], [0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0]):
        with pytest.raises(ValueError):
            vectors.nearest(v, bad)
    with pytest.raises(Exception, match="dimension"):
        vectors.nearest(v, [1.0]).collect()


@pytest.mark.parametrize("row", [(0, [1.0]), (1, []), (1, [0.0]), (1, [math.nan]), (1, [1.0, 2.0])])
def test_bad_vectors_raise(spark, row):
    with pytest.raises(Exception, match="embeddings"):
        vectors.checked(emb(spark, [row]), 1).collect()


def test_hashing_model():
    m = vectors.HashingModel(8)
    assert sum(x * x for x in m.embed("some words here")) == pytest.approx(1) and m.embed("a b") == m.embed_batch(["a b"])[0]
    with pytest.raises(ValueError):
        m.embed(" ")


def s(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, score double")


@pytest.mark.parametrize(
    "lex, sem, w, expected",
    [
        ([(1, 10.0), (2, 5.0)], [(1, 0.5), (2, 0.9)], (0.5, 0.5), [(1, 0.5), (2, 0.5)]),
        ([(1, 10.0)], [(2, 0.9)], (0.5, 0.5), [(1, 0.5), (2, 0.5)]),
        ([(1, 10.0), (2, 5.0)], [(1, 0.5), (2, 0.9)], (0.8, 0.2), [(1, 0.8), (2, 0.2)]),
        ([(1, 10.0), (2, 5.0)], [(1, 0.9)], (0.5, 0.5), [(1, 1.0), (2, 0.0)]),
        ([(1, -0.5), (2, -1.5)], [], (0.5, 0.5), [(1, 0.5), (2, 0.0)]),
        ([(3, 1.0), (1, 1.0), (2, 1.0)], [], (1, 1), [(1, 0.0), (2, 0.0), (3, 0.0)]),
        ([], [], (0.5, 0.5), []),
    ],
)
def test_fusion(spark, lex, sem, w, expected):
    assert pairs(hybrid.rank(s(spark, lex), s(spark, sem), 10, *w)) == expected
    assert hybrid.rank(s(spark, lex), s(spark, sem), 0, *w).count() == 0


@pytest.mark.parametrize("w", [(0, 0), (-1, 2), (math.nan, 1), (math.inf, 1)])
def test_bad_weights(w):
    with pytest.raises(ValueError):
        hybrid.weights(*w)


def test_scores_are_finite(spark):
    with pytest.raises(Exception, match="finite"):
        hybrid.normalised(s(spark, [(1, math.nan), (2, 1.0)])).collect()


def test_window_policy():
    assert [WindowPolicy().window(k) for k in (1, 5, 10, 20, 100)] == [50, 50, 50, 100, 500] and WindowPolicy(most=200).window(100) == 200
    for bad in (dict(factor=0), dict(least=0), dict(most=0), dict(most=10)):
        with pytest.raises(ValueError):
            WindowPolicy(**bad)
    with pytest.raises(ValueError):
        WindowPolicy().window(0)


def test_ring(spark):
    shards = ["shard-0", "shard-1", "shard-2"]
    ids = spark.range(1000).select("id", ring.shard_of(F.col("id"), shards).alias("s"), ring.shard_of(F.col("id"), [*shards, "shard-3"]).alias("t")).collect()
    assert ids[486]["s"] == "shard-1"
    assert sorted([r["s"] for r in ids].count(x) for x in shards) == [283, 347, 370]
    moved = [r for r in ids if r["s"] != r["t"]]
    assert 0 < len(moved) < 1000 and {r["t"] for r in moved} == {"shard-3"} and len(ring.ring(shards, 10)) == 30
    for bad in ([], ["a", "a"], [""]):
        with pytest.raises(ValueError):
            ring.ring(bad)


def distributed(spark, **options):
    x = built(spark, [(9001, "python text"), (9002, "other words"), (9003, "python code")])
    x.docs = x.docs.withColumn("shard_id", F.concat(F.lit("s"), (F.col("doc_id") - 9001).cast("string")))
    x.postings = x.postings.withColumn("shard_id", F.concat(F.lit("s"), (F.col("doc_id") - 9001).cast("string")))
    x.vectors = emb(spark, [(9001, [1.0, 0.0, 0.0]), (9002, [0.5, 0.0, 0.0]), (9003, [2.0, 0.0, 0.0])]).withColumn("shard_id", F.concat(F.lit("s"), (F.col("doc_id") - 9001).cast("string")))
    return Coordinator(x, **options)


def test_coordinator_modes(spark):
    c = distributed(spark)
    assert pairs(c.lexical("python", ["python"])) == [(9001, 0.287682072), (9003, 0.287682072)]
    assert pairs(c.semantic("python", [1, 0, 0])) == [(9001, 1.0), (9002, 1.0), (9003, 1.0)]
    assert pairs(c.hybrid("python", ["python"], [1, 0, 0])) == [(9001, 0.0), (9002, 0.0), (9003, 0.0)]
    assert c.hybrid(" ", [], [1, 0, 0], 0).count() == 0
    assert c.hybrid("the", [], [1, 0, 0]).count() == 3
    with pytest.raises(ValueError):
        c.lexical("python", ["python"], 0)


def test_partial_and_strict(spark):
    rows = [("s0", "lexical", "failed"), ("s0", "semantic", "timed_out"), ("s1", "lexical", "ok"), ("s1", "semantic", "failed"), ("s2", "lexical", "ok"), ("s2", "semantic", "ok")]
    status = spark.createDataFrame(rows, "shard_id string, source string, status string")
    c = distributed(spark, status=status)
    assert pairs(c.hybrid("python", ["python"], [1, 0, 0]), "doc_id") == [(9003,)]
    assert tuple(shard_summary(status).first()) == (3, 1, 1, 1, True)
    with pytest.raises(RuntimeError):
        distributed(spark, status=status, allow_partial=False).semantic("python", [1, 0, 0])


def test_best_of_shards(spark):
    assert pairs(best_of_shards(s(spark, [(1, 5.0), (1, 10.0), (2, 1.0)])).orderBy("doc_id")) == [(1, 10.0), (2, 1.0)]


def test_query_terms_reach_the_scan(spark, tmp_path):
    x = built(spark, ENGINE)
    x.postings.write.parquet(str(tmp_path / "p"))
    plan = lexical.matching(X.Index(spark.read.parquet(str(tmp_path / "p")), x.docs), ["python"]).select("doc_id")._jdf.queryExecution().toString()
    assert "EqualTo(term,python)" in plan and "positions" not in plan.split("ReadSchema")[-1]


def test_postings_of_arrow_lists():
    """Nulls, blanks, repeats and slices; a later list takes its terms away."""
    import pyarrow as pa

    lists = pa.array([["x"], ["b", "a", "b", "", None, "a"], None, [], ["a"], ["c", "c"]], pa.list_(pa.string()))
    as_sets = lambda got: [sorted((e["term"], tuple(e["positions"])) for e in row) for row in got.to_pylist()]
    whole = [[("x", (0,))], [("a", (1, 5)), ("b", (0, 2))], [], [], [("a", (0,))], [("c", (0, 1))]]
    assert as_sets(X._cut(lists)) == whole and as_sets(X._cut(lists[1:])) == whole[1:] and as_sets(X._cut(lists[:0])) == []
    late = pa.array([["x"], ["a", "z"], ["b"], None, None, ["a", None]], pa.list_(pa.string()))
    assert as_sets(X._cut(lists, late)) == [[], [("b", (0, 2))], [], [], [("a", (0,))], [("c", (0, 1))]]


def test_publishing_documents_makes_postings_once(spark, tmp_path, monkeypatch):
    """Dealing by ranges would make them twice, once for the sample of the ranges; compaction reads stored rows."""
    from siftline.sources.storage import Store

    dealt, frame = [], type(spark.range(1))
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: dealt.append(a) or deal(self, *a))
    store = Store(spark, f"file://{tmp_path}/s")
    d = spark.createDataFrame([(1, "wordb worda wordb"), (2, "worda")], "doc_id long, t string")
    store.publish("shard-0", X.build(d, F.col("t")))
    assert not dealt
    got = lambda: sorted(map(tuple, store.load("shard-0").postings.select("term", "doc_id", "tf", "positions").collect()))
    want = [("worda", 1, 1, [1]), ("worda", 2, 1, [0]), ("wordb", 1, 2, [0, 2])]
    assert got() == want
    store.compact("shard-0")
    assert dealt and got() == want


def test_ring_digest_is_computed_once(spark):
    from siftline.functions import ring

    d = spark.range(50).select(F.col("id"), ring.shard_of(F.col("id"), ["a", "b"], 5).alias("s"))
    assert "<= sha2" not in d._jdf.queryExecution().optimizedPlan().toString()
    import bisect
    import hashlib

    points = ring.ring(["a", "b"], 5)
    for r in d.collect():
        at = bisect.bisect_right([p for p, _ in points], hashlib.sha256(str(r["id"]).encode()).hexdigest())
        assert r["s"] == points[at % len(points)][1]


def test_legacy_merge_shuffles_no_posting(spark):
    """Three segments: the last writer of each term wins, and documents are what is dealt."""
    a, b, c = (X.build(spark.createDataFrame(rows, "doc_id long, t string"), F.col("t")) for rows in ([(1, "worda worda wordb"), (2, "worda"), (None, "wordx wordx")], [(1, "worda wordc"), (None, "wordx")], [(1, "wordc wordc"), (3, None)]))
    out = X.merge([a, b, c], "legacy")
    assert sorted(map(str, map(tuple, out.postings.select("doc_id", "term", "tf").collect()))) == sorted(map(str, [(1, "wordb", 1), (1, "worda", 1), (1, "wordc", 2), (2, "worda", 1), (None, "wordx", 1)]))
    assert sorted(r["doc_len"] for r in out.docs.collect()) == [0, 1, 1, 2]
    plan = out.postings._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan
