import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.llm.decontamination import contamination, decontaminate, longest_matches, op5_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench, n=8):
    windows = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, items, hit = words(t), set(), set()
        for length in {len(x) for x in windows}:
            for k in range(len(w) - length + 1):
                if found := windows.get(tuple(w[k : k + length])):
                    items |= found
                    hit |= set(range(k, k + length))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case(spark):
    random.seed(3)
    vocabulary = ["the", "of", "a1", "É", "café", "x", "y", "Z"]
    bench = [(k, " ".join(random.choices(vocabulary, k=random.choice([3, 7, 8, 9, 12, 40])))) for k in range(30)]
    bench += [(2, bench[2][1]), (2, "the of a1 x y z z x y"), (90, None), (91, ""), (92, "!!"), (None, "only here once and for all it stands")]
    docs = [(k, " ".join(random.choices(vocabulary, k=random.randrange(60)))) for k in range(150)]
    docs += [(200 + k, f"Some words, then: {bench[k][1]}... and {bench[k + 1][1]} end") for k in range(20)]
    docs += [(300, None), (301, ""), (302, "the-of;A1 x"), (None, bench[5][1]), (0, docs[0][1]), (303, "of " * 60_000 + bench[7][1]), (304, "ONLY here once and for all it stands")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_hit", F.lit(b"c")).withColumn("item_id", F.lit(1))
    return docs, bench, d.repartition(3), spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))


@pytest.mark.parametrize("block", [10**6, 60])
def test_against_brute_force(case, block):
    docs, bench, d, b = case
    assert sorted(map(tuple, contamination(d, b, block_words=block).collect()), key=str) == brute(docs, bench)


@pytest.mark.parametrize("block", [10**6, 60])
def test_contaminated_rows_go(case, block):
    docs, bench, d, b = case
    left = decontaminate(d, b, block_words=block)
    assert left.columns == d.columns
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(str(r[0]) for r in brute(docs, bench) if not r[-1])


def test_longest_matches(spark):
    item = "a b c d e f g h i j k l"
    d = spark.createDataFrame([(1, f"z z {item} q"), (2, "b c d e f g h i z"), (3, "a b c d e f g"), (4, f"{item} {item}")], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(map(tuple, longest_matches(d, b).collect())) == [(1, "7", 2, 0, 12), (2, "7", 0, 1, 8), (4, "7", 0, 0, 12), (4, "7", 12, 0, 12)]


def test_empty(case):
    _, _, d, b = case
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).where("n_items > 0 OR contaminated").count() == 0
    assert decontaminate(d, b.limit(0)).count() == d.count()


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, op5_decontamination(spark, sf).collect()), key=str) == brute(docs, bench)
