import re

import numpy as np
from pyspark.sql import functions as F

from siftline.llm.quality_rules import BASE, Rule, judgement, kept_documents, learn, learned_rules, op6_quality_rules, statistics


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen, twice = set(), set()
    for x in win:
        (twice if x in seen else seen).add(x)
    hit = {p for k, x in enumerate(win) if x in twice for p in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t", "one", "a b c d e", "a b c d e f " * 2, "x " * 30, "l one\nl one\n\n \nl one \n", "# * $$ a|b <x>", "é日本 \x1c x\x85y", "a b c d e a b c d e f g h i", "w " * 20_000 + "end", "a b c d e x a b c d e y a b c d e"]


def test_statistics_against_brute_force(spark, sf):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", statistics(F.col("text")).alias("s")).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k][n] for n in BASE) == brute(t), t


def test_no_python_on_the_main_path(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = d.select(judgement(F.col("text"), [Rule((("words", True, 3.0),))]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_learning_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = {k: rng.random(3000) for k in ("a", "b", "c")}
    bad = (x["a"] > 0.9) | (x["b"] < 0.1) & (x["c"] > 0.5)
    rules = learn(x, bad)
    covered = np.any([r.covers(x) for r in rules], axis=0)
    assert (covered == bad).mean() > 0.98 and (covered & ~bad).mean() < 0.01


def test_without_both_labels_there_are_no_rules():
    x = {"a": np.arange(10.0)}
    assert learn(x, np.ones(10, bool)) == [] and learn(x, np.zeros(10, bool)) == [] and learn({"a": np.empty(0)}, np.empty(0, bool)) == []


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = learned_rules(docs, labels.where("doc_id % 2 = 0"))
    got = labels.where("doc_id % 2 = 1").join(docs, "doc_id").select("quality", judgement(F.col("text"), rules)["kept"].alias("kept")).collect()
    right = [r["kept"] == (r["quality"] == 1) for r in got]
    assert np.mean(right) > 0.95 and np.mean([r["kept"] for r in got if r["quality"] == 1]) > 0.97


def test_stage(spark):
    rows = [(1, "fine words " + " ".join(f"w{k}" for k in range(30))), (2, "too short"), (3, None), (None, " ".join(f"v{k}" for k in range(30))), (4, "same five words again here " * 9), (1, "fine words " + " ".join(f"w{k}" for k in range(30)))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("c")).withColumn("_kept", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    left = kept_documents(d, labels)
    assert left.columns == d.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "1", "None"]
    assert kept_documents(d.limit(0), labels.limit(0)).count() == 0


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op6_quality_rules(spark, sf).collect():
        n = brute(texts[r["doc_id"]])
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        assert (tuple(r[k] for k in BASE), r["base_failed"]) == (n, failed) and not (failed and r["kept"])


def test_verdicts_are_those_of_the_rules(spark, sf):
    from siftline.llm.quality_rules import FEATURES, features

    sf = sf.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = learned_rules(docs, labels)
    assert rules
    x = {r["doc_id"]: r for r in docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", *(v.alias(k) for k, v in features(F.col("s")).items())).collect()}
    got = op6_quality_rules(spark, sf).collect()
    columns = {k: np.array([x[r["doc_id"]][k] for r in got], float) for k in FEATURES}
    rejected = np.any([rule.covers(columns) for rule in rules], axis=0)
    assert [r["kept"] for r in got] == [not r["base_failed"] and not bad for r, bad in zip(got, rejected.tolist())] and rejected.any()


def test_repeated_rows_are_one_row_of_the_sample(spark):
    good, bad = "fine words " + " ".join(f"w{k}" for k in range(30)), "junk ### " * 12 + " ".join(f"v{k}" for k in range(40))
    d = spark.createDataFrame([(k % 20, good if k % 2 else bad) for k in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    assert learned_rules(d, labels) == learned_rules(d.distinct(), labels)
