import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from siftline.llm.encoding import default_tokenizer
from siftline.llm.quality_rules import op6_quality_rules
from siftline.llm.shared import land

WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The documents and what each stage makes of what the one before it kept, as rows; the last but one also as it is stored."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, stage in P.STAGES:
        docs = land(stage(spark, docs, sf), f"test-{name}")
        out.append((docs.orderBy("_metadata.file_name", "_metadata.row_index") if name == "mix_sources" else docs).collect())
    return out


def test_all_stages_but_the_last_return_documents(steps):
    assert all(s[0].asDict().keys() == steps[0][0].asDict().keys() for s in steps[:5])
    assert list(steps[5][0].asDict()) == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_keeps_what_the_rules_keep(spark, sf, steps):
    kept = {r["doc_id"] for r in op6_quality_rules(spark, sf).collect() if r["kept"]}
    assert {tuple(r) for r in steps[1]} == {tuple(r) for r in steps[0] if r["doc_id"] in kept} and len(steps[1]) < len(steps[0])


def test_one_of_each_group_of_near_copies_stays(steps):
    sets = {}
    for r in steps[1]:
        w = [x.translate(lower) for x in WORD.findall(r["text"])]
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {r["doc_id"] for r in steps[2]} == {i for i in ids if root[i] == i} and len(steps[2]) < len(steps[1])


def test_documents_with_a_window_of_the_benchmark_go(spark, sf, steps):
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = ALNUM.findall((r["text"] or "").translate(lower))
        windows |= {tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))} if w else set()
    sizes = {len(x) for x in windows}

    def hit(text):
        w = ALNUM.findall(text.translate(lower))
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    assert [r["doc_id"] for r in sorted(steps[2], key=lambda r: r["doc_id"]) if not hit(r["text"])] == sorted(r["doc_id"] for r in steps[3])


def test_the_mix_takes_words_of_its_documents_up_to_the_targets(steps):
    texts = {r["doc_id"]: WORD.findall(r["text"]) for r in steps[3]}
    source, size, taken, words = {r["doc_id"]: r["source"] for r in steps[3]}, defaultdict(int), defaultdict(int), defaultdict(int)
    for i, w in texts.items():
        size[source[i]] += len(w)
    for r in steps[4]:
        w = WORD.findall(r["text"])
        taken[r["source"]] += len(w)
        words[r["doc_id"]] += len(w)
        assert r["source"] == source[r["doc_id"]] and r["n_chars"] == len(r["text"])
        runs = [WORD.findall(x) for x in r["text"].split("\n")]
        whole = " ".join(texts[r["doc_id"]])
        assert w and (w == texts[r["doc_id"]] or all(f" {' '.join(x)} " in f" {whole} " for x in runs if x))
    assert all(n <= 2 * len(texts[i]) for i, n in words.items())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, left, goal = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), {}
    while True:  # targets stop at twice the size, the rest is dealt again
        open_ = [s for s in names if size[s] and s not in goal]
        share = {s: (left - sum(goal.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        if not (over := [s for s in open_ if share[s] > 2 * size[s]]):
            break
        goal |= {s: 2 * size[s] for s in over}
    goal |= share
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)


def test_tokens_are_the_librarys_in_the_order_of_the_mix(steps):
    tokenizer, start = Tokenizer.from_file(default_tokenizer()), 0
    got = sorted(steps[5], key=lambda r: r["start"])
    assert len(got) == len(steps[4])
    for r, mixed in zip(got, steps[4]):
        ids = np.array([*tokenizer.encode(mixed["text"], add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r) == (mixed["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_run_ends_on_an_empty_table(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0


def test_run_takes_nulls_repeats_and_extra_columns(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "words of a text without an id " * 3, "en", None, 5), (10**6, None, None, "a", None), (10**6 + 1, "", "en", "b", 0)], d.schema)
    all_ = d.unionByName(d.limit(5)).unionByName(odd)
    for c in ("size", "hot", "text_", "_hash", "row", "tab"):
        all_ = all_.withColumn(c, all_["doc_id"])
    all_.write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() > 20
