import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftline.llm.encoding import default_tokenizer, encoder
from siftline.llm.shared import table
from siftline.llm.token_counts import context_totals, length_histogram, op1_token_counts, totals_at, with_token_count
from siftline.llm.token_output import op8_token_output, read_tokens, token_digest, write_tokens

whole = Tokenizer.from_file(default_tokenizer())


def by_library(text):
    return whole.encode(text or "", add_special_tokens=False).ids


def own(text):
    with encoder(default_tokenizer()) as e:
        return e.ids(pa.array([text]))[0].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t'sStTdDlLéÉßÿİΣσ·ǅ\x1c\x1f\x85  ́<|endoftext>123!?#&")), max_size=60))
def test_any_text_has_the_librarys_ids(text):
    assert own(text) == by_library(text)


def test_documents_have_the_librarys_ids(sf):
    for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist():
        assert own(t) == by_library(t)


def docs(spark):
    rows = [(3, "hello World", 1), (1, None, 2), (2, "", 3), (None, "no id", 4), (3, "hello World", 5), (7, "long " * 50_000, 6), (5, "ünï\x1cçödé 日本語", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumn("ids", F.lit("clash"))


def test_round_trip(spark, tmp_path):
    d, path = docs(spark), f"file://{tmp_path}/t"
    write_tokens(d, path)
    rows = token_digest(spark, path).orderBy("start").collect()
    ids = [by_library(r["text"]) + [1] for r in sorted(d.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))]
    assert [r["n_tokens"] for r in rows] == list(map(len, ids))
    assert [r["start"] for r in rows] == [0, *np.cumsum(list(map(len, ids)))[:-1]]
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_files_are_encoded_and_paged_as_said(spark, sf, tmp_path):
    write_tokens(table(spark, sf, "documents"), f"file://{tmp_path}/t", row_group_bytes=1 << 16, page_rows=20)
    f = pq.ParquetFile(next(p for p in sorted((tmp_path / "t").glob("*.parquet")) if p.stat().st_size > 5000))
    columns = {f.metadata.row_group(0).column(k).path_in_schema: f.metadata.row_group(0).column(k) for k in range(f.metadata.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    plan = read_tokens(spark, f"file://{tmp_path}/t").where("doc_id = 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1] and "EqualTo(doc_id,5)" in plan


def test_empty_table(spark, tmp_path):
    write_tokens(docs(spark).limit(0), f"file://{tmp_path}/e")
    assert token_digest(spark, f"file://{tmp_path}/e").count() == 0
    assert context_totals(length_histogram(with_token_count(docs(spark).limit(0)))).count() == 0


def test_query_8(spark, sf):
    got = {r["doc_id"]: r for r in op8_token_output(spark, sf).collect()}
    start = 0
    for r in sorted(table(spark, sf, "documents").collect(), key=lambda r: r["doc_id"]):
        ids = by_library(r["text"]) + [1]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_context_totals_against_brute_force(spark):
    random.seed(5)
    n = [random.choice([0, 1, 5, 1023, 1024, 1025, 5000, random.randrange(9000)]) for _ in range(400)]
    h = length_histogram(spark.createDataFrame([(x,) for x in n], "n_tokens int"))
    rows = context_totals(h).collect()
    assert len(rows) == len(set(n))
    for r in rows:
        x = r["n_tokens"]
        at_least = [y for y in n if y >= x]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["cut_docs"]) == (n.count(x), len(at_least), sum(at_least), sum(y > x for y in n))
        assert r["truncated_tokens"] == sum(min(x, y) for y in n) and abs(r["quantile"] - sum(y <= x for y in n) / len(n)) < 1e-12
    for r in totals_at(h, [0, 700, 10**6]).collect():
        assert (r["truncated_tokens"], r["cut_docs"]) == (sum(min(r["limit"], y) for y in n), sum(y > r["limit"] for y in n))


def test_query_1(spark, sf):
    n = [len(by_library(r["text"])) for r in table(spark, sf, "documents").collect()]
    rows = {r["n_tokens"]: r for r in op1_token_counts(spark, sf).collect()}
    assert set(rows) == set(n) and all(r["truncated_tokens"] == sum(min(x, y) for y in n) for x, r in rows.items())
