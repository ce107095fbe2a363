import pytest
from pyspark.sql import functions as F

from siftline.functions.clients import Retryable, RetryPolicy, shard_map
from siftline.operators import changes, crawl
from siftline.operators.service import BATCH, ShardService, checked_limit
from siftline.operators.vectors import HashingModel
from siftline.plans.engine import Engine, bootstrap, complete
from siftline.plans.ingest import crawl_sites, ingest, resume
from siftline.sources.storage import Store


def test_upsert_numbers_every_created_document(spark):
    old = spark.createDataFrame([], changes.DOCUMENT)
    new = spark.range(200_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("t").alias("title"), F.lit("c").alias("content"), F.lit("x").alias("content_type"))
    got = changes.upserted(old, changes.detect(old, new), 7)
    n, ids, least, most = got.agg(F.count("*"), F.countDistinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    assert (n, ids, least, most) == (200_000, 200_000, 7, 200_006)
    assert got.withColumn("up", F.expr("lag(url) OVER (ORDER BY doc_id) < url")).where("NOT up").count() == 0


def test_upsert_of_repeated_urls_follows_arrival(spark):
    old = spark.createDataFrame([(5, "a", "old", "x", "text", "", 3)], changes.DOCUMENT)
    old = old.withColumn("content_hash", changes.content_hash(F.col("content")))
    rows = [("a", "t1", "x", 1), ("a", "t2", "y", 2), ("a", "t3", "y", 3), ("b", "n1", "1", 1), ("b", "n2", "2", 2), ("b", "n3", "1", 3), ("c", "z", "", 1)]
    new = spark.createDataFrame([(u, t, c, "text", k) for u, t, c, k in rows], "url string, title string, content string, content_type string, k int").repartition(3)
    found = changes.detect(old, new, "k")
    assert [(r["url"], r["change_type"], r["version"], r["title"]) for r in found.orderBy("url", "arrival").collect()] == [
        ("a", "unchanged", 3, "old"), ("a", "updated", 4, "t2"), ("a", "unchanged", 4, "t2"), ("b", "created", 1, "n1"), ("b", "updated", 2, "n2"), ("b", "updated", 3, "n3"), ("c", "created", 1, "z"),
    ]
    got = changes.upserted(old, found, 10)
    assert sorted((r["url"], r["doc_id"], r["title"], r["content"], r["version"]) for r in got.collect()) == [("a", 5, "t2", "y", 4), ("b", 10, "n3", "1", 3), ("c", 11, "z", "", 1)]
    assert changes.by_url(got, "b").first()["doc_id"] == 10 and changes.by_url(got, "no").count() == 0


def batch(spark, *rows):
    return spark.createDataFrame([(d, t.split(), e) for d, t, e in rows], BATCH)


def test_shard_service(spark, tmp_path):
    s = ShardService(Store(spark, f"file://{tmp_path}/s"), "shard-1")
    assert not s.health() and not s.contains(1)
    with pytest.raises(LookupError):
        s.count()
    assert s.index_documents(batch(spark, (1, "red fish", [1.0, 0.0]), (2, "blue fish", None))) == 2
    assert s.health("shard-1") and not s.health("shard-2") and s.count() == 2
    assert s.index_documents(batch(spark, (1, "one bird", None), (3, "red bird", [0.0, 2.0]))) == 2
    assert s.count() == 3 and sorted(r["doc_id"] for r in s.search(["red"]).collect()) == [3] and [r["doc_id"] for r in s.semantic_search([1.0, 1.0]).collect()] == [3]
    assert len(s.store.manifest("shard-1").active_segments) == 2
    s.delete(3)
    assert s.count() == 2 and s.store.manifest("shard-1").document_count == 2 and not s.contains(3)
    s.store.compact("shard-1")
    assert len(s.store.manifest("shard-1").active_segments) == 1 and sorted(r["doc_id"] for r in s.search(["fish"]).collect()) == [2]
    for wrong in ([], [(1, "a", None), (1, "b", None)], [(0, "a", None)], [(k, "a", None) for k in range(1, 502)]):
        with pytest.raises(ValueError):
            s.index_documents(batch(spark, *wrong))
    with pytest.raises(KeyError):
        s.delete(9)
    for limit in (0, 101, True, "5"):
        with pytest.raises(ValueError):
            checked_limit(limit)
    s.clear()
    assert not s.health()


def docs(spark):
    return spark.createDataFrame([(k, "Title", f"common word{'abcdefg'[k % 7]} tail{chr(97 + k // 26)}{chr(97 + k % 26)}") for k in range(1, 60)] + [(60, None, "  ")], "doc_id long, title string, content string")


def test_engine_opens_what_is_stored_and_pushes_terms_down(spark, tmp_path):
    model, built = HashingModel(8), []
    open_ = lambda: Engine.open(spark, f"file://{tmp_path}/e", lambda: built.append(1) or docs(spark), ("shard-0", "shard-1"), stems=False, model=model, vectors=vectors_of(spark, model))
    first = [tuple(r) for r in open_().search("wordd tailak", "lexical", 5).collect()]
    e = open_()
    assert built == [1] and [tuple(r) for r in e.search("wordd tailak", "lexical", 5).collect()] == first and first[0][0] == 10
    plan = e.search("wordd", "lexical")._jdf.queryExecution().executedPlan().toString()
    assert any("PushedFilters" in line and "term" in line and "wordd" in line for line in plan.splitlines())
    assert e.search("common wordc", "hybrid").count() == 10 and e.search("common", "semantic", 3).count() == 3 and e.search(" ", "hybrid").count() == 0
    for bad in ({"mode": "other"}, {"limit": 0}, {"limit": 101}):
        with pytest.raises(ValueError):
            e.search("x", **bad)


def vectors_of(spark, model):
    from siftline.operators.vectors import embedded

    return embedded(docs(spark), model)


def test_bootstrap_indexes_what_is_missing(spark, tmp_path):
    store, shards = Store(spark, f"file://{tmp_path}/b"), ("shard-0", "shard-1")
    first = bootstrap(store, docs(spark).where("doc_id <= 40"), shards, batch=10, model=HashingModel(8), stems=False).collect()
    assert sum(r["n_missing"] for r in first) == 40 == sum(r["n_embedded"] for r in first)
    again = {r["shard_id"]: r for r in bootstrap(store, docs(spark), shards, batch=10, model=HashingModel(8), stems=False).collect()}
    assert sum(r["n_missing"] for r in again.values()) == 20 and sum(r["n_embedded"] for r in again.values()) == 19 and len(again) == 2
    assert sum(store.load(s).docs.count() for s in shards) == 60
    assert bootstrap(store, docs(spark), shards).agg(F.sum("n_missing")).first()[0] == 0
    assert complete(spark.createDataFrame([(3,), (4,)], "doc_id long"), docs(spark)).count() == 2
    with pytest.raises(LookupError):
        complete(spark.createDataFrame([(3,), (400,)], "doc_id long"), docs(spark))


def site():
    class Pages:
        """A site of pages that link on; page 3 can't be had."""

        def fetch(self, url):
            k = int(url.rsplit("/", 1)[1])
            if k == 3:
                raise OSError("status 500")
            return f"<title>p{k}</title><p>text {k}</p><a href='/{2 * k + 1}'>a</a><a href='/{2 * k + 2}#x'>b</a><a href='http://else/1'>c</a>"

    return Pages()  # of a local class, which goes to the workers as it is


def test_resumable_crawl_and_ingest(spark, tmp_path):
    f = spark.createDataFrame([(1, "http://h/0", 0, "processing", 1, None), (2, "http://other/0", 0, "pending", 0, None)], crawl.FRONTIER)
    f, pages = resume(f, 1, site(), "h", max_depth=2, max_pages=4, at_once=2)
    assert pages.count() == 4 and f.where("crawl_session_id = 2 AND status = 'pending'").count() == 1
    f, more = resume(f, 1, site(), "h", max_depth=2, max_pages=50, at_once=10)
    state = {r["url"]: (r["status"], r["depth"]) for r in f.where("crawl_session_id = 1").collect()}
    assert set(state) == {f"http://h/{k}" for k in range(7)} and state["http://h/3"] == ("failed", 2) and sum(s == "completed" for s, _ in state.values()) == 6
    assert f.where("url = 'http://h/3'").first()["last_error"] == "OSError: status 500"
    store = Store(spark, f"file://{tmp_path}/i")
    got = ingest(spark.createDataFrame([], changes.DOCUMENT), pages.unionByName(more), 1, store, stems=False)
    assert sorted((r["doc_id"], r["url"], r["title"]) for r in got.documents.collect())[0] == (1, "http://h/0", "p0") and got.documents.count() == 6
    assert {r["change_type"]: r["n"] for r in got.summary().collect()} == {"created": 6} and got.events.where("document_id IS NOT NULL").count() == 6
    assert store.load("shard-0").docs.count() == 6
    again = ingest(got.documents, pages, 100, store, stems=False)
    assert {r["change_type"] for r in again.summary().collect()} == {"unchanged"} and again.documents.count() == 6


def test_sessions(spark):
    seeds = spark.createDataFrame([("http://a/#x", "a", None), ("http://b/", "b", 2)], "seed_url string, allowed_domain string, max_depth int")
    s = crawl.opened(spark.createDataFrame([], crawl.SESSION), seeds)
    assert sorted(r["crawl_session_id"] for r in s.collect()) == [1, 2] and crawl.session_of(s, "http://a/", None).first()["seed_url"] == "http://a/"
    s = crawl.closed(s, s)
    assert {r["status"] for r in s.collect()} == {"completed"}
    s = crawl.opened(s, seeds.limit(1))
    assert sorted((r["seed_url"], r["status"]) for r in s.collect()) == [("http://a/", "running"), ("http://b/", "completed")]
    id_ = crawl.session_of(s, "http://b/", 2).first()["crawl_session_id"]
    f = spark.createDataFrame([(id_, "http://b/", 0, "pending", 0, None), (id_ + 9, "u", 0, "pending", 0, None)], crawl.FRONTIER)
    left, rows = crawl.dropped(s, f, "http://b/", 2)
    assert left.count() == 1 and [r["url"] for r in rows.collect()] == ["u"]


def test_sites_fail_alone():
    good, failed = crawl_sites(["a", "b", "c"], lambda s: 1 / 0 if s == "b" else s.upper())
    assert good == {"a": "A", "c": "C"} and failed == {"b": "ZeroDivisionError: division by zero"}


def test_retries_and_shard_maps():
    calls, pauses = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Retryable
        return "done"

    p = RetryPolicy(2, 0.5)
    assert p.run(call, pauses.append) == "done" and pauses == [0.5, 1.0] and p.total_backoff() == 1.5
    with pytest.raises(Retryable):
        RetryPolicy(1, 0).run(lambda: (_ for _ in ()).throw(Retryable()), pauses.append)
    with pytest.raises(ZeroDivisionError):
        RetryPolicy(5, 9).run(lambda: 1 / 0, pauses.append)
    assert pauses == [0.5, 1.0, 0]
    assert shard_map(" a=http://x:1 ,,b = y=z") == {"a": "http://x:1", "b": "y=z"}
    for bad in ("", "a", "=x", "a="):
        with pytest.raises(ValueError):
            shard_map(bad)


def test_failing_events_are_tried_again_and_then_sent_to_the_sink(spark, tmp_path):
    from siftline.sources.events import encoded
    from siftline.streaming.apply import Applier

    rows = [(k, f"u{k}", "t", "content", "text", "", 1) for k in (1, 2)]
    full = spark.createDataFrame(rows, changes.DOCUMENT).withColumn("content_hash", changes.content_hash(F.col("content")))
    seen, sent = [], []

    def documents():  # document 1 comes to be between two tries, document 2 never
        seen.append(1)
        return full.where("doc_id = 1") if len(seen) > 2 else full.limit(0)

    e = changes.change_events(full.withColumn("change_type", F.lit("created")))
    a = Applier(spark, f"file://{tmp_path}/x", documents, stems=False, max_retries=3, retry_delay=0, dead_sink=lambda df: sent.extend(df.collect()))
    a(encoded(e).select("value"), 0)
    assert len(seen) == 4 and [r["key"] for r in sent] == ["2"] and [r["reason"] for r in a.dead_letters().collect()] == ["no document"]
    assert [r["doc_id"] for r in Store(spark, f"file://{tmp_path}/x/index").load("shard-0").docs.collect()] == [1]
