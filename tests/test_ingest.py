import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siftline.functions import pages as P
from siftline.functions import ring
from siftline.functions import text as T
from siftline.functions import urls as U
from siftline.operators import changes, crawl, present, reconcile
from siftline.operators import index as X
from siftline.sources import events as E
from siftline.sources.storage import Manifest, Store, checked_id, export_segment, import_segments
from siftline.streaming.apply import Applier, classified

DOC = changes.DOCUMENT


def test_change_detection(spark):
    h = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    old = spark.createDataFrame([(1, "u1", "T", "same", "t", h("same"), 3), (2, "u2", "T", "old", "t", h("old"), 1)], DOC)
    new = spark.createDataFrame([("u1", "New title", "same", "t"), ("u2", "N", "new", "t"), ("u3", "N", "first", "t"), ("u0", "N", "second", "t")], "url string, title string, content string, content_type string")
    d = changes.detect(old, new)
    assert {r["url"]: (r["change_type"], r["version"], r["title"]) for r in d.collect()} == {"u1": ("unchanged", 3, "T"), "u2": ("updated", 2, "N"), "u3": ("created", 1, "N"), "u0": ("created", 1, "N")}
    after = {r["url"]: (r["doc_id"], r["version"], r["title"]) for r in changes.upserted(old, d, 10).collect()}
    assert after == {"u1": (1, 3, "T"), "u2": (2, 2, "N"), "u0": (10, 1, "N"), "u3": (11, 1, "N")}
    assert {r["event_type"] for r in changes.change_events(d).collect()} == {"created", "updated"}
    assert changes.deleted(old, spark.createDataFrame([(1,)], "doc_id long")).count() == 1


@pytest.mark.parametrize("event, indexed, document, state", [(2, 1, 2, "current"), (1, 2, 2, "stale"), (2, 2, 2, "stale"), (1, None, 2, "stale"), (3, 1, 2, "future"), (1, None, 1, "current")])
def test_version_states(spark, event, indexed, document, state):
    d = spark.createDataFrame([(event, indexed, document)], "e int, i int, d int")
    assert d.select(changes.version_state(F.col("e"), F.col("i"), F.col("d"))).first()[0] == state


def test_ledgers(spark):
    t = [dt.datetime(2026, 1, k) for k in (1, 2, 3)]
    schema = "document_id long, event_version int, event_id string, indexed_at timestamp"
    old = spark.createDataFrame([(1, 2, "a", t[0]), (2, 5, "b", t[0])], schema)
    new = spark.createDataFrame([(1, 3, "c", t[1]), (2, 5, "d", t[1]), (3, 1, "e", t[2])], schema)
    assert sorted(tuple(r) for r in changes.latest_versions(old, new).collect()) == [(1, 3, "c", t[0]), (2, 5, "b", t[0]), (3, 1, "e", t[2])]
    done = spark.createDataFrame([("a", 1)], "event_id string, document_id long")
    more = spark.createDataFrame([("a", 9), ("b", 2), ("b", 2)], "event_id string, document_id long")
    assert sorted(tuple(r) for r in changes.recorded(done, more).collect()) == [("a", 1), ("b", 2)]


GOOD = {"event_id": "e1", "event_version": 1, "event_type": "created", "document_id": 42, "url": "https://example.com/t", "content_hash": "h", "occurred_at": "2026-09-13T12:00:00+00:00", "metadata": {}}


def test_event_codec(spark):
    bad = [("no content_hash", {"content_hash": None}), ("bad document_id", {"document_id": 0}), ("no url", {"url": " "}), ("bad occurred_at", {"occurred_at": "2026-09-13T12:00:00"}), ("bad event_type", {"event_type": "moved"}), ("bad event_version", {"event_version": 0})]
    rows = [(json.dumps(GOOD), None), (json.dumps(GOOD | {"event_type": "deleted", "content_hash": None}), None), ("{not json", "not a JSON object"), (None, "no value"), (json.dumps({k: v for k, v in GOOD.items() if k != "url"}), "no url")]
    rows += [(json.dumps(GOOD | x), why) for why, x in bad]
    got = E.decoded(spark.createDataFrame([(v,) for v, _ in rows], "value string")).collect()
    assert [r["reason"] for r in got] == [why for _, why in rows]
    again = E.encoded(E.decoded(spark.createDataFrame([(json.dumps(GOOD),)], "value string"))).first()
    out = json.loads(again["value"])
    assert again["key"] == "42" and list(out) == sorted(out) and set(out) == set(GOOD) and E.decoded(spark.createDataFrame([(again["value"],)], "value string")).first()["reason"] is None


def test_kafka_options():
    o = E.KafkaOptions.from_environment({"KAFKA_DLQ_TOPIC": "dead"})
    assert (o.servers, o.topic, o.group, o.dead_letters) == ("localhost:9092", "document-events", "indexer-workers", "dead")
    with pytest.raises(ValueError):
        E.KafkaOptions(topic=" ")


def test_url_list(spark, tmp_path):
    (tmp_path / "u").write_text("# note\n\n http://a \nhttp://b\nhttp://a\n")
    assert E.url_list(spark, f"file://{tmp_path}/u", ("http://c", "http://b")) == ["http://c", "http://b", "http://a"]
    with pytest.raises(ValueError):
        E.url_list(spark)


def test_stream_applies_once_and_in_any_order(spark, tmp_path):
    root = f"file://{tmp_path}"
    docs = spark.createDataFrame([(k, f"u{k}", f"title{k}", f"word{k} common", "text", f"h{k}", v) for k, v in ((1, 1), (2, 2), (3, 1), (4, 3))], DOC)
    event = lambda i, d, v, kind="created", h=None: json.dumps(GOOD | {"event_id": i, "document_id": d, "event_version": v, "event_type": kind, "content_hash": h or f"h{d}"})
    a = Applier(spark, f"{root}/state", lambda: docs, stems=False)
    batches = [
        [event("a", 1, 1), event("a", 1, 1), event("b", 2, 1), event("c", 3, 1, h="other"), event("d", 9, 1), "junk"],
        [event("e", 2, 2), event("a", 1, 1), event("f", 4, 4), event("g", 3, 1)],
        [event("h", 1, 1, "deleted"), event("i", 2, 2)],
    ]
    for k, lines in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines))
        a.start(spark.readStream.schema("value string").text(f"{root}/in"), f"{root}/checkpoint").awaitTermination()
    x = Store(spark, f"{root}/state/index").load("shard-0")
    assert sorted(r["doc_id"] for r in x.docs.collect()) == [2, 3]
    assert {r["term"] for r in x.postings.where("doc_id = 2").collect()} == {"title", "word", "common"}
    assert sorted(r["reason"] for r in a.dead_letters().collect()) == ["future version", "no document", "not a JSON object", "other content"]
    assert sorted(r["event_id"] for r in a.processed().collect()) == ["a", "b", "e", "g", "h", "i"]
    assert {r["document_id"]: r["event_version"] for r in a.ledger().collect()} == {1: 1, 2: 2, 3: 1}
    a(spark.createDataFrame([(v,) for v in batches[2]], "value string"), 2)  # a batch that is tried again
    assert sorted(r["doc_id"] for r in Store(spark, f"{root}/state/index").load("shard-0").docs.collect()) == [2, 3]


def test_bootstrap_events_pass_the_ledger(spark):
    docs = spark.createDataFrame([(1, "u", "t", "c", "x", "h1", 1)], DOC)
    ledger = spark.createDataFrame([(1, 1, "z", dt.datetime(2026, 1, 1))], "document_id long, event_version int, event_id string, indexed_at timestamp")
    lines = [(json.dumps(GOOD | {"document_id": 1, "content_hash": "h1", "metadata": {"bootstrap": "true"}}),), (json.dumps(GOOD | {"event_id": "e2", "document_id": 1, "content_hash": "h1"}),)]
    got = {r["event_id"]: r["action"] for r in classified(E.decoded(spark.createDataFrame(lines, "value string")), docs, ledger).collect()}
    assert got == {"e1": "apply", "e2": "ignore"}


def index(spark, rows):
    return X.build(spark.createDataFrame(rows, "doc_id long, content string"), F.col("content"))


def test_generations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.load("shard-0") is None and not store.is_ready("shard-0")
    x = index(spark, [(1, "python search"), (2, "")])
    x.vectors = spark.createDataFrame([("shard-0", 1, [1.0, 2.0])], "shard_id string, doc_id long, embedding array<double>")
    assert store.publish("shard-0", x).generation == 0
    m = store.publish("shard-0", X.replaced(store.load("shard-0"), index(spark, [(3, "more")])))
    assert (m.generation, m.document_count, store.segments("shard-0")) == (1, 3, ["segment-000001"]) and store.is_ready("shard-0")
    y = store.load("shard-0")
    assert sorted(r["term"] for r in y.postings.collect()) == ["more", "python", "search"] and y.vectors.count() == 1
    stray = index(spark, [(1, "a")])
    stray.vectors = spark.createDataFrame([("shard-0", 7, [1.0])], "shard_id string, doc_id long, embedding array<double>")
    with pytest.raises(ValueError):
        store.publish("shard-0", stray)
    store.delete("shard-0")
    assert store.load("shard-0") is None
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            checked_id(bad)


@pytest.mark.parametrize("change", [{"format_version": 2}, {"shard_id": ""}, {"generation": -1}, {"generation": True}, {"state": "odd"}, {"active_segments": []}, {"active_segments": [""]}, {"document_count": -1}])
def test_bad_manifests(change):
    good = {"format_version": 1, "shard_id": "s", "generation": 0, "state": "ready", "active_segments": ["x"], "document_count": 0}
    assert Manifest.loads(json.dumps(good)).state == "ready"
    with pytest.raises(ValueError):
        Manifest.loads(json.dumps(good | change))


def test_json_segments(spark, tmp_path):
    x = index(spark, [(1, "python search python"), (2, "")])
    x.vectors = spark.createDataFrame([("shard-0", 1, [1.0, 2.0])], "shard_id string, doc_id long, embedding array<double>")
    (tmp_path / "a.json").write_text(export_segment(x, "segment-000001").first()["value"])
    y = import_segments(spark, f"file://{tmp_path}/a.json")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(y.postings) == rows(x.postings) and rows(y.docs) == rows(x.docs) and rows(y.vectors) == rows(x.vectors)
    (tmp_path / "b.json").write_text(json.dumps({"format_version": 1, "segment_id": "s", "terms": {"t": {"5": {"term_frequency": 1, "positions": [0]}}}, "document_lengths": {"5": 1}}))
    z = import_segments(spark, f"file://{tmp_path}/b.json")
    assert z.postings.first()["doc_id"] == 5 and z.vectors.count() == 0
    (tmp_path / "c.json").write_text('{"format_version": 3}')
    with pytest.raises(Exception, match="segment"):
        import_segments(spark, f"file://{tmp_path}/c.json").docs.collect()


PAGE = """<html><head><title> Home </title></head><body><nav><a href="/lost">x</a></nav><main><header><a href="gone">h</a></header><p>Hello <b>big</b> world</p>
<a href="about#part">About</a><script>no()</script><a href="http://other/x">o</a><a>none</a></main><footer><a href="/foot">f</a></footer></body></html>"""


def test_page_parsing():
    title, text, links = P.parse(PAGE, "http://h/d/")
    assert (title, text) == ("Home", "Hello big world About o none")
    assert links == ["http://h/lost", "http://h/d/about#part", "http://other/x", "http://h/foot"]
    assert P.parse("<p>a<p>b", "u")[:2] == ("", "a b") and P.parse("<div class='x content'>in</div>out", "")[1] == "in" and P.parse(None, None) == ("", "", [])


def test_urls(spark):
    d = spark.createDataFrame([("http://www.Ex.com:80/a/my-first_page.html?q#f", None), ("http://h/", " Own "), ("nothing", None), ("ftp://h/x", None)], "url string, title string")
    r = d.select(U.without_fragment(F.col("url")).alias("u"), U.is_valid(F.col("url")).alias("v"), U.domain(F.col("url")).alias("d"), U.shown_path(F.col("url")).alias("p"), U.display_title(F.col("title"), F.col("url")).alias("t"), U.favicon(F.col("url")).alias("i"), U.initial(U.domain(F.col("url"))).alias("c")).collect()
    assert tuple(r[0]) == ("http://www.Ex.com:80/a/my-first_page.html?q", True, "ex.com", "/a/my-first_page.html", "My First Page", "http://www.Ex.com:80/favicon.ico", "E")
    assert (r[1]["t"], r[1]["p"]) == ("Own", "") and (r[2]["v"], r[2]["d"], r[2]["t"]) == (False, "nothing", "Search result") and not r[3]["v"]


def test_breadth_first(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "b", 0), ("d", "a", 0), ("d", "e", 1)], "src string, dst string, place long")
    order = lambda **o: [(r["url"], r["depth"]) for r in crawl.breadth_first(edges, "a#x", **o).orderBy("depth", "place").collect()]
    assert order() == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert order(max_depth=0) == [("a", 0)] and order(max_depth=1) == order()[:3] and order(max_pages=2) == order()[:2]
    have = spark.createDataFrame([("a",), ("c",), ("d",)], "url string")
    assert order(fetched=have) == [("a", 0), ("c", 1)]
    with pytest.raises(ValueError):
        order(max_pages=0)


def test_link_edges(spark):
    pages = spark.createDataFrame([("http://h/d/", PAGE), ("http://h/s", "<a href='/wiki/Special:X'>s</a><a href='/ok'>k</a>")], "url string, html string")
    assert sorted((r["src"], r["dst"]) for r in crawl.link_edges(pages).collect()) == [("http://h/d/", "http://h/d/about"), ("http://h/d/", "http://h/foot"), ("http://h/d/", "http://h/lost"), ("http://h/s", "http://h/ok")]


def test_frontier(spark):
    f = spark.createDataFrame([], crawl.FRONTIER)
    new = spark.createDataFrame([(1, "http://a#x", 1), (1, "http://a", 0), (1, "http://b", 1)], "crawl_session_id long, url string, depth int")
    f = crawl.enqueued(crawl.enqueued(f, new), new)
    assert sorted((r["url"], r["depth"], r["status"]) for r in f.collect()) == [("http://a", 0, "pending"), ("http://b", 1, "pending")]
    f = crawl.claimed(f)
    assert {r["url"]: (r["status"], r["attempts"]) for r in f.collect()} == {"http://a": ("processing", 1), "http://b": ("pending", 0)}
    f = crawl.marked(f, spark.createDataFrame([(1, "http://a", "e" * 3000)], "crawl_session_id long, url string, error string"))
    row = f.where("url = 'http://a'").first()
    assert row["status"] == "failed" and len(row["last_error"]) == 2000
    assert crawl.retried(f, 1).where("status = 'failed'").count() == 1 and crawl.retried(f).where("status = 'failed'").count() == 0
    assert tuple(crawl.status_counts(f).first()) == (1, 0, 1) and crawl.recovered(crawl.claimed(f)).where("status = 'processing'").count() == 0


def test_reconcile(spark):
    docs = spark.range(250).withColumnRenamed("id", "doc_id").withColumn("content", F.lit("x"))
    have = index(spark, [(k, "x") for k in range(0, 250, 2)])
    left = reconcile.missing(docs, have, F.lit("shard-0"))
    assert left.count() == 125 and sorted(r["count"] for r in reconcile.batches(left, 100).groupBy("batch").count().collect()) == [25, 100]
    with pytest.raises(ValueError):
        reconcile.batches(left, 0)


def test_presentation(spark):
    res = spark.createDataFrame([(1, 2.0), (9, 1.0)], "doc_id long, score double")
    docs = spark.createDataFrame([(1, "T", None, "some python text")], "doc_id long, title string, url string, content string")
    out = {r["doc_id"]: r for r in present.with_metadata(res, docs, "python").collect()}
    assert out[1]["snippet"] == "some python text" and out[9]["title"] is None
    assert json.loads(present.as_json(spark.createDataFrame([(9, None)], "doc_id long, title string")).first()[0]) == {"doc_id": 9}


def test_shard_of_null(spark):
    assert spark.createDataFrame([(None,)], "i long").select(ring.shard_of(F.col("i"), ["a"])).first()[0] is None
    assert T.analyze(None) == []
