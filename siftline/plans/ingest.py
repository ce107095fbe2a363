"""From crawled pages to an index: parse, clean, detect changes, store, make events, index; crawls in sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import ring
from ..functions import text as T
from ..functions import urls as U
from ..functions.clients import Fetcher
from ..operators import changes, crawl
from ..operators.index import build
from ..sources.shared import landed
from ..sources.storage import Store


@dataclass
class Ingested:
    """documents after the crawl, what was detected (change_type and the rest) and the change events."""

    documents: DataFrame
    detected: DataFrame
    events: DataFrame

    def summary(self) -> DataFrame:
        """change_type, n."""
        return self.detected.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def ingest(existing: DataFrame, pages: DataFrame, next_id: int, store: Store | None = None, shards: tuple[str, ...] = ("shard-0",), stems: bool = True, arrival: str | None = None) -> Ingested:
    """pages (url, html) parsed, cleaned and upserted into existing (changes.DOCUMENT); with a store, changed documents are indexed, as one
    segment a shard."""
    page = P.parsed(F.col("html"), F.col("url"))
    extra = [arrival] if arrival else []
    rows = pages.select(U.without_fragment(F.col("url")).alias("url"), page.alias("p"), *extra)
    rows = rows.select("url", F.col("p.title").alias("title"), T.clean_text(F.col("p.text")).alias("content"), F.lit("text/html").alias("content_type"), *extra)
    found = landed(changes.detect(existing, rows, arrival), "ingest-detected")
    after = landed(changes.upserted(existing, found, next_id), "ingest-documents")
    named = found.drop("doc_id").join(after.select("url", "doc_id"), "url")
    if store is not None:
        changed = after.join(found.where("change_type <> 'unchanged'").select("url").distinct(), "url", "left_semi")
        new = build(changed, T.lexical_text(F.col("title"), F.col("content")), stems, shard=ring.shard_of(F.col("doc_id"), list(shards)))
        new = store.prepared(new)
        for s in shards:
            store.append(s, new)
    return Ingested(after, found, changes.change_events(named))


def fetched(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """urls with html and error (null if the page could be had), fetched in tasks, a page at a time."""

    @F.pandas_udf("struct<html: string, error: string>")
    def get(s):
        import pandas as pd

        rows = []
        for u in s:
            try:
                rows.append((fetcher.fetch(u), None))
            except Exception as e:  # whatever keeps a page from being had is its row's error
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["html", "error"], index=s.index)

    return urls.withColumn("_page", get.asNondeterministic()("url")).select(*urls.columns, "_page.html", "_page.error")


def resume(frontier: DataFrame, session_id: int, fetcher: Fetcher, domain: str, max_depth: int | None = None, max_pages: int = 10, at_once: int = 100) -> tuple[DataFrame, DataFrame]:
    """Crawl what a session's frontier has pending until max_pages pages are parsed or nothing is left: the frontier then,
    and pages (url, depth, html).

    What an earlier run left in processing is pending again. Each step claims the oldest rows, fetches and marks them, and
    queues their links within the domain; its state is written before the next.
    """
    mine = landed(crawl.recovered(frontier), "crawl-frontier")
    pages, done = None, 0
    while done < max_pages:
        claimed = landed(crawl.claimed(mine, n=min(at_once, max_pages - done), session_id=session_id), "crawl-frontier")
        todo = claimed.where((F.col("crawl_session_id") == session_id) & (F.col("status") == "processing"))
        got = landed(fetched(todo.select("crawl_session_id", "url", "depth"), fetcher), "crawl-pages")
        if not got.limit(1).count():
            break
        good = got.where("error IS NULL").select("url", "depth", "html")
        pages = good if pages is None else pages.unionByName(good)
        done += good.count()
        links = crawl.link_edges(good.select("url", "html")).where(U.netloc(F.col("dst")) == domain).join(good.select(F.col("url").alias("src"), "depth"), "src")
        links = links.select(F.lit(session_id).cast("long").alias("crawl_session_id"), F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"))
        if max_depth is not None:
            links = links.where(F.col("depth") <= max_depth)
        mine = landed(crawl.enqueued(crawl.marked(claimed, got), links), "crawl-frontier")
    return mine, pages if pages is not None else mine.sparkSession.createDataFrame([], "url string, depth int, html string")


def crawl_sites(sites: Iterable[str], run: Callable[[str], object]) -> tuple[dict[str, object], dict[str, str]]:
    """What run gives for each site, and the errors of those that failed; one site's failure doesn't keep the others from their
    turn. A list of sites is what a person names."""
    good, failed = {}, {}
    for site in sites:
        try:
            good[site] = run(site)
        except Exception as e:  # isolated: reported, and the caller decides
            failed[site] = f"{type(e).__name__}: {e}"
    return good, failed
