"""Crawling over a table of fetched pages: breadth-first search and the frontier's states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import urls as U
from ..sources.shared import landed, shared_path

FRONTIER = "crawl_session_id long, url string, depth int, status string, attempts int, last_error string"
ERROR_CHARS = 2000


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst, place of each link to follow: without fragment, within its page's domain, not a special page."""
    x = pages.select(U.without_fragment(F.col("url")).alias("src"), F.posexplode(P.parsed(F.col("html"), F.col("url"))["links"]).alias("place", "link"))
    x = x.withColumn("dst", U.without_fragment(F.col("link")))
    return x.where((U.netloc(F.col("dst")) == U.netloc(F.col("src"))) & ~U.path(F.col("dst")).startswith("/wiki/Special:")).select("src", "dst", "place")


def breadth_first(edges: DataFrame, start_url: str, max_pages: int = 10, max_depth: int | None = None, fetched: DataFrame | None = None, count_failures: bool = True) -> DataFrame:
    """url, depth, place of the pages that a crawl from start_url visits; by depth and place they are in its order.

    One join a level, which is written to the shared folder, so that neither plans nor memory grow with the levels; the
    driver holds a level's size and never its rows. fetched: the pages that can be had (url); others count towards
    max_pages if count_failures, and have no row. max_pages bounds the result, as in any crawl.
    """
    if max_pages <= 0 or max_depth is not None and max_depth < 0:
        raise ValueError("max_pages is to be positive and max_depth not negative")
    spark = edges.sparkSession
    root = shared_path(spark, "crawl")
    schema = "url string, place long, ok boolean, depth int"
    level = spark.createDataFrame([(start_url.strip().split("#")[0], 0)], "url string, place long")
    known = None if fetched is None else landed(fetched.select(U.without_fragment(F.col("url")).alias("url")).distinct().withColumn("_have", F.lit(True)), "crawl-fetched")
    queue = lambda: spark.read.schema(schema).parquet(root)
    depth, room, cut = 0, max_pages, None
    while True:
        marked = level.withColumn("ok", F.lit(True)) if known is None else level.join(known, "url", "left").select("url", "place", F.coalesce("_have", F.lit(False)).alias("ok"))
        marked.select("url", "place", "ok").write.parquet(f"{root}/depth={depth}")
        here = queue().where(F.col("depth") == depth)
        counted = here if count_failures else here.where("ok")
        n = counted.count()
        if n > room:
            cut = counted.orderBy("place").limit(room)
        room -= n
        if not n or room <= 0 or max_depth is not None and depth >= max_depth:
            break
        found = here.where("ok").select(F.col("url").alias("src"), F.col("place").alias("_from")).join(edges, "src")
        first = found.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("_from", "place")).alias("at")).join(queue().select("url"), "url", "left_anti")
        # Ranges of places, sorted: ids by partition and row then keep the order, and no task has a whole level.
        level = first.repartitionByRange("at").sortWithinPartitions("at").select("url", F.monotonically_increasing_id().alias("place"))
        depth += 1
    out = queue().where("ok") if cut is None else queue().where("ok").where(F.col("depth") < depth).unionByName(cut.where("ok"))
    return out.select("url", "depth", "place")


def enqueued(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """frontier with the urls (crawl_session_id, url, depth) it lacks; of repeats the least depth, fragments cut."""
    new = urls.select("crawl_session_id", U.without_fragment(F.col("url")).alias("url"), "depth").groupBy("crawl_session_id", "url").agg(F.min("depth").cast("int").alias("depth"))
    new = new.join(frontier.select("crawl_session_id", "url"), ["crawl_session_id", "url"], "left_anti")
    return frontier.unionByName(new.select("crawl_session_id", "url", "depth", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error")))


def claimed(frontier: DataFrame, order: str | None = None, n: int = 1, session_id: int | None = None) -> DataFrame:
    """frontier with its first n pending rows in processing, their attempts one more: the oldest by frontier_id, where there
    is one, else by url. session_id: of that session alone."""
    keys = ["crawl_session_id", "url"]
    order = order or ("frontier_id" if "frontier_id" in frontier.columns else "url")
    mine = frontier if session_id is None else frontier.where(F.col("crawl_session_id") == session_id)
    first = mine.where("status = 'pending'").orderBy(order).limit(n).select(*keys).withColumn("_mine", F.lit(True))
    x = frontier.join(first, keys, "left")
    return x.withColumn("status", F.when(F.col("_mine"), "processing").otherwise(F.col("status"))).withColumn("attempts", F.when(F.col("_mine"), F.col("attempts") + 1).otherwise(F.col("attempts"))).select(*frontier.columns)


def recovered(frontier: DataFrame) -> DataFrame:
    """Rows left in processing are pending again."""
    return frontier.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def retried(frontier: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Failed rows of fewer than max_attempts attempts are pending again."""
    return frontier.withColumn("status", F.when((F.col("status") == "failed") & (F.col("attempts") < max_attempts), "pending").otherwise(F.col("status")))


def marked(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """frontier after results (crawl_session_id, url, error; null: completed)."""
    keys = ["crawl_session_id", "url"]
    x = frontier.join(results.select(*keys, "error", F.lit(True).alias("_done")), keys, "left")
    status = F.when(F.col("_done") & F.col("error").isNull(), "completed").when(F.col("_done"), "failed").otherwise(F.col("status"))
    error = F.when(F.col("_done"), F.substring("error", 1, ERROR_CHARS)).otherwise(F.col("last_error"))
    return x.withColumn("status", status).withColumn("last_error", error).select(*frontier.columns)


def status_counts(frontier: DataFrame) -> DataFrame:
    """pending (with what is in processing), completed, failed."""
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0).cast("long"))
    return frontier.agg(n("pending", "processing").alias("pending"), n("completed").alias("completed"), n("failed").alias("failed"))


SESSION = "crawl_session_id long, session_key string, seed_url string, allowed_domain string, max_depth int, status string"


def opened(sessions: DataFrame, seeds: DataFrame) -> DataFrame:
    """sessions (SESSION) with one for each seed (seed_url, allowed_domain, max_depth): one that is there runs again, others
    get the next ids in the order of their keys. Seeds are what callers name, so one task may number them."""
    x = seeds.select(U.without_fragment(F.col("seed_url")).alias("seed_url"), "allowed_domain", F.col("max_depth").cast("int").alias("max_depth"))
    key = F.when(F.col("max_depth").isNull(), U.session_key(F.col("seed_url"), None)).otherwise(F.sha2(F.concat("seed_url", F.lit("|depth="), F.col("max_depth").cast("string")), 256))
    x = x.withColumn("session_key", key).dropDuplicates(["session_key"])
    again = x.select("session_key", F.lit(True).alias("_again"))
    old = sessions.join(again, "session_key", "left").withColumn("status", F.when(F.col("_again"), "running").otherwise(F.col("status"))).select(*sessions.columns)
    new = x.join(sessions.select("session_key"), "session_key", "left_anti")
    last = sessions.agg(F.coalesce(F.max("crawl_session_id"), F.lit(0)).alias("last"))
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy("session_key"))).join(F.broadcast(last))
    return old.unionByName(numbered.select((F.col("last") + F.col("n")).cast("long").alias("crawl_session_id"), "session_key", "seed_url", "allowed_domain", "max_depth", F.lit("running").alias("status")))


def session_of(sessions: DataFrame, seed_url: str, max_depth: int | None) -> DataFrame:
    return sessions.where(F.col("session_key") == U.session_key(F.lit(seed_url), max_depth))


def closed(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """sessions, those of ids (crawl_session_id) completed."""
    done = ids.select("crawl_session_id", F.lit(True).alias("_done")).distinct()
    return sessions.join(done, "crawl_session_id", "left").withColumn("status", F.when(F.col("_done"), "completed").otherwise(F.col("status"))).select(*sessions.columns)


def dropped(sessions: DataFrame, frontier: DataFrame, seed_url: str, max_depth: int | None) -> tuple[DataFrame, DataFrame]:
    """sessions and frontier without a session and its rows."""
    gone = session_of(sessions, seed_url, max_depth).select("crawl_session_id")
    return tuple(x.join(gone, "crawl_session_id", "left_anti").select(*x.columns) for x in (sessions, frontier))


def site_summary(changes: DataFrame, failed: DataFrame) -> DataFrame:
    """site, created, updated, unchanged, total and failed of changes (site, change_type) and of sites (site) that failed."""
    n = lambda kind: F.sum((F.col("change_type") == kind).cast("long")).alias(kind)
    x = changes.groupBy("site").agg(n("created"), n("updated"), n("unchanged"), F.count(F.lit(1)).alias("total"))
    bad = failed.select("site", F.lit(True).alias("failed")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return x.join(bad, "site", "full_outer").select("site", *map(zero, ("created", "updated", "unchanged", "total")), F.coalesce("failed", F.lit(False)).alias("failed"))
