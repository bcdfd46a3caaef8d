"""Adapters that make captures, and the crawl by waves over captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host
from ..shared import written

MAX_PAGES, MAX_DEPTH = 300, 3


def captures(pages: DataFrame, audit: Column | None = None) -> DataFrame:
    """The `pages` table (page_id, url, html) as captures: an audit per host. The table knows neither status nor
    redirects, so every page has answered 200 at once; of captures of one URL that with the smallest page_id counts."""
    named = pages.select((audit if audit is not None else host(F.col("url"))).alias("audit_id"), "page_id", "url", F.lit(200).alias("status_code"), F.lit(0).alias("redirects"), "html")
    # Ranked without the HTML; the few pages that a smaller id makes superfluous leave by their ids, so no HTML is shuffled.
    first = Window.partitionBy("audit_id", "url").orderBy("page_id")
    again = named.select("audit_id", "url", "page_id").withColumn("n", F.row_number().over(first)).where("n > 1").select("page_id")
    kept = named.join(again, "page_id", "left_anti")
    return kept.select("audit_id", "url", F.col("url").alias("final_url"), "status_code", "redirects", "html", F.lit(None).cast("string").alias("rendered_html"))


def crawl(frontier: DataFrame, fetched: DataFrame, edges: DataFrame, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(audit_id, final_url, depth): the pages that a breadth-first crawl of every audit visits, all audits at once.

    frontier(audit_id, url); fetched(audit_id, url, final_url): what answers, robots already applied; edges(audit_id,
    src, dst): links of one host, from final URLs. A wave takes its URLs in order up to what is left of max_pages,
    counts a final URL once, and ends at max_depth. Each wave is an anti join on what was seen; the number of waves is
    the depth, not the number of pages. What a wave got is written, so the next one reads it rather than all before it.
    """
    wave, seen, done = frontier.select("audit_id", "url").distinct(), None, None
    for depth in range(max_depth + 1):
        if seen is not None:
            wave = wave.join(seen, ["audit_id", "url"], "left_anti")
        ranked = wave.withColumn("n", F.row_number().over(Window.partitionBy("audit_id").orderBy("url")))
        used = F.lit(0)
        if done is not None:
            ranked, used = ranked.join(done.groupBy("audit_id").agg(F.count("*").alias("used")), "audit_id", "left"), F.coalesce("used", F.lit(0))
        taken = written(ranked.where(F.col("n") + used <= max_pages).select("audit_id", "url"))
        got = taken.join(fetched, ["audit_id", "url"]).select("audit_id", "final_url").distinct()
        if done is not None:
            got = got.join(done.select("audit_id", "final_url"), ["audit_id", "final_url"], "left_anti")
        new = written(got.withColumn("depth", F.lit(depth)))
        visited = taken.union(new.select("audit_id", F.col("final_url").alias("url")))
        seen = visited if seen is None else seen.union(visited)
        done = new if done is None else done.union(new)
        wave = new.join(edges, (edges["audit_id"] == new["audit_id"]) & (edges["src"] == new["final_url"])).select(new["audit_id"], F.col("dst").alias("url")).distinct()
    return done
