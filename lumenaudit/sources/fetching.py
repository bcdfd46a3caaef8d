"""Fetching through callables: waves of pages, paged search rows, files as resources.

The engine has no network client of its own. A fetch is a function that the caller gives, which runs on executors; here
is what must hold around it: bounded concurrency, politeness, paging, retries, and failures that drop out.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import fetchable, host
from ..schema import CAPTURE
from .guard import Refused

#: Pages of one host that are fetched at a time, and attempts per page.
CONCURRENCY, ATTEMPTS = 5, 3
#: Pages that a task holds at a time.
BATCH = 50
# Rows a page of search results, rows in all, and the forms under which a site may be a property.
ROW_LIMIT, MAX_ROWS = 100, 1000
PROPERTIES = ("sc-domain:{domain}", "https://{domain}/", "http://{domain}/")


def fetch_wave(wave: DataFrame, get: Callable[[str], dict | None], concurrency: int = CONCURRENCY, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """wave(audit_id, url, crawl_delay) to captures (schema.CAPTURE): what `get` returned, by keys of that schema.

    A host's URLs are fetched in one task, `concurrency` at a time, or one after another with the host's crawl delay
    between them; bodies leave the task `BATCH` at a time, however many the host has. URLs that the request guard
    refuses, and those whose every attempt fails or gives None, drop out; `guard.guarded` makes a `get` that judges
    resolved addresses and every hop of a redirect, too.
    """
    names = [c.split()[0] for c in CAPTURE.split(", ")]

    def once(url: str) -> dict | None:
        for n in range(attempts):
            try:
                return get(url)
            except Refused:
                return None
            except (OSError, ValueError):
                if n + 1 < attempts:
                    sleep(0.5 * 2**n)
        return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the host that was asked last
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for pdf in parts:
                for host_of, own in pdf.groupby("host", sort=False):
                    for k in range(0, len(own), BATCH):
                        some = own.iloc[k : k + BATCH]
                        found = []
                        if (delay := some["crawl_delay"].max()) > 0:
                            for u in some["url"]:
                                if last == host_of:
                                    sleep(delay)
                                found.append(once(u))
                                last = host_of
                        else:
                            found, last = list(pool.map(once, some["url"])), host_of
                        rows = [{"audit_id": a, "url": u, "final_url": u, "status_code": 200, "redirects": 0, "html": None, "rendered_html": None} | f for a, u, f in zip(some["audit_id"], some["url"], found, strict=True) if f is not None]
                        yield pd.DataFrame(rows, columns=names)

    asked = wave.where(fetchable(F.col("url"))).select("audit_id", "url", F.coalesce(F.col("crawl_delay").cast("double"), F.lit(0.0)).alias("crawl_delay"), host(F.col("url")).alias("host"))
    # The largest delay that any audit has for a host holds for all of them.
    delays = asked.groupBy(F.col("host").alias("own")).agg(F.max("crawl_delay").alias("delay")).where("delay > 0")
    polite = asked.join(delays, F.col("host") == F.col("own"), "left").select("audit_id", "url", F.coalesce("delay", F.lit(0.0)).alias("crawl_delay"), "host")
    return polite.repartition("host").sortWithinPartitions("host", "audit_id", "url").mapInPandas(run, CAPTURE)


def properties(domain: Column) -> Column:
    """The names under which a domain may be known to the search console, in the order in which they are tried."""
    return F.array(*(F.replace(F.lit(p), F.lit("{domain}"), domain) for p in PROPERTIES))


def search_pages(requests: DataFrame, query: Callable[[str, dict], dict | None], row_limit: int = ROW_LIMIT, max_rows: int = MAX_ROWS) -> DataFrame:
    """requests(audit_id, domain, period, dimension, start_date, end_date) to (audit_id, period, dimension, payload), which
    `connectors.search_rows` parses.

    query(property, body) returns a page of rows, or None for no access. The first property that answers is the one;
    pages follow until one is short or max_rows are there. A request that fails, on any page, has no row.
    """

    def one(r: dict) -> str | None:
        base = {"startDate": str(r["start_date"]), "endDate": str(r["end_date"]), "dimensions": [r["dimension"]]}
        names = (p.format(domain=r["domain"]) for p in PROPERTIES)
        site = next((p for p in names if query(p, base | {"rowLimit": 1, "startRow": 0}) is not None), None)
        rows: list = []
        while site is not None and len(rows) < max_rows:
            limit = min(row_limit, max_rows - len(rows))
            page = query(site, base | {"rowLimit": limit, "startRow": len(rows)})
            if page is None:
                return None
            rows += page.get("rows") or []
            if len(page.get("rows") or []) < limit:
                break
        return None if site is None else json.dumps({"rows": rows})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = p[["audit_id", "period", "dimension"]].assign(payload=[one(r) for r in p.to_dict("records")])
            yield out[out["payload"].notna()]

    return requests.select("audit_id", "domain", "period", "dimension", "start_date", "end_date").mapInPandas(run, "audit_id string, period string, dimension string, payload string")


def resources(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """(url, content, content_type, bytes) of saved files below a path, as `discovery.sitemaps` and robots parsing take
    them; kinds: content type by file ending."""
    kinds = {"xml": "application/xml", "gz": "application/gzip", "txt": "text/plain", "json": "application/json", "html": "text/html"} if kinds is None else kinds
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return files.select(F.col("path").alias("url"), "content", F.try_element_at(known, ending).alias("content_type"), F.col("length").alias("bytes"))
