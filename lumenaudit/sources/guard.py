"""The request guard: what a crawl may ask for, judged over resolved addresses and along redirects.

URLs come from sites and may point anywhere, so no request may go to a scheme but http and https, carry a user, name a
host of the inside, or reach an address that isn't public; of a name every address counts, and every hop of a redirect is
judged anew. Lookups and answers are tables: addresses by host, and answers by URL. Where a crawl fetches through a
callable, `guarded` puts the same rules around it, before each hop.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from ipaddress import ip_address, ip_network
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import CLOSED, OPEN, address, closed, once
from ..functions.urls import local_name

C = F.col
# Hops that are followed, and the statuses that lead to another.
REDIRECTS = 5
MOVED = (301, 302, 303, 307, 308)


def verdicts(urls: DataFrame, resolved: DataFrame) -> DataFrame:
    """urls(url, ...) with `refused`: null where a request may go out, else why not.

    resolved(host, address): what names resolve to, a row per address. `scheme`, `user`, `host` (none), `name` (of the
    inside), `unresolved` (no row), `address` (one of them isn't public, or can't be read). Literals need no row.
    Of each URL one row comes out; only hosts meet the lookup table, once each.
    """
    authority = F.regexp_extract("url", r"^[^/?#]*//([^/?#]*)", 1)
    # Read plainly, as a URL parser takes names such as 127.1 for none.
    own = F.lower(F.regexp_extract(authority, r"^(?:[^@\\]*@)?(\[[0-9A-Fa-f:.%]*\]|[^:@\[\]\\\s]*?)\.?(?::\d*)?$", 1))
    bad = resolved.select(F.lower(F.regexp_replace("host", r"\.$", "")).alias("__host"), F.coalesce(closed(address(C("address"))), F.lit(True)).alias("closed")).groupBy("__host").agg(F.bool_or("closed").alias("__closed"))
    named = urls.withColumn("__name", own).withColumn("__literal", closed(address(C("__name"))))
    met = named.join(bad, C("__name") == C("__host"), "left")
    scheme = F.lower(F.regexp_extract("url", r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    user = authority.contains("@")
    refused = (
        F.when(~scheme.isin("http", "https"), "scheme")
        .when(user, "user")
        .when(C("__name") == "", "host")
        .when(local_name(C("__name")), "name")
        .when(C("__literal").isNotNull(), F.when(C("__literal"), "address"))
        .when(C("__closed").isNull(), "unresolved")
        .when(C("__closed"), "address")
    )
    return met.withColumn("refused", F.when(C("url").isNull(), "scheme").otherwise(refused)).drop("__name", "__literal", "__host", "__closed")


def _without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments."""
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    def clean(segments: Column) -> Column:
        kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("")), step)
        ended = F.array_join(kept, "/")
        return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(ended, F.lit("/"))).otherwise(ended)

    return F.when(path.rlike(r"/\.{1,2}(/|$)"), once(F.split(path, "/", -1), clean)).otherwise(path)


def _joined(base: Column, ref: Column) -> Column:
    scheme, rest = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_replace(base, r"[?#].*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(rest, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/(?:.*/)?)", 1)
    query = F.regexp_extract(ref, r"(\?.*)$", 1)
    bare = F.regexp_replace(ref, r"\?.*$", "")
    absolute = F.regexp_extract(ref, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?)", 1)
    clean = lambda p: once(p, _without_dots)
    return (
        F.when(absolute != "", F.concat(absolute, clean(F.substr(bare, F.length(absolute) + 1)), query))
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(bare.startswith("/"), F.concat(origin, clean(bare), query))
        .when(bare != "", F.concat(origin, clean(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), bare)), query))
        .when(query != "", F.concat(rest, query))
        .otherwise(F.regexp_replace(base, "#.*$", ""))
    )


def joined(base: Column, reference: Column) -> Column:
    """The URL that a reference means on a page, as RFC 3986 resolves it, without fragment."""
    both = F.struct(base.alias("base"), F.regexp_replace(F.trim(reference), "#.*$", "").alias("ref"))
    return once(both, lambda x: _joined(x["base"], x["ref"]))


def followed(requests: DataFrame, answers: DataFrame, resolved: DataFrame, most: int = REDIRECTS) -> DataFrame:
    """requests(request_id, url) with final_url, redirects, status and refused: where each comes to rest.

    answers(url, status, location): what servers said, a row per URL. A hop is refused before it is asked; `redirects`
    if there would be more than `most`, `silent` if a URL has no answer. A status that leads on without a location is
    final. There are most + 1 rounds, each an equi join of the requests still on their way with the answers.
    """
    said = answers.groupBy(C("url").alias("__url")).agg(F.min(F.struct("status", "location")).alias("a"))
    going = requests.select("request_id", "url", C("url").alias("final_url"))
    done = []
    for n in range(most + 1):
        judged = verdicts(going.select("request_id", C("url").alias("asked"), C("final_url").alias("url")), resolved)
        met = judged.join(said, (C("url") == C("__url")) & C("refused").isNull(), "left")
        leads = C("a.status").isin(*MOVED) & (F.coalesce("a.location", F.lit("")) != "")
        why = F.coalesce("refused", F.when(C("a").isNull(), "silent"), F.when(leads, "redirects") if n == most else F.lit(None))
        rest = met if n == most else met.where(~F.coalesce(C("refused").isNull() & leads, F.lit(False)))
        done.append(rest.select("request_id", C("asked").alias("url"), C("url").alias("final_url"), F.lit(n).alias("redirects"), C("a.status").alias("status"), why.alias("refused")))
        going = met.where(C("refused").isNull() & leads).select("request_id", C("asked").alias("url"), joined(C("url"), C("a.location")).alias("final_url"))
    return reduce(DataFrame.union, done)


class Refused(OSError):
    """A request that must not go out."""


def guarded(ask: Callable[[str], tuple[int, str | None, dict | None]], resolve: Callable[[str], list[str]], most: int = REDIRECTS) -> Callable[[str], dict | None]:
    """A `get` for `fetching.fetch_wave`: asks hop by hop, each judged before it is asked.

    ask(url) gives status, location and what was got, without following; resolve(host) the addresses of a name. What is
    got is returned with final_url, status_code and redirects. Raises Refused, which is never tried again.
    """
    nets = [(ip_network(n), True) for n in CLOSED] + [(ip_network(n), False) for n in OPEN]

    def public(text: str) -> bool:
        found = ip_address(text)
        found = getattr(found, "ipv4_mapped", None) or found
        own = [(n.prefixlen, shut) for n, shut in nets if n.version == found.version and found in n]
        return not max(own, default=(0, False))[1]

    def check(url: str) -> None:
        u = urlsplit(url)
        name = (u.hostname or "").lower().rstrip(".")
        if u.scheme.lower() not in ("http", "https") or u.username is not None or not name or name in ("metadata.google.internal", "metadata.goog"):
            raise Refused(f"refused: {url}")
        try:
            addresses = [str(ip_address(name.partition("%")[0]))]
        except ValueError:
            addresses = resolve(name)
        if not addresses or not all(map(public, addresses)):
            raise Refused(f"{name} is not public, or unknown")

    def get(url: str) -> dict | None:
        at = url
        for n in range(most + 1):
            check(at)
            status, location, got = ask(at)
            if status not in MOVED or not location:
                return None if got is None else {"final_url": at, "status_code": status, "redirects": n} | got
            at = urljoin(at, location)
        raise Refused(f"more than {most} redirects: {url}")

    return get
