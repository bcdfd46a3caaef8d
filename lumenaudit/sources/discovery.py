"""robots.txt, sitemaps and the frontier of a crawl."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, unquote, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host
from . import robots

# User agents whose access is checked.
AGENT_BOTS = ("Amazonbot", "CCBot", "ChatGPT-User", "Claude-Web", "ClaudeBot", "GPTBot", "Google-Extended", "OAI-SearchBot", "PerplexityBot")
SITEMAP_BYTES, SITEMAP_URLS, INDEX_DEPTH = 50 << 20, 5000, 3
#: Bytes of a file that are read, or unzipped, at a time.
PIECE = 64 << 10


class Robots:
    """One robots.txt, by RFC 9309, for a client that asks URL by URL: the longest matching rule decides, allow wins a tie; no
    file allows all. Tables of URLs are judged by `robots.allowed`."""

    def __init__(self, text: str | None) -> None:
        self.found, self.sitemaps = text is not None, []
        self.groups: dict[str, tuple[list[tuple[bool, str]], list[float]]] = {}
        agents: list[str] = []
        open_ = False
        for line in (text or "").splitlines():
            name, _, value = line.partition("#")[0].partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "sitemap" and value:
                self.sitemaps.append(value)
            elif name == "user-agent":
                agents = [*agents, value.lower()] if open_ else [value.lower()]
                open_ = True
                self.groups.setdefault(value.lower(), ([], []))
            elif name in ("allow", "disallow", "crawl-delay"):
                open_ = False
                for a in agents:
                    if name == "crawl-delay":
                        if re.fullmatch(r"\d+(\.\d+)?", value):
                            self.groups[a][1].append(float(value))
                    elif value:
                        self.groups[a][0].append((name == "allow", value))

    def _group(self, agent: str) -> tuple[list, list]:
        name = agent.lower()
        # An agent goes by its product name; a group's name is that or its beginning, up to a mark.
        named = [a for a in self.groups if a != "*" and a and re.match(rf"{re.escape(a)}(?![a-z0-9])", name)]
        return self.groups.get(max(named, key=len) if named else "*", ([], []))

    @staticmethod
    def _pattern(rule: str) -> re.Pattern:
        end = rule.endswith("$")
        body = "".join(".*" if c == "*" else re.escape(c) for c in quote(unquote(rule.removesuffix("$")), safe="/*?=&%:@!$'()+,;~-._"))
        return re.compile(body + ("$" if end else ""))

    def can_fetch(self, url: str, agent: str) -> bool:
        try:
            u = urlsplit(url)
        except ValueError:
            return True
        path = quote(unquote(u.path or "/"), safe="/*?=&%:@!$'()+,;~-._") + (f"?{u.query}" if u.query else "")
        hits = [(len(rule), allow) for allow, rule in self._group(agent)[0] if self._pattern(rule).match(path)]
        return max(hits)[1] if hits else True

    def crawl_delay(self, agent: str) -> float | None:
        return next(iter(self._group(agent)[1]), None)


def site_signals(sites: DataFrame, agent: str = "*") -> DataFrame:
    """sites(audit_id, home, robots_txt, sitemap_valid, sitemap_url_count) to schema.SITE_SIGNALS; null robots: no file."""
    files = sites.select("audit_id", "robots_txt")
    homes = sites.select("audit_id", F.coalesce("home", F.lit("")).alias("url"))
    shut = robots.allowed(homes, files, list(AGENT_BOTS)).where("not allowed").groupBy("audit_id").agg(F.array_sort(F.collect_set("asked")).alias("blocked"))
    known = sites.join(robots.delays(files, agent), "audit_id", "left").join(shut, "audit_id", "left")
    return known.select("audit_id", F.col("robots_txt").isNotNull().alias("robots_found"), "crawl_delay", "sitemap_valid", F.col("sitemap_url_count").cast("int"), F.coalesce("blocked", F.array().cast("array<string>")).alias("blocked_agent_bots"), F.lit(len(AGENT_BOTS)).alias("agent_bots_checked"))


def frontier(sites: DataFrame, files: DataFrame, agent: str = "*", respect_robots: bool = True, depth: int = INDEX_DEPTH, most: int = SITEMAP_URLS) -> DataFrame:
    """(audit_id, url, place): where the crawl of every site begins: its home, then its sitemaps' URLs in order.

    sites(audit_id, home, robots_txt); files(audit_id, url, content, content_type): sitemap files that answered. Sitemaps
    are those that robots.txt declares and the default one. Only URLs of the site's own host that robots.txt allows.
    """
    from pyspark.sql import Window

    from ..functions.urls import normalized

    named = sites.withColumn("n", normalized(F.col("home"))).where("n is not null").select("audit_id", "robots_txt", F.col("n.url").alias("home"), F.col("n.host").alias("host"), F.concat(F.col("n.origin"), F.lit("/sitemap.xml")).alias("default"))
    declared = robots.sitemaps(named.select("audit_id", "robots_txt")).union(named.select("audit_id", "default")).distinct()
    begin = declared.join(named.select("audit_id", "host"), "audit_id").select("audit_id", "host", "url")
    below = expanded(sitemaps(files), begin, depth, most)
    every = named.select("audit_id", F.col("home").alias("url"), F.lit(0).alias("step")).union(below.join(named.select("audit_id", "home"), "audit_id").where("url <> home").select("audit_id", "url", F.lit(1)))
    checked = every
    if respect_robots:
        fine = robots.allowed(every.select("audit_id", "url"), named.select("audit_id", "robots_txt"), [agent]).where("allowed").select("audit_id", "url")
        checked = every.join(fine, ["audit_id", "url"], "left_semi")
    return checked.select("audit_id", "url", F.row_number().over(Window.partitionBy("audit_id").orderBy("step", "url")).alias("place"))


class _Bad(ValueError):
    """A file that is no sitemap."""


def _pieces(data: bytes, content_type: str | None, url: str | None) -> Iterator[bytes]:
    """The file a piece at a time, unzipped if its magic, type or name says so."""
    view, zipped = memoryview(data), data[:2] == b"\x1f\x8b" or "gzip" in (content_type or "").lower() or (url or "").lower().endswith(".gz")
    if not zipped and len(data) > SITEMAP_BYTES:
        raise _Bad
    z, size = zlib.decompressobj(wbits=16 + zlib.MAX_WBITS) if zipped else None, 0
    for k in range(0, len(data), PIECE):
        piece = bytes(view[k : k + PIECE])
        while piece and not (z and z.eof):
            out = z.decompress(piece, PIECE) if z else piece
            piece = z.unconsumed_tail if z else b""
            size += len(out)
            if size > SITEMAP_BYTES:
                raise _Bad
            yield out
    while z and not z.eof:  # what the last piece still holds
        out = z.decompress(b"", PIECE)
        size += len(out)
        if not out or size > SITEMAP_BYTES:
            raise _Bad
        yield out


def locations(data: bytes | None, content_type: str | None = None, url: str | None = None) -> Iterator[tuple[bool, str | None]]:
    """(is it an index?, location) of every entry of a file, after one without location; raises ValueError once the file
    turns out to be no sitemap. DTDs and entities are refused. Only a piece and an entry are held."""
    parser, kind, depth, entry, head = ElementTree.XMLPullParser(("start", "end")), None, 0, "", b""
    root = None
    name = lambda e: e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""

    def events(piece: bytes | None) -> Iterator[str]:
        nonlocal kind, depth, entry, root
        parser.close() if piece is None else parser.feed(piece)
        for event, e in parser.read_events():
            depth += event == "start"
            if event == "start" and depth == 1:
                root, kind = e, {"sitemapindex": "sitemap", "urlset": "url"}.get(name(e))
                if kind is None:
                    raise _Bad
            elif event == "start" and depth == 2:
                entry = name(e)
            elif event == "end" and depth == 3 and entry == kind and name(e) == "loc":
                if text := (e.text or "").strip():
                    yield text
            elif event == "end" and depth == 2:
                root.clear()  # an entry that is read isn't kept
            depth -= event == "end"

    try:
        told = False
        for piece in _pieces(data or b"", content_type, url):
            if len(head) < 4096:
                head = (head + piece)[:4096]
                if re.search(rb"<!(doctype|entity)", head, re.I):
                    raise _Bad
            for loc in events(piece):
                yield kind == "sitemap", loc
            if kind and not told:
                told = True
                yield kind == "sitemap", None
        for loc in events(None):
            yield kind == "sitemap", loc
        if kind is None:
            raise _Bad
    except (ElementTree.ParseError, LookupError, zlib.error) as e:
        raise _Bad from e


def sitemap(data: bytes | None, content_type: str | None = None, url: str | None = None) -> dict[str, object]:
    """valid, index?, and locations of one file, all at once."""
    try:
        found = list(locations(data, content_type, url))
    except ValueError:
        return {"valid": False, "is_index": False, "locs": []}
    return {"valid": True, "is_index": found[0][0], "locs": [x for _, x in found if x is not None]}


def sitemaps(files: DataFrame, chunk: int = 5000) -> DataFrame:
    """files(audit_id, url, content, content_type) with valid, is_index, locs: a row per chunk of locations, one at least.

    A file is read twice, first to see whether it is whole; so what a task holds doesn't grow with the size it unzips to.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = lambda a, u, valid, index, locs: pd.DataFrame({"audit_id": [a], "url": [u], "valid": [valid], "is_index": [index], "locs": [locs]})
        for p in parts:
            for a, u, c, t in zip(p["audit_id"], p["url"], p["content"], p["content_type"], strict=True):
                data = None if c is None else bytes(c)
                try:
                    index = max(i for i, _ in locations(data, t, u))
                except ValueError:
                    yield row(a, u, False, False, [])
                    continue
                found = (x for _, x in locations(data, t, u) if x is not None)
                held = list(islice(found, chunk))
                yield row(a, u, True, index, held)
                while held := list(islice(found, chunk)):
                    yield row(a, u, True, index, held)

    return files.select("audit_id", "url", "content", "content_type").mapInPandas(run, "audit_id string, url string, valid boolean, is_index boolean, locs array<string>")


def expanded(parsed: DataFrame, declared: DataFrame, depth: int = INDEX_DEPTH, most: int = SITEMAP_URLS) -> DataFrame:
    """(audit_id, url): pages of an audit's own host below the declared sitemaps, by at most `depth` levels of index
    files, the first `most` by URL. declared(audit_id, host, url)."""
    from pyspark.sql import Window

    level, pages = declared.select("audit_id", "url").distinct(), None
    seen = level
    for _ in range(depth):
        here = level.join(parsed.where("valid"), ["audit_id", "url"])
        found = here.where("not is_index").select("audit_id", F.explode("locs").alias("url"))
        pages = found if pages is None else pages.union(found)
        level = here.where("is_index").select("audit_id", F.explode("locs").alias("url")).distinct().join(seen, ["audit_id", "url"], "left_anti")
        seen = seen.union(level)
    own = pages.distinct().join(declared.select("audit_id", "host").distinct(), "audit_id").where(host(F.col("url")) == F.col("host")).select("audit_id", "url")
    order = Window.partitionBy("audit_id").orderBy("url")
    return own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
