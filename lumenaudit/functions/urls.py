"""URLs and hosts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import address, closed

DEFAULT_PORTS = {"http": "80", "https": "443"}
# Second-level suffixes below which a registrable domain has three labels.
COMPOUND_SUFFIXES = (
    "ac.jp",
    "ac.uk",
    "co.in",
    "co.jp",
    "co.kr",
    "co.nz",
    "co.uk",
    "co.za",
    "com.ar",
    "com.au",
    "com.br",
    "com.cn",
    "com.hk",
    "com.mx",
    "com.sg",
    "com.tr",
    "com.tw",
    "edu.au",
    "firm.in",
    "gen.in",
    "go.jp",
    "gov.au",
    "gov.br",
    "gov.cn",
    "gov.uk",
    "gov.za",
    "govt.nz",
    "id.au",
    "ltd.uk",
    "me.uk",
    "ne.jp",
    "net.au",
    "net.br",
    "net.cn",
    "net.in",
    "net.nz",
    "or.jp",
    "or.kr",
    "org.au",
    "org.br",
    "org.cn",
    "org.in",
    "org.nz",
    "org.uk",
    "org.za",
    "plc.uk",
)


def part(url: Column, name: str) -> Column:
    """A part of a URL, null where there is none or the URL is malformed."""
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """Lower-cased host, empty if there is none."""
    return F.coalesce(F.lower(part(url, "HOST")), F.lit(""))


def normalized(raw: Column) -> Column:
    """Struct (url, origin, scheme, host): https where no scheme is given, lower-cased host without trailing dot, no
    default port, no fragment, `/` for an empty path. Null where no host is found."""
    trimmed = F.trim(raw)
    full = F.when(trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    after_user = F.regexp_replace(authority, r"^.*@", "")
    name = F.regexp_replace(F.lower(F.regexp_extract(after_user, r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.+$", "")
    port = F.regexp_extract(after_user, r":(\d+)$", 1)
    default = reduce(lambda c, kv: c.when(scheme == kv[0], F.lit(kv[1])), list(DEFAULT_PORTS.items())[1:], F.when(scheme == "http", F.lit("80")))
    shown = F.when((port == "") | (port == F.coalesce(default, F.lit(""))), name).otherwise(F.concat(name, F.lit(":"), port))
    path = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(full, r"^[^?#]*(\?[^#]*)", 1)
    origin = F.concat(scheme, F.lit("://"), shown)
    whole = F.concat(origin, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "?", F.lit("")).otherwise(query))
    return F.when(name != "", F.struct(whole.alias("url"), origin.alias("origin"), scheme.alias("scheme"), name.alias("host")))


def same_host(url: Column, of: Column) -> Column:
    """Exact equality; `www.` makes another host."""
    return host(url) == of


def registrable_domain(value: Column) -> Column:
    """The last two labels of a URL's or host's name, three below a compound suffix; null for none."""
    raw = F.lower(F.trim(value))
    after = F.when(raw.contains("//"), F.substring_index(raw, "//", -1)).otherwise(raw)
    name = F.regexp_extract(after, r"^([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r":.*$", "")
    name = F.regexp_replace(F.regexp_replace(name, r"^\.+|\.+$", ""), r"^www\.", "")
    labels = F.split(name, r"\.")
    keep = F.when(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").isin(*COMPOUND_SUFFIXES), 3).otherwise(2)
    joined = F.array_join(F.slice(labels, F.greatest(F.size(labels) - keep + 1, F.lit(1)), keep), ".")
    return F.nullif(joined, F.lit(""))


def domain_matches(a: Column, b: Column) -> Column:
    return F.coalesce(registrable_domain(a) == registrable_domain(b), F.lit(False))


def route_family(url: Column) -> Column:
    """The first path segment; a two-letter locale before another segment is skipped; `root` where there is none."""
    segments = F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda s: s != "")
    localized = (F.size(segments) > 1) & F.get(segments, F.lit(0)).rlike("^[A-Za-z]{2}$")
    return F.coalesce(F.when(localized, F.get(segments, F.lit(1))).otherwise(F.get(segments, F.lit(0))), F.lit("root"))


def local_name(name: Column) -> Column:
    """Whether a host is a name of the inside: this machine, the local network, or the metadata service of a cloud."""
    return name.isin("localhost", "metadata.goog", "metadata.google.internal") | name.rlike(r"\.(localhost|local|internal)$")


def fetchable(url: Column) -> Column:
    """The part of the request guard that needs no name lookup: http or https, no user info, no local name, and no
    literal of an address that isn't public, however it is written."""
    name = F.regexp_replace(host(url), r"\.$", "")
    scheme = F.lower(part(url, "PROTOCOL"))
    return F.coalesce(scheme.isin("http", "https") & part(url, "USERINFO").isNull() & (name != "") & ~local_name(name) & ~F.coalesce(closed(address(name)), F.lit(False)), F.lit(False))
