"""Internet addresses as column expressions: 32 hexadecimal digits, and whether a request may reach them.

An IPv4 address is the IPv6 address that it is mapped to, so `127.0.0.1`, `2130706433`, `0177.0.0.1`, `0x7f.1` and
`::ffff:7f00:1` are all the same. Digits compare as the addresses do, so networks are intervals of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from ipaddress import ip_network

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
MAPPED = "0" * 20 + "ffff"
# Networks that no request may reach, and networks inside them that are public after all.
CLOSED = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "::/8",
    "100::/8",
    "200::/7",
    "400::/6",
    "800::/5",
    "1000::/4",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "3fff::/20",
    "4000::/3",
    "6000::/3",
    "8000::/3",
    "a000::/3",
    "c000::/3",
    "e000::/4",
    "f000::/5",
    "f800::/6",
    "fc00::/7",
    "fe00::/9",
    "fe80::/10",
    "fec0::/10",
    "ff00::/8",
)
OPEN = ("0.0.0.0/0", "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def _number(part: Column) -> Column:
    """A part of an IPv4 literal: decimal, octal after 0, or hexadecimal after 0x; null if it is none of them."""
    digits = F.length(part) <= 13
    return (
        F.when(digits & part.rlike(r"^0[xX][0-9a-fA-F]*$"), F.conv(F.concat(F.lit("0"), F.substr(part, F.lit(3))), 16, 10))
        .when(digits & part.rlike(r"^0[0-7]*$"), F.conv(part, 8, 10))
        .when(digits & part.rlike(r"^[1-9][0-9]*$"), part)
        .cast("long")
    )


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with the expression of c in the plan once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _four(name: Column) -> Column:
    """The 8 digits of an IPv4 literal of one to four parts, the last of which fills what is left."""

    def digits(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        ahead = F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
        fits = n.between(1, 4) & F.forall(ahead, lambda p: p <= 255) & (last < F.element_at(F.array(*(F.lit(256**k) for k in (4, 3, 2, 1))), F.least(n, F.lit(4))))
        high = F.aggregate(F.transform(ahead, lambda p, i: p * F.element_at(F.array(*(F.lit(256**k) for k in (3, 2, 1))), i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.coalesce(fits, F.lit(False)), F.lower(F.lpad(F.hex(high + last), 8, "0")))

    return F.when(name.rlike(r"^[0-9][0-9a-fA-FxX.]*$"), once(F.transform(F.split(name, r"\."), _number), digits))


def _six(name: Column) -> Column:
    """The 32 digits of an IPv6 literal."""

    def grouped(halves: Column) -> Column:
        groups = F.flatten(halves)
        n = F.size(groups)
        fine = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & (((F.size(halves) == 1) & (n == 8)) | ((F.size(halves) == 2) & (n <= 7)))
        padded = lambda h: F.array_join(F.transform(h, lambda g: F.lpad(g, 4, "0")), "")
        filled = F.concat(padded(halves[0]), F.repeat(F.lit("0000"), F.lit(8) - n), F.coalesce(padded(F.get(halves, F.lit(1))), F.lit("")))
        return F.when(F.coalesce(fine, F.lit(False)), filled)

    def split(plain: Column) -> Column:
        return once(F.transform(F.split(plain, "::", -1), lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))), grouped)

    # A dotted end counts as two groups; it must be four plain decimals.
    tail = F.regexp_extract(name, r"(?:^|:)((?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2}))$", 1)
    groups = once(_four(tail), lambda d: F.concat(F.substr(d, F.lit(1), F.lit(4)), F.lit(":"), F.substr(d, F.lit(5), F.lit(4))))
    return once(F.when(~name.contains("."), name).otherwise(F.concat(F.regexp_replace(name, r"[^:]*$", ""), groups)), split)


def address(literal: Column) -> Column:
    """The 32 digits of an address literal (in brackets or not, with a zone or not), null for anything else, such as a name."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(literal)), r"^\[(.*)\]$", "$1"), r"%[^%]*$", "")
    return once(bare, lambda b: F.when(b.contains(":"), _six(b)).otherwise(F.concat(F.lit(MAPPED), once(F.regexp_replace(b, r"\.$", ""), _four))))


def _span(network: str) -> tuple[int, int, int]:
    """First and last address of a network, and the length of its prefix."""
    found = ip_network(network)
    base, bits = (0xFFFF << 32, 96) if found.version == 4 else (0, 0)
    return base + int(found.network_address), base + int(found.broadcast_address), bits + found.prefixlen


def intervals(networks: dict[str, bool]) -> list[tuple[str, bool]]:
    """Disjoint intervals in order, by their first address, from networks (whether closed); the longest prefix decides."""
    spans = [(*_span(n), closed) for n, closed in networks.items()]
    bounds = sorted({0, *(a for a, _, _, _ in spans), *(b + 1 for _, b, _, _ in spans if b + 1 < 1 << 128)})
    out: list[tuple[str, bool]] = []
    for at in bounds:
        closed = max(((length, c) for a, b, length, c in spans if a <= at <= b), default=(0, False))[1]
        if not out or out[-1][1] != closed:
            out.append((f"{at:032x}", closed))
    return out


def closed(digits: Column, networks: dict[str, bool] | None = None) -> Column:
    """Whether an address lies in a network that no request may reach. networks: a short list; see `longest_prefix`."""
    known = intervals({n: True for n in CLOSED} | {n: False for n in OPEN} if networks is None else networks)
    starts = F.array(*(F.lit(s) for s, c in known if c))
    ends = F.array(*(F.lit(s) for (s, c), (_, before) in zip(known[1:], known[:-1], strict=True) if before and not c))
    # Closed intervals begin and end in turn: inside one, more have begun than ended.
    passed = lambda marks, d: F.size(F.filter(marks, lambda m: m <= d))
    return once(digits, lambda d: F.when(d.isNotNull(), passed(starts, d) > passed(ends, d)))


def _bits(digits: Column) -> Column:
    return reduce(F.concat, (F.lpad(F.conv(F.substr(digits, F.lit(1 + 16 * k), F.lit(16)), 16, 2), 64, "0") for k in range(2)))


def longest_prefix(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """addresses(address) with `verdict` of the longest matching of networks(network, verdict), null for none.

    For network tables of any size: an address meets the networks by equal prefixes, of the lengths that there are (129 at
    most), in an equi join. A network is a literal and a length, as `10.0.0.0/8`; one that can't be read is left out. The
    address of a row is 32 digits, as `address` gives them; rows without one get null. Other columns stay.
    """
    length = F.regexp_extract("network", r"/(\d{1,3})$", 1).try_cast("int")
    first = address(F.regexp_replace("network", r"/\d+$", ""))
    # Lengths of IPv4 networks count the bits before it.
    size = F.when(C("network").contains(":"), length).otherwise(length + 96)
    known = networks.select(size.alias("__size"), F.substr(_bits(first), F.lit(1), size).alias("__prefix"), "verdict").where("__prefix is not null and __size between 0 and 128").groupBy("__size", "__prefix").agg(F.max("verdict").alias("verdict"))
    sizes = sorted(r[0] for r in known.select("__size").distinct().collect())
    one = addresses.select("address").where("address is not null").distinct()
    if not sizes:
        return addresses.withColumn("verdict", F.lit(None).cast(networks.schema["verdict"].dataType))
    each = one.withColumn("__bits", _bits(C("address"))).select("address", F.explode(F.array(*map(F.lit, sizes))).alias("__size"), "__bits").withColumn("__prefix", F.expr("substr(__bits, 1, __size)"))
    found = each.join(known, ["__size", "__prefix"]).groupBy("address").agg(F.max_by("verdict", "__size").alias("verdict"))
    return addresses.join(found, "address", "left")
