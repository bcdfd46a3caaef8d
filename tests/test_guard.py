"""Addresses and the request guard, against Python's ipaddress and urljoin."""

from __future__ import annotations

import ipaddress
import random
import socket
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lumenaudit.functions import addresses, urls
from lumenaudit.sources import fetching, guard


def python_closed(text):
    a = ipaddress.ip_address(text)
    a = getattr(a, "ipv4_mapped", None) or a
    site_local = a.version == 6 and (a.is_site_local or a in ipaddress.ip_network("3fff::/20"))  # not in every Python
    return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified or not a.is_global or site_local


def literals(n=3000, seed=7):
    r = random.Random(seed)
    edges = []
    for net in map(ipaddress.ip_network, addresses.CLOSED + addresses.OPEN):
        edges += [int(net.network_address) + d for d in (-1, 0, 1)] + [int(net.broadcast_address) + d for d in (-1, 0, 1)]
    four = [ipaddress.IPv4Address(e) for e in edges if 0 <= e < 2**32] + [ipaddress.IPv4Address(r.getrandbits(32)) for _ in range(n)]
    six = [ipaddress.IPv6Address(e) for e in edges if 0 <= e < 2**128] + [ipaddress.IPv6Address(r.getrandbits(128) if r.random() < 0.5 else r.getrandbits(16) << r.randrange(0, 113, 16)) for _ in range(n)]
    out = [str(a) for a in four] + [r.choice([str(a), a.exploded, str(a).upper(), f"[{a}]"]) for a in six] + [f"::ffff:{a}" for a in four[:400]] + [f"64:ff9b::{a}" for a in four[:50]]
    return sorted(set(out))


def test_addresses_are_pythons(spark):
    found = literals()
    df = spark.createDataFrame([(x,) for x in found], "a string").withColumn("d", addresses.address(F.col("a"))).withColumn("c", addresses.closed(F.col("d")))
    for r in df.collect():
        a = ipaddress.ip_address(r["a"].strip("[]"))
        want = int(a) if a.version == 6 else (0xFFFF << 32) + int(a)
        assert (r["a"], r["d"]) == (r["a"], f"{want:032x}")
        assert (r["a"], r["c"]) == (r["a"], bool(python_closed(r["a"].strip("[]"))) or r["a"].startswith("64:ff9b::"))


def test_short_forms_are_the_systems(spark):
    """As inet_aton reads them: octal, hexadecimal, and parts that fill several bytes."""
    r = random.Random(3)
    number = lambda top: r.choice([str, hex, lambda x: f"0{x:o}", lambda x: f"0X{x:X}"])(r.randrange(top))
    found = [".".join([*(number(300) for _ in range(k)), number(256 ** (4 - k) + 5)]) for k in range(4) for _ in range(150)] + ["2130706433", "0177.0.0.1", "0x7f.1", "127.1", "08.1.1.1", "1.2.3.4.5", "256.1.1.1", "1..2", "0", "4294967295", "4294967296"]
    df = spark.createDataFrame([(x,) for x in found], "a string").withColumn("d", addresses.address(F.col("a")))
    for x in df.collect():
        try:
            want = addresses.MAPPED + socket.inet_aton(x["a"]).hex()
        except OSError:
            want = None
        assert (x["a"], x["d"]) == (x["a"], want)


@pytest.mark.parametrize("text", ["example.com", "", "::1::", ":::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7", "12345::", "::1.2.3", "::1.2.3.256", "::01.2.3.4", "g::", ":1::", "1:2:3:4::5:6:7:8", "0x7f.example"])
def test_what_is_no_address(spark, text):
    assert spark.createDataFrame([(text,), (None,)], "a string").select(addresses.address(F.col("a"))).collect() == [(None,), (None,)]


def test_longest_prefix(spark):
    networks = [("10.0.0.0/8", "ten"), ("10.1.0.0/16", "one"), ("10.1.2.3/32", "host"), ("2001:db8::/32", "doc"), ("2001:db8:1::/48", "site"), ("::/0", "all"), ("bad", "x"), ("10.0.0.0/99", "y")]
    asked = ["10.9.9.9", "10.1.9.9", "10.1.2.3", "11.0.0.1", "2001:db8::1", "2001:db8:1::5", "2002::1"]
    df = spark.createDataFrame([(x,) for x in [*asked, None]], "a string").withColumn("address", addresses.address(F.col("a")))
    got = {r["a"]: r["verdict"] for r in addresses.longest_prefix(df, spark.createDataFrame(networks, "network string, verdict string")).collect()}
    assert got == dict(zip(asked, ["ten", "one", "host", "all", "doc", "site", "all"], strict=True)) | {None: None}
    assert addresses.longest_prefix(df, spark.createDataFrame([], "network string, verdict string")).where("verdict is null").count() == 8


URLS = {
    "http://2130706433/": "address", "http://0177.0.0.1/": "address", "http://[::ffff:10.0.0.1]/": "address", "http://[0:0:0:0:0:0:0:1]/": "address", "http://198.51.99.7/": None, "http://198.51.100.7/": "address",
    "https://ok.example/": None, "https://OK.example./": None, "https://mixed.example/": "address", "https://lost.example/": "unresolved", "https://odd.example/": "address", "file:///etc/passwd": "scheme", "ftp://ok.example/": "scheme",
    "https://u:p@ok.example/": "user", "http://localhost/": "name", "http://metadata.goog/": "name", "http:///x": "host", "": "scheme", None: "scheme", "http://ok.example:8080/x?y#z": None, "http://x.internal/": "name", "http://127.1:80/": "address", "http://ok.example\\@x.example/": "user", "http://ok example/": "host",
}


def test_verdicts(spark):
    resolved = spark.createDataFrame([("ok.example", "93.184.216.34"), ("ok.example", "93.184.216.34"), ("mixed.example", "93.184.216.34"), ("mixed.example", "fd00::1"), ("odd.example", "not an address")], "host string, address string")
    got = guard.verdicts(spark.createDataFrame([(u, 1) for u in URLS], "url string, n int"), resolved).collect()
    assert {r["url"]: r["refused"] for r in got} == URLS and len(got) == len(URLS)
    assert guard.verdicts(spark.createDataFrame([], "url string"), resolved).count() == 0


def test_references_are_joined(spark):
    bases = ["http://a/b/c/d?q", "https://x.example", "https://x.example/", "https://x.example/a/"]
    refs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "./../g", "./g/.", "g/./h", "g/../h", "https://o.example/p/q?r", "g?y/./x"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    wrong = [(x["b"], x["r"], x["j"], urljoin(x["b"], x["r"])) for x in df.withColumn("j", guard.joined(F.col("b"), F.col("r"))).collect() if x["j"] != urljoin(x["b"], x["r"])]
    assert not wrong
    assert df.select(guard.joined(F.lit("http://a/b"), F.lit("https://o.example/p/../q?r#f"))).first()[0] == "https://o.example/q?r"


def test_redirects(spark):
    answers = [("https://ok.example/0", 302, "/1"), ("https://ok.example/1", 301, "https://ok.example/2"), ("https://ok.example/2", 200, None), ("https://ok.example/in", 307, "http://127.1/"), ("https://ok.example/odd", 302, None)]
    answers += [(f"https://ok.example/l{k}", 302, f"l{k + 1}") for k in range(9)]
    asked = [(1, "https://ok.example/0"), (2, "https://ok.example/in"), (3, "https://ok.example/odd"), (4, "https://ok.example/l0"), (5, "https://ok.example/l4"), (6, "https://ok.example/gone"), (7, "http://10.0.0.1/"), (8, "https://ok.example/l3")]
    resolved = spark.createDataFrame([("ok.example", "93.184.216.34")], "host string, address string")
    got = {r["request_id"]: (r["final_url"], r["redirects"], r["status"], r["refused"]) for r in guard.followed(spark.createDataFrame(asked, "request_id int, url string"), spark.createDataFrame(answers, "url string, status int, location string"), resolved).collect()}
    assert got == {
        1: ("https://ok.example/2", 2, 200, None), 2: ("http://127.1/", 1, None, "address"), 3: ("https://ok.example/odd", 0, 302, None), 4: ("https://ok.example/l5", 5, 302, "redirects"),
        5: ("https://ok.example/l9", 5, None, "silent"), 6: ("https://ok.example/gone", 0, None, "silent"), 7: ("http://10.0.0.1/", 0, None, "address"), 8: ("https://ok.example/l8", 5, 302, "redirects"),
    }


def test_a_guarded_fetch(spark):
    pages = {"https://ok.example/": (302, "/next", None), "https://ok.example/next": (200, None, {"html": "<p>"}), "https://ok.example/in": (302, "http://[::1]/", None), "http://[::1]/": (200, None, {"html": "secret"})}
    get = guard.guarded(pages.__getitem__, {"ok.example": ["93.184.216.34"], "mixed.example": ["93.184.216.34", "10.0.0.1"]}.get)
    wave = spark.createDataFrame([("a", u, 0.0) for u in ("https://ok.example/", "https://ok.example/in", "https://mixed.example/")], "audit_id string, url string, crawl_delay double")
    assert [(r["final_url"], r["redirects"], r["html"]) for r in fetching.fetch_wave(wave, get).collect()] == [("https://ok.example/next", 1, "<p>")]
    with pytest.raises(guard.Refused):
        get("https://ok.example/in")


def test_fetchable_literals(spark):
    known = {"http://2130706433/": False, "http://0177.0.0.1/": False, "http://[::ffff:10.0.0.1]/": False, "http://198.51.99.7/": True, "http://name.example/": True}
    assert {r["u"]: r["f"] for r in spark.createDataFrame([(u,) for u in known], "u string").select("u", urls.fetchable(F.col("u")).alias("f")).collect()} == known
