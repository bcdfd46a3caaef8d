"""Rules of robots.txt as a table, against the parser of single files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lumenaudit.sources import discovery, robots

AGENTS = ["*", "GPTBot/1.2", "ClaudeBot", "anyone", "googlebot-news", "Google-Extended"]


def some_file(r):
    names = ["*", "gptbot", "GPTBot", "Claude", "claudebot", "googlebot", "google", "x", ""]
    paths = ["/", "/a", "/a/", "/a/b", "/a*", "/*.pdf$", "/a$", "/a/*/c", "*", "/%61", "/é", "/%C3%A9", "/a?x", "/a b", "a", "/*?", "/$", "/a/b$*", "", "/a+b", "/(x)", "/a.b", "/A", "/%2Fa", "/a%zz"]
    out = []
    for _ in range(r.randint(0, 14)):
        kind = r.random()
        name = r.choice(["User-agent", "user-agent", " USER-AGENT "]) if kind < 0.35 else r.choice(["Disallow", "Allow", "disallow "]) if kind < 0.85 else r.choice(["Crawl-delay", "Sitemap", "Host", "", "Noindex"])
        value = r.choice(names) if "agent" in name.lower() else r.choice(["2", "1.5", "x", "https://a.example/s.xml", "10"]) if name in ("Crawl-delay", "Sitemap", "Host") else r.choice(paths)
        out.append(r.choice(["{}: {}", "{}:{}", "{} : {} # note", "{}: {}", "{}"]).format(name, value))
    return r.choice(["\n", "\r\n", "\r", "\n\n"]).join(out)


def urls():
    return [f"https://s.example{p}" for p in ("", "/", "/a", "/a/", "/a/b", "/a/b/c", "/a/x/c", "/x.pdf", "/x.pdf?q", "/%61", "/é", "/%c3%a9", "/a?x=1", "/a%20b", "/b", "/A", "/a+b", "/(x)", "/aXb", "/a.b", "/$", "/a#f", "/?a", "/%2Fa", "/a%zz", "/q?é", "//a")]


def test_tables_are_the_parsers(spark):
    r = random.Random(11)
    files = {f"s{k}": some_file(r) for k in range(120)} | {"none": None, "empty": ""}
    sites = spark.createDataFrame(list(files.items()), "audit_id string, robots_txt string")
    pages = spark.createDataFrame([(a, u) for a in files for u in [*urls(), urls()[0]]], "audit_id string, url string")
    got = robots.allowed(pages, sites, AGENTS).collect()
    assert len(got) == len(files) * len(urls()) * len(AGENTS)
    parsed = {a: discovery.Robots(t) for a, t in files.items()}
    wrong = [(files[x["audit_id"]], x["url"], x["asked"], x["allowed"]) for x in got if x["allowed"] != parsed[x["audit_id"]].can_fetch(x["url"], x["asked"])]
    assert not wrong
    for agent in AGENTS:
        assert {x["audit_id"]: x["crawl_delay"] for x in robots.delays(sites, agent).collect()} == {a: d for a, p in parsed.items() if (d := p.crawl_delay(agent)) is not None}
    assert {(x["audit_id"], x["url"]) for x in robots.sitemaps(sites).collect()} == {(a, u) for a, p in parsed.items() for u in p.sitemaps}


def test_no_python_and_no_file_per_url(spark):
    sites = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x")], "audit_id string, robots_txt string")
    pages = spark.range(1000).select(F.lit("a").alias("audit_id"), F.concat(F.lit("https://a.example/"), "id").alias("url"))
    plan = robots.allowed(pages, sites, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert robots.allowed(pages.limit(0), sites, ["x"]).count() == 0
