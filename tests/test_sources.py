"""Extraction, discovery, crawling, connectors, prompts, sinks and streaming."""

from __future__ import annotations

import gzip
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenaudit import schema
from lumenaudit.functions import text, urls
from lumenaudit.operators import prompts, sinks
from lumenaudit.plans import audit
from lumenaudit.plans.config import settings as config
from lumenaudit.sources import connectors, crawl, discovery, fetching, html
from lumenaudit.streaming import captures as streaming

PAGE = """<!doctype html><html lang="en"><head><title> Blue Widgets | Acme </title>
<meta name="Description" content="first"><meta name="description" content="All about widgets"><meta name="robots" content="index">
<meta property="og:title" content="Widgets"><meta property="og:image"><meta name="twitter:card" content="summary">
<link rel="canonical" href="https://acme.example/w"><link rel="alternate" hreflang="fr" href="/fr"><link rel="alternate" hreflang="" href="/x">
<script type="application/ld+json">{"@graph": [{"@type": ["Article", "Product"], "author": {"@type": "Person", "jobTitle": "x"}, "dateModified": "2026-01-02", "potentialAction": {"@type": "BuyAction"}, "sameAs": "https://github.com/acme"}]}</script>
<script type="application/ld+json">{broken</script></head>
<body><nav>Menu one</nav><main><h1>Widgets</h1><h2>Why Widgets?</h2><h3>No question</h3><p>Paris and Élan make <b>good</b> things.
<p>Second<table><tr><td>a<td>b</table><dl><dt>t<dd>d</dl>
<img src=a alt="x"><img src=b alt=" "><img src=c>
<a href="/a#frag">a</a><a href="/a">a</a><a href="https://other.example/x">o</a><a href="mailto:x@y">m</a><a href="https://linkedin.com/in/x">l</a>
<a href="/docs/swagger.json">api</a>
<svg aria-hidden="true"></svg><svg aria-label="named"></svg><svg></svg><svg><title></title></svg><a href="/b"><svg></svg>Text</a><button><span><svg></svg></span></button>
<form action="/s"><input placeholder="q"></form><form><input></form><form method="post"></form><form action="/z"><input></form>
<div toolname="t"></div></main><footer>Foot</footer></body></html>"""


def test_signals_of_a_page():
    s = html.signals("https://acme.example/w", PAGE)
    assert s["title"] == "Blue Widgets | Acme"
    assert (s["meta_description"], s["meta_robots"], s["canonical"]) == ("All about widgets", "index", "https://acme.example/w")
    assert s["open_graph"] == {"og:title": "Widgets", "og:image": ""}
    assert s["twitter_card"] == {"twitter:card": "summary"}
    assert s["hreflang"] == {"fr": "/fr"}
    assert (s["h1_count"], s["headings"], s["question_headings"]) == (1, {"h1": 1, "h2": 1, "h3": 1}, 1)
    assert (s["images_total"], s["images_with_alt"]) == (3, 1)
    assert s["internal_link_targets"] == ["https://acme.example/a", "https://acme.example/b", "https://acme.example/docs/swagger.json"]
    assert s["external_link_domains"] == ["linkedin.com", "other.example"]
    assert s["social_platforms"] == ["github", "linkedin"]
    assert s["structured_data_types"] == ["Article", "BuyAction", "Person", "Product"]
    assert (s["has_author"], s["author_has_credentials"], s["content_date"]) == (True, True, "2026-01-02")
    assert (s["tables_count"], s["definition_lists_count"], s["lead_paragraph_words"]) == (1, 1, 4)  # texts inside a paragraph join without a space
    assert (s["svg_total"], s["svg_accessible"]) == (4, 1)
    aso = s["aso"]
    assert (aso["potential_actions"], aso["action_schema_types"], aso["openapi_links"]) == (["BuyAction"], ["Product"], ["/docs/swagger.json"])
    assert aso["agent_usable_forms_detail"] == {"found": 4, "no_action": 1, "no_fields": 1, "no_label": 1}
    assert aso["webmcp"]["has_tool_attributes"]
    assert s["main_text_ratio"] < 1


def test_signals_of_nothing():
    s = html.signals("", "")
    assert (s["title"], s["word_count"], s["text_ratio"], s["main_text_ratio"], s["internal_links"]) == (None, 0, None, None, 0)


def test_ratio_without_main():
    s = html.signals("https://a.example/", "<body><nav>a b</nav><p>c d e f</p><footer>g h</footer></body>")
    assert s["main_text_ratio"] == 0.5


@pytest.mark.parametrize(("raw", "rendered", "mount", "scripts", "mode"), [(60, None, False, 0, "ssr"), (10, None, True, 0, "csr"), (10, None, False, 6, "csr"), (10, None, False, 1, "ssr"), (100, 300, False, 0, "csr"), (1000, 1200, False, 0, "ssr"), (10, 60, False, 0, "ssr")])
def test_render_mode(raw, rendered, mount, scripts, mode):
    assert html.render_mode(raw, rendered, mount, scripts) == mode


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/=\"' abphtmldiv&;!-é\n", max_size=200))
def test_extraction_never_fails(page):
    a = html.signals("https://a.example/", page)
    assert a == html.signals("https://a.example/", page)
    assert a["word_count"] >= 0


def test_whatever_the_partitions(spark, sf_dir):
    c = crawl.captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    want = sorted(map(repr, audit.run(c).scores.collect()))
    for n in (1, 3, 8):
        assert sorted(map(repr, audit.run(c.repartition(n)).scores.collect())) == want


def test_columns_fit_the_schema(spark):
    row = [("a", "https://a.example/", None, 200, 0, PAGE, None), ("a", None, None, None, None, None, None), ("a", "https://a.example/r", None, 200, 0, "<p>few</p>", "<p>" + "word " * 200)]
    out = html.extract(spark.createDataFrame(row, schema.struct(schema.CAPTURE)))
    assert [f.name for f in out.schema] == [f.name for f in schema.struct(schema.PAGE_SIGNALS)]
    got = {r["url"]: r for r in out.collect()}
    assert (got["https://a.example/r"]["render_mode"], got["https://a.example/r"]["raw_word_count"], got["https://a.example/r"]["rendered_word_count"]) == ("csr", 1, 200)
    assert got[""]["word_count"] == 0


ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 2\nSitemap: https://a.example/s.xml\nUser-agent: GPTBot\nDisallow: /\n"


def test_robots():
    r = discovery.Robots(ROBOTS)
    allowed = [r.can_fetch(f"https://a.example{p}", "x") for p in ("/", "/private/x", "/private/open/y", "/a.pdf", "/a.pdf?x=1")]
    assert allowed == [True, False, True, False, True]
    assert not r.can_fetch("https://a.example/", "GPTBot")
    assert (r.crawl_delay("x"), r.sitemaps, r.found) == (2.0, ["https://a.example/s.xml"], True)
    assert discovery.Robots(None).can_fetch("https://a.example/private", "x")


def test_sitemap():
    body = b'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.example/1 </loc></url><url/></urlset>'
    assert discovery.sitemap(body) == {"valid": True, "is_index": False, "locs": ["https://a.example/1"]}
    assert discovery.sitemap(gzip.compress(body))["valid"]
    assert discovery.sitemap(b"<sitemapindex><sitemap><loc>x</loc></sitemap></sitemapindex>") == {"valid": True, "is_index": True, "locs": ["x"]}
    for bad in (b"", b"<html/>", b"<!DOCTYPE x><urlset/>", b"\x1f\x8bbroken", b"<urlset>"):
        assert not discovery.sitemap(bad)["valid"]


def test_sitemap_levels(spark):
    x = lambda inner, tag, of: f"<{tag}>" + "".join(f"<{of}><loc>{u}</loc></{of}>" for u in inner) + f"</{tag}>"
    files = [("a", "https://a.example/i.xml", x(["https://a.example/s.xml", "https://a.example/i.xml"], "sitemapindex", "sitemap")), ("a", "https://a.example/s.xml", x(["https://a.example/1", "https://b.example/2", "https://a.example/0"], "urlset", "url"))]
    parsed = discovery.sitemaps(spark.createDataFrame([(a, u, c.encode(), None) for a, u, c in files], "audit_id string, url string, content binary, content_type string"))
    declared = spark.createDataFrame([("a", "a.example", "https://a.example/i.xml")], "audit_id string, host string, url string")
    assert sorted(r["url"] for r in discovery.expanded(parsed, declared).collect()) == ["https://a.example/0", "https://a.example/1"]


def test_crawl(spark):
    frame = lambda rows, names: spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} string" for n in names.split()))
    frontier = frame([("s", "/")], "audit_id url")
    fetched = frame([("s", u, u) for u in ("/", "/a", "/b", "/c")] + [("s", "/r", "/a")], "audit_id url final_url")
    edges = frame([("s", "/", "/a"), ("s", "/", "/b"), ("s", "/a", "/c"), ("s", "/", "/r"), ("s", "/c", "/"), ("s", "/", "/gone")], "audit_id src dst")
    assert sorted((r["final_url"], r["depth"]) for r in crawl.crawl(frontier, fetched, edges).collect()) == [("/", 0), ("/a", 1), ("/b", 1), ("/c", 2)]
    assert crawl.crawl(frontier, fetched, edges, max_pages=2).count() == 2
    assert crawl.crawl(frontier, fetched, edges, max_depth=0).count() == 1


def test_frontier(spark):
    sites = spark.createDataFrame([("a", "A.example", "User-agent: *\nDisallow: /x\nSitemap: https://a.example/m.xml"), ("b", "https://b.example/", "User-agent: *\nDisallow: /"), ("c", "c.example", None), ("d", "//", None)], "audit_id string, home string, robots_txt string")
    locs = lambda *u: ("<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>").encode()
    files = spark.createDataFrame([("a", "https://a.example/m.xml", locs("https://a.example/2", "https://a.example/x/1", "https://a.example/", "https://o.example/"), None), ("a", "https://a.example/sitemap.xml", locs("https://a.example/1"), None), ("b", "https://b.example/sitemap.xml", locs("https://b.example/1"), None)], "audit_id string, url string, content binary, content_type string")
    got = discovery.frontier(sites, files).orderBy("audit_id", "place").collect()
    assert [(r["audit_id"], r["url"]) for r in got] == [("a", "https://a.example/"), ("a", "https://a.example/1"), ("a", "https://a.example/2"), ("c", "https://c.example/")]
    assert discovery.frontier(sites, files, respect_robots=False).count() == 7


def test_agents_by_name():
    r = discovery.Robots("User-agent: bot\nDisallow: /\n\nUser-agent: GPTBot\nAllow: /")
    assert r.can_fetch("https://a.example/x", "GPTBot/1.0") and r.can_fetch("https://a.example/x", "CCBot") and not r.can_fetch("https://a.example/x", "bot/2")


def test_fetch_wave(spark):
    def get(url):
        if url.endswith("/gone"):
            return None
        if url.endswith("/broken"):
            raise OSError("no answer")
        return {"final_url": url + "/", "status_code": 201, "html": "<p>x</p>"}

    wave = spark.createDataFrame([("a", "https://a.example/1", None), ("a", "https://a.example/gone", None), ("a", "https://a.example/broken", None), ("b", "https://b.example/1", 0.01), ("b", "https://b.example/2", 0.01), ("c", "http://127.0.0.1/", None)], "audit_id string, url string, crawl_delay double")
    got = fetching.fetch_wave(wave, get, sleep=lambda s: None).collect()
    assert sorted((r["final_url"], r["status_code"]) for r in got) == [("https://a.example/1/", 201), ("https://b.example/1/", 201), ("https://b.example/2/", 201)]


def test_a_large_host_is_fetched_in_batches(spark):
    wave = spark.range(130).selectExpr("'a' AS audit_id", "'https://a.example/' || id AS url", "CAST(NULL AS DOUBLE) AS crawl_delay").union(spark.createDataFrame([("b", "https://a.example/x", None)], "audit_id string, url string, crawl_delay double"))
    got = fetching.fetch_wave(wave, lambda url: {"html": url[-3:]})
    assert got.select("audit_id", "url").distinct().count() == got.count() == 131
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()


def test_search_pages(spark):
    held = [{"keys": [f"q{k}"], "clicks": k, "impressions": 2 * k, "ctr": 0.5, "position": 3.0} for k in range(250)]

    def query(site, body):
        if site != "https://a.example/" or body["dimensions"] == ["page"] and body["startRow"]:
            return None
        return {"rows": held[body["startRow"] : body["startRow"] + body["rowLimit"]]}

    rows = [("a", "a.example", "current", d, "2026-01-01", "2026-03-31") for d in ("query", "page")] + [("b", "b.example", "current", "query", "2026-01-01", "2026-03-31")]
    asked = spark.createDataFrame(rows, "audit_id string, domain string, period string, dimension string, start_date string, end_date string")
    n = lambda **more: {(r["audit_id"], r["dimension"]): r["count"] for r in connectors.search_rows(fetching.search_pages(asked, query, **more)).groupBy("audit_id", "dimension").count().collect()}
    assert n() == {("a", "query"): 250}
    assert n(max_rows=120) == {("a", "query"): 120}
    assert [r["p"][0] for r in spark.range(1).select(fetching.properties(F.lit("a.b")).alias("p")).collect()] == ["sc-domain:a.b"]


def test_resources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "sitemap.xml").write_bytes(b"<urlset><url><loc>https://a.example/</loc></url></urlset>")
    r = fetching.resources(spark, str(tmp_path))
    parsed = discovery.sitemaps(r.select(F.lit("a").alias("audit_id"), "url", "content", "content_type")).first()
    assert parsed["valid"] and parsed["locs"] == ["https://a.example/"]


def test_windows_of_days(spark):
    days = spark.createDataFrame([("a", f"2026-01-{d:02d}", "q", 1, 10 * d, float(d)) for d in range(1, 12)], "audit_id string, day string, key string, clicks int, impressions int, position double")
    got = {r["period"]: (r["clicks"], round(r["position"], 3)) for r in connectors.search_windows(days, F.lit("2026-01-11"), 3).collect()}
    assert got == {"current": (4, round((64 + 81 + 100 + 121) / 38, 3)), "previous": (4, round((25 + 36 + 49 + 64) / 26, 3))}
    with pytest.raises(ValueError):
        connectors.search_windows(days, F.lit("2026-01-11"), 481)


def test_urls(spark):
    cases = {"www.example.com/x": "example.com", "blog.example.com": "example.com", "https://shop.example.co.uk/": "example.co.uk", "": None, "//": None}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r["u"]: r["d"] for r in df.select("u", urls.registrable_domain(F.col("u")).alias("d")).collect()} == cases
    forms = {"HTTPS://Example.com:443/a#b": "https://example.com/a", "example.com.": "https://example.com/", "http://x.example:8080?q=1": "http://x.example:8080/?q=1", "http://": None}
    df = spark.createDataFrame([(k,) for k in forms], "u string")
    assert {r["u"]: r["n"] for r in df.select("u", urls.normalized(F.col("u"))["url"].alias("n")).collect()} == forms
    safe = {"https://example.com/": True, "http://127.0.0.1/": False, "http://192.168.1.1/": False, "http://172.16.0.9/": False, "http://169.254.169.254/": False, "ftp://example.com/": False, "http://u@example.com/": False, "http://localhost/": False, "http://[::1]/": False, "http://8.8.8.8/": True}
    df = spark.createDataFrame([(k,) for k in safe], "u string")
    assert {r["u"]: r["s"] for r in df.select("u", urls.fetchable(F.col("u")).alias("s")).collect()} == safe
    routes = {"https://a.example/en/models/x": "models", "https://a.example/": "root", "https://a.example/en": "en", "https://a.example/blog/1": "blog"}
    df = spark.createDataFrame([(k,) for k in routes], "u string")
    assert {r["u"]: r["r"] for r in df.select("u", urls.route_family(F.col("u")).alias("r")).collect()} == routes


def test_mentions(spark):
    df = spark.createDataFrame([("Chez ÉXAMPLE, oui", "example", True), ("examples", "example", False), (None, "x", False), ("a.b", "a.b", True), ("aXb", "a.b", False), ("x", "", False)], "t string, b string, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", text.mentioned(text.fold(F.col("t")), F.col("b")).alias("got")).collect())


def test_search_console(spark):
    row = lambda k, c, i, p: {"keys": [k] if k else [], "clicks": c, "impressions": i, "ctr": c / i, "position": p}
    now = {"rows": [row("q1", 100, 1000, 2.44), row("q2", 77, 1850, 14.26), row(None, 9, 9, 1)]}
    before = {"rows": [row("q1", 90, 1500, 9.0), row(None, 10, 500, 1.0)]}
    p = spark.createDataFrame([("a", "current", "query", json.dumps(now)), ("a", "previous", "query", json.dumps(before)), ("b", "current", "query", "broken")], "audit_id string, period string, dimension string, payload string")
    r = connectors.search_comparison(connectors.search_rows(p)).first()
    assert (r["current_clicks"], r["current_impressions"], r["current_avg_position"]) == (177, 2850, 8.3)  # the mean is the double 8.35, which is below its middle
    assert (r["previous_clicks"], r["previous_impressions"], r["clicks_delta"], r["impressions_delta"]) == (100, 2000, 77, 850)
    assert r["position_delta"] == round(8.3 - 9.0, 1)


def test_other_payloads(spark):
    df = spark.createDataFrame([('{"name": "Acme", "description": "Makes widgets since 1901"}', '{"name": "Acme", "capabilities": ["x"]}', '[{"q": "What are widgets?", "a": "Widgets are useful things."}]', '{"results": []}')], "s string, v string, f string, n string")
    c = F.col
    assert tuple(df.select(connectors.valid_summary(c("s")), connectors.valid_service(c("v")), connectors.valid_faq(c("f")), connectors.nlweb(F.lit(200), c("n")), connectors.nlweb(F.lit(404), c("n")), connectors.nlweb(F.lit(200), F.lit("text"))).first()) == (True, True, True, "conformant", "absent", "present")
    b = connectors.brand_coherence(F.lit("Apple"), F.lit("computers and phones"), F.lit("Apple Inc."), F.lit("maker of computers"))
    assert df.select(b).first()[0] == {"name": 1.0, "description": 1.0}
    q = connectors.probe_queries(F.lit("www.world-models.io"), F.lit(None).cast("string"))
    assert df.select(q).first()[0] == ["world-models", "what is world-models", "world-models review"]


def test_answers(spark):
    rows = [
        ("openai", {"model": "m", "choices": [{"message": {"content": "hi", "annotations": [{"url_citation": {"url": "https://www.a.example/1", "title": "t"}}]}}]}),
        ("anthropic", {"model": "m", "content": [{"type": "text", "text": "he", "citations": [{"url": "https://a.example/1"}]}, {"type": "text", "text": "llo"}]}),
        ("gemini", {"candidates": [{"content": {"parts": [{"text": "hey"}]}, "groundingMetadata": {"groundingChunks": [{"web": {"uri": "https://a.example/"}}]}}]}),
        ("perplexity", {"choices": [{"message": {"content": "yo"}}], "citations": ["https://a.example/", "https://b.example/"]}),
    ]
    df = spark.createDataFrame([("a", e, "p", 1, True, json.dumps(p)) for e, p in rows], "audit_id string, engine string, prompt_id string, repetition int, web_search_enabled boolean, payload string")
    got = {r["engine"]: (r["response_text"], len(r["citations"])) for r in connectors.answers(df).collect()}
    assert got == {"openai": ("hi", 1), "anthropic": ("hello", 1), "gemini": ("hey", 1), "perplexity": ("yo", 2)}


def test_prompt_set(spark, sf_dir):
    s = html.extract(crawl.captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))).persist()
    d = s.select("audit_id").distinct().withColumn("domain", F.col("audit_id"))
    got = [tuple(r) for r in prompts.prompt_set(s, d).orderBy("audit_id", "place").collect()]
    assert got == [tuple(r) for r in prompts.prompt_set(s.repartition(5), d).orderBy("audit_id", "place").collect()]
    per: dict = {}
    for a, place, intent, t, _ in got:
        per.setdefault(a, []).append((place, intent, t))
    assert all([p for p, _, _ in v] == list(range(1, len(v) + 1)) and len(v) <= 15 for v in per.values())
    full = [v for v in per.values() if len(v) == 15]
    assert full and all(len({t for _, _, t in v}) == 15 for v in full)


def test_reports(spark, sf_dir, tmp_path):
    from lumenaudit.plans import queries as q

    documents = sinks.json_reports(q._results(spark, sf_dir))
    one = json.loads(documents.orderBy("audit_id").first()["document"])
    assert len(one["criteria"]) == 67 and set(one["pillars"]) == set(schema.PILLARS)
    page = sinks.html_report({"audit_id": "<b>", "issues": [{"key": "<i>"}]})
    assert "<b>" not in page and "<i>" not in page
    sinks.write_csv(sinks.page_view(spark.createDataFrame([], schema.struct(schema.PAGE_SIGNALS))), str(tmp_path / "csv"))
    profile = sinks.measurement_profile("1", {"seo": 1.0}, {}, {}, ["psi", "gsc"], 15)
    assert profile["digest"] == sinks.measurement_profile("1", {"seo": 1.0}, {}, {}, ["gsc", "psi"], 15)["digest"]
    assert profile["digest"] != sinks.measurement_profile("2", {"seo": 1.0}, {}, {}, ["gsc", "psi"], 15)["digest"]


def test_saved_signals_score_again(spark, sf_dir, tmp_path):
    from lumenaudit.operators import rules

    a = audit.run(crawl.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    tables = {"audits": a.scores, "signals": a.signals, "results": a.results, "pillars": a.pillars, "issues": a.issues, "readiness": a.readiness}
    for _ in range(2):  # saving again doubles nothing
        sinks.save_report(tables, str(tmp_path), "r1")
    sinks.save_report({"audits": a.scores.limit(1), "results": a.results.limit(0)}, str(tmp_path), "r0")
    saved = sinks.load_tables(spark, str(tmp_path))
    none = lambda ddl: spark.createDataFrame([], schema.struct(ddl))
    again = rules.evaluate(saved["signals"], none(schema.SITE_SIGNALS), none(schema.EXTERNAL_SIGNALS))
    columns = ["audit_id", "key", "score", "status"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, saved["results"].select(columns).collect()))
    reports = {r["audit_id"]: json.loads(r["document"]) for r in sinks.load_report(spark, str(tmp_path)).collect()}
    assert len(reports) == a.scores.count()
    for r in a.scores.collect():
        d = reports[r["audit_id"]]
        assert d["score_global"] == r["score_global"] and [c["key"] for c in d["criteria"]] == sorted(c["key"] for c in d["criteria"]) and len(d["criteria"]) == 67 and len(d["pillar_scores"]) == 5
        assert [(-i["priority"], i["key"]) for i in d["issues"]] == sorted((-i["priority"], i["key"]) for i in d["issues"])
        assert d["aso_readiness"]["readiness_level"] in ("none", "basic", "ready", "advanced")
    one = spark.createDataFrame([(next(iter(reports)),)], "audit_id string")
    assert sinks.load_report(spark, str(tmp_path), one).count() == 1


def test_sitemaps_are_read_in_pieces(spark):
    """What a file takes doesn't grow with what it unzips to; chunks together are the whole; a broken end makes it all invalid."""
    import tracemalloc

    def body(n):
        return b"<urlset>" + b"".join(b"<url><loc>https://a.example/%08d</loc><lastmod>2026-01-01</lastmod></url>" % k for k in range(n)) + b"</urlset>"

    peaks = []
    for n in (3000, 60_000):
        data = gzip.compress(body(n))
        tracemalloc.start()
        assert sum(x is not None for _, x in discovery.locations(data)) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] + 500_000 and peaks[1] < 3_000_000
    files = spark.createDataFrame([("a", "s.xml", body(25), None), ("a", "bad.xml", body(25)[:-3], None), ("a", "cut.gz", gzip.compress(body(2000))[:-40], None), ("a", "empty.xml", b"", None), ("a", "none.xml", None, None), ("a", "few.xml", b"<urlset/>", None)], "audit_id string, url string, content binary, content_type string")
    got = {}
    for r in discovery.sitemaps(files, chunk=10).collect():
        got.setdefault((r["url"], r["valid"]), []).append(r["locs"])
    assert [len(x) for x in got["s.xml", True]] == [10, 10, 5] and got["few.xml", True] == [[]]
    assert {u for u, valid in got if not valid} == {"bad.xml", "cut.gz", "empty.xml", "none.xml"}
    assert discovery.sitemap(body(25))["locs"] == [x for xs in got["s.xml", True] for x in xs]


def test_html_reports(spark):
    rows = [("a<b>&'c", "k\"1", ["seo"], 10.0, "critical", 1.0, "standard"), ("a<b>&'c", "k2", ["geo"], 90.0, "ok", 1.0, "standard"), ("plain", "k2", ["geo"], 90.0, "ok", 1.0, "standard")]
    results = spark.createDataFrame(rows, "audit_id string, key string, pillars array<string>, score double, status string, weight double, evidence_tier string")
    documents = {r["audit_id"]: json.loads(r["document"]) for r in sinks.json_reports(results).collect()}
    assert {r["audit_id"]: r["document"] for r in sinks.html_reports(results).collect()} == {a: sinks.html_report(d) for a, d in documents.items()}


def test_pdf_report():
    import re

    doc = {"audit_id": "a(b)\\é漢", "score_global": 51.2, "pillars": {"seo": 1.0}, "issues": [{"rank": k, "key": f"rule.{k}", "severity": "critical", "priority": 4.0, "bucket": "high"} for k in range(1, 130)]}
    pdf = sinks.pdf_report(doc)
    assert pdf.startswith(b"%PDF-1.4") and pdf.endswith(b"%%EOF\n") and pdf.count(b"/Type /Page ") == 3
    assert b"(Audit of a\\(b\\)\\\\\xe9?) Tj" in pdf and b"rule.129" in pdf
    start = int(re.search(rb"startxref\n(\d+)", pdf)[1])
    assert pdf[start : start + 4] == b"xref"
    for n, at in enumerate(re.findall(rb"(\d{10}) 00000 n", pdf), 1):  # every object stands where the table says
        assert pdf[int(at) :].startswith(b"%d 0 obj" % n)
    assert sinks.pdf_report({}).count(b"/Type /Page ") == 1


def test_stored_artifacts(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("p", "r", "html_raw", "x"), ("p", "r", "html_raw", "x"), ("p", "r", "report_json", "{}"), ("..", "r", "html_raw", "z")], "project_id string, run_id string, type string, content string")
    assert [sinks.put_artifacts(rows, path) for _ in range(2)] == [2, 0]
    more = rows.union(spark.createDataFrame([("q", "r", "html_raw", "x"), ("q", "r", "html_raw", "new")], rows.schema))
    assert sinks.put_artifacts(more, path, most=0) == 2  # a body that is there under another key isn't stored again
    assert spark.read.parquet(f"{path}/bodies").count() == 3
    keys = sinks.artifacts(rows).select("object_key").union(spark.createDataFrame([("gone",)], "object_key string"))
    got = sinks.get_artifacts(spark, path, keys).select("type", F.col("content").cast("string").alias("c")).collect()
    assert sorted(map(tuple, got)) == [("html_raw", "x"), ("report_json", "{}")]
    assert sorted(r["exists"] for r in sinks.artifacts_exist(spark, path, keys).collect()) == [False, True, True]


def test_store_reads_what_is_asked_for(spark, tmp_path):
    """Bodies are in no exchange, and only the buckets of the keys asked for are read."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "store")
    rows = spark.range(300).select(F.lit("p").alias("project_id"), F.lit("r").alias("run_id"), F.lit("html_raw").alias("type"), F.concat(F.lit("page "), "id").alias("content"))
    sinks.put_artifacts(rows, path)
    some = sinks.artifacts(rows.limit(3)).select("object_key")
    got = sinks.get_artifacts(spark, path, some)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "[bucket").replace("[[", "[")
    assert got.count() == 3 and sinks.get_artifacts(spark, path, some, most=0).count() == 3


def test_locale_order(spark):
    from lumenaudit.operators import explorer

    words = ["zèbre", "Zebra", "eclair", "Éclair", "apple", "Ärger", "arg", "ECLAIR"]
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n int")
    order = lambda **o: [r["word"] for r in explorer.table(df, "", "word", "word", **o).collect()]
    assert order() == ["apple", "arg", "Ärger", "eclair", "ECLAIR", "Éclair", "Zebra", "zèbre"]
    assert order(locale="sv") == ["apple", "arg", "eclair", "ECLAIR", "Éclair", "Zebra", "zèbre", "Ärger"]
    assert [r["word"] for r in explorer.table(df, "ÈB", "word", "n").collect()] == ["zèbre"]
    assert [r["n"] for r in explorer.table(df, "", "word", "n", descending=True, first=2).collect()] == [7, 6]


def test_messages(spark):
    from pyspark.sql import functions as F

    from lumenaudit.functions import messages

    m = spark.range(1).select(messages.message(F.lit("coverage.line"), "fr", share=F.lit(80)).alias("a"), messages.message(F.lit("issue.line"), "fr", key=F.lit("{status}"), status=F.lit("x"), priority=F.lit(None)).alias("b"), messages.message(F.lit("none"), "xx").alias("c")).first()
    assert m["a"] == "80 % of the rules' weight was measured" and m["c"] == "none" and m["b"].startswith("x : x")
    assert messages.known("issue.line", "xx") and not messages.known("none") and messages.parameters("issue.line", "fr") == {"key", "status", "priority"}


def test_artifact_keys(spark):
    rows = [("p", "r", "html_raw", "x"), ("p", "r", "html_raw", "x"), ("p/../q", "r", "html_raw", "x"), ("p", " ", "html_raw", "y")]
    got = sinks.artifacts(spark.createDataFrame(rows, "project_id string, run_id string, type string, content string")).collect()
    assert len(got) == 1 and got[0]["object_key"].startswith("projects/p/runs/r/html_raw/") and got[0]["object_key"].endswith(".html.gz")


def test_settings():
    s = config({"pillar_weights": {"seo": 0.5}, "criteria_overrides": {"meta.title": {"weight": 3}}, "crawl": {"max_pages": 10}})
    assert (s.pillar_weights["seo"], s.pillar_weights["geo"], s.max_pages, s.max_depth) == (0.5, 0.22, 10, 3)
    assert s.weights_of_rules() == {"meta.title": 3.0}
