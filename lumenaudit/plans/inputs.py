"""Queries of what comes into an audit, and of what it leaves: markup, payloads, sitemaps, windows, profiles, stored reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.messages import message
from ..functions.text import words
from ..operators import citation, compare, explorer, prompts, rules, scoring, sinks, states
from ..shared import shared_dir, written
from ..sources import connectors, discovery, guard, html, robots, services, structured
from . import analogs, markup

C = F.col


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(c, by: str = " "):
    return F.array_join(c, by)


def _signals(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return html.extract(markup.captures(spark, sf_dir), only=only)


# --- extraction from markup


def markup_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir, "title", "meta_description", "meta_robots", "canonical", "open_graph", "twitter_card", "hreflang")
    return s.select("audit_id", "url", "title", "meta_description", "meta_robots", "canonical", F.size("open_graph").alias("og"), F.try_element_at("open_graph", F.lit("og:title")).alias("og_title"), F.size("twitter_card").alias("cards"), _joined(F.array_sort(F.map_keys("hreflang"))).alias("langs"), F.try_element_at("hreflang", F.lit("en")).alias("english"))


def markup_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda h: F.coalesce(F.try_element_at("headings", F.lit(h)), F.lit(0)).alias(h)
    counts = ("word_count", "main_text_ratio", "lead_paragraph_words", "question_headings", "images_total", "images_with_alt", "svg_total", "svg_accessible", "tables_count", "definition_lists_count", "render_mode", "render_source")
    return _signals(spark, sf_dir, "h1_count", "headings", *counts).select("audit_id", "url", "h1_count", level("h2"), level("h4"), *counts)


def markup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir, "internal_links", "external_links", "internal_link_targets", "external_link_domains", "aso.openapi_links").select("audit_id", "url", "internal_links", "external_links", _joined("internal_link_targets").alias("targets"), _joined("external_link_domains").alias("outside"), _joined("aso.openapi_links").alias("openapi"))


def markup_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ("structured_data_types", "has_author", "author_has_credentials", "has_structured_dates", "content_date", "social_platforms", "aso.potential_actions", "aso.action_schema_types")
    return _signals(spark, sf_dir, *said).select("audit_id", "url", _joined("structured_data_types").alias("types"), "has_author", "author_has_credentials", "has_structured_dates", "content_date", _joined("social_platforms").alias("platforms"), _joined("aso.potential_actions").alias("actions"), _joined("aso.action_schema_types").alias("action_types"))


def markup_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda k: F.try_element_at("aso.agent_usable_forms_detail", F.lit(k)).alias(f"forms_{k}")
    return _signals(spark, sf_dir, "aso.webmcp", "aso.agent_usable_forms", "aso.agent_usable_forms_detail").select("audit_id", "url", "aso.webmcp.has_register_tool", "aso.webmcp.has_tool_attributes", "aso.webmcp.tool_count", "aso.webmcp.partial_signals", C("aso.agent_usable_forms").alias("forms_usable"), form("found"), form("no_action"), form("no_fields"), form("no_label"))


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup pages beside a rendering that adds up to 160 words: what both count, and what that says of the page."""
    more = F.concat(F.lit("<p>"), F.repeat(F.lit("more "), (40 * (F.substring_index("url", "/", -1).cast("int") % 5)).cast("int")), F.lit("</p></main>"))
    counts = ("render_mode", "render_source", "raw_word_count", "rendered_word_count", "word_count")
    return html.extract(markup.captures(spark, sf_dir).withColumn("rendered_html", F.replace("html", F.lit("</main>"), more)), only=counts).select("audit_id", "url", *counts)


def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks made of parts: graphs of up to three levels, a list of authors, actions, and broken ones; one row per page."""
    block = """CASE p_partkey % 5 WHEN 0 THEN '{"@graph": [{"@type": ["Product", "Thing"], "offers": {"@type": "Offer", "potentialAction": [{"@type": "BuyAction", "target": {"@type": "EntryPoint"}}]}}]}'
      WHEN 1 THEN '{"@type": "Article", "author": [{"@type": "Person", "jobTitle": "E"}], "datePublished": "2026-01-0' || (1 + p_partkey % 9) || '", "dateModified": 7}'
      WHEN 2 THEN '{"@type": 5, "sameAs": ["https://github.com/' || p_partkey || '", 3, "https://x.com/y"]}' WHEN 3 THEN '{"@type": "Cut' ELSE '[{"author": null}, [{"@type": "Inner"}]]' END"""
    p = _table(spark, sf_dir, "part").selectExpr("'a' || (p_partkey % 7) AS audit_id", "'u' || p_partkey AS url", f"{block} AS json")
    return structured.facts(p).withColumns({c: _joined(c) for c in ("types", "actions", "same_as")})


def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.content_types(analogs.pages(spark, sf_dir))


# --- discovery


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A nation is a site; its sitemap index names one file, which lists its suppliers and a page of another host."""
    s = _table(spark, sf_dir, "supplier").select((C("s_suppkey") % 25).cast("string").alias("n"), C("s_suppkey").cast("string").alias("k"))
    loc = F.concat(F.lit("<url><loc> https://n"), "n", F.lit(".example/s/"), "k", F.lit(" </loc></url>"))
    text = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://else.example/</loc></url>'), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>"))
    listed = s.groupBy("n").agg(text.cast("binary").alias("content")).select(C("n").alias("audit_id"), F.concat(F.lit("https://n"), "n", F.lit(".example/list.xml")).alias("url"), "content")
    index = listed.select("audit_id", F.concat(F.lit("https://n"), "audit_id", F.lit(".example/sitemap.xml")).alias("url"), F.concat(F.lit("<sitemapindex><sitemap><loc>"), "url", F.lit("</loc></sitemap></sitemapindex>")).cast("binary").alias("content"))
    broken = listed.select("audit_id", F.concat(F.lit("https://n"), "audit_id", F.lit(".example/extra.xml")).alias("url"), F.lit("<urlset><url>").cast("binary").alias("content"))
    files = listed.union(index).union(broken).withColumn("content_type", F.lit("application/xml"))
    robots = F.when(C("n_nationkey") % 5 != 0, F.concat(F.lit("User-agent: *\nDisallow: /s/1\nAllow: /s/10\nSitemap: https://n"), C("n_nationkey").cast("string"), F.lit(".example/extra.xml\n")))
    sites = _table(spark, sf_dir, "nation").select(C("n_nationkey").cast("string").alias("audit_id"), F.concat(F.lit("HTTPS://N"), C("n_nationkey").cast("string"), F.lit(".example")).alias("home"), robots.alias("robots_txt"))
    return sites, files


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.sitemaps(_sites(spark, sf_dir)[1], chunk=3).groupBy("audit_id", "url", "valid", "is_index").agg(F.sum(F.size("locs")).cast("int").alias("locations"))


def crawl_frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.frontier(*_sites(spark, sf_dir))


#: Hosts of requests, by a page's number modulo how many there are; the first four kinds may be asked.
HOSTS = ("ok.example", "198.51.99.7", "0x5DB8D822", "[2606:4700::1]", "2130706433", "0177.0.0.1", "[::ffff:10.0.0.1]", "mixed.example", "lost.example", "metadata.google.internal")


def guarded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of the pages: hosts of all kinds, a few hops that relative locations name, and some that end inside."""
    k, kinds = C("page_id"), len(HOSTS) + 2
    kind, hops, inside = k % kinds, F.floor(k / kinds) % 8, F.floor(k / (kinds * 8)) % 3 == 1
    origin = F.when(kind < len(HOSTS), F.concat(F.lit("https://"), F.get(F.array(*map(F.lit, HOSTS)), kind.cast("int")))).when(kind == len(HOSTS), F.lit("ftp://ok.example")).otherwise(F.lit("https://me@ok.example"))
    asked = _table(spark, sf_dir, "pages").select(k.alias("request_id"), origin.alias("origin"), F.concat(origin, F.lit("/p"), k.cast("string")).alias("url"), kind.alias("kind"), hops.alias("hops"), inside.alias("inside"))
    at = lambda n: F.concat(F.lit("c"), n.cast("string"), F.lit("-"), C("request_id").cast("string"))
    steps = asked.where("kind < 4").select("*", F.explode(F.sequence(F.lit(0).cast("long"), C("hops"))).alias("n"))
    url = F.when(C("n") == 0, C("url")).otherwise(F.concat("origin", F.lit("/"), at(C("n"))))
    on = F.when(C("n") < C("hops"), F.concat(F.when(C("n") % 2 == 0, "../x/./../").otherwise(""), at(C("n") + 1), F.lit("#part"))).when(C("inside"), F.lit("//169.254.169.254/x"))
    answers = steps.select(url.alias("url"), F.when(on.isNotNull(), 302).otherwise(200).alias("status"), on.alias("location"))
    resolved = spark.createDataFrame([("OK.example.", "93.184.216.34"), ("ok.example", "2606:4700::2"), ("mixed.example", "93.184.216.34"), ("mixed.example", "10.1.2.3")], "host string, address string")
    return guard.followed(asked.select("request_id", "url"), answers, resolved)


def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' pages on sites with and without a robots.txt, asked for by two agents."""
    text = "User-agent: *\nDisallow: /s/1\nAllow: /s/10 # longer\nDisallow: /*.pdf$\n\nUser-agent: GPTBot\nUser-agent: other\nDisallow: /%73/\nAllow: /s/2*5\n"
    sites = _table(spark, sf_dir, "nation").select(C("n_nationkey").cast("string").alias("audit_id"), F.when(C("n_nationkey") % 3 != 0, F.lit(text)).alias("robots_txt"))
    k = C("s_suppkey")
    pages = _table(spark, sf_dir, "supplier").select((k % 25).cast("string").alias("audit_id"), F.concat(F.lit("https://n.example/s/"), k.cast("string"), F.when(k % 4 == 0, ".pdf").when(k % 4 == 1, "?x").otherwise("")).alias("url"))
    return robots.allowed(pages, sites, ["GPTBot/1.2", "anyone"])


#: Rows of a file of the service; a page of rows is read from the files it touches.
SHELF = 10_000


def _shelves(rows: DataFrame, folder: str) -> None:
    """The rows (on, k, ...) in folders by day and shelf: the rows of a day by key, SHELF to a shelf."""
    place = F.row_number().over(Window.partitionBy("on").orderBy("k")) - 1
    rows.withColumn("n", place).withColumn("shelf", F.floor(C("n") / SHELF)).write.partitionBy("on", "shelf").parquet(folder)


def _shelf_service(folder: str) -> Callable[[str, dict], dict | None]:
    """A service over `_shelves`, which reads no shelf but those that hold a page's rows, and of them what a filter names."""
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def query(site: str, body: dict) -> dict | None:
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        if site != "https://shop.example/":
            return None
        system, path = fs.FileSystem.from_uri(f"{uri}/on={body['startDate']}")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        shelves = sorted((int(f.base_name.removeprefix("shelf=")), f.path) for f in found if f.base_name.startswith("shelf="))
        first, last = body["startRow"], body["startRow"] + body["rowLimit"]
        wanted = [f["expressions"] for f in body.get("filters", []) if f["operator"] == "equals"]
        if wanted:
            keys = sorted(int(k) for k in set.intersection(*map(set, wanted)) if k.isdecimal() and k == str(int(k)))
            held, chosen = ds.field("k").isin(pa.array(keys, pa.int64())), [p for _, p in shelves]
        else:
            held, chosen = (ds.field("n") >= first) & (ds.field("n") < last), [p for n, p in shelves if n * SHELF < last and first < (n + 1) * SHELF]
        rows = sorted((r for p in chosen for r in ds.dataset(p, filesystem=system).to_table(filter=held).to_pylist()), key=lambda r: r["k"])
        rows = rows[first:last] if wanted else rows
        return {"rows": [{"keys": [str(r["k"])], "clicks": r["clicks"], "impressions": r["impressions"], "ctr": r["clicks"] / 100, "position": r["position"]} for r in rows]}

    return query


def paged_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days as a service that gives a hundred rows at a time, read through the data source with a filter on days and one on keys."""
    folder = shared_dir(spark)
    _shelves(_days(spark, sf_dir).select(F.date_format("day", "yyyy-MM-dd").alias("on"), C("key").cast("long").alias("k"), "clicks", "impressions", "position"), folder)
    services.register(spark, services.searches("paged_searches", _shelf_service(folder)))
    read = lambda: spark.read.format("paged_searches").option("domain", "shop.example").option("start_date", "2024-01-01").option("end_date", "2024-01-31").option("max_rows", 2**62).load()
    week = read().where("day between '2024-01-08' and '2024-01-10'")
    some = read().where(C("key").isin("3", "14", "15") & (C("day") > F.lit("2024-01-20").cast("date")))
    return week.union(some).select(C("day").cast("string").alias("day"), "key", "clicks", "impressions", "ctr", "position")


# --- payloads


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant's turn as the payload of one of four engines."""
    c = _table(spark, sf_dir, "conversations").where(C("role") == "assistant").withColumn("e", (C("conv_id") + C("turn")) % 4)
    url = F.concat(F.lit("https://www.a"), C("turn").cast("string"), F.lit(".example/x"))
    cite = F.struct(url.alias("url"), F.lit("t").alias("title"))
    one = F.to_json(F.struct(F.lit("m1").alias("model"), F.array(F.struct(F.struct(C("text").alias("content"), F.array(F.struct(cite.alias("url_citation"))).alias("annotations")).alias("message"))).alias("choices")))
    two = F.to_json(F.struct(F.lit("m2").alias("model"), F.array(F.struct(F.lit("server_tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<struct<url:string,title:string>>").alias("citations")), F.struct(F.lit("text").alias("type"), C("text").alias("text"), F.array(cite, cite).cast("array<struct<url:string,title:string>>").alias("citations"))).alias("content")))
    three = F.to_json(F.struct(F.lit("m3").alias("modelVersion"), F.array(F.struct(F.struct(F.array(F.struct(C("text").alias("text")), F.struct(F.lit("!").alias("text"))).alias("parts")).alias("content"), F.struct(F.array(F.struct(F.struct(url.alias("uri"), F.lit("t").alias("title")).alias("web"))).alias("groundingChunks")).alias("groundingMetadata"))).alias("candidates")))
    four = F.to_json(F.struct(F.lit("m4").alias("model"), F.array(F.lit("https://b.example/1"), url, F.lit("")).alias("citations"), F.array(F.struct(F.struct(C("text").alias("content")).alias("message"))).alias("choices")))
    payload = F.when(C("e") == 0, one).when(C("e") == 1, two).when(C("e") == 2, three).otherwise(four)
    engine = F.element_at(F.array(*map(F.lit, ("openai", "anthropic", "gemini", "perplexity"))), (C("e") + 1).cast("int"))
    return c.select(F.lit("c").alias("audit_id"), engine.alias("engine"), C("conv_id").cast("string").alias("prompt_id"), C("turn").cast("int").alias("repetition"), F.lit(True).alias("web_search_enabled"), payload.alias("payload"))


def engine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = connectors.answers(_payloads(spark, sf_dir))
    return a.select("engine", "model", "prompt_id", "repetition", "response_text", _joined(F.transform("citations", lambda c: F.concat_ws(":", c["position"], c["domain"], F.coalesce(c["title"], F.lit("-")))), ",").alias("cites"))


def tracking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking of every conversation as a prompt, by two engines, in up to eight turns."""
    asked = _table(spark, sf_dir, "conversations").select(F.lit("c").alias("audit_id"), C("conv_id").cast("string").alias("prompt_id")).distinct()
    targets = spark.createDataFrame([("c", "a1.example", "the", ["b.example"])], "audit_id string, domain string, brand string, competitors array<string>")
    m = citation.tracking(asked, ["openai", "perplexity"], 8, connectors.answers(_payloads(spark, sf_dir)), targets)
    return m.select(F.coalesce("engine", F.lit("all")).alias("engine"), "responses", "citation_rate", "mention_rate", "share_of_voice", "average_position", "repetitions", "prompts")


def entity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as brands, each with the answer of an entity search."""
    p = _table(spark, sf_dir, "part")
    hit = F.struct(F.concat(F.lit("Q"), C("p_partkey").cast("string")).alias("id"), F.concat("p_name", F.lit(" Ltd")).alias("label"), F.concat_ws(" ", "p_type", F.lit("goods")).alias("description"))
    payload = F.to_json(F.struct(F.when(C("p_partkey") % 4 > 0, F.array(hit)).otherwise(F.array().cast("array<struct<id:string,label:string,description:string>>")).alias("search")))
    e = p.withColumn("e", connectors.entity(payload))
    name = F.when(C("p_partkey") % 3 == 0, F.lit("Other Firm")).otherwise(C("p_name"))
    told = F.when(C("p_partkey") % 2 == 0, F.concat(F.lit("Fine "), F.initcap("p_type"), F.lit(" things"))).otherwise(F.lit("nothing of the kind"))
    b = connectors.brand_coherence(name, told, C("e.label"), C("e.description"))
    return e.select("p_partkey", C("e.id").alias("id"), C("e.label").alias("label"), F.element_at(b, "name").alias("name"), F.element_at(b, "description").alias("description"))


def discovery_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the files that AI discovery looks for; every seventh is broken."""
    p = _table(spark, sf_dir, "part").withColumn("whole", C("p_partkey") % 7 != 0)
    cut = lambda j: F.when(C("whole"), j).otherwise(F.substring(j, 1, 9))
    summary = cut(F.to_json(F.struct(F.substring("p_name", 1, 2 + 9).alias("name"), F.repeat(C("p_type"), (C("p_partkey") % 5).cast("int")).alias("description"))))
    service = cut(F.to_json(F.struct(C("p_name").alias("name"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (C("p_partkey") % 3).cast("int")).alias("capabilities"))))
    item = F.struct(F.repeat(C("p_name"), (C("p_partkey") % 3).cast("int")).alias("question"), F.repeat(C("p_type"), (C("p_partkey") % 4).cast("int")).alias("answer"))
    faq = cut(F.to_json(F.struct(F.array(item, item).alias("faq"))))
    found = F.when(C("p_partkey") % 3 == 0, 404).otherwise(200)
    return p.select("p_partkey", connectors.valid_summary(summary).alias("summary"), connectors.valid_service(service).alias("service"), connectors.valid_faq(faq).alias("faq"), connectors.nlweb(found, F.when(C("p_partkey") % 2 == 0, F.lit('{"results": []}')).otherwise(F.lit('{"x": 1}'))).alias("nlweb"))


def probe_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    domain = F.concat(F.when(C("c_custkey") % 2 == 0, "www.").otherwise(""), F.lit("shop"), C("c_custkey").cast("string"), F.lit(".example"))
    brand = F.when(C("c_custkey") % 3 == 0, C("c_mktsegment")).when(C("c_custkey") % 3 == 1, "")
    return c.select("c_custkey", F.posexplode(connectors.probe_queries(domain, brand)).alias("place", "query"))


# --- searches over days


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a query; views are impressions."""
    e = _table(spark, sf_dir, "events").where(C("event_type").isin("view", "click"))
    return e.groupBy(F.lit("e").alias("audit_id"), F.to_date("ts").alias("day"), C("user_id").cast("string").alias("key")).agg(F.count_if(C("event_type") == "click").alias("clicks"), F.count_if(C("event_type") == "view").alias("impressions")).withColumn("position", (C("clicks") % 7 + C("impressions") % 5 + 1).cast("double"))


def search_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = connectors.search_windows(_days(spark, sf_dir), F.lit("2024-01-30"), 7)
    return w.select("period", "key", "clicks", "impressions", F.round("ctr", 6).alias("ctr"), F.round("position", 6).alias("position"))


def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = connectors.search_comparison(connectors.search_windows(_days(spark, sf_dir), F.lit("2024-01-30"), 14))
    return c.select("current_clicks", "previous_clicks", "clicks_delta", "current_impressions", "previous_impressions", "impressions_delta", "current_ctr", "previous_ctr")


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days as one payload a day, as the search console returns them, parsed and ranked; a row without keys drops out."""
    row = F.struct(F.when(C("key") != "7", F.array("key")).alias("keys"), "clicks", "impressions", (C("clicks") / 100).alias("ctr"), "position")
    per = _days(spark, sf_dir).groupBy("audit_id", "day").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("payload"))
    rows = connectors.search_rows(per.select(C("day").cast("string").alias("audit_id"), F.lit("current").alias("period"), F.lit("query").alias("dimension"), "payload"))
    return connectors.search_entries(rows, "query")


# --- profiles and comparisons


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("s_suppkey")
    fields = [
        F.concat(F.lit("v"), (k % 2).cast("string")).alias("tool_version"),
        F.lit(15).alias("signal_schema_version"),
        F.concat(F.lit("c"), F.floor(k / 20).cast("string")).alias("rule_catalog_digest"),
        F.create_map(F.lit("seo"), F.when(k % 9 == 0, 0.5).otherwise(0.3)).alias("pillar_weights"),
        F.create_map().cast("map<string,double>").alias("thresholds"),
        F.create_map().cast("map<string,double>").alias("criteria_overrides"),
        F.slice(F.array(F.lit("gsc"), F.lit("psi")), F.lit(1), F.when(k % 4 == 3, 1).otherwise(2)).alias("active_connectors"),
    ]
    s = _table(spark, sf_dir, "supplier").select(k, F.struct(*fields).alias("f"))
    return s.select(k.cast("string").alias("audit_id"), F.struct(*(C(f"f.{c}").alias(c) for c in s.schema["f"].dataType.names), F.sha2(F.to_json("f"), 256).alias("digest")).alias("measurement_profile"))


def scorecard_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier as an audit with a profile, beside the one two places on."""
    s = _table(spark, sf_dir, "supplier")
    pairs = s.select(C("s_suppkey").cast("string").alias("pair_id"), C("s_suppkey").cast("string").alias("left_id"), (C("s_suppkey") + 2).cast("string").alias("right_id"))
    both = pairs.union(s.select(F.concat(F.lit("n"), C("s_suppkey").cast("string")), C("s_suppkey").cast("string"), (C("s_suppkey") + 1).cast("string")))
    return compare.gates(_profiles(spark, sf_dir), both).withColumn("differences", _joined("differences")).withColumn("allowed_modes", _joined("allowed_modes"))


# --- what an audit leaves


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(analogs.pages(spark, sf_dir), analogs.site(spark, sf_dir), analogs.external(spark, sf_dir), F.lit(analogs.AUDITED_ON))


def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the sites' pages arrive late, some go, some change: the scores from the log of states, without the pages."""
    pages = analogs.pages(spark, sf_dir).withColumn("__k", F.substring_index("url", "/", -1).cast("long") % 10)
    of = lambda *ks: pages.where(C("__k").isin(*ks)).drop("__k")
    older = of(5).withColumn("word_count", C("word_count") + 100).withColumn("title", F.lit("an old title")).withColumn("has_author", F.lit(True)).withColumn("content_date", F.lit("2026-05-31"))
    asked, path = rules.declared(rules.catalog()), shared_dir(spark)
    states.append(path, states.state(of(1, 2, 3, 4, 6, 7).unionByName(older), *asked), "0")
    states.append(path, states.change(of(3), of(8, 9), *asked), "1")
    states.append(path, states.change(older, of(5, 0), *asked), "2")
    known = states.facts_of(states.read(spark, path), asked[0])
    results = rules.evaluate_facts(known, analogs.site(spark, sf_dir), analogs.external(spark, sf_dir), F.lit(analogs.AUDITED_ON))
    return results.select("audit_id", "key", "score", "status")


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every audit saved twice and loaded again as a report."""
    results, path = written(_results(spark, sf_dir)), shared_dir(spark)
    tables = {"audits": scoring.report(results), "results": results, "pillars": scoring.pillar_scores(results), "issues": scoring.issues(results)}
    for _ in range(2):
        sinks.save_report(tables, path, "r1")
    d = sinks.load_report(spark, path)
    at = lambda p: F.get_json_object("document", p)
    return d.select("audit_id", at("$.score_global").cast("double").alias("score_global"), at("$.coverage").cast("double").alias("coverage"), F.json_array_length(at("$.criteria")).alias("criteria"), F.json_array_length(at("$.issues")).alias("issues"), at("$.criteria[0].key").alias("first_rule"), at("$.issues[0].key").alias("first_issue"), at("$.pillars.seo").cast("double").alias("seo"))


def affected_by_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each open issue names, and the first."""
    i = scoring.issues(_results(spark, sf_dir), rules.affected(analogs.pages(spark, sf_dir))).where("affected_pages is not null")
    return i.select("audit_id", "key", F.size("affected_pages").alias("pages"), F.when(C("key") != "geo.ssr", F.element_at("affected_pages", 1)).alias("first_page"))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.page_view(analogs.pages(spark, sf_dir))


#: Words in the order in which a dictionary has them.
WORDS = ("apple", "arg", "Ärger", "eclair", "Éclair", "über", "Zebra", "zèbre")


def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under words with case and accents, in each size's dictionary order, those that hold an `É` of any case."""
    p = _table(spark, sf_dir, "part")
    word = F.get(F.array(*map(F.lit, WORDS)), ((C("p_partkey") * 5 + C("p_size")) % len(WORDS)).cast("int"))
    named = p.select(C("p_size").cast("string").alias("size"), F.concat_ws(" ", word, F.lpad(C("p_partkey").cast("string"), 9, "0")).alias("name"))
    return explorer.placed(explorer.table(named, "É", "name", "name", first=2**31 - 1), "size", "name")


def stored_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored in two batches, the second of which has all of them, and got back: key, digest and size from the store itself."""
    p = _table(spark, sf_dir, "pages").select("page_id", (C("page_id") % 5).cast("string").alias("project_id"), F.lit("r1").alias("run_id"), F.lit("html_raw").alias("type"), C("html").alias("content"))
    path = shared_dir(spark)
    for some in (p.where("page_id % 2 = 0"), p):
        sinks.put_artifacts(some.drop("page_id"), path)
    asked = sinks.artifacts(p.drop("page_id")).select("object_key")
    return sinks.get_artifacts(spark, path, asked).select("object_key", "sha256", F.octet_length("content").cast("bigint").alias("bytes"))


def script_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All client-rendered pages with the words that scripts add."""
    return rules.offenders(analogs.pages(spark, sf_dir), None).select("audit_id", "url", "raw_words", "rendered_words", "delta", "parity_pct")


def issue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action plan in words, in English and French by site."""
    i = scoring.issues(_results(spark, sf_dir))
    locale = F.when(F.substring("audit_id", 5, 9).cast("int") % 2 == 0, "fr").otherwise("de")
    status = message(F.concat(F.lit("status."), C("severity")), locale)
    return i.select("audit_id", "key", message(F.lit("issue.line"), locale, key=C("key"), status=status, priority=C("bucket")).alias("line"), message(F.concat(F.lit("bucket."), C("bucket")), locale).alias("when"), message(F.lit("no.such.key"), locale).alias("unknown"))


def connector_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as audits with one connector each, some named twice."""
    names = F.array(*map(F.lit, ("dataforseo", "serpapi", "llm_citation", "psi")))
    s = _table(spark, sf_dir, "customer").select(C("c_custkey").cast("string").alias("audit_id"), F.explode(F.array(F.element_at(names, (C("c_custkey") % 4 + 1).cast("int")), F.lit("psi"))).alias("connector"))
    return citation.audit_costs(s)


def tracking_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").where(C("role") == "user").select((C("conv_id") % 10).cast("string").alias("audit_id"), "text")
    return citation.dry_runs(c, ["openai", "gemini", "unknown"], 3)


def minimal_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select(C("c_custkey").cast("string").alias("audit_id"), F.concat(F.lit("shop"), C("c_custkey").cast("string"), F.lit(".example")).alias("domain"), F.when(C("c_custkey") % 2 == 0, C("c_name")).otherwise(" ").alias("brand"))
    return prompts.minimal_set(c)


def connectors_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogs.external(spark, sf_dir).select("audit_id", _joined(sinks.active_connectors()).alias("connectors"))


def text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", words(C("text")).alias("words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"}
