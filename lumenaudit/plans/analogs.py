"""Signals made from the order table, in SQL that Spark and DuckDB both read.

The page table has no images, forms, structured data or rankings, so most rules would be constant on it. Here every
order is a page of one of 97 sites and every signal is arithmetic on its key. These are analogs, not measurements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXTERNAL_SIGNALS, PAGE_SIGNALS, SITE_SIGNALS, struct


def url_of(k: str) -> str:
    return (
        f"(CASE WHEN ({k}) % 7 = 0 THEN 'http' ELSE 'https' END) || '://site' || CAST(({k}) % 97 AS STRING) || '.example/' || "
        f"(CASE ({k}) % 4 WHEN 0 THEN 'en/models/' WHEN 1 THEN 'glossary/' WHEN 2 THEN 'compare/' ELSE 'blog/' END) || CAST(({k}) AS STRING)"
    )


#: Over k (an order key) and s (its site). Lists are comma-separated text.
PAGE = {
    "audit_id": "'site' || CAST(s AS STRING)",
    "url": url_of("k"),
    "status_code": "CASE WHEN k % 11 = 0 THEN 404 ELSE 200 END",
    "redirects": "k % 5",
    "render_mode": "CASE WHEN k % 13 = 0 THEN NULL WHEN k % 3 = 0 THEN 'csr' ELSE 'ssr' END",
    "raw_word_count": "CASE WHEN k % 2 = 0 THEN k % 900 END",
    "rendered_word_count": "CASE WHEN k % 2 = 0 THEN (k * 7) % 1500 END",
    "title": "CASE WHEN k % 17 = 0 THEN NULL ELSE substr(repeat('abcdefghij ', 9), 1, CAST((k * 3) % 75 AS INT)) END",
    "meta_description": "CASE WHEN k % 6 = 0 THEN NULL ELSE repeat('x', CAST((k * 5) % 200 AS INT)) END",
    "canonical": "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'https://a.example/' ELSE '/rel' END",
    "meta_robots": "CASE k % 9 WHEN 0 THEN 'NoIndex,follow' WHEN 1 THEN 'index' END",
    "og_n": "k % 6",
    "cards_n": "k % 5",
    "langs": "k % 4",
    "h1_count": "k % 3",
    "h2": "k % 2",
    "h4": "CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END",
    "word_count": "CASE WHEN k % 19 = 0 THEN 0 ELSE (k * 11) % 1500 END",
    "text_ratio": "CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k % 40 AS DOUBLE) / 100 END",
    "types": "CASE WHEN s % 6 = 0 AND k % 4 = 0 THEN 'FAQPage' WHEN s % 6 = 1 AND k % 3 = 0 THEN 'HowTo,Product' WHEN s % 6 = 2 THEN 'BreadcrumbList' WHEN s % 6 = 3 AND k % 2 = 0 THEN 'ItemList' WHEN s % 6 = 4 THEN 'DefinedTerm,Event' ELSE '' END",
    "internal_links": "k % 130",
    "linked": "CASE WHEN k % 5 <> 0 THEN k + 97 END",
    "images_total": "k % 8",
    "images_with_alt": "least(k % 8, k % 5)",
    "svg_total": "k % 4",
    "svg_accessible": "least(k % 4, k % 3)",
    "tables_count": "CASE WHEN s % 4 = 0 AND k % 10 = 0 THEN 1 ELSE 0 END",
    "definition_lists_count": "CASE WHEN s % 5 = 0 AND k % 10 = 1 THEN 1 ELSE 0 END",
    "question_headings": "CASE WHEN s % 3 = 0 THEN k % 3 ELSE 0 END",
    "lead_paragraph_words": "k % 45",
    "has_author": "s % 2 = 0 AND k % 5 = 0",
    "author_has_credentials": "s % 4 = 0 AND k % 25 = 0",
    "has_structured_dates": "s % 3 = 1",
    "main_text_ratio": "CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(k % 50 AS DOUBLE) / 100 END",
    "entity_count": "(k * 3) % 200",
    "outside": "k % 3",
    "content_date": "CASE WHEN s % 3 = 1 THEN CASE WHEN s % 2 = 0 THEN '2026-0' ELSE '2025-0' END || CAST(1 + k % 5 AS STRING) || '-1' || CAST(k % 10 AS STRING) || 'T10:00:00Z' WHEN s % 3 = 2 THEN 'soon' END",
    "social": "CASE WHEN s % 5 = 0 THEN 'github,twitter' WHEN s % 5 = 1 AND k % 2 = 0 THEN 'linkedin' WHEN s % 5 = 1 THEN 'youtube,reddit,medium' ELSE '' END",
    "register_tool": "s % 10 = 0 AND k % 3 = 0",
    "tool_attributes": "s % 11 = 0",
    "partial_tools": "s % 7 = 0",
    "actions": "CASE WHEN s % 6 = 0 AND k % 5 = 0 THEN 'BuyAction' WHEN s % 6 = 1 THEN 'SearchAction' ELSE '' END",
    "action_types": "CASE WHEN s % 4 = 0 AND k % 2 = 0 THEN 'Event' WHEN s % 4 = 0 THEN 'Product' WHEN s % 4 = 1 THEN 'HowTo' ELSE '' END",
    "forms_found": "CASE WHEN s % 2 = 0 THEN k % 3 ELSE 0 END",
    "forms_usable": "CASE WHEN s % 2 = 0 THEN least(k % 3, k % 2) ELSE 0 END",
    "api": "s % 9 = 0",
}
#: Over s.
SITE = {
    "audit_id": "'site' || CAST(s AS STRING)",
    "sitemap_valid": "s % 3 <> 0",
    "blocked": "s % 10",
    "checked": "CASE WHEN s % 13 = 0 THEN 0 ELSE 9 END",
}
EXTERNAL = {
    "audit_id": "'site' || CAST(s AS STRING)",
    "lcp": "CASE WHEN s % 3 = 0 THEN NULL ELSE CAST(1500 + s * 40 AS DOUBLE) END",
    "cls": "CASE WHEN s % 4 = 0 THEN NULL ELSE CAST(s AS DOUBLE) / 200 END",
    "inp": "CAST(100 + s * 6 AS DOUBLE)",
    "lighthouse": "CASE WHEN s % 4 = 1 THEN NULL ELSE CAST(s AS DOUBLE) / 96 END",
    "rank": "CASE WHEN s % 5 = 0 THEN NULL ELSE CAST(s % 11 AS DOUBLE) + 0.25 END",
    "referring": "CASE WHEN s % 6 = 0 THEN NULL ELSE s * s * 3 END",
    "known": "CASE s % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END",
    "cited": "s % 2 = 0",
    "rate": "CAST(s AS DOUBLE) / 100",
    "voice": "CASE WHEN s % 4 = 0 THEN CAST(s AS DOUBLE) / 128 END",
    "place": "CASE WHEN s % 4 = 0 THEN CAST(1 + s % 7 AS DOUBLE) END",
    "overview": "CASE WHEN s % 5 = 1 THEN NULL ELSE CAST(s % 4 AS DOUBLE) / 3 END",
    "endpoints": "CASE s % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 4 END",
    "nlweb": "CASE s % 4 WHEN 1 THEN 'conformant' WHEN 2 THEN 'present' WHEN 3 THEN 'absent' END",
    "brand": "CASE s % 3 WHEN 1 THEN 0 WHEN 2 THEN 2 END",
    "position": "CASE WHEN s % 5 = 2 THEN NULL ELSE CAST(s AS DOUBLE) / 3 END",
    "impressions": "CASE WHEN s % 7 = 0 THEN 0 ELSE s * 10 END",
    "ctr": "CAST(s AS DOUBLE) / 1000",
}
AUDITED_ON = "2026-06-01"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def sql(where: str = "") -> str:
    """Common table expressions p (pages, of the orders that a condition picks), si and ex (one row per site) for DuckDB."""
    return (
        f"WITH keys AS (SELECT o_orderkey AS k, o_orderkey % 97 AS s FROM orders {where}), sites AS (SELECT DISTINCT o_orderkey % 97 AS s FROM orders), "
        f"p AS (SELECT k, s, {_select(PAGE)} FROM keys), si AS (SELECT {_select(SITE)} FROM sites), ex AS (SELECT {_select(EXTERNAL)} FROM sites)"
    )


def _listed(c: str):
    return F.filter(F.split(c, ","), lambda x: x != "")


def _some(names: tuple[str, ...], n: str):
    """A map of the first n names to a text."""
    return F.map_from_entries(F.transform(F.slice(F.array(*map(F.lit, names)), F.lit(1), F.col(n).cast("int")), lambda k: F.struct(k.alias("k"), F.lit("x").alias("v"))))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rules import OG_REQUIRED, TWITTER_WANTED

    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_orderkey % 97 AS s")
    p = keys.selectExpr("k", "s", *(f"{e} AS {n}" for n, e in PAGE.items()))
    headings = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(h).alias("k"), F.col(c).cast("int").alias("v")) for h, c in (("h1", "h1_count"), ("h2", "h2"), ("h4", "h4")))), lambda e: e["v"] > 0))
    langs = F.map_from_entries(F.filter(F.array(F.struct(F.when(F.col("langs") >= 1, "en").alias("k"), F.lit("/").alias("v")), F.struct(F.when(F.col("langs") >= 2, "x-default").alias("k"), F.lit("/").alias("v"))), lambda e: e["k"].isNotNull()))
    made = {
        "render_source": F.lit("analog"),
        "open_graph": _some(OG_REQUIRED, "og_n"),
        "twitter_card": _some(TWITTER_WANTED, "cards_n"),
        "hreflang": langs,
        "headings": headings,
        "structured_data_types": _listed("types"),
        "external_links": F.col("outside"),
        "internal_link_targets": F.filter(F.array(F.expr(f"CASE WHEN linked IS NOT NULL THEN {url_of('linked')} END")), lambda u: u.isNotNull()),
        "external_link_domains": F.slice(F.array(F.lit("a.example"), F.lit("b.example")), F.lit(1), F.col("outside").cast("int")),
        "social_platforms": _listed("social"),
        "aso": F.struct(
            F.struct(F.col("register_tool").alias("has_register_tool"), F.col("tool_attributes").alias("has_tool_attributes"), F.lit(0).alias("tool_count"), F.col("partial_tools").alias("partial_signals")).alias("webmcp"),
            _listed("actions").alias("potential_actions"),
            _listed("action_types").alias("action_schema_types"),
            F.col("forms_usable").cast("int").alias("agent_usable_forms"),
            F.create_map(F.lit("found"), F.col("forms_found").cast("int")).alias("agent_usable_forms_detail"),
            F.filter(F.array(F.when(F.col("api"), "/openapi.json")), lambda x: x.isNotNull()).alias("openapi_links"),
        ),
    }
    return p.select(*(made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in struct(PAGE_SIGNALS).fields))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey % 97 AS s").distinct()


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sites(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in SITE.items()))
    bots = F.transform(F.when(F.col("blocked") > 0, F.sequence(F.lit(1), F.col("blocked").cast("int"))).otherwise(F.array().cast("array<int>")), lambda x: F.concat(F.lit("bot"), x.cast("string")))
    made = {"robots_found": F.lit(True), "crawl_delay": F.lit(None), "sitemap_url_count": F.lit(0), "blocked_agent_bots": bots, "agent_bots_checked": F.col("checked")}
    return rows.select(*(made.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(SITE_SIGNALS).fields))


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sites(spark, sf_dir).selectExpr(*(f"{e} AS {n}" for n, e in EXTERNAL.items()))
    c = F.col
    types = {f.name: f.dataType for f in struct(EXTERNAL_SIGNALS).fields}
    vitals = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("k"), c(n).alias("v")) for n in ("lcp", "cls", "inp"))), lambda e: e["v"].isNotNull()))
    answers = F.map_from_entries(F.transform(F.array(*map(F.lit, range(1, 5))), lambda i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("k"), (i <= c("endpoints")).alias("v"))))
    made = {
        "audit_id": c("audit_id"),
        "core_web_vitals": vitals,
        "lighthouse_performance": c("lighthouse"),
        "open_page_rank": c("rank"),
        "referring_domains": c("referring"),
        "dataforseo_active": F.lit(False),
        "kg_presence": c("known"),
        "citation_metrics": F.when(c("cited"), F.struct(c("rate").alias("citation_rate"), c("rate").alias("mention_rate"), c("rate").alias("citation_confidence"), c("voice").alias("share_of_voice"), c("voice").alias("knowledge_presence"), c("place").alias("average_position"))),
        "aio_metrics": F.when(c("overview").isNotNull(), F.struct(c("overview").alias("presence_rate"), F.lit(None).alias("trigger_rate"), F.lit(None).alias("avg_position"), F.lit(3).alias("query_count"), F.lit("analog").alias("provider"))),
        "ai_discovery_endpoints": F.when(c("endpoints").isNotNull(), F.when(c("endpoints") == 0, F.create_map().cast("map<string,boolean>")).otherwise(answers)),
        "nlweb_status": c("nlweb"),
        "brand_coherence": F.when(c("brand") == 0, F.create_map().cast("map<string,double>")).when(c("brand") == 2, F.create_map(F.lit("name"), F.lit(1.0), F.lit("description"), F.lit(0.0))),
        "gsc": F.struct(c("position").alias("avg_position"), F.lit(0).alias("total_clicks"), c("impressions").alias("total_impressions"), c("ctr").alias("avg_ctr"), F.lit(90).alias("date_range_days")),
    }
    return rows.select(*(made[n].cast(t).alias(n) for n, t in types.items()))
