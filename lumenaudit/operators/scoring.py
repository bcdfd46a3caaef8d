"""From rule results to pillar scores, global score, coverage, readiness and issues. Native plans, keyed by audit_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded, rounded_sql
from ..schema import PILLARS

C = F.col
# Default pillar weights, and the effort of fixing a rule where it isn't 2.
PILLAR_WEIGHTS = {"seo": 0.30, "geo": 0.22, "gso": 0.18, "aeo": 0.15, "aso": 0.15}
EFFORT = {
    "aeo.about_page": 1,
    "aeo.author_credentials": 1,
    "aeo.dates_structured": 1,
    "aeo.defined_terms": 1,
    "aeo.llm_citation": 3,
    "aso.action_schema": 1,
    "aso.agent_access": 1,
    "aso.ai_discovery": 1,
    "aso.mcp_readiness": 3,
    "aso.nlweb": 3,
    "aso.openapi": 1,
    "aso.potential_actions": 1,
    "authority.backlinks": 3,
    "authority.opr": 3,
    "crawl.redirects": 1,
    "crawl.sitemap": 1,
    "geo.authors": 1,
    "geo.citation_confidence": 3,
    "geo.citation_rate": 3,
    "geo.freshness": 1,
    "geo.mention_rate": 3,
    "geo.primary_sources": 1,
    "geo.ssr": 3,
    "gso.breadcrumb": 1,
    "gso.cwv_eligible": 3,
    "gso.faqpage": 1,
    "gso.howto": 1,
    "gso.itemlist": 1,
    "gso.qa_format": 1,
    "i18n.hreflang": 1,
    "img.alt": 1,
    "img.svg_alt": 1,
    "links.internal": 1,
    "meta.canonical": 1,
    "meta.description": 1,
    "meta.robots": 1,
    "meta.title": 1,
    "meta.title_unique": 1,
    "og.complete": 1,
    "perf.cls": 3,
    "perf.inp": 3,
    "perf.lcp": 3,
    "perf.lighthouse": 3,
    "struct.h1": 1,
    "struct.hierarchy": 1,
    "struct.schema": 1,
    "twitter.cards": 1,
}


def is_measured() -> Column:
    return C("status").isin("ok", "warning", "critical")


def is_applicable() -> Column:
    return C("status") != "not_applicable"


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.when(whole > 0, part / whole), F.lit(0.0))


def coverage_label(c: Column) -> Column:
    return F.when(c >= 0.9, "complete").when(c >= 0.7, "substantial").when(c >= 0.4, "partial").otherwise("insufficient")


#: Weights are summed in integers of this part.
WEIGHT_UNITS = 1e9


def _units(weight: Column) -> Column:
    return F.rint(weight * WEIGHT_UNITS).cast("long")


def _sums(results: DataFrame) -> DataFrame:
    """One row per audit: for each pillar, and for all rules (`all`), a struct of score, coverage and counts.

    One grouping by audit_id with fixed-width sums serves pillar scores, global score and coverage alike; rules need not
    be exploded by pillar, and a pillar without rules comes out with zeros. Scores are summed in hundredths and weights in
    billionths, as integers, so the order of rows doesn't matter.
    """
    aggregates, names = [], (*PILLARS, "all")
    for p in names:
        own = F.lit(True) if p == "all" else F.array_contains("pillars", p)
        of = lambda flag, c, own=own: F.coalesce(F.sum(F.when(own & C(flag), C(c))), F.lit(0))
        aggregates += [
            of("measured", "w").alias(f"{p}_mw"),
            of("applicable", "w").alias(f"{p}_aw"),
            of("measured", "ws").alias(f"{p}_ws"),
            F.count_if(own & C("measured")).alias(f"{p}_m"),
            F.count_if(own & ~C("measured")).alias(f"{p}_x"),
            F.count_if(own & ~C("applicable")).alias(f"{p}_na"),
        ]
    units = results.select("audit_id", "pillars", is_measured().alias("measured"), is_applicable().alias("applicable"), _units(C("weight")).alias("w"), (F.rint(C("score") * 100).cast("long") * _units(C("weight"))).alias("ws"))
    ratio = lambda part, whole: _ratio(C(part).cast("double"), C(whole))
    sums = units.groupBy("audit_id").agg(*aggregates)
    # A step at a time, so that each value is a column when it is rounded: the coverage before it multiplies the mean.
    sums = sums.withColumns({f"{p}_c": ratio(f"{p}_mw", f"{p}_aw") for p in names})
    sums = sums.withColumns({f"{p}_c": F.expr(rounded_sql(f"{p}_c", 4)) for p in names})
    sums = sums.withColumns({f"{p}_s": _ratio(C(f"{p}_ws") / 100.0, C(f"{p}_mw")) * C(f"{p}_c") for p in names})
    one = lambda p: F.struct(F.lit(p).alias("pillar"), F.expr(rounded_sql(f"{p}_s")).alias("score"), C(f"{p}_c").alias("coverage"), C(f"{p}_m").alias("measured"), C(f"{p}_x").alias("excluded"), C(f"{p}_na").alias("not_applicable")).alias(p)
    return sums.select("audit_id", *map(one, names))


def coverage(results: DataFrame) -> DataFrame:
    """(audit_id, coverage, label): measured weight over applicable weight, each rule once."""
    return _sums(results).select("audit_id", C("all.coverage").alias("coverage"), coverage_label(C("all.coverage")).alias("label"))


def pillar_scores(results: DataFrame) -> DataFrame:
    """(audit_id, pillar, score, coverage, measured, excluded, not_applicable): every pillar of every audit.

    The score is the weighted mean of the measured rules, times the coverage.
    """
    return _sums(results).select("audit_id", F.explode(F.array(*PILLARS)).alias("p")).select("audit_id", "p.*")


def _global(weights: dict[str, float] | None) -> Column:
    """Weighted mean of the pillars with a measured rule and a positive weight, over the row of `_sums`; 0 without any."""
    merged = {p: round(float(w) * WEIGHT_UNITS) for p, w in (PILLAR_WEIGHTS | (weights or {})).items() if p in PILLARS and w > 0}
    top, whole = F.lit(0), F.lit(0)
    for p, w in sorted(merged.items()):
        counted = F.when(C(f"{p}.measured") > 0, F.lit(w)).otherwise(F.lit(0)).cast("long")
        top, whole = top + F.rint(C(f"{p}.score") * 100).cast("long") * counted, whole + counted
    return rounded(_ratio(top / 100.0, whole))


def global_scores(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(audit_id, score)."""
    return _sums(results).select("audit_id", _global(weights).alias("score"))


def scorecards(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(audit_id, score, scores): global score and an array of structs (pillar, score), in canonical order."""
    return _sums(results).select("audit_id", _global(weights).alias("score"), F.array(*(F.struct(F.lit(p).alias("pillar"), C(f"{p}.score").alias("score")) for p in PILLARS)).alias("scores"))


def readiness(pages: DataFrame, site: DataFrame, external: DataFrame) -> DataFrame:
    """Agent readiness of each audit: tools for agents and three kinds of action signals make the level."""
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = pages.groupBy("audit_id").agg(
        flag(C("aso.webmcp.has_register_tool") | C("aso.webmcp.has_tool_attributes")).alias("has_webmcp"),
        flag(F.size("aso.potential_actions") > 0).alias("has_potential"),
        flag(F.size("aso.action_schema_types") > 0).alias("has_types"),
        flag(C("aso.agent_usable_forms") > 0).alias("has_agent_forms"),
        flag(F.size("aso.openapi_links") > 0).alias("has_openapi"),
    )
    every = seen.join(site.select("audit_id", "blocked_agent_bots"), "audit_id", "full").join(external.select("audit_id", "ai_discovery_endpoints", "brand_coherence", "nlweb_status"), "audit_id", "full").fillna(False)
    n = C("has_potential").cast("int") + C("has_agent_forms").cast("int") + C("has_openapi").cast("int")
    level = F.when(C("has_webmcp") & (n >= 2), "advanced").when(C("has_webmcp") | (n >= 2), "ready").when(n >= 1, "basic").otherwise("none")
    brand = F.when(F.size("brand_coherence") > 0, rounded(F.aggregate(F.map_values("brand_coherence"), F.lit(0.0), lambda a, x: a + x) / F.size("brand_coherence") * 100))
    return every.select(
        "audit_id",
        level.alias("readiness_level"),
        level.isin("ready", "advanced").alias("agent_ready"),
        "has_webmcp",
        (C("has_potential") | C("has_types")).alias("has_action_schema"),
        "has_agent_forms",
        "has_openapi",
        n.alias("action_signals"),
        F.coalesce(F.size(F.map_filter("ai_discovery_endpoints", lambda k, v: v)), F.lit(0)).alias("ai_discovery_endpoints"),
        F.coalesce(C("nlweb_status") == "conformant", F.lit(False)).alias("has_nlweb"),
        brand.alias("brand_coherence_score"),
        F.coalesce("blocked_agent_bots", F.array().cast("array<string>")).alias("blocked_agent_bots"),
    )


def issues(results: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The action plan: what is warning or critical and not experimental, best return first.

    (audit_id, rank, key, severity, impact, effort, priority, bucket[, affected_pages]). evidence: (audit_id, key, urls).
    """
    of = lambda n: [k for k, e in EFFORT.items() if e == n]
    effort = F.when(C("key").isin(of(1)), 1).when(C("key").isin(of(3)), 3).otherwise(2)
    impact = F.when(C("weight") < 1.0, 1).when(C("weight") < 1.8, 2).otherwise(3)
    severity = F.when(C("status") == "critical", 2).otherwise(1)
    open_ = results.where(C("status").isin("warning", "critical") & (C("evidence_tier") == "standard"))
    rated = open_.select("audit_id", "key", C("status").alias("severity"), "pillars", impact.alias("impact"), effort.alias("effort"), rounded(impact * severity / effort.cast("double")).alias("priority"))
    rated = rated.withColumn("bucket", F.when(C("priority") >= 3, "high").when(C("priority") >= 1, "medium").otherwise("low"))
    if evidence is not None:
        rated = rated.join(evidence.select("audit_id", "key", C("urls").alias("affected_pages")), ["audit_id", "key"], "left")
    order = Window.partitionBy("audit_id").orderBy(F.desc("priority"), "key")
    return rated.withColumn("rank", F.row_number().over(order))


def report(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(audit_id, score_global, coverage, coverage_label, pillars): one row per audit, ready to write or to serialise."""
    pillars = F.create_map(*(x for p in sorted(PILLARS) for x in (F.lit(p), C(f"{p}.score"))))
    return _sums(results).select("audit_id", _global(weights).alias("score_global"), C("all.coverage").alias("coverage"), coverage_label(C("all.coverage")).alias("coverage_label"), pillars.alias("pillars"))
