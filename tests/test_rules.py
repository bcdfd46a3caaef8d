"""Single rules, scores and comparisons on rows with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenaudit import schema
from lumenaudit.operators import compare, rules, scoring
from lumenaudit.plans import audit


def pages(spark, *overrides):
    """Page rows with plain defaults, all of audit `a` unless said otherwise."""
    fields = schema.struct(schema.PAGE_SIGNALS).fields
    empty = {"array": [], "map": {}, "int": 0, "boolean": False}
    aso = {"webmcp": {"has_register_tool": False, "has_tool_attributes": False, "tool_count": 0, "partial_signals": False}, "potential_actions": [], "action_schema_types": [], "agent_usable_forms": 0, "agent_usable_forms_detail": {}, "openapi_links": []}
    made = []
    for n, o in enumerate(overrides):
        row = {f.name: empty.get(f.dataType.typeName() if f.dataType.typeName() != "integer" else "int") for f in fields}
        row |= {"audit_id": "a", "url": f"https://a.example/{n}", "status_code": 200, "raw_word_count": None, "rendered_word_count": None, "aso": aso}
        made.append(tuple((row | o)[f.name] for f in fields))
    return spark.createDataFrame(made, schema.struct(schema.PAGE_SIGNALS))


def evaluated(spark, page_rows, site=(), external=(), **more):
    s = spark.createDataFrame(list(site), schema.struct(schema.SITE_SIGNALS))
    fields = schema.struct(schema.EXTERNAL_SIGNALS).fields
    e = spark.createDataFrame([tuple(({"audit_id": "a"} | x).get(f.name) for f in fields) for x in external], schema.struct(schema.EXTERNAL_SIGNALS))
    return {r["key"]: r for r in rules.evaluate(page_rows, s, e, **more).where("audit_id = 'a'").collect()}


def test_catalog_is_whole(spark):
    keys = [r.key for r in rules.catalog()]
    tags = [p for r in rules.catalog() for p in r.pillars]
    assert len(keys) == len(set(keys)) == 67
    assert {p: tags.count(p) for p in schema.PILLARS} == {"seo": 29, "geo": 17, "gso": 15, "aeo": 15, "aso": 14}
    weights = {p: round(sum(r.weight for r in rules.catalog() if p in r.pillars), 1) for p in schema.PILLARS}
    assert weights == {"seo": 28.7, "geo": 19.6, "gso": 17.1, "aeo": 18.8, "aso": 17.8}
    assert sum(r.tier == "experimental" for r in rules.catalog()) == 6


@pytest.mark.parametrize(
    ("key", "over", "score", "status"),
    [
        ("meta.title", [{"title": "x" * 30}, {"title": "x" * 61}, {"title": ""}, {"title": None}], 42.5, "critical"),
        ("content.depth", [{"word_count": 400}], 50.0, "warning"),
        ("content.text_ratio", [{"text_ratio": None}, {"text_ratio": 0.3}], 50.0, "warning"),
        ("links.internal", [{"internal_links": 5}, {"internal_links": 0}, {"internal_links": 1}], 53.33, "warning"),
        ("struct.hierarchy", [{"h1_count": 1, "headings": {"h1": 1, "h3": 1}}, {"h1_count": 1, "headings": {"h1": 1, "h2": 2}}, {"headings": {}}], 50.0, "warning"),
        ("img.alt", [{"images_total": 2, "images_with_alt": 2}, {"images_total": 2, "images_with_alt": 1}], 75.0, "warning"),
        ("img.alt", [{"images_total": 1000, "images_with_alt": 900}], 90.0, "warning"),
        ("img.alt", [{}], 0.0, "not_measured"),
        ("img.svg_alt", [{"svg_total": 10, "svg_accessible": 4}], 40.0, "critical"),
        ("geo.noise_ratio", [{"main_text_ratio": 0.5}, {"main_text_ratio": 0.1}, {"main_text_ratio": None}], 75.0, "warning"),
        ("geo.entity_density", [{"entity_count": 2, "word_count": 500}], 20.0, "critical"),
        ("geo.entity_density", [{"entity_count": 200, "word_count": 500}], 60.0, "warning"),
        ("geo.entity_density", [{"word_count": 0}], 0.0, "not_measured"),
        ("geo.primary_sources", [{"word_count": 500, "external_link_domains": ["b"]}, {"word_count": 500}], 50.0, "ok"),
        ("geo.primary_sources", [{"word_count": 500, "external_link_domains": ["b"]}, {"word_count": 100}], 100.0, "ok"),
        ("geo.cross_platform", [{"social_platforms": ["github", "reddit"]}, {"social_platforms": ["reddit", "elsewhere"]}], 50.0, "warning"),
        ("geo.ssr", [{"render_mode": "ssr"}, {"render_mode": "csr"}], 50.0, "warning"),
        ("geo.ssr", [{"render_mode": "csr", "raw_word_count": 900, "rendered_word_count": 2100}, {"render_mode": "csr", "raw_word_count": 20, "rendered_word_count": 1000}], 22.43, "critical"),
        ("i18n.hreflang", [{}], 0.0, "not_applicable"),
        ("i18n.hreflang", [{"hreflang": {"en": "/"}}, {"hreflang": {"x-default": "/"}}, {}], 85.0, "ok"),
        ("gso.longtail", [{}], 0.0, "not_measured"),
        ("aeo.about_page", [{"url": "https://a.example/Team"}], 100.0, "ok"),
    ],
)
def test_rule(spark, key, over, score, status):
    r = evaluated(spark, pages(spark, *over))[key]
    assert (r["score"], r["status"]) == (score, status)


@pytest.mark.parametrize(("date", "score", "status"), [("2026-05-15", 100.0, "ok"), ("2025-06-01", 0.0, "critical"), ("2026-01-01T00:00:00Z", 50.0, "warning"), ("junk", 0.0, "not_measured"), ("2026-06", 0.0, "not_measured")])
def test_freshness(spark, date, score, status):
    r = evaluated(spark, pages(spark, {"content_date": date}), audited_on=F.lit("2026-06-01"))["geo.freshness"]
    assert (r["score"], r["status"]) == (score, status)


def test_orphans(spark):
    p = pages(spark, {"url": "https://a.example/", "internal_link_targets": ["https://a.example/a"]}, {"url": "https://a.example/a"}, {"url": "https://a.example/b"})
    assert evaluated(spark, p)["links.orphans"]["score"] == 50.0
    assert [r["url"] for r in rules.orphans(p).collect()] == ["https://a.example/b"]


def test_thresholds_and_overrides(spark):
    p = pages(spark, {"word_count": 800})
    r = evaluated(spark, p, thresholds={"content.depth": {"target_words": 1600}}, overrides={"content.depth": 9.0})["content.depth"]
    assert (r["score"], r["weight"]) == (50.0, 9.0)
    assert evaluated(spark, p, thresholds={"content.depth": {"target_words": -1}})["content.depth"]["score"] == 100.0


def test_no_pages_is_not_measured(spark):
    found = evaluated(spark, pages(spark, {"audit_id": "b"}), site=[("a", True, None, True, 3, ["GPTBot"], 9)])
    assert len(found) == 67
    assert {k for k, r in found.items() if r["status"] not in ("not_measured", "not_applicable")} == {"crawl.sitemap", "aso.agent_access"}
    assert found["aso.agent_access"]["score"] == 88.89


def test_empty_maps_differ(spark):
    found = evaluated(spark, pages(spark, {}), external=[{"ai_discovery_endpoints": {}, "brand_coherence": {}}])
    assert found["aso.ai_discovery"]["status"] == "critical"
    assert found["aso.brand_coherence"]["status"] == "not_measured"


def test_registered_rule(spark):
    @rules.register
    def extra(thresholds):
        return rules.Rule("own.pages", 1.0, ("seo",), F.col("pages") * 10.0, F.col("pages") > 0)

    try:
        assert evaluated(spark, pages(spark, {}, {}))["own.pages"]["score"] == 20.0
    finally:
        rules._EXTRA.remove(extra)


def results(spark, *rows):
    """(audit, key, pillars, score, status, weight)"""
    return spark.createDataFrame([(a, k, p.split(), s, st, w, "standard") for a, k, p, s, st, w in rows], "audit_id string, key string, pillars array<string>, score double, status string, weight double, evidence_tier string")


def test_pillar_scores(spark):
    r = results(spark, ("a", "x", "seo", 100.0, "ok", 2.0), ("a", "y", "seo", 50.0, "warning", 1.0), ("b", "x", "seo", 100.0, "ok", 2.0), ("b", "y", "seo", 0.0, "not_measured", 5.0), ("c", "x", "seo", 100.0, "ok", 2.0), ("c", "y", "seo", 0.0, "not_measured", 2.0), ("c", "z", "seo", 0.0, "not_applicable", 1.0))
    got = {(x["audit_id"], x["pillar"]): x for x in scoring.pillar_scores(r).collect()}
    assert len(got) == 15
    assert (got["a", "seo"]["score"], got["a", "seo"]["measured"]) == (83.33, 2)
    assert (got["b", "seo"]["score"], got["b", "seo"]["excluded"]) == (28.57, 1)
    assert (got["c", "seo"]["score"], got["c", "seo"]["coverage"], got["c", "seo"]["not_applicable"], got["c", "seo"]["excluded"]) == (50.0, 0.5, 1, 2)
    assert (got["a", "geo"]["score"], got["a", "geo"]["measured"]) == (0.0, 0)


def test_global_drops_unmeasured(spark):
    r = results(spark, *(("a", p, p, s, "ok", 1.0) for p, s in (("seo", 80.0), ("gso", 60.0), ("aso", 40.0))))
    want = (80 * 0.30 + 60 * 0.18 + 40 * 0.15) / (0.30 + 0.18 + 0.15)
    assert scoring.global_scores(r).first()["score"] == round(want, 2)


def test_issues(spark):
    r = results(spark, ("a", "meta.title", "seo", 0.0, "critical", 1.5), ("a", "perf.lcp", "seo", 50.0, "warning", 1.5), ("a", "img.alt", "seo", 90.0, "ok", 0.5))
    got = [(x["key"], x["impact"], x["effort"], x["priority"], x["bucket"]) for x in scoring.issues(r).orderBy("rank").collect()]
    assert got == [("meta.title", 2, 1, 4.0, "high"), ("perf.lcp", 2, 3, 0.67, "low")]


def profile(**over):
    return {"tool_version": "1", "active_connectors": ["psi"], "criteria_overrides": {}, "pillar_weights": {"seo": 1.0}, "rule_catalog_digest": "r", "signal_schema_version": 15, "thresholds": {}, "digest": "d"} | over


def test_compare(spark):
    r = results(spark, ("l", "a", "seo", 40.0, "critical", 1.0), ("l", "b", "seo", 100.0, "ok", 1.0), ("r", "a", "seo", 80.0, "ok", 1.0), ("r", "b", "seo", 0.0, "not_measured", 1.0))
    kind = "tool_version string, active_connectors array<string>, criteria_overrides map<string,double>, pillar_weights map<string,double>, rule_catalog_digest string, signal_schema_version int, thresholds map<string,double>, digest string"

    def audits(right):
        return spark.createDataFrame([("l", profile()), ("r", right)], f"audit_id string, measurement_profile struct<{kind.replace(' ', ':').replace(',:', ',')}>")

    out = compare.compare_scorecards(r, audits(profile(active_connectors=[], digest="e")), "l", "r", "intersection")
    total = out["totals"].first()
    assert (total["left_global"], total["right_global"], total["global_delta"]) == (40.0, 80.0, 40.0)
    assert [c["key"] for c in out["criteria"].collect()] == ["a"]
    assert out["profile_differences"] == ["active_connectors"]
    out = compare.compare_scorecards(r, audits(profile()), "l", "r")
    assert out["comparability"] == "exact"
    assert {c["key"]: c["delta"] for c in out["criteria"].collect()} == {"a": 40.0, "b": -100.0}
    broken = audits(profile(pillar_weights={"seo": 2.0}, digest="e"))
    with pytest.raises(compare.NotComparable):
        compare.compare_scorecards(r, broken, "l", "r")
    out = compare.compare_scorecards(r, broken, "l", "r", "descriptive")
    assert out["totals"].first()["global_delta"] is None
    assert out["criteria"].count() == 0


def test_issues_name_the_pages_of_site_rules(spark):
    """Orphans, client-rendered and unsourced pages reach audit.run's issues."""
    url = "https://a.example/{}".format
    rows = [{"url": url(n), "audit_id": "a", "word_count": 500, "internal_link_targets": [url(1)], "external_link_domains": [], "render_mode": "csr", "raw_word_count": w, "rendered_word_count": 100} for n, w in enumerate((30, 10, 20))]
    rows += [{"url": url(9), "audit_id": "a", "word_count": 10, "internal_link_targets": [], "external_link_domains": [], "render_mode": "ssr"}]
    rows += [{"url": f"https://b.example/{n:02}", "audit_id": "b", "word_count": 500, "external_link_domains": []} for n in range(40)]
    p = pages(spark, *rows)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(audit.html, "extract", lambda captures: p)
        got = {(r["audit_id"], r["key"]): r["affected_pages"] for r in audit.run(p, persist=False).issues.collect()}
    assert got["a", "links.orphans"] == [url(2), url(9)]
    assert got["a", "geo.ssr"] == [url(1), url(2), url(0)]
    assert got["a", "geo.primary_sources"] == [url(0), url(1), url(2)]
    assert got["b", "links.orphans"] == [f"https://b.example/{n:02}" for n in range(1, 11)]
    assert got["b", "geo.primary_sources"] == [f"https://b.example/{n:02}" for n in range(30)]
    assert got["a", "meta.title"] == [url(0), url(1), url(2), url(9)]
