"""The scoring rules, as data, and their one-pass evaluation over all audits.

A rule is a set of aggregates over the pages of an audit, a score over these (and over the audit's site and external
signals), and what makes it measured. All page aggregates run in a single grouping by audit_id with partial aggregation:
one exchange of one row per audit and task. Two facts need their own small plans, joined on audit_id: distinct titles and
orphans (an anti join on the link graph). The scores of an audit are one array of doubles, which becomes a row per rule;
what follows from a score (rounding, status) is one expression over these rows. `register` adds a rule without touching
the engine.

Pages' scores are rounded to two digits and summed as integers of hundredths, so a mean doesn't depend on the order of
pages; and `rounded` looks at the binary value of a double.

A rule that has no data is `not_measured`, never estimated; one that doesn't concern the audit is `not_applicable`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cents_sql, clamped, rounded, rounded_sql, share, status, steps
from ..functions.urls import route_family
from ..schema import SIGNAL_SCHEMA_VERSION
from ..sources.html import ACTION_TYPES, PLATFORMS
from .states import Fact, any_page, bits, count, newest, shares, title_key, total

C = F.col

#: Values that audits may set otherwise: thresholds[rule][name].
DEFAULTS = {
    "content.depth": {"target_words": 800},
    "img.alt": {"max_missing": 25},
    "geo.primary_sources": {"min_content_words": 300, "ok_ratio": 0.5, "warn_ratio": 0.2},
}
# Fixed values of single rules.
OG_REQUIRED = ("og:title", "og:description", "og:image", "og:url", "og:type")
TWITTER_WANTED = ("twitter:card", "twitter:title", "twitter:description", "twitter:image")
EXECUTABLE_ACTIONS = ("BuyAction", "OrderAction", "RegisterAction", "ReserveAction", "SubscribeAction")
ABOUT_HINTS = ("about", "equipe", "mentions", "notre-histoire", "propos", "qui sommes", "qui-sommes", "team", "équipe")
COMPARE_HINTS = ("/compare/", "/compare-models")
#: Pages that a rule names as evidence, at most; unsourced content pages have a longer list.
SAMPLE, UNSOURCED = 10, 30


def threshold(thresholds: dict, rule: str, name: str) -> float:
    """The audit's own value if it is a positive number, else the default."""
    value = (thresholds.get(rule) or {}).get(name)
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0 else DEFAULTS[rule][name]


@dataclass(frozen=True)
class Rule:
    key: str
    weight: float
    pillars: tuple[str, ...]
    score: Column  # before it is rounded
    measured: Column
    facts: dict[str, Fact] = field(default_factory=dict)  # aggregates over pages, by name
    applicable: Column | None = None
    status: Callable[[Column], Column] = status  # of the rounded score
    tier: str = "standard"
    page: Column | None = None  # a page's own score, for evidence
    inputs: dict[str, Column] = field(default_factory=dict)  # columns of pages that the facts name


_EXTRA: list[Callable[[dict], Rule]] = []


def register(make: Callable[[dict], Rule]) -> Callable[[dict], Rule]:
    """Adds a rule: a function of the thresholds. Also a decorator."""
    _EXTRA.append(make)
    return make


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _by_length(c: Column, low: int, high: int, short: float, long: float) -> Column:
    n = F.length(c)
    return F.when(_blank(c), 0.0).when(n < low, short).when(n > high, long).otherwise(100.0)


def _indexable(c: Column) -> Column:
    return ~F.coalesce(F.lower(c).contains("noindex"), F.lit(False))


def _present(map_column: str, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, ((~_blank(F.try_element_at(C(map_column), F.lit(k)))).cast("int") for k in keys))


def _hierarchy() -> Column:
    levels = F.array_sort(F.transform(F.map_keys("headings"), lambda k: F.substring(k, 2, 1).cast("int")))
    gaps = F.exists(F.transform(levels, lambda v, i: F.when(i > 0, v - F.get(levels, i - 1)).otherwise(1)), lambda g: g > 1)
    return (
        F.when(F.coalesce(F.size("headings"), F.lit(0)) <= 0, 0.0)
        .when((C("h1_count") != 1) | (F.array_min(levels) != 1), 50.0)
        .otherwise(F.when(gaps, 50.0).otherwise(100.0))
    )


def page_rules(thresholds: dict) -> list[Rule]:
    """Rules that score each page; an audit's score is the mean over its pages."""
    og = _present("open_graph", OG_REQUIRED) / float(len(OG_REQUIRED)) * 100
    cards = _present("twitter_card", TWITTER_WANTED)
    depth = float(threshold(thresholds, "content.depth", "target_words"))
    table = [
        ("meta.title", 1.5, "seo", _by_length(C("title"), 30, 60, 60.0, 70.0)),
        ("meta.description", 1.2, "seo", _by_length(C("meta_description"), 120, 158, 60.0, 60.0)),
        ("meta.canonical", 1.0, "seo", F.when(_blank(C("canonical")), 0.0).when(C("canonical").rlike("^https?://"), 100.0).otherwise(70.0)),
        ("meta.robots", 1.0, "seo", F.when(_indexable(C("meta_robots")), 100.0).otherwise(0.0)),
        ("og.complete", 0.6, "seo", og),
        ("twitter.cards", 0.4, "seo", F.when(cards >= 3, 100.0).when(cards >= 1, 50.0).otherwise(0.0)),
        ("struct.h1", 1.0, "seo", F.when(C("h1_count") == 1, 100.0).when(C("h1_count") > 1, 50.0).otherwise(0.0)),
        ("struct.hierarchy", 0.8, "seo", _hierarchy()),
        ("content.depth", 1.3, "seo", F.least(F.lit(100.0), C("word_count") / depth * 100)),
        ("content.text_ratio", 0.6, "seo", F.when(C("text_ratio").isNull(), 0.0).otherwise(F.least(F.lit(100.0), C("text_ratio") / 0.15 * 100))),
        ("struct.schema", 1.5, "seo gso aeo aso", F.when(F.size("structured_data_types") > 0, 100.0).otherwise(0.0)),
        ("links.internal", 0.8, "seo", F.when(C("internal_links").between(3, 100), 100.0).when(C("internal_links") == 0, 0.0).otherwise(60.0)),
        ("crawl.redirects", 0.5, "seo", steps(C("redirects"), (1, 100), (3, 50))),
    ]
    broken = ("content.depth", "content.text_ratio", "og.complete")
    rules = []
    for key, w, p, e in table:
        name = key.replace(".", "_")
        # Scores that are whole numbers need no rounding.
        cents, inputs = (F.expr(cents_sql(f"page_{name}")), {f"page_{name}": e}) if key in broken else ((e * 100).cast("long"), {})
        rules.append(Rule(key, w, tuple(p.split()), _mean(f"sum_{name}", "pages"), C("pages") > 0, {f"sum_{name}": total(cents)}, page=rounded(e) if inputs else e, inputs=inputs))
    return rules


def _mean(cents: str, n: str) -> Column:
    """The mean of n scores from their sum in hundredths."""
    return F.try_divide(C(cents) / 100.0, C(n))


def _typed(*names: str) -> Column:
    return F.arrays_overlap("structured_data_types", F.array(*map(F.lit, names)))


def site_rules(thresholds: dict) -> list[Rule]:
    """Rules over all pages of an audit and its site signals."""
    pages, flag = C("pages") > 0, lambda c: F.when(C(c), 100.0).otherwise(0.0)
    of_pages = lambda part, whole="pages": share(C(part), C(whole))
    cents = lambda c: total(F.expr(cents_sql(c)))
    limit = lambda n: float(threshold(thresholds, "geo.primary_sources", n))
    content = C("word_count") >= limit("min_content_words")
    parity = F.when(C("raw_word_count").isNotNull() & C("rendered_word_count").isNotNull(), F.when(C("rendered_word_count") <= 0, 1.0).otherwise(F.least(F.lit(1.0), C("raw_word_count") / F.greatest("rendered_word_count", F.lit(1))))).otherwise(F.when(C("render_mode") == "ssr", 1.0).otherwise(0.0))
    density = C("entity_count") / F.greatest("word_count", F.lit(1))
    dense = F.when(C("word_count") > 0, F.when(density < 0.02, density / 0.02 * 100).when(density <= 0.20, 100.0).otherwise(60.0))
    # Only full dates count; the youngest of an audit decides.
    date = F.when(C("content_date").rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ])"), F.substring("content_date", 1, 10).try_cast("date"))
    age = F.date_diff(C("audited_on"), C("newest"))
    haystack = F.concat(F.lower("url"), F.lit(" "), F.lower(F.coalesce("title", F.lit(""))))
    has = lambda words, c: reduce(lambda a, b: a | b, (c.contains(w) for w in words))
    found = F.coalesce(F.try_element_at(C("aso.agent_usable_forms_detail"), F.lit("found")), F.lit(0))
    types, platforms = bits("aso.action_schema_types", ACTION_TYPES), bits("social_platforms", tuple(sorted(set(PLATFORMS.values()))))
    actions = C("aso.potential_actions")
    ratio = F.try_divide(C("sourced").cast("double"), C("content_pages"))
    return [
        Rule("meta.title_unique", 1.0, ("seo",), of_pages("distinct_titles", "titled"), F.coalesce(C("titled"), F.lit(0)) > 0),
        Rule("links.orphans", 0.7, ("seo",), 100 - F.try_divide(C("orphans").cast("double"), C("pages") - 1) * 100, C("pages") > 1),
        Rule("img.alt", 0.5, ("seo",), of_pages("with_alt", "images"), C("images") > 0, {"images": total(C("images_total")), "with_alt": total(C("images_with_alt"))}, status=lambda s: F.when((s >= 80) & (C("images") - C("with_alt") >= threshold(thresholds, "img.alt", "max_missing")), "warning").otherwise(status(s))),
        Rule("img.svg_alt", 0.4, ("seo",), of_pages("named_icons", "icons"), C("icons") > 0, {"icons": total(C("svg_total")), "named_icons": total(C("svg_accessible"))}),
        Rule("crawl.indexable", 1.2, ("seo",), of_pages("indexable"), pages, {"indexable": count((C("status_code") == 200) & _indexable(C("meta_robots")))}),
        Rule("crawl.sitemap", 0.8, ("seo",), F.when(C("sitemap_valid"), 100.0).otherwise(0.0), F.lit(True)),
        Rule("crawl.https", 1.0, ("seo",), of_pages("secure"), pages, {"secure": count(C("url").startswith("https://"))}),
        Rule("i18n.hreflang", 0.5, ("seo",), _mean("hreflang_sum", "hreflang_pages"), C("hreflang_pages") > 0, {"hreflang_pages": count(F.size("hreflang") > 0), "hreflang_sum": total(F.when(F.size("hreflang") > 0, F.when(F.map_contains_key("hreflang", "x-default"), 10_000).otherwise(7_000)))}, applicable=C("hreflang_pages") > 0),
        Rule("geo.ssr", 1.8, ("geo", "aeo", "aso"), F.try_divide(C("parity"), C("moded")) * 100, C("moded") > 0, {"moded": count(C("render_mode").isNotNull()), "parity": shares(F.when(C("render_mode").isNotNull(), parity))}),
        Rule("geo.noise_ratio", 0.8, ("geo",), _mean("signal_sum", "signal_pages"), C("signal_pages") > 0, {"signal_pages": count(C("main_text_ratio").isNotNull()), "signal_sum": cents("page_signal")}, inputs={"page_signal": F.when(C("main_text_ratio") >= 0.20, 100.0).otherwise(C("main_text_ratio") / 0.20 * 100)}),
        Rule("geo.entity_density", 1.0, ("geo",), _mean("density_sum", "worded"), C("worded") > 0, {"worded": count(C("word_count") > 0), "density_sum": cents("page_density")}, inputs={"page_density": dense}),
        Rule("geo.primary_sources", 1.2, ("geo", "aeo"), of_pages("sourced", "content_pages"), C("content_pages") > 0, {"content_pages": count(content), "sourced": count(content & (F.size("external_link_domains") > 0))}, status=lambda s: F.when(ratio >= limit("ok_ratio"), "ok").when(ratio >= limit("warn_ratio"), "warning").otherwise("critical")),
        Rule("geo.authors", 1.2, ("geo", "aeo"), flag("authored"), pages, {"authored": any_page(C("has_author"))}),
        Rule("geo.cross_platform", 1.0, ("geo", "aso"), F.least(F.lit(100.0), F.bit_count("platforms") / 4.0 * 100), pages, {"platforms": platforms}),
        Rule("geo.freshness", 1.0, ("geo", "aeo"), F.when(age < 90, 100.0).when(age < 365, 50.0).otherwise(0.0), age.isNotNull(), {"newest": newest(date)}),
        Rule("gso.faqpage", 1.3, ("gso",), flag("faq"), pages, {"faq": any_page(_typed("FAQPage"))}),
        Rule("gso.howto", 0.6, ("gso", "aso"), flag("howto"), pages, {"howto": any_page(_typed("HowTo"))}),
        Rule("gso.breadcrumb", 1.0, ("gso",), flag("breadcrumb"), pages, {"breadcrumb": any_page(_typed("BreadcrumbList"))}),
        Rule("gso.itemlist", 0.8, ("gso",), flag("listed"), pages, {"listed": any_page(_typed("ItemList") | (C("tables_count") > 0))}),
        Rule("gso.qa_format", 1.0, ("gso", "aeo"), flag("questions"), pages, {"questions": any_page(_typed("FAQPage") | (C("question_headings") >= 2))}),
        Rule("gso.longtail", 0.8, ("gso",), F.lit(0.0), F.lit(False)),
        Rule("aeo.author_credentials", 1.5, ("aeo",), F.when(C("credentialled"), 100.0).when(C("authored"), 50.0).otherwise(0.0), pages, {"credentialled": any_page(C("author_has_credentials"))}),
        Rule("aeo.about_page", 1.0, ("aeo",), flag("about"), pages, {"about": any_page(has(ABOUT_HINTS, haystack))}),
        Rule("aeo.defined_terms", 1.0, ("aeo",), flag("defined"), pages, {"defined": any_page(_typed("DefinedTerm") | (C("definition_lists_count") > 0))}),
        Rule("aeo.dates_structured", 1.0, ("aeo", "geo"), flag("dated"), pages, {"dated": any_page(C("has_structured_dates"))}),
        Rule("aeo.comparison_tables", 0.8, ("aeo",), flag("tabled"), pages, {"tabled": any_page(C("tables_count") > 0), "bare_comparisons": count(has(COMPARE_HINTS, C("url")) & (C("tables_count") == 0))}),
        Rule("aeo.answer_directness", 1.0, ("aeo", "gso"), of_pages("direct"), pages, {"direct": count(C("lead_paragraph_words") >= 20)}),
        Rule("aso.mcp_readiness", 1.8, ("aso",), F.when(C("tooling"), 100.0).when(C("partial_tooling"), 50.0).otherwise(0.0), pages, {"tooling": any_page(C("aso.webmcp.has_register_tool") | C("aso.webmcp.has_tool_attributes")), "partial_tooling": any_page(C("aso.webmcp.partial_signals"))}, tier="experimental"),
        Rule("aso.potential_actions", 1.6, ("aso",), F.when(C("executable"), 100.0).when(C("acting"), 50.0).otherwise(0.0), pages, {"executable": any_page(F.arrays_overlap(actions, F.array(*map(F.lit, EXECUTABLE_ACTIONS)))), "acting": any_page(F.size(actions) > 0)}, tier="experimental"),
        Rule("aso.action_schema", 1.5, ("aso", "gso"), F.when(F.bit_count("action_types") >= 2, 100.0).when(F.bit_count("action_types") == 1, 50.0).otherwise(0.0), pages, {"action_types": types}, tier="experimental"),
        Rule("aso.accessible_forms", 0.8, ("aso",), F.when(C("forms_found") == 0, 100.0).otherwise(of_pages("forms_usable", "forms_found")), pages & ((C("forms_found") > 0) | (C("forms_usable") > 0)), {"forms_found": total(found), "forms_usable": total(C("aso.agent_usable_forms"))}),
        Rule("aso.openapi", 0.8, ("aso",), flag("documented"), pages, {"documented": any_page(F.size("aso.openapi_links") > 0)}, tier="experimental"),
        Rule("aso.agent_access", 1.2, ("aso", "geo"), share(C("agent_bots_checked") - F.size("blocked_agent_bots"), C("agent_bots_checked")), C("agent_bots_checked") > 0),
    ]


def external_rules() -> list[Rule]:
    """Rules over what other services say; what is null is not measured."""
    there = lambda c: C(c).isNotNull()
    vital = lambda n: F.try_element_at(C("core_web_vitals"), F.lit(n))
    endings = {"lcp": (1.5, 2500, 4000), "cls": (1.2, 0.1, 0.25), "inp": (1.2, 200, 500)}
    rate = lambda c: clamped(C(c) * 100)
    met = lambda n: f"citation_metrics.{n}"
    ctr = F.when(C("gsc.total_impressions") > 0, rounded(C("gsc.avg_ctr") * 100))
    endpoints = F.size(F.map_filter("ai_discovery_endpoints", lambda k, v: v))
    return [
        Rule("seo.avg_position", 2.0, ("seo",), steps(C("gsc.avg_position"), (3, 100), (10, 75), (20, 50), otherwise=25), there("gsc.avg_position")),
        Rule("seo.click_through_rate", 1.5, ("seo",), F.when(ctr >= 5, 100.0).when(ctr >= 2, 75.0).when(ctr >= 0.5, 50.0).otherwise(25.0), ctr.isNotNull()),
        Rule("authority.opr", 1.0, ("seo",), clamped(C("open_page_rank") * 10), there("open_page_rank")),
        Rule("authority.backlinks", 1.0, ("seo",), F.least(F.lit(100.0), F.log10(C("referring_domains") + 1.0) * 25), there("referring_domains")),
        *(Rule(f"perf.{n}", w, ("seo", "gso"), steps(vital(n), (good, 100), (fair, 50)), vital(n).isNotNull()) for n, (w, good, fair) in endings.items()),
        Rule("perf.lighthouse", 1.0, ("seo", "gso"), rate("lighthouse_performance"), there("lighthouse_performance")),
        Rule("geo.citation_rate", 2.0, ("geo",), rate(met("citation_rate")), there("citation_metrics")),
        Rule("geo.mention_rate", 1.0, ("geo",), rate(met("mention_rate")), there("citation_metrics")),
        Rule("geo.citation_confidence", 0.8, ("geo",), rate(met("citation_confidence")), there("citation_metrics")),
        Rule("geo.knowledge_presence", 0.8, ("geo",), rate(met("knowledge_presence")), there(met("knowledge_presence"))),
        Rule("geo.share_of_voice", 1.0, ("geo",), rate(met("share_of_voice")), there(met("share_of_voice"))),
        Rule("geo.citation_position", 0.8, ("geo",), F.greatest(F.lit(0.0), 100 - (C(met("average_position")) - 1) * 20), there(met("average_position"))),
        Rule("gso.cwv_eligible", 1.2, ("gso",), F.when((vital("lcp") <= 2500) & (vital("cls") <= 0.1) & (vital("inp") <= 200), 100.0).otherwise(0.0), vital("lcp").isNotNull() & vital("cls").isNotNull() & vital("inp").isNotNull()),
        Rule("gso.ai_overview_presence", 1.5, ("gso", "geo"), rate("aio_metrics.presence_rate"), there("aio_metrics.presence_rate")),
        Rule("aeo.kg_presence", 1.5, ("aeo", "geo", "aso"), F.when(C("kg_presence"), 100.0).otherwise(0.0), there("kg_presence")),
        Rule("aeo.llm_citation", 2.0, ("aeo",), rate(met("citation_rate")), there("citation_metrics")),
        Rule("aso.ai_discovery", 1.4, ("aso",), endpoints / 4.0 * 100, there("ai_discovery_endpoints"), tier="experimental"),
        Rule("aso.nlweb", 1.0, ("aso",), F.when(C("nlweb_status") == "conformant", 100.0).when(C("nlweb_status") == "present", 50.0).otherwise(0.0), there("nlweb_status"), tier="experimental"),
        Rule("aso.brand_coherence", 1.3, ("aso", "aeo"), F.aggregate(F.map_values("brand_coherence"), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("brand_coherence"), F.lit(1)) * 100, F.coalesce(F.size("brand_coherence"), F.lit(0)) > 0),
    ]


def catalog(thresholds: dict | None = None) -> list[Rule]:
    """All rules, by key."""
    t = thresholds or {}
    rules = [*page_rules(t), *site_rules(t), *external_rules(), *(make(t) for make in _EXTRA)]
    return sorted(rules, key=lambda r: r.key)


def orphans(pages: DataFrame) -> DataFrame:
    """(audit_id, url): pages but the first by URL to which no page of the audit links; links count from anywhere."""
    edges = pages.select("audit_id", F.explode("internal_link_targets").alias("url")).distinct()
    home = pages.groupBy("audit_id").agg(F.min("url").alias("home"))
    return pages.select("audit_id", "url").join(edges, ["audit_id", "url"], "left_anti").join(home, "audit_id").where("url <> home").select("audit_id", "url")


def declared(rules: list[Rule]) -> tuple[dict[str, Fact], dict[str, Column]]:
    """All facts that rules ask for, and the columns of pages that these name."""
    return {n: f for r in rules for n, f in r.facts.items()}, {n: c for r in rules for n, c in r.inputs.items()}


def facts(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per audit with everything that rules ask of its pages."""
    asked, inputs = declared(rules)
    wide = pages.withColumns({n: c.cast("double") for n, c in inputs.items()}).groupBy("audit_id").agg(F.count("*").alias("pages"), *(f.aggregate().alias(n) for n, f in sorted(asked.items())))
    titles = pages.where(title_key().isNotNull()).groupBy("audit_id").agg(F.count("*").alias("titled"), F.count_distinct(title_key()).alias("distinct_titles"))
    lost = orphans(pages).groupBy("audit_id").agg(F.count("*").alias("orphans"))
    return wide.join(titles, "audit_id", "left").join(lost, "audit_id", "left").fillna(0, ["titled", "distinct_titles", "orphans"])


@dataclass(frozen=True)
class _Compiled:
    rules: list[Rule]
    raw: Column  # the scores of all rules in order, not rounded; null is not measured
    states: Column  # by place: statuses that don't follow from the score alone
    named: list[Column]  # of a rule's row, by its place


_COMPILED: dict[tuple, _Compiled] = {}


def _compiled(thresholds: dict, overrides: dict) -> _Compiled:
    """The columns of all rules. Building them takes thousands of calls to the JVM, so they are kept per settings."""
    context = SparkContext._active_spark_context
    key = (id(context and context._jsc), json.dumps([thresholds, overrides], sort_keys=True, default=str), tuple(map(id, _EXTRA)))
    if key not in _COMPILED:
        rules, raw, states = catalog(thresholds), [], []
        for k, r in enumerate(rules):
            measured = F.coalesce(r.measured, F.lit(False))
            raw.append(F.when(measured, clamped(r.score)))
            state = F.when(measured, r.status(rounded(clamped(r.score)))) if r.status is not status else None
            if r.applicable is not None:
                state = (F.when(F.lit(False), "") if state is None else state).when(~measured & ~F.coalesce(r.applicable, F.lit(False)), "not_applicable")
            if state is not None:
                states += [F.lit(k), state]
        quoted = lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")"
        doubles = ", ".join(f"{float(overrides.get(r.key, r.weight))!r}D" for r in rules)
        of = lambda sql, name: F.expr(f"get({sql}, place)").alias(name)
        named = [of(quoted(r.key for r in rules), "key"), of("array(" + ", ".join(quoted(r.pillars) for r in rules) + ")", "pillars"), of(f"array({doubles})", "weight"), of(quoted(r.tier for r in rules), "evidence_tier")]
        if len(_COMPILED) > 32:
            _COMPILED.clear()
        _COMPILED[key] = _Compiled(rules, F.array(*raw), F.create_map(*states) if states else F.create_map().cast("map<int,string>"), named)
    return _COMPILED[key]


def evaluate(pages: DataFrame, site: DataFrame, external: DataFrame, audited_on: Column | None = None, thresholds: dict | None = None, overrides: dict | None = None) -> DataFrame:
    """(audit_id, key, pillars, score, status, weight, evidence_tier, schema_version): all rules of every audit.

    An audit counts if any of the three tables has it. overrides: weights by rule key. audited_on: the reference date of
    freshness, over the columns of site and external; null means not measured.
    """
    return evaluate_facts(facts(pages, _compiled(thresholds or {}, overrides or {}).rules), site, external, audited_on, thresholds, overrides)


def evaluate_facts(known: DataFrame, site: DataFrame, external: DataFrame, audited_on: Column | None = None, thresholds: dict | None = None, overrides: dict | None = None) -> DataFrame:
    """`evaluate`, from a row of facts per audit: of `facts`, or of states that were kept (`states.facts_of`)."""
    made = _compiled(thresholds or {}, overrides or {})
    known = known.join(site, "audit_id", "full").join(external, "audit_id", "full").fillna(0, ["pages", "titled", "distinct_titles", "orphans"])
    known = known.withColumn("audited_on", (audited_on if audited_on is not None else F.lit(None)).cast("date"))
    each = known.select("audit_id", made.states.alias("states"), F.posexplode(made.raw).alias("place", "raw"))
    state = F.coalesce(F.try_element_at("states", C("place")), F.when(C("score").isNull(), "not_measured").otherwise(status(C("score"))))
    scored = each.select("audit_id", "states", "place", F.expr(rounded_sql("raw")).alias("score"))
    key, pillars, weight, tier = made.named
    return scored.select("audit_id", key, pillars, F.coalesce("score", F.lit(0.0)).alias("score"), state.alias("status"), weight, tier, F.lit(SIGNAL_SCHEMA_VERSION).alias("schema_version"))


def evidence(pages: DataFrame, thresholds: dict | None = None, sample: int = SAMPLE) -> DataFrame:
    """(audit_id, key, urls): per page rule the first URLs that score below 80; ranked within groups, never gathered."""
    rules = [r for r in catalog(thresholds) if r.page is not None]
    scored = pages.select("audit_id", "url", F.explode(F.array(*(F.struct(F.lit(r.key).alias("key"), r.page.cast("double").alias("score")) for r in rules))).alias("r")).select("audit_id", "url", "r.*")
    first = Window.partitionBy("audit_id", "key").orderBy("url")
    return scored.where("score < 80").withColumn("n", F.row_number().over(first)).where(C("n") <= sample).groupBy("audit_id", "key").agg(F.array_sort(F.collect_list("url")).alias("urls"))


def routes(pages: DataFrame, top: int = 12) -> DataFrame:
    """Pages by rendering and route family; families with the most client-rendered pages first."""
    counts = pages.where(C("render_mode").isin("ssr", "csr")).groupBy("audit_id", route_family(C("url")).alias("path")).agg(F.count("*").alias("pages"), F.count_if(C("render_mode") == "ssr").alias("ssr"), F.count_if(C("render_mode") == "csr").alias("csr"))
    order = Window.partitionBy("audit_id").orderBy(F.desc("csr"), F.desc("pages"), "path")
    return counts.withColumn("rank", F.row_number().over(order)).where(C("rank") <= top)


def offenders(pages: DataFrame, top: int | None = 10) -> DataFrame:
    """Client-rendered pages whose words are counted, least parity first; with top=None all, those without counts last."""
    raw, rendered = C("raw_word_count"), C("rendered_word_count")
    counted = raw.isNotNull() & rendered.isNotNull()
    parity = F.when(rendered <= 0, 1.0).otherwise(F.least(F.lit(1.0), raw / F.greatest(rendered, F.lit(1))))
    rows = pages.where(C("render_mode") == "csr").select("audit_id", "url", raw.alias("raw_words"), rendered.alias("rendered_words"), (rendered - raw).alias("delta"), F.when(counted, parity).alias("parity"))
    order = Window.partitionBy("audit_id").orderBy(F.asc_nulls_last("parity"), F.desc("delta"), "url")
    ranked = rows.where("parity is not null" if top else "true").withColumn("rank", F.row_number().over(order))
    ranked = ranked.where(C("rank") <= top) if top else ranked
    return ranked.select("audit_id", "rank", "url", "raw_words", "rendered_words", "delta", rounded(C("parity") * 100, 0).cast("int").alias("parity_pct"))


def affected(pages: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """(audit_id, key, urls): `evidence`, the first orphans and unsourced content pages, and all client-rendered pages by parity."""

    def listed(key: str, rows: DataFrame, most: int | None) -> DataFrame:
        if most:
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("audit_id").orderBy("url"))).where(C("rank") <= most)
        urls = F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda r: r["url"])
        return rows.groupBy("audit_id").agg(urls.alias("urls")).select("audit_id", F.lit(key).alias("key"), "urls")

    content = C("word_count") >= float(threshold(thresholds or {}, "geo.primary_sources", "min_content_words"))
    unsourced = pages.where(content & (F.coalesce(F.size("external_link_domains"), F.lit(0)) <= 0)).select("audit_id", "url")
    parts = [listed("links.orphans", orphans(pages), SAMPLE), listed("geo.ssr", offenders(pages, None), None), listed("geo.primary_sources", unsourced, UNSOURCED)]
    out = evidence(pages, thresholds)
    for part in parts:
        out = out.unionByName(part)
    return out
