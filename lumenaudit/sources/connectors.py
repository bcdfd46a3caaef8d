"""Payloads of other services (JSON strings) to external signals, as column expressions.

Fetching is out of the engine: payloads are a table. A malformed payload, or one without the value, gives null, which
the rules report as not measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded, steady_sum
from ..functions.urls import host

C = F.col
#: Positions are summed in integers of this part.
POSITION_UNITS = float(1 << 30)


def _json(payload: Column, ddl: str) -> Column:
    return F.from_json(payload, ddl, {"mode": "PERMISSIVE"})


def page_speed(payload: Column) -> Column:
    """Struct (core_web_vitals, lighthouse_performance); the layout shift percentile is in hundredths."""
    m = "struct<percentile:double>"
    p = _json(payload, f"loadingExperience struct<metrics:struct<LARGEST_CONTENTFUL_PAINT_MS:{m},CUMULATIVE_LAYOUT_SHIFT_SCORE:{m},INTERACTION_TO_NEXT_PAINT:{m}>>, lighthouseResult struct<categories:struct<performance:struct<score:double>>>")
    metrics = p["loadingExperience"]["metrics"]
    pairs = [("lcp", metrics["LARGEST_CONTENTFUL_PAINT_MS"]["percentile"]), ("cls", rounded(metrics["CUMULATIVE_LAYOUT_SHIFT_SCORE"]["percentile"] / 100, 4)), ("inp", metrics["INTERACTION_TO_NEXT_PAINT"]["percentile"])]
    vitals = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs)), lambda e: e["value"].isNotNull()))
    return F.struct(F.when(F.size(vitals) > 0, vitals).alias("core_web_vitals"), p["lighthouseResult"]["categories"]["performance"]["score"].alias("lighthouse_performance"))


def open_page_rank(payload: Column) -> Column:
    first = F.get(_json(payload, "response array<struct<status_code:int,page_rank_decimal:double>>")["response"], F.lit(0))
    return F.when(first["status_code"] == 200, first["page_rank_decimal"])


def authority(analytics: Column, labs: Column) -> Column:
    """On a scale of 10: the domain's rank over 100, else from its estimated traffic. A labs payload that can't be read
    counts as no traffic; one that is absent (null) as no answer."""
    rank = F.get(F.get(_json(analytics, "tasks array<struct<result:array<struct<domain_rank:double>>>>")["tasks"], F.lit(0))["result"], F.lit(0))["domain_rank"]
    organic = F.get(F.get(F.get(_json(labs, "tasks array<struct<result:array<struct<items:array<struct<metrics:struct<organic:struct<etv:double,count:bigint>>>>>>>>")["tasks"], F.lit(0))["result"], F.lit(0))["items"], F.lit(0))["metrics"]["organic"]
    traffic = F.when(labs.isNotNull(), F.coalesce(organic["etv"], F.lit(0.0)))
    capped = lambda c: F.when(c.isNotNull(), rounded(F.least(F.lit(10.0), c)))  # noqa: E731  least() passes over nulls
    return F.coalesce(capped(F.floor(rank) / 100), capped(F.log10(traffic + 1) * 2.5))


def entity(payload: Column) -> Column:
    """Struct (id, label, description) of the first hit of an entity search, null without one."""
    first = F.get(_json(payload, "search array<struct<id:string,label:string,description:string>>")["search"], F.lit(0))
    return F.when(F.coalesce(first["id"], F.lit("")) != "", first)


def brand_coherence(name: Column, description: Column, label: Column, about: Column) -> Column:
    """Map name and description to 1 or 0: half of the shorter name's words are shared; a tenth of all description words."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    n, m, d, e = tokens(name), tokens(label), tokens(description), tokens(about)
    named = shared(n, m) / F.greatest(F.least(F.size(n), F.size(m)), F.lit(1)) >= 0.5
    described = shared(d, e) / F.greatest(F.size(F.array_union(d, e)), F.lit(1)) >= 0.1
    return F.create_map(F.lit("name"), named.cast("double"), F.lit("description"), described.cast("double"))


def _long(c: Column, least: int) -> Column:
    return F.coalesce(F.length(F.trim(c)) >= least, F.lit(False))


def valid_summary(payload: Column) -> Column:
    p = _json(payload, "name string, description string")
    return _long(p["name"], 3) & _long(p["description"], 20)


def valid_service(payload: Column) -> Column:
    p = _json(payload, "name string, capabilities array<string>")
    return _long(p["name"], 3) & F.coalesce(F.size(p["capabilities"]) > 0, F.lit(False))


def valid_faq(payload: Column) -> Column:
    """A list, or one under `faq` or `questions`, whose every item has a question and an answer of some length."""
    item = "struct<question:string,q:string,answer:string,a:string>"
    p = _json(payload, f"faq array<{item}>, questions array<{item}>")
    # An object read as a list would be a list of one.
    items = F.coalesce(F.when(payload.rlike(r"^\s*\["), _json(payload, f"array<{item}>")), F.when(F.size(p["faq"]) > 0, p["faq"]).otherwise(p["questions"]))
    said = lambda i, a, b: F.coalesce(F.nullif(i[a], F.lit("")), i[b])
    fine = F.forall(items, lambda i: _long(said(i, "question", "q"), 10) & _long(said(i, "answer", "a"), 20))
    return F.coalesce((F.size(items) > 0) & fine, F.lit(False))


def nlweb(status: Column, payload: Column) -> Column:
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    return F.when(F.coalesce(status, F.lit(0)) != 200, "absent").when(F.array_contains(keys, "@context") | F.array_contains(keys, "results"), "conformant").otherwise("present")


def probe_queries(domain: Column, brand: Column) -> Column:
    """Three searches: the name, what it is, and reviews of it. By default the name is the domain without its end."""
    bare = F.regexp_replace(domain, r"^www\.", "")
    b = F.coalesce(F.nullif(brand, F.lit("")), F.regexp_replace(bare, r"\.[^.]*$", ""))
    return F.array(b, F.concat(F.lit("what is "), b), F.concat(b, F.lit(" review")))


def serp(rows: DataFrame) -> DataFrame:
    """rows(audit_id, query, target_domain, payload): per search whether there is an overview, whether it names the
    target (its domain equal to or containing it), and at which ordinal of the payload's list."""
    ref = "struct<link:string,url:string,title:string>"
    p = _json(C("payload"), f"ai_overview struct<text:string,references:array<{ref}>,sources:array<{ref}>>")["ai_overview"]
    raw = F.when(F.size(p["references"]) > 0, p["references"]).otherwise(F.coalesce(p["sources"], F.array().cast(f"array<{ref}>")))
    linked = F.transform(raw, lambda r, i: F.struct(F.coalesce(F.nullif(r["link"], F.lit("")), r["url"]).alias("url"), r["title"].alias("title"), (i + 1).alias("position")))
    sources = F.transform(F.filter(linked, lambda s: F.coalesce(s["url"], F.lit("")) != ""), lambda s: F.struct(s["url"].alias("url"), F.regexp_replace(host(s["url"]), r"^www\.", "").alias("domain"), s["title"].alias("title"), s["position"].alias("position")))
    named = F.get(F.filter("sources", lambda s: s["domain"].contains(C("target_domain"))), F.lit(0))
    triggered = F.coalesce(F.get_json_object("payload", "$.ai_overview").rlike(r"^\{.*[^{}\s].*\}$"), F.lit(False))
    return rows.select("audit_id", "query", "target_domain", triggered.alias("triggered"), F.when(triggered, sources).alias("sources")).withColumn("position", named["position"]).withColumn("cited", C("position").isNotNull())


def serp_metrics(searches: DataFrame) -> DataFrame:
    """Per audit: shares of searches that name the target and that have an overview, mean position where named."""
    return searches.groupBy("audit_id").agg(F.avg(C("cited").cast("double")).alias("presence_rate"), F.avg(C("triggered").cast("double")).alias("trigger_rate"), F.avg("position").alias("avg_position"), F.count("*").cast("int").alias("query_count"))


def search_rows(payloads: DataFrame) -> DataFrame:
    """payloads(audit_id, period, dimension, payload) to one row per entry (schema.GSC_ROW); key is null where absent."""
    rows = F.explode(_json(C("payload"), "rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>")["rows"])
    n = lambda c: F.coalesce(C(f"r.{c}"), F.lit(0.0))
    return payloads.select("audit_id", "period", "dimension", rows.alias("r")).select("audit_id", "period", "dimension", F.get("r.keys", F.lit(0)).alias("key"), n("clicks").cast("bigint").alias("clicks"), n("impressions").cast("bigint").alias("impressions"), n("ctr").alias("ctr"), n("position").alias("position"))


def search_entries(rows: DataFrame, dimension: str) -> DataFrame:
    """Entries of the current period, rounded; queries by position, pages by clicks and then position."""
    own = rows.where((C("period") == "current") & (C("dimension") == dimension) & C("key").isNotNull())
    out = own.select("audit_id", "key", "clicks", "impressions", rounded(C("ctr"), 4).alias("ctr"), rounded(C("position"), 1).alias("position"))
    return out.orderBy("audit_id", *(["position"] if dimension == "query" else [F.desc("clicks"), "position"]), "key")


def search_totals(rows: DataFrame) -> DataFrame:
    """Per audit and period, over queries. The current period counts rows with keys and means rounded positions, the
    earlier one counts all rows and means positions as they are."""
    now, keyed = C("period") == "current", C("key").isNotNull()
    counted = rows.where((C("dimension") == "query") & (~now | keyed))
    sums = counted.groupBy("audit_id", "period").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), steady_sum(F.when(keyed, F.when(now, rounded(C("position"), 1)).otherwise(C("position"))), POSITION_UNITS).alias("p"), F.count_if(keyed).alias("n"))
    return sums.select("audit_id", "period", "clicks", "impressions", F.coalesce(rounded(F.try_divide(C("clicks").cast("double"), C("impressions")), 4), F.lit(0.0)).alias("ctr"), rounded(F.try_divide("p", "n"), 1).alias("avg_position"))


def search_comparison(rows: DataFrame) -> DataFrame:
    """Per audit: both periods and current minus previous; a smaller position is better."""
    totals = search_totals(rows)
    side = lambda p, a: totals.where(C("period") == p).select("audit_id", *(C(c).alias(f"{a}_{c}") for c in ("clicks", "impressions", "ctr", "avg_position")))
    both = side("current", "current").join(side("previous", "previous"), "audit_id", "left").fillna(0, ["previous_clicks", "previous_impressions", "previous_ctr"])
    delta = lambda c, d: rounded(C(f"current_{c}") - C(f"previous_{c}"), d)
    return both.select("*", delta("clicks", 0).cast("bigint").alias("clicks_delta"), delta("impressions", 0).cast("bigint").alias("impressions_delta"), delta("ctr", 4).alias("ctr_delta"), delta("avg_position", 1).alias("position_delta"))


# Shortest and longest window of rank tracking, in days.
WINDOW_DAYS = (1, 480)


def search_windows(days: DataFrame, until: Column, n: int = 90, dimension: str = "query") -> DataFrame:
    """days(audit_id, day, key, clicks, impressions, position), a row per day and key, to schema.GSC_ROW: the n days up
    to `until` as the current period and the n days before them as the previous one, whose last day is the current
    period's first. A key's position is the mean over impressions."""
    if not WINDOW_DAYS[0] <= n <= WINDOW_DAYS[1]:
        raise ValueError(f"a window has {WINDOW_DAYS[0]} to {WINDOW_DAYS[1]} days")
    ends = {"current": until.cast("date"), "previous": F.date_sub(until, n)}
    inside = F.filter(F.array(*(F.when(C("day").cast("date").between(F.date_sub(e, n), e), F.lit(p)) for p, e in ends.items())), lambda p: p.isNotNull())
    sums = days.withColumn("period", F.explode(inside)).groupBy("audit_id", "period", "key").agg(F.sum("clicks").cast("bigint").alias("clicks"), F.sum("impressions").cast("bigint").alias("impressions"), steady_sum(C("position"), POSITION_UNITS, C("impressions")).alias("p"), steady_sum(C("position"), POSITION_UNITS).alias("plain"), F.count("position").alias("n"))
    position = F.coalesce(F.try_divide("p", "impressions"), F.try_divide("plain", "n"), F.lit(0.0))
    return sums.select("audit_id", "period", F.lit(dimension).alias("dimension"), "key", "clicks", "impressions", F.coalesce(F.try_divide(C("clicks").cast("double"), C("impressions")), F.lit(0.0)).alias("ctr"), position.alias("position"))


def answers(payloads: DataFrame) -> DataFrame:
    """payloads(audit_id, engine, prompt_id, repetition, web_search_enabled, payload) of four engines to
    schema.LLM_RESPONSE. A citation's position is its ordinal in the payload."""
    cite = "struct<url:string,title:string>"
    p = _json(
        C("payload"),
        f"model string, citations array<string>, search_results array<{cite}>, choices array<struct<message:struct<content:string,annotations:array<struct<url_citation:{cite}>>>>>,"
        f"content array<struct<type:string,text:string,citations:array<{cite}>>>, modelVersion string,"
        "candidates array<struct<content:struct<parts:array<struct<text:string>>>,groundingMetadata:struct<groundingChunks:array<struct<web:struct<uri:string,title:string>>>>>>",
    )
    message = F.get(p["choices"], F.lit(0))["message"]
    candidate = F.get(p["candidates"], F.lit(0))
    blocks = F.coalesce(p["content"], F.array().cast(f"array<struct<type:string,text:string,citations:array<{cite}>>>"))
    none = F.array().cast(f"array<{cite}>")
    text = F.when(C("engine") == "anthropic", F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")).when(C("engine") == "gemini", F.array_join(F.transform(candidate["content"]["parts"], lambda x: x["text"]), "")).otherwise(message["content"])
    pairs = (
        F.when(C("engine") == "openai", F.transform(message["annotations"], lambda a: a["url_citation"]))
        .when(C("engine") == "anthropic", F.flatten(F.transform(blocks, lambda b: F.coalesce(b["citations"], none))))
        .when(C("engine") == "gemini", F.transform(candidate["groundingMetadata"]["groundingChunks"], lambda g: F.struct(g["web"]["uri"].alias("url"), g["web"]["title"].alias("title"))))
        .otherwise(F.when(F.size(p["search_results"]) > 0, p["search_results"]).otherwise(F.transform(p["citations"], lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("title")))))
    )
    numbered = F.transform(F.coalesce(pairs, none), lambda c, i: F.struct(c["url"].alias("url"), host(c["url"]).alias("domain"), c["title"].alias("title"), (i + 1).alias("position")))
    return payloads.select("audit_id", "engine", F.coalesce(p["model"], p["modelVersion"]).alias("model"), "prompt_id", "repetition", F.coalesce(text, F.lit("")).alias("response_text"), "web_search_enabled", F.filter(numbered, lambda c: F.coalesce(c["url"], F.lit("")) != "").alias("citations"))
