"""Citations of a site in answers of language models: metrics per audit and engine, tracking cells, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, mentioned, rounded, steady_sum
from ..functions.urls import registrable_domain

C = F.col
# Fixed values, in US dollars: per million tokens in and out, and per call.
PRICES = {"anthropic": (0.80, 4.0, 0.01), "gemini": (0.075, 0.30, 0.0), "openai": (0.15, 0.60, 0.01), "perplexity": (1.0, 1.0, 0.005)}
TOKENS_IN, TOKENS_OUT = 40, 400
DATAFORSEO_CALL, DATAFORSEO_CALLS, SERP_PROBE, SERP_PROBES = 0.01, 2, 0.015, 3


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(rounded(F.try_divide(part.cast("double"), whole), 4), F.lit(0.0))


def prepared(responses: DataFrame, targets: DataFrame) -> DataFrame:
    """responses with what the metrics ask of each: cited, best position, brand mention, hits of target and rivals.

    targets(audit_id, domain, brand, competitors). A citation counts by its domain field, or its URL if that is blank;
    the brand is by default the first label of the domain.
    """
    target = registrable_domain(C("domain"))
    known = targets.select("audit_id", target.alias("__target"), fold(F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.split(target, r"\.")[0])).alias("__brand"), F.transform(F.coalesce("competitors", F.array().cast("array<string>")), registrable_domain).alias("__rivals"))
    cites = F.transform(F.coalesce("citations", F.array().cast("array<struct<url:string,domain:string,title:string,position:int>>")), lambda c: F.struct(registrable_domain(F.coalesce(F.nullif(F.trim(c["domain"]), F.lit("")), c["url"])).alias("d"), c["position"].alias("p")))
    return (
        responses.join(known, "audit_id")
        .withColumn("__cites", cites)
        .withColumn("__own", F.filter("__cites", lambda c: c["d"] == C("__target")))
        .withColumn("cited", F.size("__own") > 0)
        .withColumn("best", F.array_min(F.transform("__own", lambda c: c["p"])))
        .withColumn("hits", F.size("__own"))
        .withColumn("rival_hits", F.size(F.filter("__cites", lambda c: (c["d"] != C("__target")) & F.array_contains("__rivals", c["d"]))))
        .withColumn("mentioned", mentioned(fold(C("response_text")), C("__brand")))
        .drop("__cites", "__own", "__target", "__brand", "__rivals")
    )


def metrics(ready: DataFrame) -> DataFrame:
    """Metrics over all engines (engine null) and per engine of each audit, from `prepared` responses.

    Two levels: (audit, prompt, engine) first, whose sums roll up to GROUPING SETS ((audit), (audit, engine)).
    """
    web = C("web_search_enabled")
    cells = ready.groupBy("audit_id", "engine", "prompt_id").agg(
        F.count("*").alias("n"),
        F.count_if(web).alias("retrieval"),
        F.count_if(web & C("cited")).alias("cited"),
        F.count_if("mentioned").alias("mentions"),
        F.count_if(~web & C("mentioned")).alias("known"),
        F.sum(F.when(web, C("hits")).otherwise(0)).alias("hits"),
        F.sum(F.when(web, C("rival_hits")).otherwise(0)).alias("rivals"),
        F.sum(F.when(web, C("best"))).alias("positions"),
        F.count(F.when(web, C("best"))).alias("placed"),
    )
    sums = cells.groupingSets([[C("audit_id")], [C("audit_id"), C("engine")]], "audit_id", "engine").agg(
        *(F.sum(c).alias(c) for c in ("n", "retrieval", "cited", "mentions", "known", "hits", "rivals", "positions", "placed")),
        steady_sum(F.when(C("cited") > 0, C("cited") / C("retrieval"))).alias("confidence"),
        F.count_if(C("cited") > 0).alias("confident"),
        F.max("n").alias("repetitions"),
        F.count_distinct("prompt_id").alias("prompts"),
    )
    closed = C("n") - C("retrieval")
    return sums.select(
        "audit_id",
        "engine",
        C("n").alias("responses"),
        _rate(C("cited"), C("retrieval")).alias("citation_rate"),
        _rate(C("mentions"), C("n")).alias("mention_rate"),
        F.when(closed > 0, _rate(C("known"), closed)).alias("knowledge_presence"),
        F.coalesce(rounded(F.try_divide(C("confidence"), C("confident")), 4), F.lit(0.0)).alias("citation_confidence"),
        rounded(F.try_divide(C("hits").cast("double"), C("hits") + C("rivals")), 4).alias("share_of_voice"),
        rounded(F.try_divide(C("positions").cast("double"), C("placed")), 2).alias("average_position"),
        "repetitions",
        "prompts",
    )


def citation_metrics(responses: DataFrame, targets: DataFrame) -> DataFrame:
    return metrics(prepared(responses, targets))


def cells(prompts: DataFrame, engines: list[str], repetitions: int) -> DataFrame:
    """Every (prompt, engine, repetition) that a tracking run asks: prompts times a handful, by explode."""
    return prompts.withColumn("engine", F.explode(F.array(*map(F.lit, engines)))).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


def answered(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """The cells that got an answer; failed ones drop out."""
    return responses.join(asked.select("audit_id", "prompt_id", "engine", "repetition"), ["audit_id", "prompt_id", "engine", "repetition"], "left_semi")


def tracking(prompts: DataFrame, engines: list[str], repetitions: int, responses: DataFrame, targets: DataFrame) -> DataFrame:
    """Citation metrics of a tracking run: what its cells got for an answer; an audit whose every cell failed has no row."""
    return citation_metrics(answered(cells(prompts, engines, repetitions), responses), targets)


def dry_runs(prompts: DataFrame, engines: list[str], repetitions: int) -> DataFrame:
    """(audit_id, prompt_count, call_volume, total_usd): what a run would ask and cost, without asking; prompts(audit_id, text)."""
    counts = prompts.groupBy("audit_id").agg(F.count("*").alias("prompt_count"))
    runs = counts.select(C("audit_id").alias("run_id"), F.array(*map(F.lit, engines)).cast("array<string>").alias("engines"), C("prompt_count").alias("prompts"), F.lit(repetitions).alias("repetitions"))
    return counts.join(run_costs(runs).select(C("run_id").alias("audit_id"), C("calls").alias("call_volume"), "total_usd"), "audit_id")


def run_costs(runs: DataFrame, prices: dict[str, tuple[float, float, float]] = PRICES, tokens_in: int = TOKENS_IN, tokens_out: int = TOKENS_OUT) -> DataFrame:
    """runs(run_id, engines, prompts, repetitions): calls and cost; an engine without a price costs nothing, but calls."""
    unit = F.create_map(*(F.lit(x) for e, (i, o, f) in sorted(prices.items()) for x in (e, float(tokens_in / 1e6 * i + tokens_out / 1e6 * o + f))))
    each = C("prompts") * C("repetitions")
    cost = F.transform("engines", lambda e: F.coalesce(F.try_element_at(unit, e), F.lit(0.0)) * each)
    return runs.select("run_id", (each * F.size("engines")).cast("long").alias("calls"), rounded(F.aggregate(cost, F.lit(0.0), lambda a, x: a + x), 4).alias("total_usd"))


def audit_costs(settings: DataFrame) -> DataFrame:
    """settings(audit_id, connector): a line per paid or free connector that is on, and its worst-case cost."""
    calls = F.when(C("connector") == "dataforseo", DATAFORSEO_CALLS).when(C("connector") == "serpapi", SERP_PROBES).when(C("connector") == "llm_citation", 0).otherwise(1)
    unit = F.when(C("connector") == "dataforseo", DATAFORSEO_CALL).when(C("connector") == "serpapi", SERP_PROBE).otherwise(0.0)
    return settings.distinct().select("audit_id", "connector", calls.alias("calls"), unit.alias("unit_usd"), rounded(calls * unit, 4).alias("total_usd"))
