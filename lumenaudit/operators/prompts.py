"""Theme profiles and balanced prompt sets from a site's titles and descriptions.

Everything is one plan over all audits: tokens are counted and ranked in windows, candidates come from exploding at most
twelve topics and eight entities per audit, and the balanced choice is two rankings and a filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, mentioned, rounded
from ..functions.urls import registrable_domain

C = F.col
TOPICS, ENTITIES, TARGET = 12, 8, 15
# Share of the set and base quality per intent, in order; stop words; what types say of the content.
INTENTS = {
    "recommendation": (0.25, 0.85),
    "comparative": (0.25, 0.85),
    "listing": (0.15, 0.80),
    "definitional": (0.12, 0.55),
    "use_case": (0.10, 0.60),
    "explanatory": (0.08, 0.50),
    "news": (0.05, 0.60),
}
STOP_WORDS = (
    "and",
    "are",
    "aux",
    "avec",
    "avoir",
    "can",
    "celle",
    "celui",
    "cette",
    "chez",
    "comme",
    "dans",
    "des",
    "deux",
    "elle",
    "entre",
    "etre",
    "fait",
    "for",
    "from",
    "les",
    "leur",
    "leurs",
    "notre",
    "nous",
    "our",
    "plus",
    "pour",
    "sans",
    "sont",
    "sur",
    "that",
    "the",
    "this",
    "tous",
    "tout",
    "toute",
    "une",
    "votre",
    "vous",
    "was",
    "will",
    "with",
    "you",
    "your",
)
CONTENT = {
    "ecommerce": ("AggregateOffer", "Offer", "Product"),
    "software": ("SoftwareApplication", "WebApplication"),
    "editorial": ("Article", "BlogPosting", "NewsArticle"),
    "knowledge_base": ("DefinedTerm", "FAQPage", "HowTo"),
}
# What a topic's word and an entity are.
TOPIC = "[a-zà-ÿ0-9]+"
ENTITY = r"[A-ZÀ-Ý][A-Za-zà-ÿ0-9-]+(?:\s+[A-ZÀ-Ý][A-Za-zà-ÿ0-9-]+)*"
#: Wording of a prompt by intent; {x} is a topic, {x} and {y} two subjects.
WORDING = {
    "definitional": "What does {x} mean?",
    "recommendation": "Which {x} would you recommend?",
    "explanatory": "How does {x} work?",
    "listing": "Who offers {x}?",
    "use_case": "When is {x} useful?",
    "news": "What is new in {x}?",
    "comparative": "{x} or {y}?",
}
SEPARATORS = ("|", "—", "–", "·", ":", "-")


def brands(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """(audit_id, domain, brand, label, words): brand from the first page by URL (site name, else the title's first
    part), the domain's first label, and the folded words of both. domains(audit_id, domain)."""
    home = pages.groupBy("audit_id").agg(F.min_by(F.struct(F.try_element_at(C("open_graph"), F.lit("og:site_name")).alias("site"), "title"), "url").alias("h"))
    title = C("h.title")
    first = reduce(lambda c, s: c.when(title.contains(s) & (F.trim(F.substring_index(title, s, 1)) != ""), F.trim(F.substring_index(title, s, 1))), SEPARATORS, F.when(F.lit(False), ""))
    brand = F.coalesce(F.nullif(F.trim(C("h.site")), F.lit("")), F.when(title != "", F.coalesce(first, F.trim(title))))
    named = domains.join(home, "audit_id", "left").select("audit_id", "domain", brand.alias("brand"), F.split(F.coalesce(registrable_domain(C("domain")), F.lit("")), r"\.")[0].alias("label"))
    words = F.array_distinct(F.filter(F.split(fold(F.concat_ws(" ", "brand", "label")), r"(?U)[\s\-_]+"), lambda w: w != ""))
    return named.withColumn("words", words)


def _texts(pages: DataFrame) -> DataFrame:
    tag = lambda k: F.try_element_at(C("open_graph"), F.lit(k))
    every = F.array("title", "meta_description", tag("og:title"), tag("og:description"))
    return pages.select("audit_id", F.explode(F.transform(F.filter(every, lambda t: F.trim(t) != ""), lambda t: F.trim(t))).alias("text"))


def _top(terms: DataFrame, n: int) -> DataFrame:
    """The most frequent terms of each audit, ties by term."""
    counts = terms.groupBy("audit_id", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("audit_id").orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(C("rank") <= n)


def topics(pages: DataFrame, known: DataFrame, top: int = TOPICS) -> DataFrame:
    """(audit_id, term, n, rank): words of four letters or more that are no stop word and not of the brand."""
    words = _texts(pages).select("audit_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TOPIC), F.lit(0))).alias("term")).where((F.length("term") >= 4) & ~C("term").isin(*STOP_WORDS))
    # Counted before the brand filter, so that folding, the one Python step, sees each term once.
    counted = words.groupBy("audit_id", "term").agg(F.count("*").alias("n"))
    fair = counted.withColumn("f", fold(C("term"))).join(known.select("audit_id", "words"), "audit_id", "left").where(~F.coalesce(F.array_contains("words", C("f")), F.lit(False)))
    order = Window.partitionBy("audit_id").orderBy(F.desc("n"), "term")
    return fair.withColumn("rank", F.row_number().over(order)).where(C("rank") <= top).select("audit_id", "term", "n", "rank")


def entities(pages: DataFrame, known: DataFrame, top: int = ENTITIES) -> DataFrame:
    """(audit_id, term, n, rank): runs of capitalised words that share no word with the brand."""
    found = _texts(pages).select("audit_id", F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("term")).where(F.length("term") >= 3)
    counted = found.groupBy("audit_id", "term").agg(F.count("*").alias("n")).withColumn("f", F.split(fold(C("term")), r"(?U)\s+"))
    fair = counted.join(known.select("audit_id", "words"), "audit_id", "left").where(~F.coalesce(F.arrays_overlap("words", "f"), F.lit(False)))
    order = Window.partitionBy("audit_id").orderBy(F.desc("n"), "term")
    return fair.withColumn("rank", F.row_number().over(order)).where(C("rank") <= top).select("audit_id", "term", "n", "rank")


def content_types(pages: DataFrame) -> DataFrame:
    """(audit_id, content_type) by the structured data of all pages; the first kind that matches."""
    has = {k: F.bool_or(F.arrays_overlap("structured_data_types", F.array(*map(F.lit, v)))).alias(k) for k, v in CONTENT.items()}
    flags = pages.groupBy("audit_id").agg(*has.values())
    kind = reduce(lambda c, k: c.when(C(k), k), list(CONTENT)[1:], F.when(C(next(iter(CONTENT))), next(iter(CONTENT)))).otherwise("general")
    return flags.select("audit_id", kind.alias("content_type"))


def _worded(intent: str, x: Column, y: Column | None = None) -> Column:
    out = F.lit(WORDING[intent])
    out = F.replace(out, F.lit("{x}"), x)
    return out if y is None else F.replace(out, F.lit("{y}"), y)


def candidates(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """(audit_id, intent, text, quality): a prompt per topic and intent and per pair of entities (topics, if there are
    under two), without repeats and without any that names the brand or the domain."""
    known = brands(pages, domains)
    t, e = topics(pages, known), entities(pages, known)
    single = [i for i in WORDING if i != "comparative"]
    made = t.select("audit_id", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(i).alias("intent"), _worded(i, C("term")).alias("text"), C("term").alias("slot")) for k, i in enumerate(single)))).alias("p"), "rank", F.lit(0).alias("other"))
    enough = e.groupBy("audit_id").agg(F.count("*").alias("m")).where("m >= 2").select("audit_id")
    subjects = e.join(enough, "audit_id", "left_semi").unionByName(t.join(enough, "audit_id", "left_anti"))
    # At most twelve subjects per audit, so their pairs are few; a collected list keeps it to one row per audit.
    per = subjects.groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("s"))
    pairs = per.select("audit_id", F.explode("s").alias("a"), "s").select("audit_id", "a", F.explode(F.filter("s", lambda b: b["rank"] > C("a.rank"))).alias("b"))
    compared = pairs.select("audit_id", F.struct(F.lit(len(single)).alias("step"), F.lit("comparative").alias("intent"), _worded("comparative", C("a.term"), C("b.term")).alias("text"), F.concat_ws(" ", "a.term", "b.term").alias("slot")).alias("p"), C("a.rank").alias("rank"), C("b.rank").alias("other"))
    every = made.unionByName(compared).select("audit_id", "p.*", "rank", "other").withColumn("f", fold(C("text")))
    first = Window.partitionBy("audit_id", "f").orderBy("step", "rank", "other")
    unbiased = every.withColumn("n", F.row_number().over(first)).where("n = 1").join(known.select("audit_id", fold(C("brand")).alias("brand"), "label"), "audit_id", "left").where(~mentioned(C("f"), C("brand")) & ~mentioned(C("f"), C("label")))
    base = F.element_at(F.create_map(*(F.lit(x) for i, (_, q) in INTENTS.items() for x in (i, q))), C("intent"))
    return unbiased.select("audit_id", "intent", "text", rounded(F.least(F.lit(1.0), base + F.when(F.trim("slot").contains(" "), 0.1).otherwise(0.0)), 4).alias("quality"))


def balanced(pool: DataFrame, target: int = TARGET) -> DataFrame:
    """(audit_id, place, intent, text, quality): each intent's share of the set, best first; what is missing comes from
    the best of the rest, and what is too much goes, worst first. In order of intent, quality and text."""
    quota = F.element_at(F.create_map(*(F.lit(x) for i, (s, _) in INTENTS.items() for x in (i, round(s * target)))), C("intent"))
    order = F.element_at(F.create_map(*(F.lit(x) for k, i in enumerate(INTENTS) for x in (i, k))), C("intent"))
    within = Window.partitionBy("audit_id", "intent").orderBy(F.desc("quality"), "text")
    chosen = pool.withColumn("spare", (F.row_number().over(within) > quota).cast("int")).withColumn("n", F.row_number().over(Window.partitionBy("audit_id").orderBy("spare", F.desc("quality"), "text")))
    placed = Window.partitionBy("audit_id").orderBy(order, F.desc("quality"), "text")
    return chosen.where(C("n") <= target).withColumn("place", F.row_number().over(placed)).select("audit_id", "place", "intent", "text", "quality")


def prompt_set(pages: DataFrame, domains: DataFrame, target: int = TARGET) -> DataFrame:
    return balanced(candidates(pages, domains), target)


#: A set for a site of which only the name is known: intent, quality and wording; {d} is the domain, {b} the brand.
MINIMAL = (
    ("definitional", 0.8, "What does {d} do?"),
    ("definitional", 0.7, "Who is behind {b}?"),
    ("recommendation", 0.7, "Would you recommend {b}?"),
    ("explanatory", 0.7, "How is {b} used?"),
    ("comparative", 0.6, "What could one use instead of {b}?"),
)


def minimal_set(domains: DataFrame) -> DataFrame:
    """(audit_id, place, intent, text, quality) from domains(audit_id, domain, brand); a null or empty brand is the domain."""
    brand = F.coalesce(F.nullif(F.trim("brand"), F.lit("")), "domain")
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("place"), F.lit(i).alias("intent"), F.replace(F.replace(F.lit(t), F.lit("{d}"), C("domain")), F.lit("{b}"), brand).alias("text"), F.lit(q).alias("quality")) for k, (i, q, t) in enumerate(MINIMAL))))
    return domains.select("audit_id", each.alias("p")).select("audit_id", "p.*")
