"""robots.txt files as a table of rules, and URLs judged by joins with it.

A file becomes rows of (agent, rule); a URL meets only rules whose text up to the first wildcard begins its path: its path
is cut at the lengths that such beginnings have on its site, and these pieces are joined by equality. So a file is parsed
once however many URLs its site has, no file travels with a URL, and all of it is native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: What ends a line.
ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# A fixed value: characters of a path that stand for themselves.
SAFE = r"A-Za-z0-9/*?=&%:@!$'()+,;~\-._"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def canonical(path: Column) -> Column:
    """A path in which a character is escaped if it must be, and only then."""
    tokens = F.regexp_extract_all(path, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    escaped = lambda t: F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1")
    decoded = lambda t: F.decode(F.unhex(F.substr(t, F.lit(2))), "ISO-8859-1")
    one = lambda t: F.when(F.length(t) == 3, F.when(decoded(t).rlike(f"^[{SAFE}]$"), decoded(t)).otherwise(F.upper(t))).when(t.rlike(f"^[{SAFE}]$"), t).otherwise(escaped(t))
    return F.when(path.rlike(f"^[{SAFE.replace('%', '')}]*$"), path).otherwise(F.array_join(F.transform(tokens, one), ""))


def target(url: Column) -> Column:
    """What rules are held against: the path, `/` if it is empty, and the query."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]+)", 1)
    return F.concat(canonical(F.when(path == "", F.lit("/")).otherwise(path)), query)


def lines(sites: DataFrame) -> DataFrame:
    """(audit_id, place, name, value) of every line of sites(audit_id, robots_txt), without comments; null files have none."""
    each = sites.where("robots_txt is not null").select("audit_id", F.posexplode(F.split("robots_txt", ENDS)).alias("place", "line"))
    bare = F.regexp_extract("line", "^([^#]*)", 1)
    return each.select("audit_id", "place", F.lower(_stripped(F.regexp_extract(bare, "(?s)^([^:]*)", 1))).alias("name"), _stripped(F.regexp_extract(bare, "(?s)^[^:]*:(.*)$", 1)).alias("value"))


def rules(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """agents(audit_id, agent) that a file names, and rules(audit_id, agent, place, allow, rule, delay) of each.

    Lines of agents that follow each other share what comes below; what an agent has in several places adds up. A rule is
    an allow or disallow line that isn't empty, or a delay (its seconds).
    """
    own = lines(sites).where(C("name").isin("user-agent", "allow", "disallow", "crawl-delay")).withColumn("is_agent", C("name") == "user-agent")
    order = Window.partitionBy("audit_id").orderBy("place")  # one file, which is short
    begins = (C("is_agent") & ~F.coalesce(F.lag("is_agent").over(order), F.lit(False))).cast("int")
    grouped = own.withColumn("begins", begins).withColumn("g", F.sum("begins").over(order))
    named = grouped.where("is_agent").select("audit_id", "g", F.lower("value").alias("agent")).distinct()
    said = grouped.where("not is_agent").select("audit_id", "g", "place", (C("name") == "allow").alias("allow"), F.when(C("name") != "crawl-delay", F.nullif("value", F.lit(""))).alias("rule"), F.when((C("name") == "crawl-delay") & C("value").rlike(r"^\d+(\.\d+)?$"), C("value").cast("double")).alias("delay"))
    found = named.join(said.where("rule is not null or delay is not null"), ["audit_id", "g"]).drop("g")
    return named.select("audit_id", "agent").distinct(), found.select("audit_id", "agent", "place", "allow", "rule", "delay")


def groups(sites: DataFrame, agents: DataFrame, asked: list[str]) -> DataFrame:
    """(audit_id, asked, agent): the agent of the file whose rules hold for each that is asked for: the longest that its
    name begins with, up to a mark, else `*`."""
    every = sites.select("audit_id").distinct().select("audit_id", F.explode(F.array(*map(F.lit, asked))).alias("asked"))
    bot, name = F.lower("asked"), C("agent")
    fits = (name != "") & (name != "*") & F.startswith(bot, name) & ~F.substr(bot, F.length(name) + 1, F.lit(1)).rlike("[a-z0-9]")
    best = every.join(agents, "audit_id").where(fits).groupBy("audit_id", "asked").agg(F.max_by("agent", F.length("agent")).alias("agent"))
    return every.join(best, ["audit_id", "asked"], "left").withColumn("agent", F.coalesce("agent", F.lit("*")))


def compiled(found: DataFrame) -> DataFrame:
    """rules with `begin` (what every path that they match begins with), its length `cut`, and `pattern` (null if that is all)."""
    ended = C("rule").endswith("$")
    body = canonical(F.regexp_replace("rule", r"\$$", ""))
    wild = F.when(body.contains("*") | ended, F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.split(body, r"\*", -1), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))), ".*"), F.when(ended, F.lit(r"\z")).otherwise("")))
    begin = F.regexp_extract(body, r"^([^*]*)", 1)
    return found.where("rule is not null").select("audit_id", "agent", "allow", F.length("rule").alias("size"), begin.alias("begin"), F.length(begin).alias("cut"), wild.alias("pattern")).distinct()


def allowed(urls: DataFrame, sites: DataFrame, asked: list[str]) -> DataFrame:
    """(audit_id, url, asked, allowed) for each of urls(audit_id, url) and each agent asked for; sites(audit_id, robots_txt).

    The longest matching rule decides, allow wins a tie, and no rule, or no file, allows all.
    """
    agents, found = rules(sites)
    held = compiled(found).join(groups(sites, agents, asked), ["audit_id", "agent"])
    cuts = held.groupBy("audit_id").agg(F.collect_set("cut").alias("cuts"))
    every = urls.select("audit_id", "url").distinct()
    pieces = every.join(cuts, "audit_id").withColumn("path", target(C("url"))).select("audit_id", "url", "path", F.explode("cuts").alias("cut")).where(F.length("path") >= C("cut")).withColumn("begin", F.expr("substr(path, 1, cut)"))
    met = pieces.join(held, ["audit_id", "cut", "begin"]).where(C("pattern").isNull() | F.regexp_like("path", C("pattern")))
    best = met.groupBy("audit_id", "url", "asked").agg(F.max(F.struct("size", "allow")).alias("best")).select("audit_id", "url", "asked", C("best.allow").alias("allowed"))
    whole = every.select("audit_id", "url", F.explode(F.array(*map(F.lit, asked))).alias("asked"))
    return whole.join(best, ["audit_id", "url", "asked"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def delays(sites: DataFrame, asked: str) -> DataFrame:
    """(audit_id, crawl_delay): the first delay that holds for an agent, where there is one."""
    agents, found = rules(sites)
    own = found.where("delay is not null").join(groups(sites, agents, [asked]), ["audit_id", "agent"])
    return own.groupBy("audit_id").agg(F.min_by("delay", "place").alias("crawl_delay"))


def sitemaps(sites: DataFrame) -> DataFrame:
    """(audit_id, url): the sitemaps that files declare."""
    return lines(sites).where((C("name") == "sitemap") & (C("value") != "")).select("audit_id", C("value").alias("url")).distinct()
