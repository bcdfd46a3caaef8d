"""What JSON-LD blocks say, by a walk over variants: native, whatever their nesting.

Blocks are parsed to variants once. A level of the walk is a table of values; what its objects say is read by path, and
exploding them gives the next level, until a level is empty. So a block of any depth and width becomes rows, and no row
holds more than a value. `html.Structured` does the same for the blocks of one page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import dropped, written
from .html import CREDENTIALS

C = F.col
#: Levels at most; Python's parser ends near a thousand.
DEPTH = 500


def _at(v: str, name: str) -> str:
    return f"variant_get({v}, '$[\"{name}\"]')"


def _strings(v: str) -> Column:
    """A text, or the texts of a list, as an array; nothing else counts."""
    one = "schema_of_variant({0}) = 'STRING'"
    return F.expr(f"CASE WHEN {one.format(v)} THEN array(CAST({v} AS STRING)) WHEN startswith(schema_of_variant({v}), 'ARRAY') THEN transform(filter(CAST({v} AS ARRAY<VARIANT>), x -> x IS NOT NULL AND {one.format('x')}), x -> CAST(x AS STRING)) ELSE CAST(array() AS ARRAY<STRING>) END")


def walk(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """blocks(audit_id, url, json) to a row per object: audit_id, url, in_action, names, same_as, dates, author, credentials.

    A block that is no JSON, or has a key twice in an object, says nothing; nor does a null or empty one.
    """
    level = written(blocks.select("audit_id", "url", F.lit(False).alias("in_action"), F.expr("try_parse_json(json)").alias("v")).where("v is not null"))
    found = []
    for _ in range(depth):
        if level.isEmpty():
            break
        objects = level.where("startswith(schema_of_variant(v), 'OBJECT')")
        held = {k: F.expr(_at("v", n)) for k, n in (("kind", "@type"), ("same", "sameAs"), ("published", "datePublished"), ("modified", "dateModified"))}
        said = objects.select("audit_id", "url", "in_action", *(c.alias(k) for k, c in held.items()), F.expr(f"{_at('v', 'author')} IS NOT NULL").alias("by"), F.expr(" OR ".join(f"{_at('v', n)} IS NOT NULL" for n in sorted(CREDENTIALS))).alias("proven"))
        names = said.withColumn("names", _strings("kind")).withColumn("person", F.array_contains("names", "Person"))
        one = lambda c: F.expr(f"CASE WHEN schema_of_variant({c}) = 'STRING' THEN CAST({c} AS STRING) END")
        found.append(written(names.select("audit_id", "url", "in_action", "names", _strings("same").alias("same_as"), F.array_compact(F.array(one("published"), one("modified"))).alias("dates"), (C("person") | C("by")).alias("author"), (C("person") & C("proven")).alias("credentials"))))
        level.createOrReplaceTempView("__level")
        below = level.sparkSession.sql("SELECT audit_id, url, in_action OR coalesce(e.key = 'potentialAction', FALSE) AS in_action, e.value AS v FROM __level, LATERAL variant_explode(v) e WHERE startswith(schema_of_variant(e.value), 'OBJECT') OR startswith(schema_of_variant(e.value), 'ARRAY')")
        before, level = level, written(below)
        dropped(before)
    if not found:
        empty = "audit_id string, url string, in_action boolean, names array<string>, same_as array<string>, dates array<string>, author boolean, credentials boolean"
        return blocks.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, found)


def facts(blocks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(audit_id, url, types, actions, same_as, newest, has_author, has_credentials) of every page with an object; lists sorted."""
    rows = walk(blocks, depth)
    of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return rows.groupBy("audit_id", "url").agg(
        of("names").alias("types"),
        of(F.when(C("in_action"), C("names"))).alias("actions"),
        of("same_as").alias("same_as"),
        F.max(F.array_max("dates")).alias("newest"),
        F.bool_or("author").alias("has_author"),
        F.bool_or("credentials").alias("has_credentials"),
    )
