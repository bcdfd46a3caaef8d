"""The walk over variants, against the parser of single pages."""

from __future__ import annotations

import json
import random

from lumenaudit.sources import html, structured

KEYS = ["@type", "author", "sameAs", "datePublished", "dateModified", "potentialAction", "jobTitle", "name", "@graph", "x.y", "it's"]
TEXTS = ["Person", "Article", "BuyAction", "2026-01-05", "https://github.com/x", "", "Ünï \"quoted\"\n"]


def value(r, depth):
    kind = r.random()
    if depth and kind < 0.45:
        return {k: value(r, depth - 1) for k in r.sample(KEYS, r.randint(0, 5))}
    if depth and kind < 0.65:
        return [value(r, depth - 1) for _ in range(r.randint(0, 4))]
    return r.choice([*TEXTS, *TEXTS, None, True, 3, 2.5, 12345678901234567890])


def test_walk_is_the_parsers(spark):
    r = random.Random(9)
    pages = {f"p{k}": [json.dumps(value(r, r.randint(0, 6)), ensure_ascii=r.random() < 0.5) for _ in range(r.randint(0, 3))] for k in range(250)}
    deep = {"@type": "Deep", "author": None}
    for k in range(40):
        deep = {"potentialAction": [deep]} if k == 20 else {"x": [deep]}
    pages |= {"deep": [json.dumps(deep)], "bad": ['{"@type": ', "", "nothing", '{"@type": "Fine"}'], "plain": ["3", '"Person"', "null"], "nothing": [None]}
    blocks = spark.createDataFrame([("a", p, b) for p, bs in pages.items() for b in bs], "audit_id string, url string, json string")
    got = {x["url"]: (x["types"], x["actions"], x["same_as"], x["newest"], x["has_author"], x["has_credentials"]) for x in structured.facts(blocks).collect()}
    for p, bs in pages.items():
        s = html.Structured([b for b in bs if b is not None])
        want = (sorted(s.types), sorted(s.actions), sorted(s.same_as), max(s.dates, default=None), s.author, s.credentials)
        assert (p, got.get(p, ([], [], [], None, False, False))) == (p, want)
    assert got["deep"][1] == ["Deep"]


def test_no_python(spark):
    blocks = spark.createDataFrame([("a", "u", '{"@type": "X"}')], "audit_id string, url string, json string")
    plan = structured.facts(blocks)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert structured.facts(blocks.limit(0)).count() == 0
