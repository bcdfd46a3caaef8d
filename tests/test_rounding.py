"""Rounding as Python's, and sums that don't depend on the order of rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenaudit.functions.text import cents_sql, rounded, rounded_sql, steady_sum
from lumenaudit.operators import rules, scoring
from lumenaudit.schema import EXTERNAL_SIGNALS, PAGE_SIGNALS, SITE_SIGNALS, struct

ODD = [0.0, 0.125, 2.675, 40.175, 0.375, -0.125, -2.675, 99.995, 100.0, 1e-9, 0.005, 0.015, 0.045, 5e-324, 0.00625, 1 / 3, 70.335]


def numbers():
    r = random.Random(5)
    return [*ODD, *(r.randrange(100_000) / 1000 for _ in range(3000)), *(r.uniform(-100, 100) for _ in range(2000)), *(r.randrange(6400) / 64 for _ in range(500)), *(r.randrange(10_000) / 100 / r.randrange(1, 99) for _ in range(3000))]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_rounding_is_pythons(spark, digits):
    df = spark.createDataFrame([(x,) for x in numbers()] + [(None,)], "x double")
    got = df.select("x", rounded(F.col("x"), digits).alias("a"), F.expr(rounded_sql("x", digits)).alias("b"), F.expr(cents_sql("x", digits)).alias("c")).collect()
    for r in got:
        want = None if r["x"] is None else round(r["x"], digits)
        assert (r["x"], r["a"], r["b"]) == (r["x"], want, want)
        assert r["c"] == (None if want is None else round(want * 10**digits))


def test_sums_in_any_order(spark):
    r = random.Random(6)
    values = [(r.random(),) for _ in range(4000)]
    sums = set()
    for n in (1, 3, 17):
        r.shuffle(values)
        sums |= {x[0] for x in spark.createDataFrame(values, "x double").repartition(n).agg(steady_sum(F.col("x"))).collect()}
    assert len(sums) == 1


def page(audit, k, **values):
    plain = {"audit_id": audit, "url": f"https://{audit}.example/{k}", "status_code": 200, "redirects": 0, "h1_count": 1, "word_count": 0, "internal_links": 5, "external_links": 0, "images_total": 0, "images_with_alt": 0, "svg_total": 0, "svg_accessible": 0, "tables_count": 0, "definition_lists_count": 0, "question_headings": 0, "lead_paragraph_words": 0, "has_author": False, "author_has_credentials": False, "has_structured_dates": False, "entity_count": 0}
    return [(plain | values).get(f.name) for f in struct(PAGE_SIGNALS).fields]


def scores(spark, pages, parts=1):
    none = lambda ddl: spark.createDataFrame([], struct(ddl))
    df = spark.createDataFrame(pages, struct(PAGE_SIGNALS)).repartition(parts)
    return rules.evaluate(df, none(SITE_SIGNALS), none(EXTERNAL_SIGNALS))


def test_pages_are_rounded_before_their_mean(spark):
    """Literal values: 791, 443 and 454 words of 800 are 98.88, 55.38 and 56.75, whose mean is 70.34; unrounded it is 70.33."""
    pages = [page("a", k, word_count=w) for k, w in enumerate((791, 443, 454))]
    pages += [page("b", k, text_ratio=x) for k, x in enumerate((0.0123, 0.0457, 0.1111))]
    pages += [page("c", k, main_text_ratio=x) for k, x in enumerate((0.0123, 0.0457, 0.1111))]
    pages += [page("d", k, word_count=w, entity_count=e) for k, (w, e) in enumerate(((700, 3), (900, 7), (811, 11)))]
    got = {(r["audit_id"], r["key"]): r["score"] for r in scores(spark, pages).collect()}
    assert got["a", "content.depth"] == 70.34
    mean = lambda xs: round(sum(round(x, 2) for x in xs) / len(xs), 2)
    assert got["b", "content.text_ratio"] == mean([x / 0.15 * 100 for x in (0.0123, 0.0457, 0.1111)])
    assert got["c", "geo.noise_ratio"] == mean([x / 0.20 * 100 for x in (0.0123, 0.0457, 0.1111)])
    assert got["d", "geo.entity_density"] == mean([e / w / 0.02 * 100 for w, e in ((700, 3), (900, 7), (811, 11))])


def test_scores_in_any_order(spark):
    r = random.Random(8)
    pages = [page(f"s{k % 7}", k, word_count=r.randrange(1200), text_ratio=r.random() / 3, main_text_ratio=r.random() / 3, entity_count=r.randrange(40), render_mode="csr", raw_word_count=r.randrange(500), rendered_word_count=1 + r.randrange(900), title="t" * r.randrange(80)) for k in range(700)]
    found = set()
    for n in (1, 3, 17):
        r.shuffle(pages)
        results = scores(spark, pages, n)
        rows = tuple(sorted((x["audit_id"], x["key"], x["score"], x["status"]) for x in results.collect()))
        found.add((rows, tuple(sorted(map(repr, scoring.report(results).collect())))))
    assert len(found) == 1


def test_weights_of_any_size(spark):
    rows = [("a", "x", ["seo"], 40.17, "warning", 0.1, "standard"), ("a", "y", ["seo"], 99.99, "ok", 0.2, "standard"), ("a", "z", ["seo", "geo"], 12.5, "critical", 1234.567, "standard")]
    r = spark.createDataFrame(rows, "audit_id string, key string, pillars array<string>, score double, status string, weight double, evidence_tier string")
    got = {x["pillar"]: x["score"] for x in scoring.pillar_scores(r).collect()}
    assert got["seo"] == round((40.17 * 0.1 + 99.99 * 0.2 + 12.5 * 1234.567) / (0.1 + 0.2 + 1234.567), 2) and got["geo"] == 12.5
