"""States of audits: pages added, changed and taken out, in batches and in streams."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lumenaudit import schema
from lumenaudit.operators import rules, states
from lumenaudit.plans import analogs
from lumenaudit.streaming import captures as streaming
from lumenaudit.sources import html

COLUMNS = ["audit_id", "key", "score", "status"]


def none(spark, ddl):
    return spark.createDataFrame([], schema.struct(ddl))


def rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


@pytest.fixture(scope="module")
def declared():
    return rules.declared(rules.catalog())


def full(spark, pages):
    return rows(rules.evaluate(pages, none(spark, schema.SITE_SIGNALS), none(spark, schema.EXTERNAL_SIGNALS), F.lit(analogs.AUDITED_ON)))


def of(spark, s, declared):
    known = states.facts_of(s, declared[0])
    return rows(rules.evaluate_facts(known, none(spark, schema.SITE_SIGNALS), none(spark, schema.EXTERNAL_SIGNALS), F.lit(analogs.AUDITED_ON)))


def test_a_state_is_a_full_run(spark, sf_dir, declared):
    pages = analogs.pages(spark, sf_dir).where(F.substring("audit_id", 5, 9).cast("int") < 9)
    assert of(spark, states.state(pages, *declared), declared) == full(spark, pages)


def test_changes_add_up(spark, sf_dir, declared, tmp_path):
    """Random changes: pages that go, come, and take another's signals; a whole audit goes. The log, folded or not, equals a full run."""
    r = random.Random(4)
    pages = analogs.pages(spark, sf_dir).where(F.substring("audit_id", 5, 9).cast("int") < 5)
    every = pages.collect()
    now = {(p["audit_id"], p["url"]): p for p in r.sample(every, len(every) // 2)}
    frame = lambda found: spark.createDataFrame(list(found), schema.struct(schema.PAGE_SIGNALS))
    log = str(tmp_path / "log")
    states.append(log, states.state(frame(now.values()), *declared), "0")
    for n in range(1, 4):
        before, after = [], []
        for p in r.sample(every, len(every) // 4):
            at = (p["audit_id"], p["url"])
            if at in now:
                before.append(now.pop(at))
            if r.random() < 0.7:
                other = r.choice(every).asDict()
                now[at] = type(p)(**(other | {"audit_id": p["audit_id"], "url": p["url"]}))
                after.append(now[at])
        if n == 3:
            gone = [k for k in now if k[0] == "site2"]
            kept = [p for p in after if p["audit_id"] != "site2"]
            before += [now.pop(k) for k in gone if now[k] not in after]
            for k in gone:
                now.pop(k, None)
            after = kept
        for _ in range(2):  # a batch that runs again counts once
            states.append(log, states.change(frame(before), frame(after), *declared), str(n))
        touched = spark.createDataFrame([(p["audit_id"],) for p in before + after], "audit_id string")
        want = full(spark, frame(now.values()))
        names = {x[0] for x in touched.collect()}
        assert of(spark, states.read(spark, log, touched), declared) == [x for x in want if x[0] in names]
    assert of(spark, states.read(spark, log), declared) == want
    states.compact(spark, log, str(tmp_path / "folded"))
    assert of(spark, states.read(spark, str(tmp_path / "folded")), declared) == want


def test_no_pages(spark, declared):
    assert of(spark, states.state(none(spark, schema.PAGE_SIGNALS), *declared), declared) == []


def captures(spark, *found):
    return spark.createDataFrame([(a, u, None, 200, 0, h, None) for a, u, h in found], schema.struct(schema.CAPTURE))


def document(title, *links):
    return f"<title>{title}</title><h1>x</h1><p>{'word ' * 30}" + "".join(f'<a href="{x}">l</a>' for x in links)


def test_stream(spark, tmp_path):
    """Three starts from one checkpoint: each scores the audits it touches as a full run over the latest captures does."""
    parts = [
        [("a", "https://a.example/1", document("old", "/2")), ("a", "https://a.example/2", document("two")), ("b", "https://b.example/", document("b"))],
        [("a", "https://a.example/1", document("new title, which is long enough")), ("a", "https://a.example/3", document("two", "/1")), ("a", "https://a.example/3", document("two", "/1"))],
        [("b", "https://b.example/", document("b"))],
    ]
    seen: dict = {}
    now: dict = {}
    for n, part in enumerate(parts):
        captures(spark, *part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streaming.start(streaming.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, k: seen.__setitem__(k, sorted(map(tuple, df.select("audit_id", "score_global", "coverage").collect()))), available_now=True)
        q.awaitTermination()
        now |= {(a, u): (a, u, h) for a, u, h in part}
        whole = rules.evaluate(html.extract(captures(spark, *now.values())), none(spark, schema.SITE_SIGNALS), none(spark, schema.EXTERNAL_SIGNALS))
        from lumenaudit.operators import scoring

        want = sorted(map(tuple, scoring.report(whole).select("audit_id", "score_global", "coverage").collect()))
        touched = {0: {"a", "b"}, 1: {"a"}, 2: set()}[n]  # what comes again unchanged touches nothing
        assert seen[n] == [x for x in want if x[0] in touched]
    per = {r["batch"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out/changes")).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert per == {0: 3, 1: 3}  # in proportion to what changed: two pages, one of them with its old state
    assert spark.read.parquet(str(tmp_path / "out/signals")).count() == 5


def test_pages_expire(spark, tmp_path):
    """A page that isn't captured again in time is taken out of its audit."""
    captures(spark, ("a", "https://a.example/1", document("one")), ("a", "https://a.example/2", document("two"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen: list = []
    q = streaming.start(streaming.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, k: seen.append(df.count()), ttl=4.0)
    until = time.time() + 90
    while time.time() < until and (not seen or seen[-1] != 0):
        time.sleep(1)
    q.stop()
    assert seen[0] == 1 and seen[-1] == 0
    assert spark.read.parquet(str(tmp_path / "out/changes")).agg(F.sum("sign")).first()[0] == 0
