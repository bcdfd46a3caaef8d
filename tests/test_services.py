"""Data sources over stub services: pages, retries, filters, and streams that go on where they ended."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from lumenaudit import schema
from lumenaudit.sources import services

DAYS, KEYS = 6, 7


def server(folder, failing=0):
    """A service whose table is a file, which notes every request, and whose every first answer fails so often."""

    def query(site, body):
        with open(f"{folder}/asked", "a") as f:
            f.write(json.dumps([site, body]) + "\n")
        if not site.startswith("https://"):
            return None
        if failing and body["rowLimit"] > 1:
            at = f"{folder}/failed-{body['startDate']}-{body['startRow']}"
            n = os.path.getsize(at) if os.path.exists(at) else 0
            if n < failing:
                with open(at, "a") as f:
                    f.write("x")
                raise OSError("try again")
        day = dt.date.fromisoformat(body["startDate"])
        keys = [f"k{n}" for n in range(KEYS)]
        for f in body.get("filters", []):
            keys = [k for k in keys if (k in f["expressions"] if f["operator"] == "equals" else f["expressions"][0] in k)]
        rows = [{"keys": [k], "clicks": day.day, "impressions": 10, "ctr": 0.5, "position": 2} for k in keys]
        return {"rows": rows[body["startRow"] : body["startRow"] + body["rowLimit"]]}

    return query


def asked(folder):
    with open(f"{folder}/asked") as f:
        return [json.loads(x) for x in f]


def reader(spark, name, query, **options):
    services.register(spark, services.searches(name, query, lambda: "2024-01-06"))
    r = spark.read.format(name)
    for k, v in ({"domain": "a.example", "start_date": "2024-01-01", "end_date": f"2024-01-0{DAYS}", "row_limit": 3, "wait": 0.0} | options).items():
        r = r.option(k, v)
    return r.load()


def test_pages_and_retries(spark, tmp_path):
    df = reader(spark, "flaky", server(str(tmp_path), failing=2))
    assert df.count() == DAYS * KEYS
    assert {(r["day"].day, r["clicks"], r["position"]) for r in df.collect()} == {(d, d, 2.0) for d in range(1, DAYS + 1)}
    with pytest.raises(Exception, match="try again"):
        reader(spark, "broken", server(str(tmp_path / ".."), failing=9), start_date="2024-02-01", end_date="2024-02-02", attempts=2).count()


def test_filters_reach_the_service(spark, tmp_path):
    df = reader(spark, "filtered", server(str(tmp_path)))
    found = df.where((F.col("day") >= F.lit("2024-01-03").cast("date")) & (F.col("day") < F.lit("2024-01-05").cast("date")) & F.col("key").isin("k1", "k5", "no")).collect()
    assert sorted((r["day"].day, r["key"]) for r in found) == [(3, "k1"), (3, "k5"), (4, "k1"), (4, "k5")]
    bodies = [b for _, b in asked(tmp_path) if b["rowLimit"] > 1]
    assert {b["startDate"] for b in bodies} == {"2024-01-03", "2024-01-04"}
    assert all(b["filters"] == [{"dimension": "query", "operator": "equals", "expressions": ["k1", "k5", "no"]}] for b in bodies)
    assert df.where(F.col("key").contains("5")).count() == DAYS
    assert df.where((F.col("key") == "k1") & (F.col("key") == "k2")).count() == 0
    assert df.where("clicks = 2 and day = date'2024-01-02'").count() == KEYS


def test_limits_and_no_access(spark, tmp_path):
    assert reader(spark, "capped", server(str(tmp_path)), max_rows=5).count() == DAYS * 5
    assert reader(spark, "closed", lambda site, body: None).count() == 0


def test_a_stream_goes_on(spark, tmp_path):
    """Two starts from one checkpoint: the second reads the days that came since, and none twice."""
    os.makedirs(tmp_path / "s")
    (tmp_path / "latest").write_text("2024-01-02")
    at = str(tmp_path / "latest")

    def latest():
        with open(at) as f:
            return f.read()

    services.register(spark, services.searches("daily", server(str(tmp_path / "s")), latest))
    for until in ("2024-01-02", "2024-01-05", "2024-01-05"):
        (tmp_path / "latest").write_text(until)
        df = spark.readStream.format("daily").option("domain", "a.example").option("start_date", "2024-01-01").load()
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["day"].day, r["n"]) for r in got.groupBy("day").agg(F.count("*").alias("n")).collect()} == {(d, KEYS) for d in range(1, 6)}
    days = [b["startDate"] for _, b in asked(tmp_path / "s") if b["rowLimit"] > 1 and not b["startRow"]]
    assert sorted(days) == [f"2024-01-0{d}" for d in range(1, 6)]


def test_a_feed(spark, tmp_path):
    """Captures by number, as a table and as a stream; a failing page is asked for again alone."""
    folder = str(tmp_path)

    def fetch(first, last):
        if first == 40 and not os.path.exists(f"{folder}/once"):
            open(f"{folder}/once", "w").close()
            raise OSError("gone")
        return [("a", f"https://a.example/{n}", None, 200, 0, f"<title>{n}</title>", None) for n in range(first, last)]

    def end():
        with open(f"{folder}/end") as f:
            return int(f.read())

    (tmp_path / "end").write_text("70")
    services.register(spark, services.feed("captures", schema.CAPTURE, fetch, end))
    read = spark.read.format("captures").option("page", 8).option("range", 20).option("wait", 0.0)
    df = read.load()
    assert df.rdd.getNumPartitions() == 4
    assert sorted(int(r["url"].rsplit("/", 1)[1]) for r in df.collect()) == list(range(70))
    assert read.option("first", 60).load().count() == 10
    for n in (70, 95):
        (tmp_path / "end").write_text(str(n))
        q = spark.readStream.format("captures").option("range", 20).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).select("url").distinct().count() == n == spark.read.parquet(str(tmp_path / "out")).count()
