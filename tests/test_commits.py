"""Tables that change together."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.operators import commits, sinks


def tables(spark, score):
    audits = spark.createDataFrame([("a", score), ("b", score + 1)], "audit_id string, score_global double")
    return {"audits": audits, "results": audits.select("audit_id", F.lit("k").alias("key"), F.lit(score).alias("score")), "pillars": audits.select("audit_id", F.lit("seo").alias("pillar"), F.lit(score).alias("score"))}


def seen(spark, path, version=None):
    found = sinks.load_tables(spark, path, version=version)
    return {n: sorted(map(tuple, df.select("audit_id", "score_global" if n == "audits" else "score").collect())) for n, df in found.items()}


def test_a_failure_between_tables_leaves_the_old_report(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    assert sinks.save_report(tables(spark, 1.0), path, "r1") == 1
    before = seen(spark, path)
    new = tables(spark, 5.0)
    new["pillars"] = new["pillars"].withColumn("score", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        sinks.save_report(new, path, "r1")
    assert seen(spark, path) == before and commits.versions(spark, path) == [1]
    # A commit that fails itself leaves it, too.
    monkeypatch.setattr(commits._Files, "create", lambda self, name, text: False)
    with pytest.raises(commits.Conflict):
        sinks.save_report(tables(spark, 6.0), path, "r1")
    monkeypatch.undo()
    assert seen(spark, path) == before
    assert sinks.save_report(tables(spark, 7.0), path, "r1") == 2
    assert seen(spark, path)["pillars"] == [("a", 7.0), ("b", 7.0)]


def test_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.save_report(tables(spark, 1.0), path, "r1")
    held = sinks.load_tables(spark, path)
    sinks.save_report(tables(spark, 2.0), path, "r1")
    sinks.save_report({k: df.where("audit_id = 'a'") for k, df in tables(spark, 3.0).items()}, path, "r2")
    assert {r["score"] for r in held["results"].collect()} == {1.0}
    assert seen(spark, path, 1)["results"] == [("a", 1.0), ("b", 1.0)]
    assert seen(spark, path)["results"] == [("a", 3.0), ("b", 2.0)]
    assert commits.sweep(spark, path) == 1
    assert seen(spark, path)["results"] == [("a", 3.0), ("b", 2.0)] and commits.versions(spark, path) == [3]
    with pytest.raises(ValueError, match="no version"):
        seen(spark, path, 1)


def test_commits_at_the_same_time(spark, tmp_path):
    path = str(tmp_path / "store")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda k: commits.commit(spark, path, {f"r{k}": {"audits": f"{path}/data/{k}/audits"}}), range(12)))
    assert sorted(numbers) == list(range(1, 13))
    assert set(commits.state(spark, path)) == {f"r{k}" for k in range(12)}
    assert set(commits.state(spark, path, commits.commit(spark, path, {}, gone=("r3",)))) == {f"r{k}" for k in range(12)} - {"r3"}


def test_ids_of_hosts(spark):
    hosts = spark.createDataFrame([("A.example",), ("a.example",), ("b.example",), ("c.example",)], "host string")
    found = sinks.new_domains(hosts, spark.createDataFrame([("B.example",)], "host string")).collect()
    assert sorted(r["host"] for r in found) == ["a.example", "c.example"] and len({r["host_id"] for r in found}) == 2
    again = sinks.new_domains(hosts.repartition(7), spark.createDataFrame([], "host string")).collect()
    assert {(r["host"], r["host_id"]) for r in found} <= {(r["host"], r["host_id"]) for r in again}
    assert isinstance(hosts, DataFrame)
