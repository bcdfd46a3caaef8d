"""The service of paged searches: what it reads for a page, and days larger than a page and a shelf."""

from __future__ import annotations

import pyarrow.dataset as ds
from pyspark.sql import functions as F

from lumenaudit.plans import inputs


def test_a_page_reads_its_shelf_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "SHELF", 40)
    rows = spark.range(250).select(F.lit("2024-01-09").alias("on"), (F.col("id") * 7 % 250).alias("k"), F.col("id").alias("clicks"), F.lit(1).cast("long").alias("impressions"), F.lit(2.0).alias("position"))
    folder = str(tmp_path / "days")
    inputs._shelves(rows, folder)
    read, real = [], ds.dataset
    monkeypatch.setattr(ds, "dataset", lambda p, **k: read.append(p) or real(p, **k))
    query = inputs._shelf_service(folder)
    body = {"startDate": "2024-01-09", "rowLimit": 30}
    got = []
    while page := query("https://shop.example/", body | {"startRow": len(got)})["rows"]:
        got += page
    assert [r["keys"] for r in got] == [[str(k)] for k in range(250)]
    assert len(read) == 14  # nine pages, four of which lie on two shelves, and an empty one
    some = body | {"filters": [{"operator": "equals", "expressions": ["3", "249", "0250", "x"]}]}
    assert [r["keys"] for r in query("https://shop.example/", some | {"startRow": 0})["rows"]] == [["3"], ["249"]]
    assert [r["keys"] for r in query("https://shop.example/", some | {"startRow": 1})["rows"]] == [["249"]]
    assert query("https://shop.example/", body | {"startDate": "2024-02-09", "startRow": 0}) == {"rows": []}
    assert query("https://else.example/", body) is None
