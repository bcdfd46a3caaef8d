"""Pages of markup go to tasks whose size doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenaudit.plans import markup


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(markup, "PAGES", 50)
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pages = markup.captures(spark, str(tmp_path))
    sizes = pages.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 20
    assert max(r["count"] for r in sizes) <= 75
    assert pages.select("url").distinct().count() == 1000
