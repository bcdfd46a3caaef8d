"""Captures that keep arriving: pages are parsed as they come, and the audits they belong to are scored again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import rules, scoring, states
from ..schema import CAPTURE, EXTERNAL_SIGNALS, PAGE_SIGNALS, SITE_SIGNALS, struct
from ..sources import html

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGE = "audit_id string, url string, sign int, contribution string, page string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Captures from Parquet files that appear in a folder."""
    return spark.readStream.schema(struct(CAPTURE)).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class Changes(StatefulProcessor):
    """Of a page (its audit and URL): what it contributed when it was last seen.

    A page that is seen again gives two changes, its old contribution taken out and its new one added, or none if they are
    equal; of several captures in a batch the one with the greatest contribution counts. With a time to live, a timer
    takes out a page that isn't seen again in time.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "contribution string")

    def _row(self, key: Any, sign: int, contribution: str, page: str | None) -> pd.DataFrame:
        return pd.DataFrame({"audit_id": [key[0]], "url": [key[1]], "sign": [sign], "contribution": [contribution], "page": [page]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        contribution, page = max(max(zip(df["contribution"], df["page"], strict=True)) for df in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if self.ttl_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        if before != contribution:
            if before is not None:
                yield self._row(key, -1, before, None)
            self.last.update((contribution,))
            yield self._row(key, 1, contribution, page)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self._row(key, -1, self.last.get()[0], None)
            self.last.clear()

    def close(self) -> None:
        pass


def changes(captures: DataFrame, ttl: float | None = None) -> DataFrame:
    """A stream of captures to a stream of changes (CHANGE), a page's state being kept by audit and URL, so that an audit of any size is spread.

    ttl: seconds after which a page that isn't captured again is taken out. Needs the RocksDB state store.
    """
    asked, inputs = rules.declared(rules.catalog())
    pages = html.extract(captures)
    made = states.contributions(pages, asked, inputs).select("audit_id", "url", F.to_json("contribution").alias("contribution"), F.to_json(F.struct(*pages.columns)).alias("page"))
    mode = "None" if ttl is None else "ProcessingTime"
    return made.groupBy("audit_id", "url").transformWithStateInPandas(Changes(None if ttl is None else int(ttl * 1000)), CHANGE, "Append", mode)


def start(captures: DataFrame, path: str, checkpoint: str, scored: Callable[[DataFrame, int], None], available_now: bool = False, ttl: float | None = None) -> StreamingQuery:
    """Hands the scores of the audits that a batch touches to `scored`, with the batch's number.

    Below the path: the batch's changes, the signals of the pages that are new or changed, and the log of states. A
    batch costs its own pages and the states of the audits it touches; pages of earlier batches are never read. A batch
    that runs again replaces what it left, so each change counts once.
    """
    asked, _ = rules.declared(rules.catalog())
    base = path.rstrip("/")

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{base}/changes/batch={n}")
        own = spark.read.schema(struct(CHANGE)).parquet(f"{base}/changes/batch={n}")
        new = own.where("sign = 1").select(F.from_json("page", struct(PAGE_SIGNALS)).alias("p")).select("p.*")
        new.write.mode("overwrite").parquet(f"{base}/signals/batch={n}")
        parsed = own.withColumn("contribution", F.from_json("contribution", states.CONTRIBUTION))
        states.append(f"{base}/states", states.summed(parsed, asked), str(n))
        known = states.facts_of(states.read(spark, f"{base}/states", own), asked)
        results = rules.evaluate_facts(known, spark.createDataFrame([], struct(SITE_SIGNALS)), spark.createDataFrame([], struct(EXTERNAL_SIGNALS)))
        scored(scoring.report(results), n)

    spark = captures.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the query keeps it, the session doesn't
    try:
        w = changes(captures, ttl).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by tumbling (or sliding) windows; works on batches and streams."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    return marked.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "event_type", "n", "total")
