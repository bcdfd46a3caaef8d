"""The audit from end to end: captures in, tables out, over all sites at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators import rules, scoring
from ..schema import EXTERNAL_SIGNALS, SITE_SIGNALS, struct
from ..shared import written
from ..sources import html


@dataclass
class Audit:
    signals: DataFrame
    results: DataFrame
    pillars: DataFrame
    scores: DataFrame
    issues: DataFrame
    readiness: DataFrame


def run(captures: DataFrame, site: DataFrame | None = None, external: DataFrame | None = None, audited_on: Column | None = None, thresholds: dict | None = None, overrides: dict | None = None, weights: dict | None = None, persist: bool = True, bare: bool = True) -> Audit:
    """site and external signals are optional; what is missing is not measured (a missing sitemap scores 0).

    persist: pages are parsed at once, for all outputs, and their signals written into the shared folder, so that no lost
    executor makes them be parsed again; without it every output parses them anew. bare: as for `html.Tree`.
    """
    spark = captures.sparkSession
    site = site if site is not None else spark.createDataFrame([], struct(SITE_SIGNALS))
    external = external if external is not None else spark.createDataFrame([], struct(EXTERNAL_SIGNALS))
    signals = html.extract(captures, bare=bare)
    if persist:
        signals = written(signals)
    results = rules.evaluate(signals, site, external, audited_on, thresholds, overrides)
    pillars = scoring.pillar_scores(results)
    return Audit(signals, results, pillars, scoring.report(results, weights), scoring.issues(results, rules.affected(signals, thresholds)), scoring.readiness(signals, site, external))
