"""Looking through an audit: filters, orders and totals of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col
SORTS = ("url", "http", "words", "js_delta", "alt_missing", "svg_unnamed", "forms_usable", "render")


def pages(view: DataFrame, search: str = "", sort: str = "url", descending: bool = False, first: int = 50) -> DataFrame:
    """Pages whose URL holds the text, whatever its case; an unknown number sorts as -1."""
    if sort not in SORTS:
        raise ValueError(f"sort by one of {', '.join(SORTS)}")
    hit = view.where(F.lower("url").contains(search.lower())) if search else view
    key = C(sort) if sort in ("url", "render") else F.coalesce(C(sort), F.lit(-1))
    return hit.orderBy(key.desc() if descending else key.asc(), "audit_id", "url").limit(first)


def totals(view: DataFrame) -> DataFrame:
    return view.groupBy("audit_id").agg(F.count("*").alias("pages"), F.coalesce(F.sum("alt_missing"), F.lit(0)).alias("alt_missing"), F.coalesce(F.sum("svg_unnamed"), F.lit(0)).alias("svg_unnamed"), F.count_if(C("render") == "csr").alias("csr"))


def criteria(results: DataFrame, hidden: tuple[str, ...] = (), pillar: str | None = None) -> DataFrame:
    """Results without hidden statuses, of one pillar if asked, each under the first pillar that it has."""
    shown = results.where(~C("status").isin(*hidden)) if hidden else results
    shown = shown.where(F.array_contains("pillars", pillar)) if pillar else shown
    return shown.withColumn("group", F.element_at("pillars", 1))


def table(rows: DataFrame, search: str, search_column: str, sort: str, descending: bool = False, first: int = 50, locale: str = "UNICODE") -> DataFrame:
    """A sortable, searchable list such as that of queries or ranks.

    Texts are in the order of a locale (a name of Spark's collations, such as `fr` or `de_CI`), where case and accents
    come after letters; the search passes over case, of any letters.
    """
    text = rows.schema[sort].dataType.typeName() == "string"
    hit = rows.where(F.contains(F.collate(search_column, f"{locale.removesuffix('_CI')}_CI"), F.collate(F.lit(search), f"{locale.removesuffix('_CI')}_CI"))) if search else rows
    key = F.collate(sort, locale) if text else C(sort)
    return hit.orderBy(key.desc() if descending else key.asc(), F.collate(search_column, locale), search_column).limit(first)


def placed(rows: DataFrame, by: str, column: str, locale: str = "UNICODE") -> DataFrame:
    """rows with `place`: their position within each value of `by`, in a locale's order of a text."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.collate(column, locale), column)))
