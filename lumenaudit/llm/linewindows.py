"""Line dedup by overlapping windows of three lines, in DataFrame functions alone.

Lines are trimmed and blank ones skipped. A window is three such lines in a row. Of all windows with equal lines the
one with the smallest (doc_id, text hash, position) stays; a later one covers its three lines, and runs of covered lines,
with the blank lines between them, are removed.

Windows are known by 128 bits of hashes, so what is shuffled is narrow and a window is never mistaken for another at
any size of corpus. The earliest place of each repeated window comes from a grouping with partial aggregation, so a
window that half of all documents share is no hot key there. Places and first places are written before they meet in a
join: both its sides are plain shuffles, so adaptive execution can split that window's rows. No window function holds
the places of one key together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, unused, written

#: Lines in a window.
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, a hash of the text, the trimmed lines that aren't blank, and where they stand."""
    lined = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), _lines(F.col(text_col)).alias("lines"))
    trimmed = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(" \t\r")).alias("line"))), lambda s: s["line"] != "")
    return lined.select("id", "th", trimmed.alias("full"))


def places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, pos, h1, h2): every window of every document."""
    n = F.size("full")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    three = [lambda k, j=j: F.get("full", k + j)["line"] for j in range(WINDOW)]
    hashed = F.transform(starts, lambda k: F.struct(k.alias("pos"), F.xxhash64(*(f(k) for f in three)).alias("h1"), F.xxhash64(F.lit(1), *(f(k) for f in three)).alias("h2")))
    return _sources(docs, id_col, text_col).select("id", "th", F.explode(hashed).alias("w")).select("id", "th", "w.*")


def meet(every: DataFrame, first: DataFrame) -> DataFrame:
    """The windows of `places` that aren't the first of their kind; first(h1, h2, first)."""
    place = F.struct("id", "th", "pos")
    return every.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "th", "pos")


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, starts): sorted positions of a document's windows that stand somewhere earlier too."""
    every = written(places(docs, id_col, text_col))
    place = F.struct("id", "th", "pos")
    first = written(every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = written(meet(every, first))
    dropped(every, first)
    return later.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Column, Column]:
    """docs with two more columns, and these: the text's lines, and the runs of lines to go, as structs (a, b) of first and last line, in order; empty if none.

    Work per document is linear in its lines, however long the text. Null texts are as empty ones. Documents of under
    three lines have no window. Ties: of equal windows in one document the first stays, and of documents of one id that
    with the smaller text hash ranks first; a null id ranks before all others. Rows that repeat both id and text are one
    document and are treated alike. Other columns of docs may have any names. An empty table gives an empty one.
    """
    lines, starts, at, begin, end, spans, th, own_id, own_th = unused(docs.columns, "lines", "starts", "at", "begin", "end", "cuts", "hash", "found_id", "found_hash")
    found = later_windows(docs, id_col, text_col).select(F.col("id").alias(own_id), F.col("th").alias(own_th), F.col("starts").alias(starts))
    full = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x, F.lit(" \t\r")) != "", i)), lambda i: i.isNotNull())
    begins = F.filter(F.transform(starts, lambda v, i: F.when((i == 0) | (v - F.get(starts, i - 1) > WINDOW), v)), lambda v: v.isNotNull())
    ends = F.filter(F.transform(starts, lambda v, i: F.when((i == F.size(starts) - 1) | (F.get(starts, i + 1) - v > WINDOW), v + WINDOW - 1)), lambda v: v.isNotNull())
    runs = F.zip_with(begin, end, lambda a, b: F.struct(F.get(at, a).alias("a"), F.get(at, b).alias("b")))
    out = (
        docs.withColumn(th, F.xxhash64(text_col))
        .join(found, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(th) == F.col(own_th)), "left")
        .withColumn(lines, _lines(F.col(text_col)))
        .withColumn(at, F.when(F.col(starts).isNotNull(), full))
        .withColumn(begin, begins)
        .withColumn(end, ends)
        .withColumn(spans, F.coalesce(runs, F.array().cast("array<struct<a:int,b:int>>")))
        .select(*docs.columns, lines, spans)
    )
    return out, F.col(lines), F.col(spans)


def _rest(lines: Column, spans: Column) -> Column:
    """The lines outside the spans, joined."""
    gap = lambda j: (F.when(j == 0, 0).otherwise(F.get(spans, j - 1)["b"] + 1), F.when(j == F.size(spans), F.size(lines)).otherwise(F.get(spans, j)["a"]))
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda j: F.slice(lines, gap(j)[0] + 1, gap(j)[1] - gap(j)[0]))), "\n")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the removed lines gone from the text; same columns. A document of which no word is left goes. Odd rows as in `removals`."""
    out, lines, spans = removals(docs, id_col, text_col)
    (left,) = unused(out.columns, "left")
    cut = F.size(spans) > 0
    out = out.withColumn(left, F.when(cut, _rest(lines, spans)).otherwise(F.col(text_col)))
    out = out.where(~cut | (F.trim(left, F.lit(" \t\r\n")) != ""))
    return out.select(*(F.when(cut, F.length(left)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(left).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op9(docs: DataFrame) -> DataFrame:
    """Per document: lines, lines removed, the spans as text, and what is left. Odd rows as in `removals`."""
    r, lines, spans = removals(docs.select("doc_id", "text"))
    return r.select(
        "doc_id",
        F.size(lines).alias("n_lines"),
        F.aggregate(spans, F.lit(0), lambda n, s: n + s["b"] - s["a"] + 1).alias("n_removed"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["a"], s["b"])), ",").alias("spans"),
        _rest(lines, spans).alias("kept_text"),
    )
