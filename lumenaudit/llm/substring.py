"""Substring dedup: repeated lines, paragraphs or sentences are removed, with their original offsets kept.

A unit is a line, a paragraph (lines between blank ones) or a sentence (a stretch up to closing marks or a line break, so
that a passage inside a line is found too). It is normalised: A-Z lower-cased, white space collapsed. Equal units, known
by a 128-bit digest, are grouped over all documents with partial aggregation, and that with the smallest (doc_id, text
hash, offset) is the first; every later occurrence goes. A document's repeated units that follow each other are a run, and
with `least` only runs of so many code points go: then short units that recur by chance or as a phrase (headings, list
marks, greetings) stay, while a passage goes however short its sentences are. The query takes sentences and `LEAST`.

First places are written before they meet the units again, so both sides of that join are plain shuffles and adaptive
execution can split a digest that a third of all units share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED_TABLE, dropped, written

#: Code points of a run of repeated units that goes in the query; some thirty words.
LEAST = 200
UNITS = {
    "line": re.compile(r"[^\n]+\n?|\n"),
    "paragraph": re.compile(r"(?:[^\n]|\n(?![ \t\r]*(?:\n|\Z)))+(?:\n[ \t\r]*(?=\n|\Z))*\n?|\n"),
    "sentence": re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+"),
}


def units(docs: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, k, a, b, h1, h2): number, code points and digest of every unit that holds a word."""
    pattern = UNITS[unit]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        low = (1 << 64) - 1
        for batch in parts:
            row, number, start, end, h1, h2 = [], [], [], [], [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                k = 0
                for m in pattern.finditer(text or ""):
                    words = m[0].encode("utf-8", "surrogatepass").translate(SPACED_TABLE).split()
                    if words:
                        h = digest(b" ".join(words))
                        row.append(at)
                        number.append(k)
                        start.append(m.start())
                        end.append(m.end())
                        h1.append(h >> 64)
                        h2.append(h & low)
                        k += 1
            at = pa.array(row, pa.int32())
            ints = [pa.array(x, pa.int32()) for x in (number, start, end)]
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *ints, *(pa.array(x, pa.uint64()).view(pa.int64()) for x in (h1, h2))], names=["doc_id", "th", "k", "a", "b", "h1", "h2"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, th long, k int, a int, b int, h1 long, h2 long")


def meet(every: DataFrame, first: DataFrame) -> DataFrame:
    """The units of `units` that aren't the first of their kind; first(h1, h2, first)."""
    place = F.struct("doc_id", "th", "a")
    return every.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "th", "k", "a", "b")


def repeats(docs: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, later): per document, sorted structs (k, a, b) of the units that stand somewhere earlier."""
    every = written(units(docs, unit, id_col, text_col))
    place = F.struct("doc_id", "th", "a")
    first = written(every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = written(meet(every, first))
    dropped(every, first)
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("k", "a", "b"))).alias("later"))


def runs(later: list[dict] | None, least: int) -> list[tuple[int, int, int]]:
    """(a, b, units) of the runs of consecutive units that are long enough."""
    out, held = [], []
    for u in [*(later or ()), None]:
        if held and (u is None or u["k"] != held[-1]["k"] + 1):
            if sum(x["b"] - x["a"] for x in held) >= least:
                out.append((held[0]["a"], held[-1]["b"], len(held)))
            held = []
        held.append(u)
    return out


def dedup(docs: DataFrame, unit: str = "line", least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_units removed, removed (spans in code points of the original text, end exclusive), text (what is left).

    A unit goes with the marks, spaces and line break that end it. Null and empty texts have no units and come back as
    empty texts; texts of any length are taken whole. Ties: of equal units in one document that with the smaller offset
    is the first, and of documents of one id that with the smaller text hash; a null id ranks before all others. Rows
    that repeat both id and text are one document and are treated alike. An empty table gives an empty one. Other
    columns are not read.
    """
    found = repeats(docs, unit, id_col, text_col).withColumnsRenamed({"doc_id": "found_id", "th": "found_th"})
    joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("th")).join(
        found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("th") == F.col("found_th")), "left"
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            kept, spans, counts = [], [], []
            for text, later in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, cut, out, at = text or "", runs(later, least), [], 0
                for a, b, _ in cut:
                    out.append(text[at:a])
                    at = b
                kept.append("".join([*out, text[at:]]))
                spans.append([{"start": a, "end": b} for a, b, _ in cut])
                counts.append(sum(n for _, _, n in cut))
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())], names=["doc_id", "n_units", "removed", "text"])

    return joined.select("doc_id", "text", "later").mapInArrow(run, "doc_id long, n_units int, removed array<struct<start:int,end:int>>, text string")


def op3(docs: DataFrame) -> DataFrame:
    """Sentences, runs of `LEAST` code points; spans as text, so that results compare simply. Nulls, ties and repeated rows as `dedup` has them."""
    return dedup(docs, "sentence", LEAST).select(
        "doc_id",
        F.col("n_units").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        F.length("text").cast("long").alias("kept_chars"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"),
        "text",
    )
