"""Benchmark decontamination: an FM-index per training shard, searched for all test phrases.

A task gathers documents up to `SHARD_WORDS` words (or one longer document), numbers their words by the benchmark's
vocabulary, and indexes them. A word that no benchmark item has can be in no occurrence, so it becomes a separator, and
a stretch between separators that is shorter than the shortest phrase is left out of the index; nothing else is. The
phrases are sought backward through the wavelet ranks, their places come from the sampled suffix positions, and
overlapping places merge into spans of words.

The benchmark is what is broadcast, each distinct text of it once, however many items share it. It is dealt into blocks of
about `BLOCK_WINDOWS` windows, whatever its size or that of an item; each block is one pass over the documents, whose hits
are written before the next block is gathered, so the driver and a worker hold one block. Texts that several items share
are found under a mark, and joined with their items at the end. A document is never split, so a place is found whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, alnum_words, unused, written
from .fmindex import FMIndex

SHARD_WORDS = 2_000_000
#: Windows in a block; some 100 bytes each on the driver and in a worker.
BLOCK_WINDOWS = 1_000_000
#: Words of an item that are handled as one.
ITEM_WORDS = 100_000
#: Words in a window; an item of fewer is one window.
WINDOW = 10
#: Places that are resolved at a time.
PLACES = 1 << 20
#: Before the digest of a text that several items share, in the place of an item.
MARK = "\x00"


class Phrases:
    """The windows of some items: word numbers, right-aligned, and the items that hold each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        names = {n: k for k, n in enumerate(sorted({n for n, _ in items}))}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            words = np.array([self.number.setdefault(w, len(self.number) + 1) for w in alnum_words(text)], np.int32)
            if len(words):
                own = np.lib.stride_tricks.sliding_window_view(words, window) if len(words) >= window else np.pad(words, (window - len(words), 0))[None, :]
                rows.append(own)
                owners.append(np.full(len(own), names[item], np.int32))
        self.names = list(names)
        self.patterns, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        held = np.unique(np.stack([of.reshape(-1), np.concatenate(owners)], axis=1), axis=0)
        self.owner, self.begin = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(self.patterns) + 1))
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(self.patterns) else 0

    def holders(self, phrase: int) -> list[str]:
        return [self.names[k] for k in self.owner[self.begin[phrase] : self.begin[phrase + 1]].tolist()]


class _Shard:
    """Documents that are gathered until they are indexed together."""

    def __init__(self, phrases: Phrases) -> None:
        self.of, self.keys, self.words, self.runs, self.where = phrases, [], [], [], []
        self.total = 0

    def add(self, key: tuple, text: bytes | None) -> None:
        words = alnum_words(text)
        self.keys.append(key)
        self.words.append(len(words))
        self.total += len(words)
        if not self.of.shortest:
            return
        get = self.of.number.get
        number = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        gap = np.flatnonzero(np.r_[0, number, 0] == 0)  # run between gaps g and h: words g .. h - 2
        for at in np.flatnonzero(np.diff(gap) > self.of.shortest):
            self.runs.append(number[gap[at] : gap[at + 1] - 1])
            self.where.append((len(self.keys) - 1, gap[at]))

    def found(self) -> dict[int, tuple[list, set]]:
        """By document: places (start, end) in words, and items."""
        out: dict[int, tuple[list, set]] = {}
        if not self.runs:
            return out
        starts = np.cumsum([1, *(len(r) + 1 for r in self.runs[:-1])])
        text = np.zeros(int(starts[-1] + len(self.runs[-1]) + 1), np.int64)
        for s, r in zip(starts, self.runs, strict=True):
            text[s : s + len(r)] = r
        index = FMIndex(text, len(self.of.number))
        lo, hi = index.search(self.of.patterns)
        hits = np.flatnonzero(hi > lo)
        docs, offsets = np.array(self.where, np.int64).T
        pairs = np.zeros(0, np.int64)  # document and phrase, each pair once however often it stands there
        upto = np.cumsum((hi - lo)[hits])
        while len(hits):
            take = max(1, int(np.searchsorted(upto, PLACES)))
            part, hits, upto = hits[:take], hits[take:], upto[take:] - upto[take - 1]
            many = (hi - lo)[part]
            row = np.repeat(lo[part] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            at, phrase = index.locate(row), np.repeat(part, many)
            run = np.searchsorted(starts, at, side="right") - 1
            begin = offsets[run] + at - starts[run]
            for d, a, n in zip(docs[run].tolist(), begin.tolist(), self.of.lengths[phrase].tolist(), strict=True):
                out.setdefault(d, ([], set()))[0].append((a, a + n))
            pairs = np.union1d(pairs, docs[run] * len(self.of.patterns) + phrase)
        for d, p in zip(*(x.tolist() for x in np.divmod(pairs, len(self.of.patterns))), strict=True):
            out[d][1].update(self.of.holders(p))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<start:long,end:long>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, items: list[tuple[str, bytes]], window: int, shard_words: int) -> DataFrame:
    """docs(doc_id, th, text): one row each, (doc_id, th, n_words, spans, items), for one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard: _Shard) -> pa.RecordBatch:
            found = shard.found()
            spans = [[{"start": a, "end": b} for a, b in merged(found[k][0])] if k in found else [] for k in range(len(shard.keys))]
            names = [sorted(found[k][1]) if k in found else [] for k in range(len(shard.keys))]
            ids, hashes = zip(*shard.keys, strict=True)
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(shard.words, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "th", "n_words", "spans", "items"])

        phrases = sent.value
        shard = _Shard(phrases)
        for b in parts:
            for key, text in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True):
                shard.add(key, text)
                if shard.total >= shard_words:
                    yield flush(shard)
                    shard = _Shard(phrases)
        if shard.keys:
            yield flush(shard)

    return docs.mapInArrow(run, f"doc_id long, th long, n_words long, spans {SPANS}, items array<string>")


def windows(benchmark: DataFrame, window: int, item_col: str, item_text_col: str, item_words: int) -> DataFrame:
    """(item, text, n): the items in pieces of some item_words words that share window - 1 words, and their windows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                for k in range(0, max(1, len(words) - window + 1), item_words) if words else ():
                    piece = words[k : k + item_words + window - 1]
                    rows.append((item, b" ".join(piece), max(1, len(piece) - window + 1)))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["item", "text", "n"])

    picked = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    return picked.where("text is not null").mapInArrow(run, "item string, text binary, n long")


def _named(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """found with the items of every text that several of them share, in the place of its mark."""
    marked = lambda x: x.startswith(MARK)
    kept = written(found)
    owners = pieces.select(F.concat(F.lit(MARK), F.md5("text")).alias("mark"), "item").distinct()
    hits = kept.where(F.exists("items", marked)).select("doc_id", "th", F.explode(F.filter("items", marked)).alias("mark")).distinct()
    more = hits.join(owners, "mark").groupBy(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th")).agg(F.collect_set("item").alias("more"))
    joined = kept.join(more, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th")), "left")
    every = F.array_sort(F.array_union(F.filter("items", lambda x: ~marked(x)), F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select("doc_id", "th", "n_words", "spans", every.alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS, block_windows: int = BLOCK_WINDOWS, item_words: int = ITEM_WORDS) -> DataFrame:
    """Per row of docs: doc_id, th (a hash of the text), n_words, spans of hit words (merged, end exclusive), items.

    Null and empty texts have no words; items without words are no window; an item without an id goes by the empty
    string. Texts and items of any length are read whole. Ties: items of equal words are all named. Rows that repeat
    both id and text come back as often as they are. Empty tables give no rows or no hits; other columns are not read.
    """
    pieces = written(windows(benchmark, window, item_col, item_text_col, item_words))
    owned = F.when(F.min("item") == F.max("item"), F.min("item")).otherwise(F.concat(F.lit(MARK), F.col("piece")))
    items = written(pieces.groupBy(F.md5("text").alias("piece")).agg(F.first("text").alias("text"), F.first("n").alias("n"), owned.alias("item")))
    total, shared = items.agg(F.sum("n"), F.count_if(F.col("item").startswith(MARK))).first()
    blocks = -(-(total or 0) // block_windows) or 1
    block = F.pmod(F.xxhash64("piece"), F.lit(blocks))
    named = lambda found: _named(found, pieces) if shared else found
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    every: list[DataFrame] = []
    for k in range(blocks):
        part = _pass(picked, [(r["item"], bytes(r["text"])) for r in items.where(block == k).collect()], window, shard_words)
        if blocks == 1:
            return named(part)
        # The first pass has a row for every row of docs; of the others only hits matter, once for each text.
        every.append(written(part if not every else part.where(F.size("spans") > 0).dropDuplicates(["doc_id", "th"])))
    first, more, *rest = every
    for p in rest:
        more = more.unionByName(p)
    more = written(more.groupBy(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th")).agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items")))
    joined = first.join(more, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": x, "end": y} for x, y in merged([(s["start"], s["end"]) for s in own])] for own in b.column(3).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(spans, _ARROW_SPANS), b.column(4)], names=b.schema.names)

    both = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b))
    return named(joined.select("doc_id", "th", "n_words", both("spans", "more_spans").alias("spans"), F.array_sort(F.array_distinct(both("items", "more_items"))).alias("items")).mapInArrow(run, first.schema))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    plain, out, at, word = text.translate(ALNUM_TABLE) + b" ", [], 0, -1
    inside, k, begin = False, 0, 0
    for i in np.flatnonzero(np.diff(np.frombuffer(b" " + plain, np.uint8) == 0x20)).tolist():
        inside = not inside
        word += inside
        if k < len(spans) and inside and word == spans[k][0]:
            begin = i
        if k < len(spans) and not inside and word == spans[k][1] - 1:
            out.append(text[at:begin].rstrip(b" "))
            at, k = i, k + 1
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **more) -> DataFrame:
    """docs without the words that benchmark items hold; same columns, of any names. A document of which no word is left goes.

    Odd rows as in `find`; a text that isn't hit comes back as it is.
    """
    own_id, own_th, spans, th, left = unused(docs.columns, "hit_id", "hit_hash", "spans", "hash", "left")
    hits = written(find(docs, benchmark, id_col=id_col, text_col=text_col, **more).where(F.size("spans") > 0).select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th), F.col("spans").alias(spans)).distinct())
    joined = docs.withColumn(th, F.xxhash64(text_col)).join(hits, F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (F.col(th) == F.col(own_th)), "left")

    @F.udf("string", useArrow=True)
    def cut(text: bytes, spans: list) -> str | None:
        return None if spans is None else without_spans(text, [(s["start"], s["end"]) for s in spans]).decode("utf-8", "replace")

    hit = F.col(spans).isNotNull()
    # Only the texts that are hit go to Python; of the others a null does.
    out = joined.withColumn(left, cut(F.when(hit, F.col(text_col).cast("binary")), F.col(spans))).where(~hit | F.col(left).rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"))
    return out.select(*(F.when(hit, F.col(left)).otherwise(F.col(c)).alias(c) if c == text_col else F.when(hit, F.length(left)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(c) for c in docs.columns))


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of `find`, which says what becomes of odd rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find(docs, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
