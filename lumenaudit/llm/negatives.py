"""Hard negatives by a blocked matrix product: shards of rows times chunks of dimensions.

Scores of anchors against all rows are a product of two integer matrices. Both are cut into panels of `ROWS` (`ANCHORS`)
rows and `DIMS` dimensions. A task that has a panel of the rows lets the panels of all anchors of the same dimensions
stream past it and gives a partial tile for each. Tiles are shuffled by panel of rows, and the partial ones of an anchor
are added up there, in int64. A whole tile at once becomes

* the anchor's best rows of its own label, and
* the rows of other labels that might be in the window of one of its positives: their score reaches `low` hundredths of
  the anchor's fifth best positive so far in the task. The fifth best of all is no worse, so none is missed.

The first, read back alone, give every anchor its positives; the second, narrowed down to their windows, the negatives. So
the product is computed once, tiles are never stored, and what is stored is a small share of them. Tiles are shuffled
in the narrowest integers that no score can exceed, and anchors are dealt into as many rounds as keep a round's tiles
below `ROUND_BYTES`, since their sum grows with anchors times rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written
from .mtree import scaled, usable

#: Rows of a panel, anchors of a panel, dimensions of a chunk.
ROWS, ANCHORS, DIMS = 1024, 256, 32
#: Bytes of partial tiles in a round, at most.
ROUND_BYTES = 1 << 42
#: Rows of partial tiles that are added up at a time.
TAKEN = 2048
#: No score, and no possible score.
NONE = np.iinfo(np.int64).min

PANELS = "block int, chunk int, n int, ids binary, labels binary, data binary"
FOUND = "anchor_id long, own_ids array<long>, own_scores array<long>, ids array<long>, scores array<long>"


def _panels(width: int, dims: int, kind: type, named: bool):
    """Of the rows (id, label, v) of a block: a panel per chunk of dimensions, with ids and labels in the first, or in each if named."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        ids = table.column("id").combine_chunks().to_numpy()
        order = np.argsort(ids, kind="stable")
        labels = table.column("label").combine_chunks().to_numpy()[order]
        lists = table.column("v").combine_chunks()
        size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        whole = np.zeros((len(ids), width), np.int64)
        whole[np.arange(width)[None, :] < size[:, None]] = flat
        whole = whole[order]
        chunks = max(1, -(-width // dims))
        names = [c.split()[0] for c in PANELS.split(", ")]
        repeat = lambda x: [x] + [x if named else None] * (chunks - 1)
        data = [np.ascontiguousarray(whole[:, k * dims : (k + 1) * dims]).astype(kind).tobytes() for k in range(chunks)]
        columns = [pa.array([block] * chunks, pa.int32()), pa.array(range(chunks), pa.int32()), pa.array([len(ids)] * chunks, pa.int32()), pa.array(repeat(ids[order].tobytes()), pa.binary()), pa.array(repeat(labels.tobytes()), pa.binary()), pa.array(data, pa.binary())]
        return pa.table(columns, names=names)

    return run


def _multiplied(kind: type, tile: type, exact: bool):
    """Over (block, chunk, kind, n, ids, labels, data), a panel of rows before those of anchors: a row of a partial tile per anchor."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Products of doubles are exact as long as no sum reaches 2^53, and much faster.
        as_ = np.float64 if exact else np.int64
        rows, held = None, None
        for b in parts:
            blocks, chunks, anchors, sizes, ids, labels, data = (c.to_pylist() for c in b.columns)
            for block, chunk, is_anchor, n, i, of, raw in zip(blocks, chunks, anchors, sizes, ids, labels, data, strict=True):
                panel = np.frombuffer(raw, kind).reshape(n, -1).astype(as_)
                if not is_anchor:
                    rows, held = panel, (block, chunk)
                if not is_anchor or held != (block, chunk):  # of a block that no row fell into there is no panel
                    continue
                scores = (panel @ rows.T).astype(np.int64).astype(tile)
                yield pa.record_batch([pa.array([block] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array(np.frombuffer(i, np.int64)), pa.array(np.frombuffer(of, np.int64)), pa.array([chunk] * n, pa.int32()), pa.array([x.tobytes() for x in scores], pa.binary())], names=["block", "kind", "anchor_id", "label", "chunk", "data"])

    return run


class _Reduced:
    """Whole tiles, one panel of rows after another: keeps every anchor's best scores of its label so far."""

    def __init__(self, positives: int, low: int, high: int):
        self.positives, self.low, self.high = positives, low, high
        self.index: dict[int, int] = {}
        self.best = np.full((0, positives), NONE, np.int64)

    def lists(self, n: int, r: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int | None = None) -> tuple[pa.Array, pa.Array]:
        """Per anchor its entries, best first, ties to the smaller id."""
        order = np.lexsort((ids, -scores, r))
        r, ids, scores = r[order], ids[order], scores[order]
        if most is not None:
            keep = np.arange(len(r)) - np.searchsorted(r, r) < most
            r, ids, scores = r[keep], ids[keep], scores[keep]
        ends = pa.array(np.searchsorted(r, np.arange(n + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(scores))

    def reduce(self, anchors: np.ndarray, labels: np.ndarray, tile: np.ndarray, ids: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        k, n = self.positives, len(anchors)
        at = np.array([self.index.setdefault(a, len(self.index)) for a in anchors.tolist()])
        if len(self.index) > len(self.best):
            self.best = np.concatenate([self.best, np.full((max(len(self.best), len(self.index) - len(self.best)), k), NONE, np.int64)])
        same = labels[:, None] == of[None, :]
        own = np.where(same & (anchors[:, None] != ids[None, :]), tile, NONE)
        top = np.partition(own, max(0, own.shape[1] - k), axis=1)[:, -k:]
        r, c = np.nonzero((own >= top.min(axis=1)[:, None]) & (own != NONE))
        own_ids, own_scores = self.lists(n, r, ids[c], own[r, c], k)
        if top.shape[1] < k:
            top = np.pad(top, ((0, 0), (0, k - top.shape[1])), constant_values=NONE)
        self.best[at] = np.partition(np.concatenate([self.best[at], top], axis=1), -k, axis=1)[:, -k:]
        floor = self.best[at].min(axis=1)
        # A window of a negative score is empty, so scores of windows are never below zero.
        least = np.where(floor > 0, -(-self.low * np.maximum(floor, 0) // self.high), 0)
        r, c = np.nonzero(~same & (tile >= least[:, None]))
        other_ids, other_scores = self.lists(n, r, ids[c], tile[r, c])
        return pa.record_batch([pa.array(anchors), own_ids, own_scores, other_ids, other_scores], names=[x.split()[0] for x in FOUND.split(", ")])


def _summed(tile: type, positives: int, low: int, high: int):
    """Over (block, kind, anchor_id, label, chunk, data), each panel's ids and labels (kind 0) before its tiles: rows of FOUND.

    An anchor's partial tiles follow each other; what a batch may not have wholly is kept for the next one.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced, block, ids, of = _Reduced(positives, low, high), None, None, None
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for b in parts:
            blocks, kinds, anchors, labels = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            cuts = np.unique(np.r_[range(0, len(blocks), TAKEN), np.flatnonzero(np.diff(blocks) | np.diff(kinds)) + 1, len(blocks)]).tolist()
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if not kinds[s]:
                    if held is not None:
                        yield reduced.reduce(*held, ids, of)
                        held = None
                    block, raw = blocks[s], b.column(5)[s].as_py()
                    ids, of = np.frombuffer(raw, np.int64).reshape(2, -1)
                    continue
                assert block == blocks[s]
                own, of_own = anchors[s:e], labels[s:e]
                sums = np.frombuffer(b"".join(b.column(5).slice(s, e - s).to_pylist()), tile).reshape(e - s, -1).astype(np.int64)
                if held is not None:
                    own, of_own, sums = np.r_[held[0], own], np.r_[held[1], of_own], np.concatenate([held[2], sums])
                first = np.flatnonzero(np.r_[True, np.diff(own) != 0])
                sums = np.add.reduceat(sums, first, axis=0)
                own, of_own = own[first], of_own[first]
                if len(own) > 1:
                    yield reduced.reduce(own[:-1], of_own[:-1], sums[:-1], ids, of)
                held = own[-1:], of_own[-1:], sums[-1:]
        if held is not None:
            yield reduced.reduce(*held, ids, of)

    return run


def mined(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, rows: int = ROWS, anchors: int = ANCHORS, dims: int = DIMS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor and positive its hardest negatives.

    Scores are inner products of floor(factor * x) components. An anchor's positives are its best rows of the same label;
    a positive's negatives are the best of other labels with low * positive_score <= high * score <= high * positive_score.
    Ties go to the smaller id. Rows with a null id or label, or an unusable vector (null, or with null or non-finite
    components) take no part; shorter vectors are filled with zeros, so empty ones score 0. Rows that repeat an id count
    once, with the smallest of its labels and vectors. If a score could pass 2^63 / high it is an error, not a wrong
    result. No rows or no anchors, no result; other columns are not read.
    """
    if not 0 < low < high:
        raise ValueError("low must be above 0 and below high")
    fine = F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vector_col))
    flagged = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), scaled(F.col(vector_col), factor).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    one = flagged.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("anchor").alias("anchor"))
    every = written(one.select("id", "r.label", "r.v", "anchor"))
    largest = F.array_max(F.transform("v", lambda x: F.greatest(x, -(x + 1))))
    n, asking, width, most = every.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v")), F.max(largest)).first()
    width, most = width or 0, (most or 0) + 1
    bound = max(1, width) * most * most
    if bound * high >= 2**63:
        raise ValueError(f"components of up to {most} in {width} dimensions may give scores that don't fit 64 bits")
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
    tile = np.int32 if bound < 2**31 else np.int64
    chunks = max(1, -(-width // dims))

    def panels(df: DataFrame, blocks: int, named: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        return written(df.select(block.alias("block"), "id", "label", "v").groupBy("block").applyInArrow(_panels(width, dims, kind, named), PANELS))

    n_right, n_left = max(1, -(-n // rows)), max(1, -(-asking // anchors))
    right, left = panels(every, n_right, False), panels(every.where("anchor"), n_left, True)
    per_round = max(1, round_bytes // max(1, np.dtype(tile).itemsize * n * chunks * anchors))
    out = None
    heads = right.where("chunk = 0").select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("anchor_id"), F.lit(0).cast("long").alias("label"), F.lit(0).alias("chunk"), F.concat("ids", "labels").alias("data"))
    for k in range(0, n_left, per_round):
        now = left.where(F.col("block").between(k, k + per_round - 1))
        # The stated set of queries against all rows, in blocks: every panel of anchors goes past every panel of rows.
        asked = now.select(F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("block"), "chunk", F.lit(1).alias("kind"), "n", "ids", "labels", "data")
        none = F.lit(None).cast("binary")
        met = right.select("block", "chunk", F.lit(0).alias("kind"), "n", none.alias("ids"), none.alias("labels"), "data").unionByName(asked)
        tiles = met.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind").mapInArrow(_multiplied(kind, tile, bound < 2**53), "block int, kind int, anchor_id long, label long, chunk int, data binary")
        order = ("block", "kind", "anchor_id", "chunk")
        found = heads.union(tiles).repartition("block").sortWithinPartitions(*order).mapInArrow(_summed(tile, positives, low, high), FOUND)
        part = _windows(written(found), positives, negatives, low, high)
        out = part if out is None else out.union(part)
    dropped(right, left, every)
    return out


def _windows(found: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """From FOUND: positives first, from their columns alone; then what lies in their windows."""
    best = lambda key, score, i: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), i))
    own = found.select("anchor_id", F.explode(F.arrays_zip("own_ids", "own_scores")).alias("p")).select("anchor_id", F.col("p.own_ids").alias("positive_id"), F.col("p.own_scores").alias("positive_score"))
    top = own.withColumn("k", best(["anchor_id"], "positive_score", "positive_id")).where(F.col("k") <= positives).drop("k")
    # Up to `positives` an anchor, so its windows are one short row.
    windows = written(top.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("w")))
    pairs = found.where(F.size("ids") > 0).select("anchor_id", F.arrays_zip("ids", "scores").alias("others")).join(windows, "anchor_id").select("anchor_id", "others", F.explode("w").alias("p"))
    score = F.col("p.positive_score")
    within = lambda x: (x["scores"] * high >= score * low) & (x["scores"] <= score)
    # A tile's rows come best first, so its first in the window are its best.
    first = F.slice(F.filter("others", within), 1, negatives)
    each = pairs.select("anchor_id", F.col("p.positive_id").alias("positive_id"), score.alias("positive_score"), F.explode(first).alias("x"))
    flat = each.select("anchor_id", "positive_id", "positive_score", F.col("x.ids").alias("negative_id"), F.col("x.scores").alias("negative_score"))
    ranked = flat.withColumn("rank", best(["anchor_id", "positive_id"], "negative_score", "negative_id")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13(embeddings: DataFrame) -> DataFrame:
    """The contract's anchors (ids divisible by 100) and labels (shifted where 7 divides the id). Odd rows as in `mined`."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mined(embeddings, F.col("vec_id") % 100 == 0, label)
