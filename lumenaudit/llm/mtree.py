"""Exact top-k by inner product: paged M-trees, searched best-first.

The inner product is no metric, so vectors get one more component, sqrt(M^2 - |v|^2) with M the largest norm, and queries
a zero: then |q - v|^2 = |q|^2 + M^2 - 2 q.v, and the nearest by distance are the highest by product. Products are exact
integers; distances serve only as bounds, with slack for rounding, so ties are never pruned.

Layout. Up to `PIVOTS` sampled vectors route every vector to its nearest; a pivot's vectors are dealt by a hash into
shards of about `SHARD` (many equal vectors thus make many shards, not a large one), and each shard becomes one M-tree:
a row of bytes, whatever the size of the table.

Search. A query ranks the shards by the least distance that their pivot's covering radius allows and visits them in that
order, 1, 4, 16, ... shards a round. After a round its k-th best score is the floor for the next, and shards that cannot
reach it are left out, query by query. So where vectors have structure most shards are never visited, and where they
have none, as in independent random ones, every shard must be, but only few rows of each come back. In a round every
tree is loaded once per `ASKED` queries, which stream past it.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Pivots at most, vectors a pivot at least, vectors that floors begin with, and vectors a shard.
PIVOTS, PER_PIVOT, SAMPLE, SHARD = 256, 2048, 1024, 16_384
#: Queries that one copy of a tree serves in a round, and that are searched for at a time.
ASKED, BLOCK = 16_384, 512
#: Shards that a query visits in a round, as a multiple of those of the round before.
WIDER = 4
#: Entries in a leaf page, children in an inner page.
LEAF, FAN = 256, 16


def scaled(c: Column, factor: int = 64) -> Column:
    return F.transform(c, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def usable(c: Column) -> Column:
    """Not null, without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(c, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False))), F.lit(False))


def lifted(v: np.ndarray, m2: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, m2 - (v * v).sum(axis=1)))])


def _gap(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = points - to
    return np.sqrt((d * d).sum(axis=-1))


class MTree:
    """nodes: (leaf?, member or routing indices, distances to the parent's routing object, covering radii, child nodes)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m2: float, root: np.ndarray) -> None:
        """root: the lifted pivot, the routing object above the tree."""
        self.ids, self.vectors, self.m2, self.root = ids, vectors, m2, root
        self.points = lifted(vectors, m2)
        self.nodes: list[tuple] = []
        d = _gap(self.points, root)
        self.radius = float(d.max())
        self.top = self._build(np.arange(len(ids)), d)

    def _build(self, at: np.ndarray, d: np.ndarray) -> int:
        if len(at) <= LEAF:
            self.nodes.append((True, at, d, None, None))
            return len(self.nodes) - 1
        route = at[np.linspace(0, len(at) - 1, FAN).astype(int)]
        apart = np.stack([_gap(self.points[at], self.points[r]) for r in route], axis=1)
        own = apart.argmin(axis=1)
        if (own == own[0]).all():  # copies: cut into pages that share a routing object
            own, route, apart = np.arange(len(at)) // LEAF, np.repeat(route[own[0]], -(-len(at) // LEAF)), np.repeat(apart[:, own[:1]], -(-len(at) // LEAF), axis=1)
        groups = [(r, np.flatnonzero(own == k), k) for k, r in enumerate(route) if (own == k).any()]
        parts = [(r, at[g], apart[g, k]) for r, g, k in groups]
        up = {int(a): float(x) for a, x in zip(at, d, strict=True)}
        me = len(self.nodes)
        self.nodes.append(())
        children = [self._build(a, x) for _, a, x in parts]
        self.nodes[me] = (False, np.array([r for r, _, _ in parts]), np.array([up[int(r)] for r, _, _ in parts]), np.array([x.max() for _, _, x in parts]), children)
        return me

    def __getstate__(self) -> dict:
        """Without the lifted points, which follow from the vectors, and with these in as few bytes as hold them."""
        most = int(np.abs(self.vectors).max(initial=0))
        small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
        return self.__dict__ | {"points": None, "vectors": self.vectors.astype(small)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.vectors = self.vectors.astype(np.int64)
        self.points = lifted(self.vectors, self.m2)

    def search(self, queries: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best here of each query, but for its own id; none below its floor.

        Best-first for a block of queries at once: the node with the least lower bound of any query comes next, with the
        queries that it can still serve; each query keeps its own bound.
        """
        point = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
        reach = (point**2).sum(axis=1) + self.m2
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * max(1, q.shape[1]) < 2**53
        v, as_q = (self.vectors.astype(np.float64), q.astype(np.float64)) if exact else (self.vectors, q)
        slack = 1e-9 * (1 + np.sqrt(reach))
        least = floor.astype(np.float64).copy()  # a k-th best so far, or the floor
        top = np.full((len(q), k), -math.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def limit(of: np.ndarray) -> np.ndarray:
            return np.where(np.isinf(least[of]), math.inf, np.sqrt(np.maximum(0.0, reach[of] - 2 * np.where(np.isinf(least[of]), 0, least[of]))) + slack[of])

        bound = limit(np.arange(len(q)))
        away = _gap(point, self.root)
        low = np.maximum(0.0, away - self.radius)
        heap, serial = [(float(low.min(initial=0)), 0, self.top, np.arange(len(q)), away, low)], 0
        while heap:
            _, _, node, own, away, low = heapq.heappop(heap)
            open_ = low <= bound[own]
            own, away = own[open_], away[open_]
            if not len(own):
                continue
            leaf, at, up, radii, children = self.nodes[node]
            # What the stored distance to the parent's routing object rules out costs no computation.
            fit = np.abs(away[:, None] - up[None, :]) - (0 if leaf else radii[None, :]) <= bound[own][:, None]
            some = np.flatnonzero(fit.any(axis=0))
            if not len(some):
                continue
            if leaf:
                ids = self.ids[at[some]]
                scores = as_q[own] @ v[at[some]].T
                scores = np.where(queries[own][:, None] == ids[None, :], -math.inf, scores.astype(np.float64)) if exact else np.where(queries[own][:, None] == ids[None, :], np.iinfo(np.int64).min, scores)
                r, c = np.nonzero((scores >= least[own][:, None]) & (queries[own][:, None] != ids[None, :]))
                found.append((own[r], ids[c], scores[r, c].astype(np.int64)))
                hit = np.unique(r)
                if len(hit):
                    top[own[hit]] = np.partition(np.concatenate([top[own[hit]], scores[hit].astype(np.float64)], axis=1), -k, axis=1)[:, -k:]
                    least[own[hit]] = np.maximum(least[own[hit]], top[own[hit]].min(axis=1))
                    bound[own[hit]] = limit(own[hit])
                continue
            d = np.sqrt(((point[own][:, None, :] - self.points[at[some]][None, :, :]) ** 2).sum(axis=-1))
            for j, c in enumerate(some.tolist()):
                under = np.maximum(0.0, d[:, j] - radii[c])
                go = fit[:, c] & (under <= bound[own])
                if go.any():
                    serial += 1
                    heapq.heappush(heap, (float(under[go].min()), serial, children[c], own[go], d[go, j], under[go]))
        r, ids, scores = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        good = scores >= least[r]
        r, ids, scores = r[good], ids[good], scores[good]
        order = np.lexsort((ids, -scores, r))
        r, ids, scores = r[order], ids[order], scores[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        return queries[r[rank < k]], ids[rank < k], scores[rank < k]


def _matrix(lists: list, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(lists), width), np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


def _floors(ids: np.ndarray, q: np.ndarray, s_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query in the sample."""
    if len(s_ids) <= k:
        return np.full(len(ids), -math.inf)
    large = max(1, q.shape[1]) * float(np.abs(q).max(initial=0)) * float(np.abs(sample).max(initial=0)) >= 2**53
    scores = (q.astype(object) @ sample.T.astype(object) if large else q.astype(np.float64) @ sample.T.astype(np.float64)).astype(np.float64)
    return np.partition(np.where(ids[:, None] == s_ids[None, :], -math.inf, scores), -k, axis=1)[:, -k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64, pivots: int = PIVOTS, per_pivot: int = PER_PIVOT, shard: int = SHARD, asked: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row the k best of all other rows, by floor(factor * x) components.

    Rows with a null id or an unusable vector (null, or with null or non-finite components) take no part; an empty vector
    and any other shorter one are taken as filled with zeros. Rows that repeat an id count once, with the smallest of its
    vectors, component by component. Ties go to the smaller id. If a score might not fit 64 bits it is an error, not a wrong
    result. No rows in, no rows out; other columns are not read.
    """
    flagged = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), factor).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    every = written(flagged.groupBy("id").agg(F.min("v").alias("v"), F.max("query").alias("query")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, m2, width = every.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    n, m2, width = n, m2 or 0.0, width or 0
    if m2 >= 2**63:  # no product of two vectors, nor of parts of them, is above the square of the largest norm
        raise ValueError("components so large that scores may not fit 64 bits")
    sample = every.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    s_ids, s_vectors = np.array([r["id"] for r in sample], np.int64), _matrix([r["v"] for r in sample], width)
    centres = lifted(s_vectors[: min(pivots, max(1, -(-n // per_pivot)))], m2)
    if not n:
        return every.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))

    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            points = lifted(_matrix(b.column(1).to_pylist(), width), m2)
            apart = np.stack([_gap(points, p) for p in centres], axis=1)
            yield pa.record_batch([*b.columns, pa.array(apart.argmin(axis=1).astype(np.int32)), pa.array(apart.min(axis=1))], names=[*b.schema.names, "pivot", "away"])

    routed = written(every.mapInArrow(route, "id long, v array<long>, query boolean, pivot int, away double"))
    per = {r["pivot"]: r for r in routed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}
    shards = np.array([-(-per[p]["n"] // shard) if p in per else 0 for p in range(len(centres))])
    far = np.array([per[p]["far"] if p in per else -math.inf for p in range(len(centres))])
    before = np.cumsum(shards) - shards
    narrow = next(t for t in (np.int8, np.int16, np.int32, np.int64) if math.sqrt(m2) < np.iinfo(t).max)  # as no component is above the norm
    total = int(shards.sum())
    dealt = F.element_at(F.array(*(F.lit(int(x)) for x in before)), F.col("pivot") + 1) + F.pmod(F.xxhash64("id"), F.element_at(F.array(*(F.lit(int(max(1, x))) for x in shards)), F.col("pivot") + 1)).cast("int")

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(pdf["id"].to_numpy(np.int64), _matrix(list(pdf["v"]), width), m2, centres[int(pdf["pivot"].iloc[0])])
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tree": [pickle.dumps(tree, 5)]})

    trees = written(routed.withColumn("shard", dealt).groupBy("pivot", "shard").applyInPandas(plant, "shard int, tree binary"))

    def ask(first: int, last: int):
        """Of each query the first to last shard of its order, but for those that its floor rules out."""

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                ids, q = b.column(0).to_numpy(), _matrix(b.column(1).to_pylist(), width)
                floor = np.array([-math.inf if x is None else x for x in b.column(2).to_pylist()])
                floor = np.maximum(floor, _floors(ids, q, s_ids, s_vectors, k))
                points = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
                reach = (points**2).sum(axis=1) + m2
                bound = np.where(np.isinf(floor), math.inf, np.sqrt(np.maximum(0.0, reach - 2 * np.where(np.isinf(floor), 0, floor)))) + 1e-9 * (1 + np.sqrt(reach))
                away = np.stack([_gap(points, p) for p in centres], axis=1)
                low = np.maximum(0.0, away - far[None, :])
                order = np.argsort(np.where(shards[None, :] > 0, low + 1e-6 * away, math.inf), axis=1, kind="stable")
                own, at = [], []
                for j, o in enumerate(order):
                    upto = np.cumsum(shards[o])
                    place = np.arange(first, min(last, total))
                    slot = np.searchsorted(upto, place, side="right")
                    slot = slot[fit := low[j, o[slot]] <= bound[j]]
                    p = o[slot]
                    at.append(before[p] + (place[fit] - upto[slot] + ids[j]) % shards[p])
                    own.append(np.full(len(p), j))
                if not own or not sum(map(len, own)):
                    continue
                # Queries of a shard travel together, neighbours beside each other.
                own, at = np.concatenate(own), np.concatenate(at)
                by = np.lexsort((order[:, 0][own], at))
                own, at = own[by], at[by]
                cuts = np.flatnonzero(np.r_[True, np.diff(at) != 0])
                cuts = np.concatenate([np.arange(s, e, BLOCK) for s, e in zip(cuts, [*cuts[1:], len(at)], strict=True)])
                payload = q.astype(narrow)
                blocks = [own[s:e] for s, e in zip(cuts, [*cuts[1:], len(at)], strict=True)]
                columns = [pa.array(at[cuts].astype(np.int32)), pa.array([len(x) for x in blocks], pa.int32()), *(pa.array([v[x].tobytes() for x in blocks], pa.binary()) for v in (ids, floor, payload))]
                yield pa.record_batch(columns, names=["shard", "n", "ids", "floors", "payload"])

        return run

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held = None
        for b in parts:
            for shard_of, is_block, ids, floors, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not is_block:
                    if held != shard_of:
                        tree, held = pickle.loads(payload), shard_of
                    continue
                own = np.frombuffer(ids, np.int64)
                q = np.frombuffer(payload, narrow).reshape(len(own), width).astype(np.int64)
                found = tree.search(own, q, k, np.frombuffer(floors, np.float64))
                yield pa.record_batch([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    queries, best = routed.where("query").select("id", "v"), None
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = last = 0
    while last < total:
        first, last = last, last + WIDER ** (0 if not last else round(math.log(max(1, last - first), WIDER)) + 1)
        if best is None:
            state = queries.withColumn("floor", F.lit(None).cast("double"))
        else:
            floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            state = queries.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", F.when(F.col("n") >= k, F.col("least").cast("double")).alias("floor"))
        wanted = written(state.mapInArrow(ask(first, last), "shard int, n int, ids binary, floors binary, payload binary"))
        counted = wanted.groupBy("shard").agg(F.ceil(F.sum("n") / F.lit(asked)).cast("int").alias("parts"))
        # A shard that many queries want has a copy of its tree for each part of them.
        none = F.lit(None).cast("binary")
        copies = trees.join(counted, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), none.alias("ids"), none.alias("floors"), F.col("tree").alias("payload"))
        rows = wanted.join(counted, "shard").select("shard", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "ids", "floors", "payload")
        met = copies.union(rows).repartition(max(1, min(10_000, total)), "shard", "part").sortWithinPartitions("shard", "part", "kind").select("shard", "kind", "ids", "floors", "payload")
        found = met.mapInArrow(search, "query_id long, vec_id long, score long")
        ranked = (found if best is None else found.union(best)).withColumn("rank", rank).where(F.col("rank") <= k)
        done = best
        best = written(ranked.select("query_id", "vec_id", "score"))
        dropped(wanted, *([done] if done is not None else []))
    dropped(trees, routed, every)
    return best.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")


def op4(embeddings: DataFrame) -> DataFrame:
    """The contract's queries: ids divisible by 20. Odd rows as in `top_k`."""
    return top_k(embeddings, F.col("vec_id") % 20 == 0)
