"""Quality classifier by weak labels: heuristic labellers, EM over their votes, a hashed linear scorer.

Labellers look at one trait each and vote good, bad or not at all; they overlap and err. Their votes are counted over all
documents, pattern by pattern (at most 3^labellers rows reach the driver), and expectation-maximisation estimates how
often each labeller is right on good and on bad documents, and how many are bad. A pattern's posterior is the soft label
of its documents. On a bounded, hash-chosen sample (`FIT_ROWS`), a logistic scorer learns these labels from hashed
features that the labellers don't look at as such: words, how often words recur, and the shapes of tokens. It scores every document from its
whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

#: Documents on which the scorer is fitted, at most; chosen by a hash of their id.
FIT_ROWS = 4_000
#: Hashed features.
DIMENSIONS = 1 << 16
#: Documents that score below are rejected.
KEEP = 0.5
LABELLERS = ("symbols", "capitals", "trigrams", "loose_marks", "lines", "letters", "vocabulary", "lengths", "function_words")
#: Token shapes, and words, that are remembered per task.
REMEMBERED = 100_000
#: Frequent words of English, German, French and Spanish, as they are and capitalised.
FUNCTION_WORDS = tuple(
    form.encode()
    for w in (
        "a an and are as at be by for from in is it of on or that the this to was with "
        "auf das dem den der des die ein eine für im ist mit nicht und von zu "
        "au aux avec ce dans elle en est et il la le les ne par pas pour que qui un une "
        "como con del el las los más no para por se su sus una y"
    ).split()
    for form in (w, w.capitalize())
)
ZEROS = (0,) * len(FUNCTION_WORDS)

_SHAPE = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b for b in range(256))


def _squeezed(shape: bytes) -> bytes:
    """Runs of one class, twice at most, so that `word!!` and `word!` differ but lengths don't matter."""
    out = bytearray()
    for c in shape:
        if len(out) < 2 or out[-1] != c or out[-2] != c:
            out.append(c)
    return bytes(out[:12])


def _vote(value: float, good: float, bad: float) -> int:
    """Good on its side of `good`, bad beyond `bad`, else no vote."""
    return (1 if value <= good else -1 if value >= bad else 0) if good < bad else (1 if value >= good else -1 if value <= bad else 0)


class Reader:
    """Votes and hashed features of a text; remembers what token shapes are like, and buckets of words."""

    def __init__(self) -> None:
        self.seen: dict[bytes, tuple[int, bool, bool]] = {}
        self.buckets: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        if len(self.buckets) >= REMEMBERED:
            self.buckets.clear()
        found = self.buckets[word] = zlib.crc32(b"word:" + word.lower()) % DIMENSIONS
        return found

    def _shape(self, shape: bytes) -> tuple[int, bool, bool]:
        """Bucket of a token's shape, whether marks stand in a row, and whether there are only marks."""
        marks = [c not in b"Aa9" for c in shape]
        known = (zlib.crc32(b"shape:" + _squeezed(shape)) % DIMENSIONS, any(a and b for a, b in zip(marks, marks[1:], strict=False)), all(marks))
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[shape] = known
        return known

    def read(self, text: bytes | None, features: bool = True) -> tuple[tuple[int, ...], dict[int, float]]:
        """One vote per labeller, and features; texts of few words get few votes, and those without words none."""
        words = text.split() if text else []
        if not words:
            return (0,) * len(LABELLERS), {}
        n, counts, seen = len(words), Counter(words), self.seen
        shaped = text.translate(_SHAPE)
        shapes: dict[int, int] = {}
        rows = loose = 0
        for shape, c in Counter(shaped.split()).items():  # shapes are few, so the work is in the counting
            bucket, in_row, only = seen.get(shape) or self._shape(shape)
            shapes[bucket] = shapes.get(bucket, 0) + c
            rows += c * in_row
            loose += c * only
        upper = shaped.count(b"A")
        letters = upper + shaped.count(b"a")
        lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
        values = {
            "symbols": rows / n,
            "capitals": upper / max(1, letters),
            "trigrams": max(0.0, 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2)),
            "loose_marks": loose / n,
            "lines": 1 - len(set(lines)) / len(lines),
            "letters": letters / sum(map(len, words)),
            "vocabulary": 1 - len(counts) / n,
            "lengths": abs(len(text) / n - 6),
            "function_words": sum(map(counts.get, FUNCTION_WORDS, ZEROS)) / n,
        }
        enough = n >= 16
        votes = (
            _vote(values["symbols"], 0.02, 0.2) if enough else 0,
            _vote(values["capitals"], 0.2, 0.5) if enough else 0,
            _vote(values["trigrams"], 0.1, 0.3) if n >= 20 else 0,
            _vote(values["loose_marks"], 0.05, 0.2) if enough else 0,
            _vote(values["lines"], 0.1, 0.3) if len(lines) >= 4 else 0,
            _vote(values["letters"], 0.9, 0.75) if enough else 0,
            _vote(values["vocabulary"], 0.45, 0.7) if 20 <= n <= 2000 else 0,
            _vote(values["lengths"], 3, 6) if n >= 20 else 0,
            # Other languages than those of the list get no vote rather than a bad one: their counts are all zero.
            _vote(values["function_words"], 0.15, 0.08) if n >= 50 and values["function_words"] else 0,
        )
        if not features:
            return votes, {}
        get, own = self.buckets.get, self._word
        for w, c in counts.items():
            bucket = get(w)
            if bucket is None:
                bucket = own(w)
            shapes[bucket] = shapes.get(bucket, 0) + c
        # How often words recur, in a text of that size.
        for c, distinct in Counter(counts.values()).items():
            bucket = zlib.crc32(b"times:%d:%d" % (c.bit_length(), n.bit_length())) % DIMENSIONS
            shapes[bucket] = shapes.get(bucket, 0) + c * distinct
        return votes, {b: math.sqrt(c / n) for b, c in shapes.items()}


def _binary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def vote_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[tuple[int, ...], int]:
    """How many documents have each pattern of votes, over all of docs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(), Counter()
        for b in parts:
            counts.update(reader.read(t, False)[0] for t in b.column(1).to_pylist())
        yield pa.record_batch([pa.array([list(k) for k in counts], pa.list_(pa.int8())), pa.array(list(counts.values()), pa.int64())], names=["votes", "n"])

    counted = _binary(docs, id_col, text_col).mapInArrow(run, "votes array<byte>, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return {tuple(r["votes"]): r["n"] for r in counted.collect()}


class LabelModel:
    """Accuracies of the labellers by EM; a labeller that doesn't vote says nothing."""

    def __init__(self, counts: dict[tuple[int, ...], int], rounds: int = 100) -> None:
        votes = np.array(sorted(counts), np.int8).reshape(-1, len(LABELLERS))
        n = np.array([counts[tuple(v)] for v in votes.tolist()], float)
        good, bad = (votes == 1).astype(float), (votes == -1).astype(float)
        # To begin with, a bad vote counts more than a good one: labellers see one trait each and most traits are fine.
        p = np.where(bad.any(axis=1), 0.9, 0.05) if len(votes) else np.zeros(0)
        total = max(1.0, n.sum())
        self.prior = 0.1
        self.right = np.full((2, len(LABELLERS)), 0.8)  # chance of a bad vote on bad documents, of a good one on good ones
        for _ in range(rounds):
            w = np.stack([n * p, n * (1 - p)])
            # A weak prior (a hundredth of the votes) keeps a labeller that never votes from being sure of anything.
            strength = 0.01 * total
            self.right[0] = (w[0] @ bad + 0.6 * strength) / (w[0] @ (bad + good) + strength)
            self.right[1] = (w[1] @ good + 0.95 * strength) / (w[1] @ (bad + good) + strength)
            self.prior = float((w[0].sum() + 1) / (total + 10))
            p = self._bad(good, bad)
        self.posterior = dict(zip(map(tuple, votes.tolist()), p.tolist(), strict=True))

    def _bad(self, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        right = np.clip(self.right, 1e-3, 1 - 1e-3)
        odds = math.log(self.prior / (1 - self.prior)) + bad @ np.log(right[0] / (1 - right[1])) + good @ np.log((1 - right[0]) / right[1])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(rows: list[tuple[float, list[int], list[float]]], rounds: int = 200, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for rows (probability of good, buckets, values), by Adam on all rows."""
    weights = np.zeros(DIMENSIONS + 1)
    weights[-1] = 2.0
    if not rows:
        return weights[:-1], 2.0
    y = np.array([r[0] for r in rows])
    row = np.concatenate([np.full(len(r[1]) + 1, k) for k, r in enumerate(rows)])
    col = np.concatenate([np.array([*r[1], DIMENSIONS], np.int64) for r in rows])
    val = np.concatenate([np.array([*r[2], 1.0]) for r in rows])
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights[col] * val, len(rows))
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, err[row] * val, DIMENSIONS + 1) / len(rows) + ridge * weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weights[:-1], float(weights[-1])


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, np.ndarray, float]:
    """The label model over all documents, and the scorer on at most fit_rows of them."""
    model = LabelModel(vote_counts(docs, id_col, text_col))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id", F.lit(11)), "id").limit(fit_rows)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in parts:
            read = [reader.read(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([pa.array([list(v) for v, _ in read], pa.list_(pa.int8())), pa.array([list(f) for _, f in read], pa.list_(pa.int32())), pa.array([list(f.values()) for _, f in read], pa.list_(pa.float64()))], names=["votes", "at", "value"])

    picked = _binary(docs, id_col, text_col)
    # Of several texts of an id that with the smallest hash counts, so that reruns agree.
    once = picked.join(ids, picked["doc_id"] == ids["id"], "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = once.mapInArrow(run, "votes array<byte>, at array<int>, value array<double>").collect()
    # The sample comes from the same documents, so each of its patterns has a posterior. Sorted, for the sum of floats.
    data = sorted((1 - model.posterior[tuple(r["votes"])], list(r["at"]), list(r["value"])) for r in rows)
    return model, *fit(data)


def scored(docs: DataFrame, fit_rows: int = FIT_ROWS, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, and its name: a struct of votes, weak (the label model's probability of good), score and keep.

    Null, empty and wordless texts get the scorer's bias and no votes; texts of any length are read whole. Rows are
    judged each on its own, so repeats and ties are judged alike; an empty table gives an empty one. Columns of docs may
    have any names. Only the text goes to Python, and only the judgement comes back.
    """
    model, weights, bias = train(docs, fit_rows, id_col, text_col)
    posterior, prior = model.posterior, model.prior
    kind = T.StructType.fromDDL("votes array<byte>, weak double, score double, keep boolean")
    types = (pa.list_(pa.int8()), pa.float64(), pa.float64(), pa.bool_())

    @F.arrow_udf(kind)
    def judge(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader()
        for a in parts:
            rows = []
            for t in a:
                v, f = reader.read(t.as_py())
                z = bias + sum(weights[k] * x for k, x in f.items())
                score = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                rows.append((list(v), 1 - posterior.get(v, prior), score, score >= keep))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=kind.names)

    (name,) = unused(docs.columns, "quality")
    return docs.withColumn(name, judge(F.col(text_col).cast("binary"))), name


def kept(docs: DataFrame, **more) -> DataFrame:
    """The documents that aren't rejected; same columns. Odd rows as in `scored`."""
    out, name = scored(docs, **more)
    return out.where(F.col(name)["keep"]).select(*docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    """Per document: votes, the label model's probability of good, score, keep. Odd rows as in `scored`."""
    out, name = scored(docs.select("doc_id", "text"))
    q = F.col(name)
    return out.select("doc_id", q["votes"].alias("votes"), F.round(q["weak"], 6).alias("weak"), F.round(q["score"], 6).alias("score"), q["keep"].alias("keep"))
