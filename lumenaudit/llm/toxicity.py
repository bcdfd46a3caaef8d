"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes.

Fitting. Of the labelled documents that may be learnt from, at most `FIT_ROWS` are taken by a hash of their id. Terms are
all their words and, since a stem has many endings, those beginnings of words that stand in toxic examples far more often
than chance allows (chi-square); terms that do weigh `BOOST` times as much. Document frequencies are counted over all
documents. A text is its TF-IDF vector over all its terms; a word that no example holds has no posting, but counts in the norm as one that no document holds.
Examples of equal vectors share an entry with their votes. Entries are sorted by their heaviest term and cut into
blocks; a term's postings are stored block by block, with the block's largest weight (those of very common terms as
rows of a matrix, which holds the same weights).

Scoring. What the matrix gives is computed for many texts at once; it is a lower bound of every cosine, and its k-th best
is a floor. With the largest weights of the other terms it also gives each block an upper bound, and only blocks whose
bound reaches the floor are visited. No other block can hold a neighbour, so the neighbours are exact. Votes count by
1 / (1.05 - cosine). The vote is set against what it would have been on the examples, each left out of its own vote
(isotonic regression), and that calibrated share is the score.

The index is bounded by FIT_ROWS and FIT_WORDS whatever the corpus, so it is sent to every task.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, alnum_words, dropped, written

#: Labelled documents that are learnt from, at most, and words of them.
FIT_ROWS, FIT_WORDS = 4_000, 4_000_000
#: How much more a term weighs that speaks for toxicity.
BOOST = 3.0
#: Such a term must stand in so many toxic examples and this share of them, exceed this chi-square, and be so many times
#: likelier in them. Near copies of an example don't count again, or their every word would seem to speak for its label.
LEAST_DF, LEAST_SHARE, LEAST_CHI2, LEAST_LIFT = 3, 0.02, 12.0, 2.5
NEIGHBOURS, BLOCK = 24, 64
#: A term that stands in over this share of the entries is a row of the matrix.
COMMON = 1 / 16
#: Bytes of the matrix, at most.
MATRIX_BYTES = 64 << 20
#: Texts that are searched for at a time.
BATCH = 64
#: Weight of the base rate in a vote, in examples.
SMOOTH = 0.5
TOXIC_AT = 0.3
#: Lengths of beginnings that may be terms.
STEMS = (4, 5, 6)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each begin up to its end, one range after another."""
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Terms:
    """Numbers of the terms that a word stands for: itself and its known beginnings."""

    def __init__(self, words: dict[bytes, int], stems: dict[bytes, int]) -> None:
        self.words, self.stems = words, stems
        self.heads = {s[: min(STEMS)] for s in stems}  # bytes by which most words are seen to have no known beginning

    def distinct(self, text: bytes | None) -> list[int]:
        """The known terms of a text, each once."""
        found, heads, length = set(alnum_words(text)), self.heads, min(STEMS)
        out = [self.words[w] for w in filter(self.words.__contains__, found)]
        stems = {self.stems[s] for w in found if w[:length] in heads for s in beginnings(w) if s in self.stems}
        return [*out, *stems]

    def counts(self, text: bytes | None) -> tuple[dict[int, int], list[int]]:
        """Counts of known terms, and of each word that is none."""
        words, heads, length = self.words, self.heads, min(STEMS)
        out: dict[int, int] = {}
        stems: dict[int, int] = {}
        rest: list[int] = []
        for w, c in Counter(alnum_words(text)).items():
            if w in words:
                out[words[w]] = c
            else:
                rest.append(c)
            if w[:length] in heads:
                for s in beginnings(w):
                    if s in self.stems:
                        stems[self.stems[s]] = stems.get(self.stems[s], 0) + c
        return out | stems, rest


def beginnings(word: bytes) -> list[bytes]:
    if word.isascii():
        return [word[:n] for n in STEMS if len(word) >= n]
    w = word.decode("utf-8", "replace")
    return [w[:n].encode() for n in STEMS if len(w) >= n]


class BlockMaxIndex:
    """Postings by term and block, and each block's largest weight of the term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> None:
        """vectors: term numbers and weights of each entry."""
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
        entry = np.repeat(np.arange(self.size), [len(v[0]) for v in vectors])
        held = np.bincount(term, minlength=terms)
        common = np.flatnonzero(held > max(BLOCK, COMMON * self.size))
        # The most frequent ones, as far as the matrix may grow; the others are postings like any.
        most = MATRIX_BYTES // (8 * BLOCK * max(1, self.blocks))
        common = np.sort(common[np.argsort(-held[common], kind="stable")][:most])
        self.row = np.full(terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.blocks * BLOCK))
        many = self.row[term] >= 0
        self.matrix[self.row[term[many]], entry[many]] = weight[many]
        self.matrix_max = self.matrix.reshape(len(common), self.blocks, BLOCK).max(axis=2) if len(common) else np.zeros((0, self.blocks))
        term, weight, entry = term[~many], weight[~many], entry[~many]
        order = np.lexsort((entry, term))
        term, self.weight, self.entry = term[order], weight[order], entry[order].astype(np.int32)
        block = self.entry // BLOCK
        begin = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.begin = np.r_[begin, len(term)]  # of every list of a term in a block
        self.block = block[begin].astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, begin) if len(term) else np.zeros(0)
        self.lists = np.searchsorted(term[begin], np.arange(terms + 1))  # a term's lists

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (of length 1): cosines and numbers of the k entries of highest positive cosine, ties to the smaller number."""
        if not self.size:
            return [(np.zeros(0), np.zeros(0, np.int64))] * len(vectors)
        dense = np.zeros((len(vectors), len(self.matrix)))
        for q, (term, weight) in zip(dense, vectors, strict=True):
            rows = self.row[term]
            q[rows[rows >= 0]] = weight[rows >= 0]
        started = dense @ self.matrix
        return [self._best(s, term, weight, k) for s, (term, weight) in zip(started, vectors, strict=True)]

    def _best(self, scores: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """scores: what the terms of the matrix give each entry, and thus a lower bound of its cosine."""
        rare = self.row[term] < 0
        begin, end = self.lists[term[rare]], self.lists[term[rare] + 1]
        lists, w = _ranges(begin, end), np.repeat(weight[rare], end - begin)
        block = self.block[lists]
        # k entries have at least the k-th best of what is known, so a block whose bound is below that holds no neighbour.
        if self.size > k:
            bound = np.bincount(block, w * self.most[lists], self.blocks) + scores.reshape(self.blocks, BLOCK).max(axis=1)
            own = (bound >= np.partition(scores, -k)[-k] - 1e-9)[block]
            lists, w = lists[own], w[own]
        begin, end = self.begin[lists], self.begin[lists + 1]
        at = _ranges(begin, end)
        scores += np.bincount(self.entry[at], np.repeat(w, end - begin) * self.weight[at], len(scores))
        scores = scores[: self.size]
        best = np.flatnonzero(scores > (np.partition(scores, -k)[-k] - 1e-8 if self.size > k else 0))
        cosines = np.round(scores[best], 9)
        best, cosines = best[cosines > 0], cosines[cosines > 0]
        order = np.argsort(-cosines, kind="stable")[:k]
        return np.minimum(1.0, cosines[order]), best[order]


def isotonic(x: list[float], y: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The increasing function nearest to y: mean x and value of its steps (pool adjacent violators)."""
    total: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for a, b in zip(x, y, strict=True):
        total[a][0] += b
        total[a][1] += 1
    pools: list[list[float]] = []
    for a in sorted(total):
        pools.append([a * total[a][1], *total[a]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            q = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], q, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """Examples, their index and the calibration, which `calibrate` sets."""

    def __init__(self, idf: np.ndarray, unseen: float, ids: list[int], labels: list[int], counts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> None:
        """counts: numbers of an example's terms, and how often it has each; unseen: the weight of a word that is no term."""
        self.idf, self.unseen, self.k = idf, unseen, k
        entries: dict[bytes, list] = {}
        empty = [0, 0]
        for i, label, own in sorted(zip(ids, labels, counts, strict=True), key=lambda e: e[0]):
            term, weight = self.vector(*own, [])
            if not len(term):
                empty = [empty[0] + label, empty[1] + 1]
                continue
            e = entries.setdefault(xxhash.xxh3_128_digest(term.tobytes() + np.round(weight, 9).tobytes()), [term, weight, 0, 0, []])
            e[2], e[3] = e[2] + label, e[3] + 1
            e[4].append(i)
        order = sorted(entries.values(), key=lambda e: (int(e[0][np.argmax(e[1])]), e[4][0]))
        self.toxic, self.many = np.array([e[2] for e in order], float), np.array([e[3] for e in order], float)
        self.ids = [e[4][:3] for e in order]
        self.of = {i: n for n, e in enumerate(order) for i in e[4]}
        self.index = BlockMaxIndex([(e[0], e[1]) for e in order], len(idf))
        self.base = sum(labels) / max(1, len(labels))
        self.none = (empty[0] + SMOOTH * self.base) / (empty[1] + SMOOTH)
        self.steps, self.values = np.zeros(1), np.full(1, self.base)

    def vector(self, term: np.ndarray, count: np.ndarray, rest: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms by number and their weights; words that aren't terms only lengthen the vector."""
        weight = (1 + np.log(count)) * self.idf[term]
        beyond = (1 + np.log(np.array(rest, float))) * self.unseen if rest else np.zeros(1)
        norm = math.sqrt(float(weight @ weight + beyond @ beyond))
        order = np.argsort(term)
        return term[order], weight[order] / (norm or 1.0)

    def vote(self, cosines: np.ndarray, entries: np.ndarray, out: int = -1, label: int = 0) -> float:
        """Share of toxic votes; of entry `out`, one example of that label doesn't vote."""
        w, own = 1 / (1.05 - cosines), (entries == out).astype(float)
        top = SMOOTH * self.base + w @ (self.toxic[entries] - label * own)
        return float(top / (SMOOTH + w @ (self.many[entries] - own)))

    def near(self, terms: Terms, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The neighbours of each text; none for one without known terms."""
        vectors = []
        for t in texts:
            counts, rest = terms.counts(t)
            vectors.append(self.vector(np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts)), rest))
        return [n for at in range(0, len(vectors), BATCH) for n in self.index.nearest(vectors[at : at + BATCH], self.k)]

    def calibrate(self, votes: list[tuple[float, int]]) -> None:
        if votes:
            self.steps, self.values = isotonic([round(v, 9) for v, _ in votes], [float(label) for _, label in votes])

    def scores(self, terms: Terms, texts: list[bytes | None]) -> list[tuple[float, list[int], float]]:
        """Of each text: score, ids of the nearest examples, and the best cosine."""
        out = []
        for cosines, entries in self.near(terms, texts):
            if len(entries):
                value = float(np.interp(round(self.vote(cosines, entries), 9), self.steps, self.values))
                out.append((value, [i for e in entries[:5].tolist() for i in self.ids[e]][:5], float(cosines[0])))
            else:
                out.append((self.none, [], 0.0))
        return out


def held_out(c: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def speaking(labels: np.ndarray, terms: list[np.ndarray], size: int) -> np.ndarray:
    """Which terms speak for toxicity, of examples' labels and term numbers (each once; below 0 is none)."""
    held = np.zeros((2, size))
    for label, own in zip(labels.tolist(), terms, strict=True):
        held[label, own[own >= 0]] += 1
    n1, n0 = float((labels == 1).sum()), float((labels == 0).sum())
    b, a = held
    n = n1 + n0
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n - a - b + 1e-9) * n1 * n0)
        lift = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    return (a >= max(LEAST_DF, LEAST_SHARE * n1)) & (chi2 >= LEAST_CHI2) & (lift >= LEAST_LIFT) & (n0 > 0)


def speaking_stems(vocabulary: list[bytes], labels: np.ndarray, words: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    """Beginnings of words that speak for toxicity, sorted, and of each word their numbers, or -1."""
    number: dict[bytes, int] = {}
    of = np.full((len(vocabulary), len(STEMS)), -1, np.int32)
    for w, word in enumerate(vocabulary):
        for k, s in enumerate(beginnings(word)):
            of[w, k] = number.setdefault(s, len(number))
    chosen = speaking(labels, [np.unique(of[own]) for own in words], len(number))
    names = np.array(list(number), object)[chosen] if len(number) else np.zeros(0, object)
    rank = np.full(len(number) + 1, -1)  # its last place is that of -1, no beginning
    rank[np.flatnonzero(chosen)[np.argsort(names)]] = np.arange(len(names))
    return sorted(names), rank[of]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_words: int = FIT_WORDS, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> tuple[Model, Broadcast]:
    """The model, and the numbers of its terms as executors have them. learn: which labels may be learnt from (default: those whose id isn't held out).

    Labels without an id, and other values than 0 and 1, are left out; of several labels of an id the highest counts,
    of several texts that with the smallest hash, and an id without text is an empty text. An example that would bring the
    sample above fit_words words is passed over.
    """
    usable = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = usable.where(~held_out(F.col("doc_id")) if learn is None else learn).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # Labels may name documents that aren't there, so the sample is drawn from those that are.
    there = usable.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = there.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(fit_rows)
    rows = written(texts.join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    # What the driver gathers is bounded in words, too: examples are taken in the sample's order while they fit.
    sizes = rows.select("doc_id", F.xxhash64("doc_id", F.lit(5)).alias("h"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(ALNUM)), F.lit(0)).alias("n")).collect()
    total, long = 0, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if total + r["n"] > fit_words:
            long.append(r["doc_id"])
        else:
            total += r["n"]
    rows = rows.where(~F.col("doc_id").isin(long)) if long else rows

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            words = [alnum_words(t) for t in b.column(2).to_pylist()]
            counts = [Counter(w) for w in words]
            # Near copies mostly share the smallest hash of their five-word shingles.
            least = [min((xxhash.xxh64_intdigest(b" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))), default=0) >> 1 for w in words]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())), pa.array(least, pa.int64())], names=["doc_id", "label", "words", "n", "least"])

    # As Arrow, not as objects: the driver holds some tens of bytes per word of an example.
    found = rows.mapInArrow(count, "doc_id long, label int, words array<binary>, n array<int>, least long").toArrow().sort_by("doc_id").combine_chunks()
    listed, many = (found.column(c).combine_chunks() if found.num_rows else pa.array([], t) for c, t in (("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int32()))))
    ids, labels_, least = found.column("doc_id").to_pylist(), found.column("label").to_numpy(), found.column("least").to_numpy()
    vocabulary = pc.unique(listed.flatten())
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
    number = pc.index_in(listed.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.r_[0, np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))].astype(np.int64)
    often = many.flatten().to_numpy(zero_copy_only=False).astype(float)
    words = [number[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    once = sorted({(label, x): k for k, (label, x) in reversed(list(enumerate(zip(labels_.tolist(), least.tolist(), strict=True))))}.values())
    names = vocabulary.to_pylist()
    own = [words[k] for k in once]
    stems, stem_of = speaking_stems(names, labels_[once], own)
    boost = np.r_[np.where(speaking(labels_[once], own, len(names)), BOOST, 1.0), np.full(len(stems), BOOST)]
    size = len(names) + len(stems)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(({w: n for n, w in enumerate(names)}, {t: len(names) + n for n, t in enumerate(stems)}))
    del found, listed, many, vocabulary, names

    def frequency(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, read = Counter(), 0, Terms(*known.value)
        for b in parts:
            for t in b.column(0).to_pylist():
                counts.update(read.distinct(t))
                n += 1
        yield pa.record_batch([pa.array([-1, *counts], pa.int32()), pa.array([n, *counts.values()], pa.int64())], names=["term", "n"])

    seen = texts.select("text").mapInArrow(frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1)  # its last place is that of term -1, the number of documents
    df[seen.column("term").to_numpy()] = seen.column("n").to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * boost

    def counted(k: int) -> tuple[np.ndarray, np.ndarray]:
        own, n = words[k], often[cuts[k] : cuts[k + 1]]
        at = stem_of[own]
        hits = np.bincount(at[at >= 0], np.repeat(n, len(STEMS)).reshape(at.shape)[at >= 0], len(stems)) if len(stems) else np.zeros(0)
        extra = np.flatnonzero(hits)
        return np.concatenate([own, extra + size - len(stems)]), np.concatenate([n, hits[extra]])

    model = Model(idf, math.log(1 + df[-1]) + 1, ids, labels_.tolist(), [counted(k) for k in range(len(ids))])
    sent = spark.sparkContext.broadcast(model)

    def leave_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(*known.value)
        for b in parts:
            near = sent.value.near(terms, b.column(2).to_pylist())
            votes = [sent.value.vote(*n, sent.value.of[i], label) if len(n[1]) else None for i, label, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), near, strict=True)]
            yield pa.record_batch([pa.array(votes, pa.float64()), b.column(1)], names=["vote", "label"])

    spread = max(1, min(64, -(-len(ids) // 100)))
    model.calibrate([(r["vote"], r["label"]) for r in rows.repartition(spread).mapInArrow(leave_out, "vote double, label int").where("vote is not null").collect()])
    sent.unpersist()
    dropped(rows)
    return model, known


def scored(docs: DataFrame, model: Model, known: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, cosine of the nearest entry, evidence (ids of the nearest examples).

    Null, empty and wordless texts, and texts of none of the examples' words, get the base rate, drawn to that of empty
    examples. Texts of any length are read whole. Ties between neighbours go to the earlier entry. Rows are scored each
    on its own, so repeats get equal scores; other columns of docs are not read; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(*known.value)
        for b in parts:
            out = sent.value.scores(terms, b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array([s for s, _, _ in out], pa.float64()), pa.array([c for _, _, c in out], pa.float64()), pa.array([e for _, e, _ in out], pa.list_(pa.int64()))], names=["doc_id", "score", "cosine", "evidence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, cosine double, evidence array<long>")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and cosine and evidence; `train` and `scored` say what becomes of odd rows."""
    out = scored(docs, *train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), "cosine", "evidence")
