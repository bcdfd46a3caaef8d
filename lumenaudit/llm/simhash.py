"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Blocks. Fingerprints that differ in at most d of their bits, cut into d + k blocks, agree in at least k blocks. Each
choice of k blocks is a table; two fingerprints meet in a table if they agree in its blocks. `exact_tables` picks k so
that a table's key has about as many values as there are fingerprints: no pair within d is missed, and buckets stay
small at any size; where many fingerprints agree in a block all the same, a larger k splits their bucket.
`sliced_tables` cuts a wide fingerprint into single blocks, several times over, and finds pairs far beyond that bound
almost surely; it serves where a similarity, not a Hamming distance, is asked for. The width of these blocks follows the
number of rows too. What meets there is a candidate only, and `near_links` compares the sets of shingles themselves.

Equal fingerprints are grouped before anything is joined, so a group of copies is one row. Buckets are never expanded
into pairs of rows: a task reads its buckets sorted, compares fingerprints as arrays, and emits a spanning forest.
In a large bucket, whoever is near a pivot is linked to it and compared only with what the triangle inequality leaves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, spaced_words, unused, written
from .components import roots

#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15
#: Buckets up to this many fingerprints are compared pair by pair.
SMALL = 32
#: Buckets of more fingerprints are split by wider keys, as far as these go.
BUCKET = 50_000
#: Shingle sets are near copies from this Jaccard similarity on, as a fraction.
NEAR = (4, 5)
#: Lanes of the fingerprints that find them, lanes that travel with a key, and bits of those that may differ.
NEAR_LANES, NEAR_HEAD, NEAR_DISTANCE = 8, 2, 38
#: Bits of all lanes that may differ, where all candidates of a component are compared: three deviations above the mean at NEAR.
NEAR_WHOLE = 103
#: Chance that a pair at that similarity meets in no block.
NEAR_MISS = 0.01
#: Of sets up to this size the smallest hashes are keys too: the bits of so few shingles follow no angle.
SHORT = 20


def lanes_of(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """One 64-bit hash per lane from one hash: lane 0 is the hash itself, the others are splitmix64 of it and the lane."""
    out = [hashes]
    with np.errstate(over="ignore"):
        for k in range(1, lanes):
            z = hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(words: list[bytes], shingle: int, lanes: int = 1, seed: int = 42) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give zero."""
    if not words:
        return np.zeros(lanes, np.uint64)
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    ones = np.zeros(64 * lanes, np.int64)
    while part := [h(g, seed) for g in itertools.islice(grams, CHUNK)]:
        bits = lanes_of(np.array(part, np.uint64), lanes).astype("<u8").view(np.uint8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as lanes * 8 bytes, each lane big-endian. A null text has no words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fps = [fingerprint(spaced_words(t), shingle, lanes).astype(">u8").tobytes() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def exact_tables(rows: int, distance: int, bits: int = 64, least: int = 1) -> np.ndarray:
    """Masks (tables, lanes) by which fingerprints within the distance surely meet, some 16 rows a bucket at most; of `least` blocks or more."""
    k = least
    while k < 4 and (bits * k // (distance + k)) < math.log2(max(rows, 1) / 16 + 1):
        k += 1
    blocks = np.array_split(np.arange(bits), distance + k)
    return _masks([np.concatenate(c) for c in itertools.combinations(blocks, k)], bits)


def largest_bucket(groups: DataFrame, masks: np.ndarray) -> int:
    """Of groups(fp) of one lane: the most fingerprints that share a key of a table."""
    word = F.conv(F.hex("fp"), 16, -10).cast("long")
    keys = F.array(*(F.struct(F.lit(t).alias("t"), word.bitwiseAND(F.lit(int(m[0].astype(np.int64)))).alias("key")) for t, m in enumerate(masks)))
    return groups.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def tables_for(groups: DataFrame, distance: int, bucket: int = BUCKET) -> np.ndarray:
    """Exact tables for groups(fp) of one lane, of more blocks where a bucket would be larger than that."""
    rows = groups.count()
    for least in range(1, 5):
        masks = exact_tables(rows, distance, least=least)
        if rows <= bucket or largest_bucket(groups, masks) <= bucket:
            break
    return masks


def sliced_tables(bits: int, rows: int = 0) -> np.ndarray:
    """Masks of the single blocks of a wide fingerprint, whose bits are shuffled before every cut.

    A block has 16 to 24 bits, as the rows need for small buckets, and there are as many cuts as a pair at similarity
    NEAR needs to agree in some block but for NEAR_MISS of all cases.
    """
    block = min(24, max(16, math.ceil(math.log2(max(rows, 1) / 16 + 1))))
    similarity = NEAR[0] / NEAR[1]
    agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** block
    cuts = math.ceil(math.log(NEAR_MISS) / math.log(1 - agree) / (bits // block))
    r = np.random.default_rng(8)
    return _masks([b for _ in range(cuts) for b in np.array_split(r.permutation(bits), bits // block)], bits)


def _masks(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits), np.uint8)
    for row, of in zip(out, sets, strict=True):
        row[of] = 1
    return np.packbits(out, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


class _Forest:
    """Keeps the links that join what was apart."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _middle(fp: np.ndarray) -> np.intp:
    """The fingerprint next to the majority of each bit: where many are copies of one, that one."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(fp), bitorder="little").view("<u8").astype(np.uint64)
    return np.argmin(_apart(fp, most))


def _large(fp: np.ndarray, distance: int, middle: bool = False) -> Iterator[tuple[int, int]]:
    """Links among the fingerprints of one large bucket: enough for its components, by index. middle: stars have the middle one as pivot."""
    forest, left = _Forest(), np.arange(len(fp))
    while len(left) > 1:
        at = int(_middle(fp[left])) if middle else 0
        pivot, rest = left[at], np.delete(left, at)
        d = _apart(fp[rest], fp[pivot])
        near = rest[d <= distance]
        yield from ((pivot, x) for x in near if forest.add(int(pivot), int(x)))
        left = rest[d > distance]
        ring = rest[(d > distance) & (d <= 2 * distance)]  # all that may be near a member of this star
        for x in near:
            if not len(ring):
                break
            hit = _apart(fp[ring], fp[x]) <= distance
            yield from ((x, y) for y in ring[hit] if forest.add(int(x), int(y)))
            ring = ring[~hit]


def _links(key: np.ndarray, fp: np.ndarray, distance: int, middle: bool = False) -> list[tuple[int, int]]:
    """Links, by index, among rows sorted by key; only those that a spanning forest needs."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    found: list[tuple[int, int]] = []
    for s, e in zip(starts[ends - starts > SMALL], ends[ends - starts > SMALL], strict=True):
        found += [(s + a, s + b) for a, b in _large(fp[s:e], distance, middle)]
    end = np.repeat(np.where(ends - starts > SMALL, 0, ends), ends - starts)
    at, step = np.flatnonzero(end > np.arange(len(key)) + 1), 1
    while len(at):
        hit = at[_apart(fp[at], fp[at + step]) <= distance]
        found += zip(hit, hit + step, strict=True)
        step += 1
        at = at[at + step < end[at]]
    return found


def _pairs(key: np.ndarray, fp: np.ndarray, top: np.ndarray, size: np.ndarray, shared: np.ndarray, table: np.ndarray, masks: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different tops within the distance, by index, among rows sorted by key; as many at a time as there are rows.

    size and shared: of a set of shingles, and how many of them any other set has. Two sets have no more in common than
    the smaller `shared`, so pairs that cannot reach NEAR by it are left out. Short sets may differ in more bits. A pair that meets in several tables comes
    from the first of them (a key of another kind, table -1, is the last).
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    end = np.repeat(ends, ends - starts)
    at, step = np.flatnonzero(end > np.arange(len(key)) + 1), 1
    while len(at):
        hit = at[top[at] != top[at + step]]
        hit = hit[np.minimum(shared[hit], shared[hit + step]) * sum(NEAR) >= (size[hit] + size[hit + step]) * NEAR[0]]
        short = np.minimum(size[hit], size[hit + step]) <= SHORT
        hit = hit[_apart(fp[hit], fp[hit + step]) <= np.where(short, distance * 7 // 5, distance)]
        apart = fp[hit] ^ fp[hit + step]
        new = np.ones(len(hit), bool)
        for t, mask in enumerate(masks):
            new &= ((table[hit] >= 0) & (table[hit] <= t)) | np.any(apart & mask, axis=1)
        if (hit := hit[new]).size:
            yield hit, hit + step
        step += 1
        at = at[at + step < end[at]]


def _by_key(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by `key`, cut anew so that no key is in two."""
    held: list[pd.DataFrame] = []
    for pdf in pdfs:
        if not len(pdf):
            continue
        key = pdf["key"].to_numpy()
        first, last = int(np.searchsorted(key, key[0], side="right")), int(np.searchsorted(key, key[-1], side="left"))
        if held and held[0]["key"].iloc[0] != key[0]:
            yield pd.concat(held)
            held = []
        if last == 0:  # one key, which may go on
            held.append(pdf)
            continue
        yield pd.concat([*held, pdf.iloc[:first]])
        if first < last:
            yield pdf.iloc[first:last]
        held = [pdf.iloc[last:]]
    if held:
        yield pd.concat(held)


def links(groups: DataFrame, distance: int, masks: np.ndarray, head: int | None = None, every: bool = False) -> DataFrame:
    """groups(fp, rep). (a, b) of reps, enough of them that fingerprints within the distance are connected.

    head: compare only so many lanes, which is all that travels, by default all. every: all pairs whose column `top`
    differs and whose columns `size` and `shared` allow it (see `_pairs`), not only those that connect.
    A column `low` of groups holds further keys by which a row meets others.
    """
    lanes = masks.shape[1]
    head = head or lanes
    low = ["low"] if "low" in groups.columns else []
    carry = ["top", "size", "shared"] if every else []
    extra = [*carry, "table"] if every else []
    names = ["key", *(f"f{k}" for k in range(head)), "rep", *extra]

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            words = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8").reshape(-1, lanes).astype(np.uint64)
            carried = [*(pa.array(words[:, k].view(np.int64) if lanes == 1 else np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(head)), b.column(1), *(b.column(1 + k + len(low)) for k in range(1, len(carry) + 1))]
            in_table = lambda t, n: [pa.array(np.full(n, t, np.int64))] if every else []
            if low:
                at = pc.list_parent_indices(b.column(2))
                yield pa.record_batch([pc.list_flatten(b.column(2)), *(x.take(at) for x in carried), *in_table(-1, len(at))], names=names)
            for t, mask in enumerate(masks):
                own = words & mask
                with np.errstate(over="ignore"):
                    key = np.full(len(own), t + 1, np.uint64)
                    for k in range(lanes):  # a table's key is a hash of its number and the masked bits
                        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ own[:, k] ^ (key >> np.uint64(29))
                yield pa.record_batch([pa.array(key.view(np.int64)), *carried, *in_table(t, len(own))], names=names)

    def link(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = _Forest()
        for pdf in _by_key(pdfs):
            fp = np.stack([pdf[f"f{k}"].to_numpy(np.int64).view(np.uint64) for k in range(head)], axis=1)
            key, rep = pdf["key"].to_numpy(np.int64), pdf["rep"].to_numpy(np.int64)
            if every:
                yield from (pd.DataFrame({"a": rep[i], "b": rep[j]}) for i, j in _pairs(key, fp, *(pdf[c].to_numpy(np.int64) for c in extra), masks, distance))
                continue
            pairs = [p for i, j in _links(key, fp, distance, head < lanes) if forest.add(*(p := (int(rep[i]), int(rep[j]))))]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    dealt = groups.select("fp", "rep", *low, *(F.col(c).cast("long") for c in carry)).where("rep is not null").mapInArrow(deal, ", ".join(f"{n} long" for n in names))
    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(link, "a long, b long")


def components(docs: DataFrame, shingle: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest doc_id that links reach.

    Fingerprints within the distance are all found. Null or wordless texts share fingerprint zero and are linked like any
    other; texts are taken whole. A row whose doc_id is null gets the component of its fingerprint, and null if no row with
    an id has that. Repeated rows come back as often as they are; ids that repeat with different texts may come back with
    several components. An empty table gives an empty one; other columns are not read.
    """
    fps = written(fingerprints(docs, shingle, 1, id_col, text_col))
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    up = roots(links(groups, distance, tables_for(groups, distance)))
    named = groups.join(up, groups["rep"] == up["a"], "left").select("fp", F.coalesce("b", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of fewer words all are one shingle."""
    h = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((h(g, 42) for g in grams), np.uint64))


def set_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """As `fingerprint`, of a set of shingles: however often one stands in a text, it counts once."""
    ones = np.zeros(64 * lanes, np.int64)
    for k in range(0, len(hashes), 255):  # so many fit a byte
        bits = lanes_of(hashes[k : k + 255], lanes).astype("<u8").view(np.uint8)
        ones += np.add.reduce(np.unpackbits(bits, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def _sketches(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """docs(doc_id, text): doc_id, a digest of the set of shingles, its fingerprint, and of a short set its smallest hashes.

    Two sets of similarity NEAR share one of their n - ceil(0.8 n) + 1 smallest hashes each.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sets = [shingle_set(spaced_words(t), shingle) for t in b.column(1).to_pylist()]
            low = [s[: len(s) - -(-len(s) * NEAR[0] // NEAR[1]) + 1].view(np.int64) if len(s) <= SHORT else [] for s in sets]
            fps = [set_fingerprint(s, lanes).astype(">u8").tobytes() for s in sets]
            yield pa.record_batch([b.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(fps, pa.binary()), pa.array(low, pa.list_(pa.int64()))], names=["doc_id", "digest", "fp", "low"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, digest binary, fp binary, low array<long>")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, text), ids(doc_id): doc_id and s, the hashes of its shingles."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sets = [shingle_set(spaced_words(t), shingle).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "s"])

    return docs.join(ids, "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, s array<long>")


def _alike(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets(doc_id, s) have a Jaccard similarity of NEAR or more."""
    x, y = (sets.select(F.col("doc_id").alias(c), F.col("s").alias(f"{c}s")) for c in ("a", "b"))
    common = F.size(F.array_intersect("as", "bs"))
    # No pair whose sizes alone rule it out needs its sets intersected.
    sized = F.greatest(F.size("as"), F.size("bs")) * NEAR[0] <= F.least(F.size("as"), F.size("bs")) * NEAR[1]
    alike = F.when(sized, common * NEAR[1] >= (F.size("as") + F.size("bs") - common) * NEAR[0]).otherwise(False)
    return pairs.join(x, "a").join(y, "b").where(alike).select("a", "b").distinct()


def _shared(sets: DataFrame) -> DataFrame:
    """(rep, size, shared) of sets(doc_id, s): how many shingles it has, and how many of them another has too.

    Shingles that only one set has are counted back to it. An id of several sets keeps all, so that no link is lost.
    """
    alone = sets.select("doc_id", F.explode("s").alias("h")).groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep = top")
    counted = alone.groupBy("rep").agg(F.count("*").alias("alone"))
    sizes = sets.groupBy(F.col("doc_id").alias("rep")).agg(F.min(F.size("s")).alias("size"), F.max(F.size("s")).alias("most"), F.count("*").alias("n"))
    shared = F.when(F.col("n") > 1, F.col("most")).otherwise(F.col("size") - F.coalesce("alone", F.lit(0)))
    return sizes.join(counted, "rep", "left").select("rep", "size", shared.alias("shared"))


def _topped(df: DataFrame, up: DataFrame, col: str, out: str) -> DataFrame:
    """df with the root of a column's node as `out`."""
    return df.join(up.select(F.col("a").alias(col), F.col("b").alias("__root")), col, "left").withColumn(out, F.coalesce("__root", col)).drop("__root")


def near_links(docs: DataFrame, groups: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, text), groups(fp, rep, low). (a, b), a above b, for the reps that links of similarity NEAR connect.

    Candidates make components, and of each the member with most candidates, mostly the text that the others are copies
    of, is compared with all others. Where that leaves a component in parts, all candidates between its parts are
    compared, but for those that share too few shingles with any other text to be near one.
    """
    groups = groups.where("rep is not null")
    masks = sliced_tables(64 * NEAR_LANES, groups.count())
    found = written(links(groups, NEAR_DISTANCE, masks, NEAR_HEAD).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = found.count()
    whole = roots(found)
    ends = found.select(F.col("a").alias("rep")).union(found.select("b"))
    members = written(_topped(ends.groupBy("rep").agg(F.count("*").alias("n")), whole, "rep", "part"), 2 * n)
    sets = written(_sets(docs, members.select(F.col("rep").alias("doc_id")), shingle))
    centre = members.groupBy("part").agg(F.max_by("rep", F.struct("n", -F.col("rep"))).alias("b"))
    star = members.join(written(centre, n), "part").where("rep <> b").select(F.col("rep").alias("a"), "b")
    good = written(_alike(sets, star), 2 * n)
    up = roots(good)
    tops = _topped(members, up, "rep", "top")
    apart = written(tops.groupBy("part").agg(F.min("top").alias("x"), F.max("top").alias("y")).where("x <> y").select("part"), n)
    left = tops.join(apart, "part", "left_semi").join(_shared(sets), "rep").where(F.col("shared") * NEAR[1] >= F.col("size") * NEAR[0])
    left = written(groups.join(left.select("rep", "top", "size", "shared"), "rep"), 2 * n)
    if left.isEmpty():
        return up
    more = written(links(left, NEAR_WHOLE, masks, every=True).distinct())
    out = roots(good.union(_alike(sets, more)))
    dropped(found, members, sets, good, apart, left, more, up, whole)
    return out


def near_duplicates_out(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are not the first of their component; columns as given, of any names.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; 512-bit
    fingerprints say which are compared. The first is the smallest id. Rows with a null id are kept. Rows that repeat an
    id stay or go together. Null and wordless texts say nothing of each other and are kept too. Texts are taken whole;
    an empty table gives an empty one.
    """
    worded = docs.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(_sketches(worded, shingle, NEAR_LANES))
    groups = written(sketches.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.min("low").alias("low")))
    up = near_links(worded, groups, shingle)
    named = written(groups.join(up, groups["rep"] == up["a"], "left").select("digest", F.coalesce("b", "rep").alias("component_id")))
    (gone_id,) = unused(docs.columns, "gone")
    gone = written(sketches.select("doc_id", "digest").join(named, "digest").where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct())
    dropped(sketches, groups, named, up)
    return docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")


def op8(docs: DataFrame) -> DataFrame:
    """The contract's digest: 3-word shingles, 64 bits, links at 3 or fewer differing bits. Odd rows as in `components`."""
    return components(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
