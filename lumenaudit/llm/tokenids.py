"""Token ids as raw binary files, with a minimal perfect hash index for keyed access.

Writing. Documents are sorted by range of their id, so that every task writes the ids of its documents one after another
into files of about `FILE_BYTES`, in 16 bits where the vocabulary allows it, else 32. What stands before a file, and so
every document's place, are prefix sums over a table with a row per file. Names count only once they stand in the
committed manifest; a task that runs again leaves a file that no one reads.

Index. A key is a document's id and, where rows share it, their number (from 0). Keys are dealt by hash into buckets of
about `BUCKET`, and each bucket gets a minimal perfect hash function: level by level a key sets the bit that its hash
names; keys that meet go on to the next, smaller level. A key's slot is the number of bits before its own, so n keys
have the slots 0 to n - 1 at some three bits each. In a slot stand a 64-bit fingerprint, which tells keys that were never
stored, and file, offset and length. Looking up reads one bucket and one range of one file, however many documents there are.

Formats, all little-endian. `NAME.ids`: ids and nothing else. `NAME.mph`: the magic, the length of a JSON header, the
header (n, sizes of the levels, arrays by name, type and length), and the arrays' bytes.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, shared_dir, written
from .warc import arrow_uri

#: A file ends with the document that passes this size. Keys of a bucket. Bytes that a reader fetches at once.
FILE_BYTES, BUCKET, FETCH = 64 << 20, 100_000, 4 << 20
#: Texts that are encoded at a time.
TEXTS = 256
#: Bits of a level per key that is left; smaller is more compact, larger needs fewer levels.
GAMMA = 2.0
MAGIC = b"MPHIDX01"
#: Words whose ids an encoder keeps.
KEPT = 600_000
#: Words of Latin letters alone, whatever their case, and marks that may follow one. No token holds letters and such a mark.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
MARKS = ".,;:!?"

PLACES = "file int, start long, length long"


class Encoder:
    """Ids of whole texts, word by word, for tokenizers that drop white space: then a text's ids are those of its words.

    Whether the tokenizer does so is read from its normaliser and pre-tokenizer; others get whole texts. Words' ids are
    kept in two generations of at most `KEPT` each, so that memory is bounded and frequent words stay. New words of
    letters alone need no search for pieces, as each is one, which ends with the mark of a word's end: they are encoded
    all at once.
    """

    def __init__(self, vocabulary: str, kind: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.kind, self.young, self.old = kind, {}, {}
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.by_word = by_words(vocabulary)
        if self.by_word:
            # ASCII letters in lower case stand for themselves; others are lowered and spelt byte by byte.
            self.ascii, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.latin.normalizer = normalizers.Lowercase()
            self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            ids, mark = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
            self.ends = np.zeros(max(ids.values()) + 1, bool)
            self.ends[[i for t, i in ids.items() if t.endswith(mark)]] = True
            # Upper case may be lowered at once, but not where it could make the text of an added token.
            self.added = [t.content[:1].encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.marks = dict(zip(MARKS.encode(), self._encoded(list(MARKS)), strict=True))

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, tokenizer, words: list[bytes]) -> None:
        """Puts the ids of words of letters into the young generation."""
        if words:
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.kind)
            ends, raw = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist(), ids.tobytes()
            self.young.update(zip(words, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _learn(self, new: set[bytes]) -> None:
        """Puts the ids of words into the young generation."""
        known = self.old.keys() & new
        self.young.update((w, self.old[w]) for w in known)
        plain, bodies, marked, rest = set(), set(), [], []
        for w in new - known:
            if w.isalpha() and w.islower():
                plain.add(w)
                continue
            body = w[:-1] if w[-1] in self.marks else w
            if body.isalpha() and body.islower():
                plain.add(body)
            elif LATIN.fullmatch(body.decode()):
                bodies.add(body)
            else:
                rest.append(w)
                continue
            if len(body) < len(w):
                marked.append((w, body))
        self._letters(self.ascii, list(plain.difference(self.young)))
        self._letters(self.latin, list(bodies.difference(self.young)))
        self.young.update((w, self.young[body] + self.marks[w[-1]]) for w, body in marked)
        self.young.update(zip(rest, self._encoded([w.decode() for w in rest]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of UTF-8 texts, as bytes."""
        if not self.by_word:
            return self._encoded([t.decode() for t in texts])
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}
        words = [(t if any(a in t for a in self.added) else t.lower()).split() for t in texts]  # at ASCII white space
        found = [list(map(self.young.get, ws)) for ws in words]
        gaps = []
        for ids, ws in zip(found, words, strict=True):
            k = -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                gaps.append((ids, k, ws[k]))
        self._learn({w for _, _, w in gaps})
        for ids, k, w in gaps:
            ids[k] = self.young[w]
        return list(map(b"".join, found))


def by_words(vocabulary: str) -> bool:
    """Whether no token of this tokenizer (its JSON) reaches over white space, or over a letter and a mark after it.

    True of one kind only: it lower-cases, normalises, then keeps the matches of the pattern below, byte by byte, and
    marks where a word ends.
    """
    found = json.loads(vocabulary)
    normal, split = found.get("normalizer") or {}, found.get("pre_tokenizer") or {}
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal.get("normalizers", [{"type": ""}]))
    first, *more = split.get("pretokenizers", [{"type": ""}])
    # A fixed value: the pattern of this kind of tokenizer.
    pattern = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    cut = first["type"] == "Split" and first["pattern"] == pattern and first["behavior"] == "Removed" and first["invert"]
    marks = re.compile(r"\s|[A-Za-z][.,;:!?]")
    return bool(plain and cut and found["model"].get("end_of_word_suffix") and "Lowercase" in str(normal) and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in more) and not any(marks.search(x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in found.get("added_tokens", [])))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(vocabulary: str, kind: str) -> Encoder:
    """A worker's encoder; it serves all its tasks."""
    key = (hash(vocabulary), kind)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, kind)
    return _ENCODERS[key]


# --- minimal perfect hashing


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """64 well mixed bits of two hashes and a level."""
    x = a + b * np.uint64(2 * level + 1) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((_mixed(a, b, level) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class Mph:
    """A minimal perfect hash function over keys given as two 64-bit hashes each."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> Mph:
        if len(np.unique(np.stack([a, b], axis=1), axis=0)) < len(a):
            raise ValueError("two keys have the same 128-bit hash, or a key is given twice")
        sizes, parts = [], []
        while len(a):
            size = -(-int(max(64, GAMMA * len(a))) // 64) * 64
            at = _place(a, b, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of keys; -1, or any slot, for one that wasn't there."""
        out, open_, offset = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = offset + _place(a[open_], b[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.before[word[hit]] + below
            open_, offset = open_[~hit], offset + size
        return out


def packed(a: np.ndarray, b: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
    """The bytes of an index file: the function, fingerprints, and the columns by slot."""
    mph = Mph.of(a, b)
    order = np.argsort(mph.slots(a, b))
    arrays = {"bits": mph.bits, "fingerprints": b[order]} | {k: v[order] for k, v in columns.items()}
    head = json.dumps({"n": len(a), "sizes": mph.sizes, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(v).tobytes() for v in arrays.values())])


class Index:
    """An index file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        at = 12 + int.from_bytes(data[8:12], "little")
        head = json.loads(data[12:at])
        self.columns = {}
        for name, kind, n in head["arrays"]:
            self.columns[name] = np.frombuffer(data, kind, n, at)
            at += n * np.dtype(kind).itemsize
        self.mph, self.fingerprints = Mph(head["sizes"], self.columns.pop("bits")), self.columns.pop("fingerprints")

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each key is there, and the columns at its slot (of any slot if not)."""
        slots = self.mph.slots(a, b)
        if not len(self.fingerprints):
            return np.zeros(len(a), bool), {k: np.zeros(len(a), v.dtype) for k, v in self.columns.items()}
        safe = np.maximum(slots, 0)
        return (slots >= 0) & (self.fingerprints[safe] == b), {k: v[safe] for k, v in self.columns.items()}


def hashes(key: str, copy: str) -> tuple[Column, Column]:
    """Two independent hashes of a key, as column functions; a null key is a key."""
    of = lambda salt: F.xxhash64(F.lit(salt), F.col(key).isNull(), F.col(key), F.col(copy).cast("long"))
    return of("slot"), of("fingerprint")


# --- writing, looking up, reading


class Archive:
    """Token ids of a corpus in a folder: files(file, path, n_docs, n_ids, start) and index(bucket, path, n)."""

    def __init__(self, folder: str, files: DataFrame, index: DataFrame, buckets: int, width: int, key: str):
        self.folder, self.files, self.index, self.buckets, self.width, self.key = folder, files, index, buckets, width, key

    def keys(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(key, copy): of every row of docs the key under which it is found; rows that share an id are numbered."""
        counts = docs.groupBy(F.col(id_col).alias("key")).agg(F.count("*").alias("n"))
        return counts.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, copy, file, start, length) of each of keys(key, copy): the index's answer, null where a key isn't there.

        start counts ids from the beginning of the file.
        """
        a, b = hashes("key", "copy")
        own = keys.select("key", F.col("copy").cast("long").alias("copy"), a.alias("a"), b.alias("b")).withColumn("own", F.pmod("a", F.lit(self.buckets)).cast("int"))
        met = own.join(self.index.select("bucket", "path"), F.col("own") == F.col("bucket"), "left").select("own", "path", "key", "copy", "a", "b")
        uri, kind = arrow_uri(keys.sparkSession, self.folder), self.key

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, _ = fs.FileSystem.from_uri(uri)
            index, held = None, None
            for batch in parts:
                paths = batch.column(1).to_pylist()
                cuts = [0, *(k for k in range(1, len(paths)) if paths[k] != paths[k - 1]), len(paths)]
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    if s == e:
                        continue
                    rows = batch.slice(s, e - s)
                    if paths[s] is None:  # a bucket without keys
                        places = [pa.nulls(e - s, t) for t in (pa.int32(), pa.int64(), pa.int64())]
                    else:
                        if held != paths[s]:
                            with system.open_input_stream(paths[s], compression=None) as f:
                                index, held = Index(f.read()), paths[s]
                        there, found = index.find(*(np.ascontiguousarray(rows.column(k).to_numpy()).view(np.uint64) for k in (4, 5)))
                        places = [pa.array(found[c].astype(t), mask=~there) for c, t in (("file", np.int32), ("start", np.int64), ("length", np.int64))]
                    yield pa.record_batch([rows.column(2), rows.column(3), *places], names=["key", "copy", "file", "start", "length"])

        return met.repartition("own").sortWithinPartitions("own").mapInArrow(run, f"key {kind}, copy long, {PLACES}")

    def read(self, places: DataFrame, with_ids: bool = True) -> DataFrame:
        """(key, copy, start, n_tokens, ids_crc32[, ids]) of places(key, copy, file, start, length): ranges of the files.

        start counts all ids before the document; the checksum is that of the ids in 32 bits each. Places without a file
        have null results. A file's ranges are read in order, `FETCH` bytes or one document at a time.
        """
        met = places.join(self.files.select(F.col("file").alias("own"), "path", F.col("start").alias("before")), F.col("file") == F.col("own"), "left")
        uri, width, kind = arrow_uri(places.sparkSession, self.folder), self.width, self.key

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, _ = fs.FileSystem.from_uri(uri)
            stream, held, data, at = None, None, b"", 0
            for batch in parts:
                sums, lists, size, first = [], [], 0, 0

                def made(first: int, end: int) -> pa.RecordBatch:
                    rows = batch.slice(first, end - first)  # noqa: B023
                    start = pa.array([None if p is None else s + x for p, s, x in zip(*(rows.column(k).to_pylist() for k in (2, 3, 5)), strict=True)], pa.int64())
                    columns = [rows.column(0), rows.column(1), start, rows.column(4), pa.array(sums, pa.int64())]  # noqa: B023
                    names = ["key", "copy", "start", "n_tokens", "ids_crc32"]
                    return pa.record_batch([*columns, pa.array(lists, pa.list_(pa.int64()))] if with_ids else columns, names=[*names, "ids"] if with_ids else names)  # noqa: B023

                for k, (path, start, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    if path is None:
                        sums.append(None)
                        lists.append(None)
                        continue
                    if held != path:
                        if stream is not None:
                            stream.close()
                        stream, held, data, at = system.open_input_file(path), path, b"", 0
                    begin, n = start * width, length * width
                    if not (at <= begin and begin + n <= at + len(data)):
                        stream.seek(begin)
                        data, at = stream.read(max(n, FETCH)), begin
                    ids = np.frombuffer(data, f"<u{width}", length, begin - at)
                    sums.append(zlib.crc32(ids.astype("<u4")))
                    lists.append(ids.astype(np.int64) if with_ids else None)
                    size += n if with_ids else 0
                    if size > FETCH:
                        yield made(first, k + 1)
                        sums, lists, size, first = [], [], 0, k + 1
                if first < batch.num_rows:
                    yield made(first, batch.num_rows)
            if stream is not None:
                stream.close()

        schema = f"key {kind}, copy long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
        return met.select("key", "copy", "path", "start", "length", "before").repartition("path").sortWithinPartitions("path", "start").mapInArrow(run, schema)


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, bucket: int = BUCKET) -> Archive:
    """Encodes all texts and writes ids and index below the folder. vocabulary: a tokenizer's JSON.

    Documents stand in ascending order of their ids, null ids last; rows that share an id follow each other in the order
    in which they were read, and are numbered so. A null or empty text has the end id alone; long ones are encoded whole.
    Special tokens' strings are encoded as the library does. No documents, no files; other columns are not read.
    """
    # 16-bit ids where every id fits them.
    found = json.loads(vocabulary)
    ids = [*found["model"]["vocab"].values(), *(x["id"] for x in found.get("added_tokens", [])), end_id]
    width = 2 if max(ids) < 1 << 16 else 4
    kind = {2: "H", 4: "I"}[width]
    end = end_id.to_bytes(width, "little")
    uri = arrow_uri(docs.sparkSession, folder)
    key = docs.schema[id_col].dataType.simpleString()
    order = [F.asc_nulls_last("key"), F.asc("row")]
    # The row number keeps apart what shares an id, so that no range grows with such a group.
    placed = docs.select(F.col(id_col).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(vocabulary, kind)
        system, root = fs.FileSystem.from_uri(uri)
        part, seq, n, done, out, path = TaskContext.get().partitionId(), 0, 0, 0, None, ""
        names = ["key", "part", "seq", "row", "start", "length", "path"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def rows(keys: pa.Array, *columns: list) -> pa.RecordBatch:
            return pa.record_batch([keys, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

        def closed(keys: pa.Array) -> pa.RecordBatch:
            """A file's own row: path, documents, ids."""
            out.close()
            return rows(pa.nulls(1, keys.type), [part], [seq], [n], [None], [done], [path])

        for b in parts:
            keys, texts = b.column(0), b.column(2)
            for s in range(0, b.num_rows, TEXTS):
                at = []
                some = texts.slice(s, TEXTS).to_pylist()
                keyed = keys.slice(s, len(some))
                finished = []
                for raw in encoder.encode(some):
                    if out is None:
                        path, n, done = f"{root}/{uuid.uuid4().hex}.ids", 0, 0
                        out = system.open_output_stream(path, compression=None)
                    length = len(raw) // width + 1
                    out.write(raw + end)
                    at.append((part, seq, n, done, length, None))
                    n, done = n + 1, done + length
                    if done * width >= file_bytes:
                        finished.append(closed(keys))
                        out, seq = None, seq + 1
                yield rows(keyed, *map(list, zip(*at, strict=True)))
                yield from finished
        if out is not None:
            yield closed(keys)

    encoded = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"key {key}, part int, seq int, row long, start long, length long, path string")
    made = written(encoded.repartition(docs.sparkSession.sparkContext.defaultParallelism))  # narrow rows, in a few files
    line = Window.orderBy("part", "seq")
    ahead = line.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    # A row per file, some 10^6 of them for 10^14 bytes of text: one task may order them.
    files = written(made.where("path is not null").select((F.row_number().over(line) - 1).cast("int").alias("file"), "part", "seq", "path", F.col("row").alias("n_docs"), F.col("length").alias("n_ids"), sums("length").cast("long").alias("start"), sums("row").cast("long").alias("docs_before")))
    entries = made.where("path is null").join(files.select("part", "seq", "file", "docs_before"), ["part", "seq"]).select("key", (F.col("docs_before") + F.col("row")).alias("place"), "file", "start", "length")
    several = entries.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("own"), "first")
    numbered = entries.join(several, F.col("key").eqNullSafe(F.col("own")), "left").withColumn("copy", F.coalesce(F.col("place") - F.col("first"), F.lit(0)))
    n = files.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, -(-n // bucket))
    a, b = hashes("key", "copy")
    dealt = numbered.select(a.alias("a"), b.alias("b"), "file", "start", "length").withColumn("bucket", F.pmod("a", F.lit(buckets)).cast("int"))

    def index(table: pa.Table) -> pa.Table:
        system, root = fs.FileSystem.from_uri(uri)
        column = lambda c: table.column(c).combine_chunks().to_numpy()
        path = f"{root}/{uuid.uuid4().hex}.mph"
        data = packed(column("a").view(np.uint64), column("b").view(np.uint64), {"file": column("file").astype("<u4"), "start": column("start").astype("<u8"), "length": column("length").astype("<u8")})
        with system.open_output_stream(path, compression=None) as f:
            f.write(data)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "path": pa.array([path]), "n": pa.array([table.num_rows], pa.int64())})

    made_index = written(dealt.groupBy("bucket").applyInArrow(index, "bucket int, path string, n long"))
    dropped(made)
    return Archive(folder, files, made_index, buckets, width, key)


def op12(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes all documents, finds every one through the index and reads its ids back. vocabulary: a tokenizer's file.

    Odd rows as in `write`.
    """
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()  # the driver's file; tasks get its content
    archive = write(docs, shared_dir(docs.sparkSession), text, end_id)
    found = archive.read(archive.lookup(archive.keys(docs)), with_ids=False)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
