"""WARC archives in Zstandard with an embedded dictionary, and their reader.

A dictionary is built from a bounded, hash-ordered sample of the records as they are archived, headers included. Every
archive begins with it in a skippable frame (magic 0x184D2A5D); each record is a frame of its own, so a reader needs
nothing but the file. Payloads that another page has too are written once: of equal payloads of at least `LEAST_BYTES`
bytes the smallest page_id is the response, the others are revisit records without payload.

Which pages are revisits is found from digests alone, with no payload in that shuffle: both sides of its join are
written tables, so adaptive execution can split a digest that a third of all pages share. Payloads meet the answer by
digest, id and URL together.

Tasks write files of unique names into a folder that all see, through Arrow's file systems; a file counts only once its
name is in the manifest, a table that Spark commits. A task that is lost and runs again leaves a file that no one reads.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, shared_dir, written

#: Equal payloads below this size are all written.
LEAST_BYTES = 100
#: Bounds of the dictionary, of its sample, and of a page that may be in the sample, which is whole.
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_BYTES, SAMPLE_PAGE_BYTES = 65_536, 500, 8_000_000, 1_000_000
#: An archive ends with the record that passes this size.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_MAGIC = 0x184D2A5D
#: Record ids are UUIDs in this name space: of a digest for a response that others refer to, else of archive and place.
SPACE = uuid.UUID("6a1f3a1e-3c58-5c0e-9d52-6a6d6c2f7a10")
#: Pages carry no capture time.
DATE = "1970-01-01T00:00:00Z"


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary from pages(id, url, payload, digest); empty if they are too few or too small to train one."""
    # Sizes are ranked first, so that payloads of the sample alone travel.
    size = F.length("payload")
    ranked = pages.where((size > 0) & (size <= SAMPLE_PAGE_BYTES) & F.col("id").isNotNull()).groupBy("id").agg(F.max(size).alias("n")).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(SAMPLE_PAGES).collect()
    chosen, total = [], 0
    for r in ranked:
        total += r["n"]
        if total <= SAMPLE_BYTES:
            chosen.append(r["id"])
    found = pages.where(F.col("id").isin(chosen) & (size <= SAMPLE_PAGE_BYTES)).groupBy("id").agg(F.min_by(F.struct("url", "payload", "digest"), "digest").alias("p")).collect() if chosen else []
    records = [record(f"sample:{r['id']}", r["id"], r["p"]["url"], bytes(r["p"]["payload"]), r["p"]["digest"]) for r in sorted(found, key=lambda r: r["id"])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def skippable(data: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def record(name: str, page: int | None, url: str | None, payload: bytes | None, digest: str, size: int | None = None, first: int | None = None) -> bytes:
    """One record. Control characters in a URL become %XX; a page without URL gets a URN. A revisit has no payload, but its size, and the id of the page it refers to."""
    revisit = payload is None
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (size if revisit else len(payload))
    block = http + (payload or b"")
    heads = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(name)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        heads.append(f"X-Page-Id: {page}")
    if revisit:
        heads += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(digest)}", f"X-Refers-To-Page: {first}"]
    return "\r\n".join(heads).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def arrow_uri(spark: SparkSession, folder: str) -> str:
    """A folder by the name under which Arrow opens it, made by Hadoop's file system, which also resolves a path without scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    found = system.resolvePath(path).toUri()
    scheme, place = found.getScheme(), found.getPath()
    scheme = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme)
    return f"{scheme}://{found.getAuthority() or ''}{place}"


def revisits(pages: DataFrame) -> DataFrame:
    """Of pages(id, url, digest, n_bytes): groups(digest, id, url, n_bytes, n, first, is_first) of payloads that stand more than once.

    The first is the smallest id, of its rows that with the smallest
    URL. Payloads that only pages without an id have are left out.
    """
    each = written(pages.where(F.col("n_bytes") >= LEAST_BYTES).groupBy("digest", "id", "url").agg(F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "url")
    first = written(each.groupBy("digest").agg(F.min(place).alias("first"), F.sum("n").alias("all")).where("all > 1 and not first.none").drop("all"))
    out = written(each.join(first, "digest").select("digest", "id", "url", "n_bytes", "n", F.col("first.id").alias("first"), place.eqNullSafe(F.col("first")).alias("is_first")))
    dropped(each, first)
    return out


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives all pages below the folder. Returns the manifest (path, records, bytes), already committed.

    A null html is an empty payload; small payloads are all responses; long ones are written whole. Ties: of rows that
    repeat id and payload one is the response and the others revisit it, and of several URLs the smallest is the
    response's. A page without an id never is the response of a group that has one, and payloads that only such pages
    have are all responses. Record ids are unique. An empty table makes no archive; other columns are not read.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    all_pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    words = dictionary(all_pages)
    again = revisits(all_pages.select("id", "url", "digest", F.length("payload").alias("n_bytes")))
    key = again.select(F.col("digest").alias("own_digest"), F.col("id").alias("own_id"), F.col("url").alias("own_url"), "is_first")
    met = all_pages.join(key, (F.col("digest") == F.col("own_digest")) & F.col("id").eqNullSafe(F.col("own_id")) & F.col("url").eqNullSafe(F.col("own_url")), "left")
    columns = ("id", "url", "payload", "digest", "n_bytes", "first")
    none = (F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("first"))
    alone = met.where("is_first is null").select("id", "url", "payload", "digest", *none, F.lit(False).alias("named"))
    firsts = met.where("is_first").groupBy("digest").agg(F.first(F.struct("id", "url", "payload")).alias("p")).select("p.id", "p.url", "p.payload", "digest", *none, F.lit(True).alias("named"))
    copies = F.col("n") - F.col("is_first").cast("int")
    later = again.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select("id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "n_bytes", "first", F.lit(False).alias("named"))
    linked = alone.union(firsts).union(later).select(*columns, "named")
    uri = arrow_uri(pages.sparkSession, folder)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        made = zstandard.ZstdCompressionDict(words) if words else None
        press = zstandard.ZstdCompressor(level=3, dict_data=made, write_checksum=True)
        out, name, done, n = None, "", 0, 0

        def manifest() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([f"{root}/{name}.warc.zst"]), pa.array([n], pa.int64()), pa.array([done], pa.int64())], names=["path", "records", "bytes"])

        for b in parts:
            for page, url, payload, digest, size, first, named in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, done, n = uuid.uuid4().hex, 0, 0
                    out = system.open_output_stream(f"{root}/{name}.warc.zst", compression=None)  # the name would make Arrow compress it again
                    done += out.write(skippable(words)) or 0
                frame = press.compress(record(digest if named else f"{name}:{n}", page, url, payload, digest, size, first))
                out.write(frame)
                done, n = done + len(frame), n + 1
                if done >= ARCHIVE_BYTES:
                    yield manifest()
                    out = None
        if out is not None:
            yield manifest()

    manifest = written(linked.mapInArrow(run, "path string, records long, bytes long"))
    dropped(again)
    return manifest


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one frame after another; only a part of the file is held."""
    head = stream.read(8)
    if int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    words = stream.read(int.from_bytes(head[4:], "little"))
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    held = b""
    while True:
        one, parts = plain.decompressobj(), []
        while not one.eof:
            held = held or stream.read(1 << 16)
            if not held:
                if parts:
                    raise ValueError("an archive ends inside a record")
                return
            parts.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
        yield b"".join(parts)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    heads = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return heads, rest[: int(heads["Content-Length"])]


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload, record_id) of every archived record.

    A response's payload is held against its digest; a mismatch is an error. A revisit has a null payload.
    """
    import hashlib

    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "record_id"]
    uri = arrow_uri(manifest.sparkSession, folder)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(uri)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for b in parts:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for raw in frames(stream):
                        heads, block = parsed(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = heads["WARC-Type"] == "revisit"
                        digest = heads["WARC-Payload-Digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: payload and digest of {heads['WARC-Record-ID']} differ")
                        page, first = heads.get("X-Page-Id"), heads.get("X-Refers-To-Page")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        rows.append((page and int(page), heads["WARC-Target-URI"], heads["WARC-Type"], digest, length, first and int(first), None if revisit else payload, heads["WARC-Record-ID"]))
                        size += len(payload)
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, record_id string"
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, schema)


def op7(pages: DataFrame) -> DataFrame:
    """Writes archives of all pages into the shared folder, reads them back, and tells what is in them. Odd rows as in `write`."""
    folder = shared_dir(pages.sparkSession)
    back = read(write(pages, folder), folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
