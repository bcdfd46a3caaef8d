"""Token ids: round trips through files and index, against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenaudit.llm import tokenids

SCHEMA = "doc_id long, text string, key int, copy int, file string, start int, path string, bucket int"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "f", 3, "p", 4) for r in rows], SCHEMA)


def texts():
    r = random.Random(1)
    odd = ["", None, " \n\t ", "Élan É x\x1cy \x85 z w", "Don't stop. It's 3.5, (ok)! <|endoftext|> end", "a.b,c;d:e!f?g", "e.́ é. e;̸", "K. ΣΑΣ. İ!", "no\rcarriage\x0bfeed\x0cform", "日本語 テスト。", "x" * 3000 + ".", "A. " * 5000, "we'll've 'tis", "Über ÀÉÎ ŉ Ǆ ɏ ×÷ naïve. œuvre, ß! İstanbul ſ Ωm K", "x.y. a.. b?! É. é,", "<|ENDOFTEXT|> UPPER <|endoftext|>", "LIKE This", "…?!?!.", "  　"]
    words = "".join(map(chr, [*range(33, 127), 0xE9, 0xDF, 0x301, 0x2019, 0x4E2D]))
    return odd + [" ".join("".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 60))) for _ in range(120)]


def want(rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens_are_the_librarys(spark):
    rows = [(k * 7 % 1000 + k, t) for k, t in enumerate(texts())]
    assert sorted(map(tuple, tokenids.op12(frame(spark, rows).repartition(5), VOCABULARY).collect())) == sorted(want(rows))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_round_trip(spark, tmp_path, name):
    """Small files and buckets, ids that rows share or lack, and both ways of encoding."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        vocabulary = f.read()
    rows = [(k % 90, t) for k, t in enumerate(texts())] + [(None, "no id"), (None, "no id")] + [(500, "same")] * 40
    docs = frame(spark, rows).repartition(6)
    archive = tokenids.write(docs, f"file://{tmp_path}/a", vocabulary, 1, file_bytes=3000, bucket=20)
    assert archive.files.count() > 5 and archive.index.count() > 5
    got = archive.read(archive.lookup(archive.keys(docs))).collect()
    tokenizer = Tokenizer.from_str(vocabulary)
    plain = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert sorted(((r["key"], r["ids"]) for r in got), key=repr) == sorted(((i, plain(t)) for i, t in rows), key=repr)
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    # Places follow each other without a gap, in ascending order of ids.
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["key"] is None, r["key"]) for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1] or 0))
    assert len({(r["key"], r["copy"]) for r in got}) == len(rows)


def test_keys_that_were_never_stored(spark, tmp_path):
    with open(VOCABULARY, encoding="utf-8") as f:
        vocabulary = f.read()
    docs = frame(spark, [(k, f"text {k}") for k in range(50)])
    archive = tokenids.write(docs, f"file://{tmp_path}/a", vocabulary, 1, bucket=7)
    asked = spark.range(40, 2000).select(F.col("id").alias("key"), F.lit(0).alias("copy")).union(spark.createDataFrame([(3, 1), (None, 0)], "key long, copy int"))
    got = archive.read(archive.lookup(asked)).collect()
    assert len(got) == 1962
    assert {r["key"] for r in got if r["ids"] is not None} == set(range(40, 50))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 30_000])
def test_perfect_hashing(n):
    r = np.random.default_rng(n)
    a, b = r.integers(0, 2**64, n, np.uint64), r.integers(0, 2**64, n, np.uint64)
    index = tokenids.Index(tokenids.packed(a, b, {"v": np.arange(n)}))
    assert sorted(index.mph.slots(a, b).tolist()) == list(range(n))
    there, found = index.find(a, b)
    assert there.all() and found["v"].tolist() == list(range(n))
    assert not index.find(b, a)[0].any()
    assert sum(index.mph.sizes) <= 4.5 * n + 64 * 40


def test_a_key_given_twice():
    with pytest.raises(ValueError, match="twice"):
        tokenids.Mph.of(np.array([1, 2, 1], np.uint64), np.array([5, 6, 5], np.uint64))


def test_no_documents(spark):
    assert tokenids.op12(frame(spark, []), VOCABULARY).count() == 0


def test_encoder_generations(monkeypatch):
    """Words that were dropped from the kept ones are encoded again, the same."""
    monkeypatch.setattr(tokenids, "KEPT", 10)
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = tokenids.Encoder(f.read(), "H")
    some = [f"word{k % 13} other{k % 7}. end" for k in range(60)]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for t in some:
        assert np.frombuffer(encoder.encode([t.encode()])[0], "<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
