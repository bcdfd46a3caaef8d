"""The training-data operators against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenaudit.llm import decontam, fmindex, licenses, linewindows, mixing, mtree, quality, simhash, substring, toxicity, warc
from lumenaudit.llm.components import roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, th int, pos int, a int, b int, w string, score double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """documents with columns that clash with names the operators might use; rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 1, 2, 3, 4, "y", 0.5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(n=60, seed=0):
    """Random texts with copies, near copies, shared lines, odd characters, nulls, empty ones, and one very long one."""
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(1, 12)))
    shared = [line() for _ in range(6)]
    texts = ["\n".join(r.choice([line, line, lambda: r.choice(shared)])() for _ in range(r.randint(1, 9))) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5] + " extra", "\n".join(shared), "\n".join(shared[:4]) + "\nMore", None, "", " \n\t ", "Élan É x\x1cy", "a", "\n".join(line() for _ in range(3000)), "\n".join([shared[0]] * 9)]
    return [(i * 3, t, None if i % 11 == 0 else f"s{i % 4}") for i, t in enumerate(texts)] + [(9, texts[3], "s1"), (9, texts[3], "s1"), (None, texts[3], "s2")]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- simhash


def fp(text, n):
    w = [x for x in SPACED.findall((text or "").translate(LOWER))]
    grams = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_is_brute_force(spark):
    docs = corpus()
    prints = {}
    for i, t, _ in docs:
        prints.setdefault(i, set()).add(fp(t, 3))
    nodes = sorted({p for s in prints.values() for p in s})
    up = {p: p for p in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= 3:
                up[top(b)] = top(a)
    least = {}
    for i, t, _ in docs:
        if i is not None:
            k = top(fp(t, 3))
            least[k] = min(least.get(k, i), i)
    want = sorted(((i, f"{fp(t, 3):016x}", least[top(fp(t, 3))]) for i, t, _ in docs), key=repr)
    assert rows_of(simhash.op8(frame(spark, docs)), "doc_id", "fingerprint", "component_id") == want


def test_simhash_blocks_miss_nothing():
    r = np.random.default_rng(1)
    for n in (10, 2_000_000, 10**9):
        masks = simhash.exact_tables(n, 3)[:, 0]
        for _ in range(200):
            x = int(r.integers(0, 2**63))
            y = x
            for b in r.choice(64, 3, replace=False):
                y ^= 1 << int(b)
            assert any(x & int(m) == y & int(m) for m in masks)


def test_simhash_splits_buckets(spark):
    """Fingerprints that share sixteen bits get keys of more blocks, and still none within the distance is missed."""
    r = np.random.default_rng(6)
    base = [0xABCD000000000000 | int(x) for x in r.integers(0, 2**48, 200)]
    prints = sorted({p ^ sum(1 << int(b) for b in r.choice(48, int(r.integers(0, 4)), replace=False)) for p in base for _ in range(3)})
    groups = spark.createDataFrame([(p.to_bytes(8, "big"), k) for k, p in enumerate(prints)], "fp binary, rep long")
    few, many = simhash.tables_for(groups, 3), simhash.tables_for(groups, 3, bucket=100)
    assert simhash.largest_bucket(groups, few) == len(prints) > simhash.largest_bucket(groups, many) and len(many) > len(few)
    parts = lambda masks: {(x["a"], x["b"]) for x in roots(simhash.links(groups, 3, masks)).collect()}
    assert parts(few) == parts(many) != set()


def test_simhash_large_bucket():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 4, dtype=np.uint64)
    prints = np.unique(np.array([int(base[k % 4]) ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 4)), replace=False)) for k in range(400)], np.uint64))[:, None]
    linked = list(simhash._large(prints, 3))
    assert len(linked) < len(prints)
    assert all((int(prints[a, 0]) ^ int(prints[b, 0])).bit_count() <= 3 for a, b in linked)

    def parts(pairs):
        up = list(range(len(prints)))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[top(int(a))] = top(int(b))
        return [top(x) for x in range(len(prints))]

    every = [(a, b) for a in range(len(prints)) for b in range(a) if (int(prints[a, 0]) ^ int(prints[b, 0])).bit_count() <= 3]
    mine, theirs = parts(linked), parts(every)
    assert len(set(mine)) == len(set(theirs)) == len(set(zip(mine, theirs, strict=True)))


def test_near_duplicates_go(spark):
    r = random.Random(4)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(300)) for _ in range(20)]
    near = [(100 + k, t + " one more") for k, t in enumerate(base[:5])]
    docs = frame(spark, [*enumerate(base), *near, (200, base[7]), (201, None), (202, ""), (None, base[0])])
    out = simhash.near_duplicates_out(docs)
    assert out.columns == docs.columns
    assert sorted((x["doc_id"] for x in out.collect()), key=repr) == sorted([*range(20), 201, 202, None], key=repr)


def shingle_jaccard(x, y):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def test_near_duplicates_are_brute_force(spark):
    r = random.Random(5)
    docs = []
    for k in range(150):
        w = [r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(r.choice((8, 9, 12, 60, 200, 400)))]
        docs.append((10 * k, " ".join(w)))
        for j in range(1, 3):  # ends of other words: similarities on both sides of 0.8
            n = len(w) - max(1, int(len(w) * r.choice((0.05, 0.09, 0.1, 0.11, 0.13, 0.2))))
            docs.append((10 * k + j, " ".join([*w[:n], *(f"o{k}x{j}x{x}" for x in range(len(w) - n))])))
        docs.append((10 * k + 3, " ".join(w[: len(w) - len(w) // 10])))
    up = {i: i for i, _ in docs}

    def top(x):
        return x if up[x] == x else top(up[x])

    for (i, x), (j, y) in ((p, q) for n, p in enumerate(docs) for q in docs[n + 1 : n + 4] if p[0] // 10 == q[0] // 10):
        if shingle_jaccard(x, y) >= 0.8:
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    got = {x["doc_id"] for x in simhash.near_duplicates_out(frame(spark, docs)).collect()}
    want = {i for i in up if up[i] == i}
    assert 150 < len(want) < len(docs) - 100
    # a miss has a chance of about one in a thousand; wrong links have none
    assert want <= got and len(got - want) <= 2


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 60), (60, 60), (None, 3)], "a long, b long")
    assert {(r["a"], r["b"]) for r in roots(links).collect()} == {(k, 0) for k in range(1, 41)} | {(60, 50)}
    assert roots(links.limit(0)).count() == 0


# --- line windows and lines


def windows_removed(docs):
    """What the three-line windows take: {(id, text): kept text}."""
    distinct = sorted({(i, t) for i, t, _ in docs}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, out = set(), {}
    for i, t in distinct:
        lines = (t or "").split("\n")
        full = [(k, x.strip(" \t\r")) for k, x in enumerate(lines) if x.strip(" \t\r")]
        cut = set()
        for j in range(len(full) - 2):
            key = tuple(x for _, x in full[j : j + 3])
            if key in seen:
                cut.update((j, j + 1, j + 2))
            seen.add(key)
        gone = {full[j][0] for j in cut}
        for j in cut:
            if j + 1 in cut:
                gone.update(range(full[j][0], full[j + 1][0]))
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_windows_are_brute_force(spark):
    docs = [d for d in corpus() if not (d[0] == 9 and d[2] != "s1")]
    docs = [d for d in docs if d[0] != 9 or d[1] is not None]
    want = windows_removed(docs)
    got = linewindows.op9(frame(spark, docs))
    assert rows_of(got, "doc_id", "kept_text") == sorted(((i, want[i, t]) for i, t, _ in docs), key=repr)
    out = linewindows.dedup(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns
    left = sorted(((i, t if want[i, t] == (t or "") else want[i, t]) for i, t, _ in docs if want[i, t] == (t or "") or want[i, t].strip()), key=repr)
    assert rows_of(out, "doc_id", "text") == left
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_line_windows_of_one_id(spark):
    """Texts of one id rank by their hashes: one of them keeps the shared lines, and equal rows are treated alike."""
    shared = "one\ntwo\nthree\n"
    docs = frame(spark, [(1, shared + "a"), (1, shared + "b"), (1, shared + "b"), (2, shared + "c"), (None, None), (3, "")])
    got = sorted(((r["doc_id"], r["kept_text"]) for r in linewindows.op9(docs).collect()), key=repr)
    assert got[-1] == (None, "") and got.count((2, "c")) == 1 and got.count((3, "")) == 1
    first = [t for i, t in got if i == 1]
    assert sorted(first) in (sorted([shared + "a", "b", "b"]), sorted(["a", shared + "b", shared + "b"]))


def test_line_windows_need_no_python(spark):
    plan = linewindows.dedup(frame(spark, corpus(8)).withColumnsRenamed({"w": "lines", "id": "STARTS"}))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def units_removed(docs, unit, least):
    """{(id, text): (kept text, spans)} by walking all units in order."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in docs}, key=lambda x: (x[0] is not None, x[0] or 0)):
        found, kept, at, spans = [], "", 0, []
        for m in substring.UNITS[unit].finditer(t or ""):
            if words := SPACED.findall(m[0].translate(LOWER)):
                found.append((m.start(), m.end(), " ".join(words) in seen))
                seen.add(" ".join(words))
        k = 0
        while k < len(found):
            j = k
            while j < len(found) and found[j][2]:
                j += 1
            if j > k and sum(b - a for a, b, _ in found[k:j]) >= least:
                spans.append((found[k][0], found[j - 1][1]))
            k = max(j, k + 1)
        for a, b in spans:
            kept, at = kept + t[at:a], b
        out[i, t] = (kept + (t or "")[at:], spans)
    return out


@pytest.mark.parametrize(("unit", "least"), [("line", 1), ("sentence", 1), ("sentence", 60), ("paragraph", 1)])
def test_repeated_units_are_brute_force(spark, unit, least):
    docs = [d for d in corpus() if d[0] != 9] + [(9, "Über alles hier nun\n\nund so weiter. Fort", "s"), (15, "nichts\nÜber  alles hier nun\nX und so weiter. fort", "s"), (18, "漢字。漢字\n漢字。漢字", "s")]
    docs = [d for k, d in enumerate(docs) if d[0] not in (15, 18) or k >= len(docs) - 2]
    want = units_removed(docs, unit, least)
    got = sorted(((r["doc_id"], r["text"], [(s["start"], s["end"]) for s in r["removed"]]) for r in substring.dedup(frame(spark, docs), unit, least).collect()), key=repr)
    assert got == sorted(((i, *want[i, t]) for i, t, *_ in docs), key=repr)
    assert any(spans for _, _, spans in got)


def test_repeated_units_of_one_id(spark):
    docs = frame(spark, [(1, "Same words here. More of one."), (1, "Same words here. Other of one."), (1, "Same words here. Other of one.")])
    got = sorted(r["text"] for r in substring.dedup(docs, "sentence").collect())
    assert len(got) == 3 and len(set(got)) == 2 and sum(t.startswith("Same") for t in got) in (1, 2)
    assert substring.op3(docs.limit(0)).count() == 0
    short = frame(spark, [(1, "a line\nb"), (2, "A  Line\nc\nb")])  # by itself the operator takes lines, and all repeats go
    assert {r["doc_id"]: r["text"] for r in substring.dedup(short).collect()} == {1: "a line\nb", 2: "c\n"}


def test_paragraphs(spark):
    docs = frame(spark, [(1, "one two three four\nfive\n\nsix seven eight nine"), (2, "x\n\none two three four\nfive\n\ny")])
    got = {r["doc_id"]: r["text"] for r in substring.dedup(docs, "paragraph", 1).collect()}
    assert got == {1: "one two three four\nfive\n\nsix seven eight nine", 2: "x\n\ny"}


@pytest.fixture
def tiny_partitions(spark):
    """Adaptive execution's thresholds so small that a key with half the rows stands out."""
    held = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["lines", "windows", "components", "revisits"])
def test_a_hot_key_is_split(spark, tiny_partitions, monkeypatch, kind):
    """One unit, window, hub or payload in half the rows: adaptive execution splits the join it is in."""
    from lumenaudit.llm import common, components

    plans = []

    def keep(df, rows=None):  # runs the plan as written, and keeps what it became
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, rows)

    r = random.Random(3)
    if kind in ("lines", "windows"):
        module = substring if kind == "lines" else linewindows
        monkeypatch.setattr(module, "written", keep)
        docs = spark.createDataFrame([(k, "the same line\nas elsewhere\nin a row\n" * (k % 2) + "\n".join(f"{r.random()}" for _ in range(4))) for k in range(6000)], "doc_id long, text string").repartition(8)
        assert (substring.repeats(docs, "line") if kind == "lines" else linewindows.later_windows(docs)).count() > 2000
    elif kind == "components":
        monkeypatch.setattr(components, "written", keep)
        links = spark.createDataFrame([(0, k) for k in range(1, 6000)] + [(10_000 + 2 * k, 10_001 + 2 * k) for k in range(6000)], "a long, b long").repartition(8)
        assert roots(links).count() == 5999 + 6000
    else:
        monkeypatch.setattr(warc, "written", keep)
        pages = spark.createDataFrame([(k, f"u{k}", f"{k if k % 2 else 0}", 500) for k in range(12_000)], "id long, url string, digest string, n_bytes long").repartition(8)
        assert warc.revisits(pages).count() == 6000
    assert any("SortMergeJoin(skew=true)" in p for p in plans)


# --- decontamination


def test_fm_index_is_brute_force():
    r = np.random.default_rng(3)
    for _ in range(60):
        seq = np.r_[0, r.integers(0, 4, int(r.integers(1, 60))), 0]
        index = fmindex.FMIndex(seq, 3)
        for _ in range(5):
            p = r.integers(1, 4, int(r.integers(1, 5)))
            lo, hi = index.search(np.r_[np.zeros(5 - len(p), np.int64), p][None, :])
            want = [k for k in range(len(seq) - len(p) + 1) if (seq[k : k + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def hits(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, t, _ in docs:
        w, hit, named = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit.update(range(k, k + n))
                    named |= grams[g]
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def exam():
    r = random.Random(5)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(11, 20)))) for i in range(12)]
    items += [(100, "Kappa, NU  mu!"), (101, ""), (102, None), (103, items[0][1]), (104, "un peu d'été é")]
    docs = corpus(40, 6) + [(500, f"x {items[0][1]} y {items[1][1].upper()}.", "s"), (501, "kappa nu mu kappa-nu/mu", "s"), (502, "Un peu D été É", "s"), (503, " ".join(items[2][1].split()[:10]), "s"), (504, " ".join(items[2][1].split()[:9]), "s")]
    return docs, items


@pytest.mark.parametrize("more", [{}, {"shard_words": 50}, {"block_windows": 20}, {"block_windows": 30, "item_words": 3}])
def test_decontamination_is_brute_force(spark, exam, more):
    docs, items = exam
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find(frame(spark, docs), bench, **more)
    got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["spans"])) for r in found.collect()), key=repr)
    assert got == hits(docs, items)
    if not more:
        columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert rows_of(decontam.op10(frame(spark, docs), bench), *columns) == hits(docs, items)


def test_many_items_of_one_text(spark, monkeypatch):
    """Three hundred items share a text, and others a window of it: the text is sent once, and all are named."""
    long = " ".join(f"w{k}" for k in range(25))
    items = [(k, long) for k in range(300)] + [(1000 + k, " ".join(long.split()[k : k + 12]) + f" own{k}") for k in range(10)] + [(2000, long.upper())]
    docs = [(1, f"a {long} b {long}", "s"), (2, " ".join(long.split()[3:14]), "s"), (3, "nothing of it", "s"), (1, f"a {long} b {long}", "s"), (None, long, "s")]
    sent = []
    plain = decontam._pass
    monkeypatch.setattr(decontam, "_pass", lambda df, block, *more: (sent.append(len(block)), plain(df, block, *more))[1])
    for more in ({}, {"block_windows": 20}):
        found = decontam.find(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **more)
        got = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["spans"])) for r in found.collect()), key=repr)
        assert got == hits(docs, items)
    assert sent[0] == 11 == sum(sent[1:]) and len(sent) > 3


def test_clean_text(spark, exam):
    docs, items = exam
    out = decontam.clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == frame(spark, docs).columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[500] == "x y."
    assert 501 not in got and 503 not in got
    assert got[504] == dict((i, t) for i, t, _ in docs)[504]
    assert not any(x[5] for x in hits([(i, t, None) for i, t in got.items() if i != 500], items))


def test_without_spans():
    assert decontam.without_spans("Ää, b c. d\n".encode(), [(1, 3)]).decode() == "Ää,. d\n"
    assert decontam.without_spans(b"a b c", [(0, 3)]) == b""


def test_no_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontam.op10(frame(spark, corpus(8)), none).collect()} == {False}


# --- mixing


def mix(docs):
    size = [len(SPACED.findall(t or "")) for _, t, _ in docs]
    totals = {}
    for (_, _, s), n in zip(docs, size, strict=True):
        totals[s] = totals.get(s, 0) + n
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    targets, open_, left = {}, set(order), sum(totals.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * totals[s]}
        if not over:
            targets |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            targets[s] = 3.0 * totals[s]
            left -= 3 * totals[s]
        open_ -= over
    return totals, targets


def test_mixing(spark):
    docs = [d for d in corpus(60, 7)]
    docs += [(900 + k, "tiny", "t1") for k in range(2)]
    totals, targets = mix(docs)
    got = mixing.plan(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    by: dict = {}
    keyed = {}
    for i, t, s in docs:
        keyed.setdefault(i, set()).add(s)
    for r in mixing.plan(frame(spark, docs), carry=["source"]).collect():
        s = r["__c_source"]
        assert r["source_size"] == totals[s]
        assert r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[s] = by.get(s, 0) + r["taken"]
    assert by == {s: int(targets[s] + 0.5) for s in totals}
    again = sorted(map(tuple, mixing.op5(frame(spark, docs).repartition(5)).collect()), key=repr)
    assert again == sorted(map(tuple, mixing.op5(frame(spark, docs)).collect()), key=repr)
    assert mixing.mixed(frame(spark, docs).withColumnsRenamed({"w": "epoch", "id": "Words"})).columns[-2:] == ["_epoch", "_words"]
    whole = mixing.mixed(frame(spark, docs))
    assert whole.columns == [*frame(spark, docs).columns, "epoch", "words"]
    for r in whole.collect():
        assert len(SPACED.findall(r["text"])) == r["words"] and r["n_chars"] == len(r["text"])
    assert whole.agg(F.sum("words")).first()[0] == sum(by.values())


def test_mixing_nothing(spark):
    assert mixing.op5(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.op5(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


# --- licences


def test_licences(spark):
    rows = [
        (1, "Released under the MIT License. mit LICENSE, mit-license"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "the mit and its license; general, public a license apache"),
        (5, None),
        (6, ""),
        (7, "x\x1cMIT\nLICENSE " + "word " * 50_000 + "Apache  license"),
        (8, "éMIT license mit licensé"),
        (9, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
        (10, "Permission is hereby granted, free of charge, to nobody"),
        (2, "Licensed under the Apache License, Version 2.0."),
        (11, "under the terms of the GNU General Public License version 3"),
        (12, "licensed under the Mozilla Public License v 2.0"),
        (14, "Copyright X. " + " ".join(dict((t.label, t.words) for t in licenses.TEMPLATES)["mit-full"]).upper() + " end"),
        (15, " ".join(w if k % 4 else "other" for k, w in enumerate(dict((t.label, t.words) for t in licenses.TEMPLATES)["isc-full"][15:]))),
        (16, " ".join(w for t in licenses.TEMPLATES for w in t.words)),
        (13, "MIT LICENSE, İSC ÉCOLE \u212aey mit\u0130license MIT license\u212a"),
    ]
    got = rows_of(licenses.op6(frame(spark, rows)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        at = [(k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=repr)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.op6(frame(spark, rows)).collect()}
    assert labels[2] == ("apache,apache-2.0", 1.0)
    assert labels[3] == ("gpl,gpl-3.0", 1.0)
    assert labels[11][0] == "gpl,gpl-3.0" and labels[12] == ("mpl-2.0", 1.0)
    for i, t in rows:  # every label and the score from the words alone
        w = ALNUM.findall((t or "").translate(LOWER))
        shares = {}
        for x in licenses.TEMPLATES:
            a, b = x.key
            for k in range(len(w) - (b - a) + 1):
                if tuple(w[k : k + b - a]) == x.words[a:b]:
                    share = sum(0 <= k - a + j < len(w) and w[k - a + j] == y for j, y in enumerate(x.words)) / len(x.words)
                    if share >= licenses.SHARE:
                        shares[x.label] = max(share, shares.get(x.label, 0))
        assert labels[i] == (",".join(sorted(shares)), pytest.approx(max(shares.values(), default=0.0)))
    assert labels[9][0] == "mit-text" and 0.6 <= labels[9][1] < 1
    assert labels[4] == labels[10] == ("", 0.0) and labels[14][0] == "mit-full,mit-text" and labels[15][0] == ""
    assert set(labels[16][0].split(",")) == {t.label for t in licenses.TEMPLATES}
    assert not re.search("Python|Pandas|Arrow", licenses.op6(frame(spark, rows))._jdf.queryExecution().toString())
    assert licenses.op6(frame(spark, [])).count() == 0


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "ü" * 200
    pages = [(k, f"https://a.example/{k}", f"<html><body>{'text ' * (k % 7)}{k}</body></html>") for k in range(40)]
    pages += [(50, "https://a.example/x y\n", long), (51, None, long), (49, "u", long), (60, "u", None), (61, "u", ""), (62, "u", "short"), (63, "u", "short"), (49, "u", long), (None, "u", long)]
    df = spark.createDataFrame([(*p, "extra", "x") for p in pages], "page_id long, url string, html string, first string, digest string")
    payload = lambda h: (h or "").encode()
    want, seen = [], set()
    for i, _, h in pages:
        same = [j for j, _, x in pages if j is not None and payload(x) == payload(h)]
        revisit = len(payload(h)) >= 100 and bool(same) and (i != min(same) or (i, h) in seen)
        seen.add((i, h))
        want.append((i, len(payload(h)), hashlib.sha256(payload(h)).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert sum(w[3] == "revisit" for w in want) == 4
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(warc.op7(df), *columns) == sorted(want, key=repr)
    assert warc.op7(df.limit(0)).count() == 0
    folder = f"file://{tmp_path}/pages"
    back = warc.read(warc.write(df, folder), folder).collect()
    assert len({r["record_id"] for r in back}) == len(back) == len(pages)
    assert sorted((bytes(r["payload"]) for r in back if r["payload"] is not None), key=repr) == sorted((payload(h) for (_, _, h), w in zip(pages, want, strict=True) if w[3] == "response"), key=repr)


def test_warc_of_pages_without_ids(spark):
    df = spark.createDataFrame([(None, "a", "x" * 200), (None, "b", "x" * 200)], "page_id long, url string, html string")
    assert rows_of(warc.op7(df), "page_id", "record_type", "refers_to") == [(None, "response", None)] * 2


def test_warc_file(spark, tmp_path):
    import zstandard

    df = spark.createDataFrame([(k, f"https://a.example/{k}", f"<html>{'lorem ipsum dolor ' * 30}{k}{k * 7919}</html>") for k in range(300)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    found = warc.read(warc.write(df.coalesce(1), folder), folder)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in found.collect()} == {r["page_id"]: r["html"] for r in df.collect()}
    (file,) = (tmp_path / "w").glob("*.warc.zst")
    data = file.read_bytes()
    assert data[:4] == bytes.fromhex("5d2a4d18")
    size = int.from_bytes(data[4:8], "little")
    assert size > 0
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(data[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


# --- top k


def best_of(vectors):
    """Of unique ids: the 20 best of each query by all products."""
    fine = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q, v in fine.items():
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in fine.items() if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return sorted(want, key=repr)


def test_top_k_is_brute_force(spark):
    r = np.random.default_rng(8)
    vectors = [(int(k), [float(x) for x in v]) for k, v in enumerate(np.round(r.normal(size=(300, 6)), 1))]
    vectors += [(1000 + k, vectors[0][1]) for k in range(30)] + [(2000, None), (2020, [float("nan")] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [float("inf")] * 6), (20, vectors[20][1]), (None, vectors[1][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, pivot int, shard int")
    assert rows_of(mtree.op4(df), "query_id", "rank", "vec_id", "score") == best_of(vectors)
    few = df.where("vec_id in (20, 40, 41)")
    assert mtree.op4(few).count() == 4
    assert mtree.op4(df.limit(0)).count() == 0


def test_top_k_of_an_id_with_two_vectors(spark):
    vectors = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (2, [0.7, 0.7]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert rows_of(mtree.op4(df), "query_id", "rank", "vec_id", "score") == best_of([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.7, 0.7]), (20, [0.0, 1.0]), (21, [0.0, 0.0])])


def test_top_k_of_empty_vectors(spark):
    rows = spark.createDataFrame([(20, []), (1, []), (2, None), (40, [])], "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mtree.op4(rows).collect()) == [(20, 1, 1, 0), (20, 2, 40, 0), (40, 1, 1, 0), (40, 2, 20, 0)]


def test_top_k_of_large_components(spark):
    rows = [(20, [2.0**24, 1.0]), (1, [2.0**24, 3.0]), (2, [2.0**24, -2.0])]
    frame_of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in mtree.op4(frame_of(rows)).orderBy("rank").collect()]
    assert got == [(1, 2**60 + 64 * 192), (2, 2**60 - 64 * 128)]
    with pytest.raises(ValueError, match="64 bits"):
        mtree.op4(frame_of([(20, [2.0**30])]))


@pytest.mark.parametrize("clustered", [True, False])
def test_top_k_over_many_shards(spark, clustered):
    """Dozens of pivots, shards, rounds and copies of trees."""
    r = np.random.default_rng(9)
    points = r.normal(size=(40, 8))[r.integers(0, 40, 1500)] * 3 + r.normal(size=(1500, 8)) * 0.05 if clustered else r.normal(size=(1500, 8))
    points[700:900] = points[700]  # one vector that many ids share
    vectors = [(k, [float(x) for x in v]) for k, v in enumerate(points)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = mtree.top_k(df, F.col("vec_id") % 20 == 0, pivots=24, per_pivot=10, shard=40, asked=16)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == best_of(vectors)


# --- classifiers


def junky(n=400, seed=9):
    r = random.Random(seed)
    good = lambda: ". ".join(" ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randint(5, 15))).capitalize() for _ in range(8)) + "."
    kinds = [lambda: " ".join(w + "***" for w in good().split()), lambda: " ".join(w.upper() + "!!" for w in good().split()), lambda: " | ".join(good().split()), lambda: "buy now cheap " * 60]
    return [(k, good() if k % 5 else r.choice(kinds)()) for k in range(n)]


def test_quality(spark):
    rows = junky()
    docs = frame(spark, [*rows, (5000, None), (5001, ""), (5002, "Short one."), (3, rows[3][1]), (5003, " ".join(t for _, t in rows if "***" not in t) * 20), (5004, "spam! " * 60_000)])
    got = {r["doc_id"]: r for r in quality.op1(docs).collect()}
    right = sum(got[i]["keep"] == bool(i % 5) for i, _ in rows)
    assert right >= 0.95 * len(rows)
    assert sum(not got[i]["keep"] for i, _ in rows if i % 5) == 0
    assert {i: r["score"] for i, r in got.items()} == {r["doc_id"]: r["score"] for r in quality.op1(docs.repartition(5)).collect()}
    assert not got[5004]["keep"]
    clash = docs.withColumnsRenamed({"w": "quality", "id": "_quality"})
    assert quality.kept(clash).columns == clash.columns
    assert quality.kept(docs).count() == sum(got[i]["keep"] for i, _ in [*rows, *((i, 0) for i in (5000, 5001, 5002, 5003, 5004, 3))])
    assert quality.op1(frame(spark, [])).count() == 0


def votes_of(text):
    """The nine votes, trait by trait, from the text alone: 1 good, -1 bad, 0 none."""
    raw = (text or "").encode()
    words, n = raw.split(), len(raw.split())
    if not n:
        return [0] * 9
    mark, letter = rb"[^A-Za-z0-9\x80-\xff]", rb"[A-Za-z\x80-\xff]"
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    letters = len(re.findall(letter, raw))
    triples = [tuple(words[k : k + 3]) for k in range(n - 2)]
    function = sum(w in quality.FUNCTION_WORDS for w in words) / n
    below = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
    above = lambda x, good, bad: 1 if x >= good else -1 if x <= bad else 0
    return [
        below(sum(bool(re.search(mark + mark, w)) for w in words) / n, 0.02, 0.2) if n >= 16 else 0,
        below(len(re.findall(rb"[A-Z]", raw)) / max(1, letters), 0.2, 0.5) if n >= 16 else 0,
        below(max(0.0, 1 - len(set(triples)) / max(1, n - 2)), 0.1, 0.3) if n >= 20 else 0,
        below(sum(bool(re.fullmatch(mark + b"+", w)) for w in words) / n, 0.05, 0.2) if n >= 16 else 0,
        below(1 - len(set(lines)) / len(lines), 0.1, 0.3) if len(lines) >= 4 else 0,
        above(letters / sum(map(len, words)), 0.9, 0.75) if n >= 16 else 0,
        below(1 - len(set(words)) / n, 0.45, 0.7) if 20 <= n <= 2000 else 0,
        below(abs(len(raw) / n - 6), 3, 6) if n >= 20 else 0,
        above(function, 0.15, 0.08) if n >= 50 and function else 0,
    ]


def dense_fit(rows, rounds=200, rate=0.05, ridge=1e-4):
    """The scorer's descent over a dense matrix of the buckets that any row has; rows: (buckets and values, probability of good)."""
    used = sorted({b for f, _ in rows for b in f})
    x = np.array([[f.get(b, 0.0) for b in used] + [1.0] for f, _ in rows])
    y = np.array([p for _, p in rows])
    w = np.r_[np.zeros(len(used)), 2.0]
    first = second = np.zeros_like(w)
    for t in range(1, rounds + 1):
        gradient = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(rows) + ridge * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return dict(zip(used, w[:-1], strict=True)), w[-1]


def test_quality_is_brute_force(spark):
    """Votes from the texts, EM document by document, the scorer's features from the texts, and its fit over a dense matrix."""
    import math
    from collections import Counter

    rows = junky(150)
    got = {r["doc_id"]: r for r in quality.op1(frame(spark, rows)).collect()}
    votes = {i: votes_of(t) for i, t in rows}
    assert {i: list(r["votes"]) for i, r in got.items()} == votes
    assert {x for v in votes.values() for x in v} == {-1, 0, 1}
    bad = {i: 0.9 if -1 in v else 0.05 for i, v in votes.items()}
    for _ in range(100):
        weight = 0.01 * len(rows)
        right = [[(sum(p[i] for i, v in votes.items() if v[k] == sign) + prior * weight) / (sum(p[i] for i, v in votes.items() if v[k]) + weight) for k in range(len(quality.LABELLERS))] for p, sign, prior in ((bad, -1, 0.6), ({i: 1 - x for i, x in bad.items()}, 1, 0.95))]
        share = (sum(bad.values()) + 1) / (len(rows) + 10)
        held = [[min(0.999, max(0.001, x)) for x in r] for r in right]
        for i, v in votes.items():
            odds = math.log(share / (1 - share))
            for k, x in enumerate(v):
                odds += math.log(held[0][k] / (1 - held[1][k])) if x < 0 else math.log((1 - held[0][k]) / held[1][k]) if x > 0 else 0
            bad[i] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    assert {i: round(1 - x, 5) for i, x in bad.items()} == {i: pytest.approx(r["weak"], abs=2e-5) for i, r in got.items()}
    features = {}
    for i, text in rows:
        words = text.encode().split()
        found = Counter()
        for w in words:
            shape = re.sub(rb"[a-z]", b"a", re.sub(rb"[A-Z]", b"A", w))
            found[b"shape:" + re.sub(rb"(.)\1+", rb"\1\1", shape)[:12]] += 1
            found[b"word:" + w.lower()] += 1
        for c in Counter(words).values():
            found[b"times:%d:%d" % (c.bit_length(), len(words).bit_length())] += c
        buckets = Counter()
        for name, c in found.items():
            buckets[zlib.crc32(name) % quality.DIMENSIONS] += c
        features[i] = {b: math.sqrt(c / len(words)) for b, c in buckets.items()}
    weights, bias = dense_fit([(features[i], 1 - bad[i]) for i, _ in rows])
    for i, f in features.items():
        z = bias + sum(weights[b] * x for b, x in f.items())
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)
        assert got[i]["keep"] == (got[i]["score"] >= 0.5)


def test_label_model():
    r = np.random.default_rng(10)
    truth = r.random(20_000) < 0.2
    right = [(0.9, 0.95), (0.7, 0.9), (0.6, 0.97)]
    counts: dict = {}
    for bad in truth:
        v = [(-1 if r.random() < b else 1) if bad else (1 if r.random() < g else -1) for b, g in right] + [0] * (len(quality.LABELLERS) - 3)
        counts[tuple(v)] = counts.get(tuple(v), 0) + 1
    m = quality.LabelModel(counts)
    assert m.prior == pytest.approx(0.2, abs=0.05)
    for k, (b, g) in enumerate(right):
        assert m.right[0][k] == pytest.approx(b, abs=0.1) and m.right[1][k] == pytest.approx(g, abs=0.05)


@pytest.mark.parametrize("rows", [40, 2, 0])
def test_block_max_is_exact(monkeypatch, rows):
    """With as many common terms in the matrix as there are, two, or none."""
    r = random.Random(11)
    vectors = []
    for _ in range(1000):
        at = sorted({int(40 * r.random() ** 3) for _ in range(r.randint(1, 9))})
        w = np.array([r.choice((0.1, 0.5, 1.0)) + (t > 30) for t in at])
        vectors.append((np.array(at), w / np.sqrt(w @ w)))
    whole = np.zeros((1000, 40))
    for k, (t, w) in enumerate(vectors):
        whole[k, t] = w
    monkeypatch.setattr(toxicity, "MATRIX_BYTES", rows * 8 * 1024)
    index = toxicity.BlockMaxIndex(vectors, 40)
    assert (len(index.matrix) == rows if rows < 40 else 2 < len(index.matrix) < 40) and index.blocks > 10
    for v, (cosines, entries) in zip(vectors[:80], index.nearest(vectors[:80], 10), strict=True):
        every = np.round(sum(whole[:, t] * w for t, w in zip(*v, strict=True)), 9)
        want = sorted(((-s, k) for k, s in enumerate(every.tolist()) if s > 0))[:10]
        assert [(round(s, 6), k) for s, k in zip(cosines.tolist(), entries.tolist(), strict=True)] == [(round(min(1.0, -s), 6), k) for s, k in want]
    assert [len(x) for x in toxicity.BlockMaxIndex([], 3).nearest([(np.array([0]), np.ones(1))], 5)[0]] == [0, 0]


def toxic_rows(n=600):
    r = random.Random(12)
    prose = lambda: [r.choice(WORDS) + r.choice(WORDS) for _ in range(60)]
    rows, labels = [], []
    for k in range(n):
        w, toxic = prose(), k % 6 == 0
        for _ in range(3 * toxic):
            w.insert(r.randint(0, 60), r.choice(["vilefool", "vilefools", "rotter", "dolt"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, [*rows, (5000, None), (5001, ""), (5002, "unheard of"), (5003, "alphabeta " * 40_000), (7, rows[7][1])])
    known = spark.createDataFrame([(i, 1, t, "x") for i, t in labels] + [(9999, 1, 1, "x"), (None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = {x["doc_id"]: x for x in toxicity.op2(docs, known).collect()}
    out = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, x in got.items() if x["held_out"] and i < 5000} == out
    assert sum(got[i]["predicted"] == t for i, t in labels if i in out) >= 0.97 * len(out)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())
    assert got[5000]["score"] == got[5001]["score"] == got[5002]["score"] < 0.3
    assert got[5003]["predicted"] == 0
    assert {x["score"] for x in toxicity.op2(docs, known.limit(0)).collect()} == {0.0}
    flipped = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x["doc_id"]: x["score"] for x in toxicity.op2(docs.repartition(5), flipped).collect()} == {i: x["score"] for i, x in got.items()}
    assert toxicity.op2(frame(spark, []), known).count() == 0


def test_long_examples_are_passed_over(spark):
    """The sample is bounded in words: a long example is no example, and the others still are."""
    rows, labels = toxic_rows(120)
    long = [(2000 + k, "vilefool " + " ".join(f"w{k}x{j}" for j in range(3000))) for k in range(4)]
    known = spark.createDataFrame([*labels, *((i, 0) for i, _ in long)], "doc_id long, toxic int")
    docs = frame(spark, [*rows, *long])
    model, _ = toxicity.train(docs, known, fit_words=5_900)
    learnt = {i for ids in model.ids for i in ids}
    assert len(learnt) > 40 and len(learnt & {i for i, _ in long}) < 2
    assert toxicity.op2(docs, known).count() == len(rows) + 4


def test_toxicity_is_brute_force(spark):
    """The whole query again from the texts: every cosine with every example, votes, calibration."""
    import math
    from collections import Counter

    rows, labels = toxic_rows(240)
    rows += [(1000, rows[6][1]), (1001, rows[12][1] + " extra words"), (1002, "dolt")]
    got = {x["doc_id"]: x for x in toxicity.op2(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    text, words = dict(rows), {i: Counter(ALNUM.findall(t.translate(LOWER))) for i, t in rows}
    learnt = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    starts = lambda w: [w[:n] + "*" for n in (4, 5, 6) if len(w) >= n]
    n1, n0 = sum(t for _, t in learnt), sum(1 - t for _, t in learnt)

    def speaks(holds):
        a, b = (sum(holds(i) for i, t in learnt if t == label) for label in (1, 0))
        chi2 = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n1 + n0 - a - b + 1e-9) * n1 * n0)
        return a >= max(3, 0.02 * n1) and chi2 >= 12 and (a + 0.5) / (n1 + 1) >= 2.5 * (b + 0.5) / (n0 + 1)

    stems = {s for s in {s for i, t in learnt if t for w in words[i] for s in starts(w)} if speaks(lambda i, s=s: any(s in starts(w) for w in words[i]))}
    loud = stems | {w for w in {w for i, t in learnt if t for w in words[i]} if speaks(lambda i, w=w: w in words[i])}
    assert stems and loud - stems
    terms = {}
    for i, c in words.items():
        terms[i] = Counter(c)
        for w, n in c.items():
            for s in starts(w):
                if s in stems:
                    terms[i][s] += n
    df = Counter(t for c in terms.values() for t in c)
    known = {t for i, _ in learnt for t in terms[i]}
    idf = lambda t: (math.log((1 + len(rows)) / (1 + (df[t] if t in known else 0))) + 1) * (3 if t in loud else 1)
    vectors = {}
    for i, c in terms.items():
        v = {t: (1 + math.log(n)) * idf(t) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    groups = {}
    for i, t in learnt:
        groups.setdefault(tuple(sorted((w, round(x, 9)) for w, x in vectors[i].items())), []).append((i, t))
    groups = sorted(groups.values())
    base = n1 / (n1 + n0)

    def vote(i, but=None):
        near = sorted(((-round(sum(x * vectors[g[0][0]].get(w, 0) for w, x in vectors[i].items()), 9), k) for k, g in enumerate(groups)))
        cut = near[23][0] if len(near) > 23 else 0
        assert cut == 0 or sum(s == cut for s, _ in near) == 1  # no tie at the last neighbour
        top, every = 0.5 * base, 0.5
        for s, k in near[:24]:
            for j, t in groups[k]:
                if s < 0 and j != but:
                    top, every = top + t / (1.05 - min(1.0, -s)), every + 1 / (1.05 - min(1.0, -s))
        return top / every

    left = sorted((round(vote(i, i), 9), t) for i, t in learnt)
    fit = [(sum(x for x, _ in p) / len(p), sum(t for _, t in p) / len(p)) for p in pooled(left)]
    for i in text:
        want = float(np.interp(round(vote(i), 9), [x for x, _ in fit], [y for _, y in fit]))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6), i


def pooled(points):
    """Groups of neighbours until their mean labels increase."""
    same: dict = {}
    for x, t in points:
        same.setdefault(x, []).append((x, t))
    pools = [same[x] for x in sorted(same)]
    mean = lambda p: sum(t for _, t in p) / len(p)
    k = 0
    while k + 1 < len(pools):
        if mean(pools[k]) >= mean(pools[k + 1]) - 1e-12:
            pools[k : k + 2] = [pools[k] + pools[k + 1]]
            k = max(0, k - 1)
        else:
            k += 1
    return pools
