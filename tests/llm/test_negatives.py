"""Hard negatives against brute force, over tiles of any size."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenaudit.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, block int, id int, data string, scores int, w int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "d", 3, 4) for r in rows], SCHEMA)


def table(n=260, width=11, seed=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, width))
    rows = [(k, (centres[k % 4] + r.normal(size=width) * 0.4).astype(np.float32).tolist(), int(k % 4 if r.random() < 0.8 else r.integers(0, 4))) for k in range(n)]
    rows += [(k, rows[1][1], rows[1][2]) for k in range(1000, 1040)]  # equal vectors, so ties
    rows += [(k, rows[1][1], 3 - rows[1][2]) for k in range(1100, 1120)]
    rows += [(2000, None, 1), (2100, [1.0, None], 1), (2200, [math.nan] * width, 1), (2300, [math.inf] * width, 1), (2400, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(2500, [], 1), (2600, rows[3][1][:5], 2), (100, rows[100][1], rows[100][2]), (2700, [0.0] * width, 0)]
    return rows


def want(rows):
    width = max(len(v) for _, v, _ in rows if v)
    used = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used[i] = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v] + [0] * (width - len(v)))
    ids = sorted(used)
    m = np.array([used[i][1] for i in ids], object)
    out = set()
    for a in (i for i in ids if i % 100 == 0):
        scores = dict(zip(ids, (m @ np.array(used[a][1], object)).tolist(), strict=True))
        ranked = sorted((i for i in ids if i != a), key=lambda i: (-scores[i], i))
        for p in [i for i in ranked if used[i][0] == used[a][0]][:5]:
            found = [i for i in ranked if used[i][0] != used[a][0] and 80 * scores[p] <= 100 * scores[i] <= 100 * scores[p]]
            out |= {(a, p, k + 1, i, scores[p], scores[i]) for k, i in enumerate(found[:5])}
    return out


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))



def test_negatives_are_brute_force(spark):
    rows = table()
    full = want(rows)
    assert len(full) > 50
    assert {tuple(r) for r in negatives.op13(frame(spark, rows)).collect()} == full


@pytest.mark.parametrize(("rows_", "anchors", "dims", "round_bytes"), [(16, 2, 3, 10_000), (50, 1, 1, 1 << 30), (3, 64, 64, 1 << 30)])
def test_tiles_make_the_same_whole(spark, rows_, anchors, dims, round_bytes):
    """Panels of few rows (some of them empty), chunks of few dimensions, and several rounds."""
    rows = table(120, 7, 5)
    got = negatives.mined(frame(spark, rows), F.col("vec_id") % 100 == 0, label(), rows=rows_, anchors=anchors, dims=dims, round_bytes=round_bytes)
    assert {tuple(r) for r in got.collect()} == want(rows)


def test_large_scores(spark):
    rows = [(100, [2.0**18, 1.0], 1), (1, [2.0**18, 3.0], 1), (2, [2.0**18, 2.0], 2), (3, [-(2.0**18), 2.0], 2)]
    assert {tuple(r) for r in negatives.op13(frame(spark, rows)).collect()} == want(rows) != set()
    with pytest.raises(ValueError, match="64 bits"):
        negatives.op13(frame(spark, [(100, [2.0**30], 1)]))


def test_nothing_to_mine(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [], 1), (1, [], 1), (2, [], 2)]):
        got = negatives.op13(frame(spark, rows)).collect()
        assert len(got) == (1 if len(rows) == 3 else 0)  # empty vectors score zero, and zero is in the window of zero
