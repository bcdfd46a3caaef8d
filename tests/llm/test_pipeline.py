"""The ten queries against SQL, and the pipeline stage by stage."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import corpus_pipeline
from lumenaudit.llm import queries, sql
from lumenaudit.llm.common import documents, written


def rows(df, columns):
    def plain(x):
        if x is None or str(x) in ("<NA>", "nan") or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) if hasattr(x, "dtype") or isinstance(x, (bool, int, float)) else str(x)

    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_as_sql(name, spark, sf_dir, duck):
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), duck.sql(sql.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_one_query_each():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        assert docs.columns == documents(spark, sf_dir).columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert set(documents(spark, sf_dir).columns) <= set(last.columns)
    assert last.join(docs, "doc_id", "left_anti").count() == 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in last.collect())


@pytest.mark.parametrize("k", range(5))
def test_stage_of_nothing(spark, sf_dir, k):
    assert corpus_pipeline.STAGES[k][1](spark, documents(spark, sf_dir).limit(0), sf_dir).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, epoch int, words string, lines int, cuts int, spans int, hash int, quality double, gone string, left string, hit_id long"


@pytest.mark.parametrize("k", range(5))
def test_stage_of_odd_rows(spark, sf_dir, k):
    """Nulls, empty and long texts, repeated ids and rows, ties, and columns whose names the stages might use."""
    name, stage = corpus_pipeline.STAGES[k]
    prose = [r["text"] for r in documents(spark, sf_dir).where("lang = 'en' and length(text) > 400 and not contains(text, '!!')").limit(12).collect()]
    texts = [*prose, prose[0], prose[0] + " more", None, "", "  \n ", "Word. " * 30_000, "\n".join(["Same line here."] * 50)]
    rows = [(n, t, "en", None if n % 5 == 0 else f"s{n % 3}") for n, t in enumerate(texts)] + [(2, prose[2], "en", "s1"), (2, prose[3], "en", "s1"), (None, prose[4], None, None), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "w", 1, 2, 3, 4, 0.5, "g", "l", 7) for r in rows], ODD)
    out = written(stage(spark, docs, sf_dir))
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.columns[len(docs.columns) :] == (["_epoch", "_words"] if k == 4 else [])
    if k == 4:
        assert all(r["_words"] == len(r["text"].split()) and r["n_chars"] == len(r["text"]) for r in out.collect())
    else:
        assert 10 <= out.count() <= docs.count()
        kept = {(r["doc_id"], r["text"]) for r in out.collect()}
        own = {(r[0], r[1]) for r in rows}
        if k in (0, 2):
            assert kept <= own
        if k == 2:
            assert not {(12, prose[0]), (13, prose[0] + " more")} & kept and (None, None) in kept
