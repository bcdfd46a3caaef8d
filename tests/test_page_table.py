"""Queries over the page table on pages that its smallest copies lack, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from lumenaudit.plans import oracle, queries
from lumenaudit.sources import html

#: Headings that end inside a character reference, with and without one that is whole.
CUT = ("Fish &amp; chips &amp", "&quot;Tea&quot; &lt", "&amp;&am", "&copy; 2024 &copy", "plain", "&amp;amp; &gt")


@pytest.fixture(scope="module")
def cut_pages(tmp_path_factory):
    at = tmp_path_factory.mktemp("cut")
    page = lambda t: f"<html><head><title>{t}</title><script>var a = 1 && 2;</script></head><body><h1>{t}</h1><article><p>Some words of a page</p></article><ul><li><a href=\"/x?a=1&amp;b=2\">one</a></li></ul></body></html>"
    c = duckdb.connect()
    c.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(n, f"https://a{n % 2}.example/{n}", page(t.replace("&copy", "&quot"))) for n, t in enumerate(CUT)])
    c.sql(f"COPY pages TO '{at}/pages.parquet'")
    return str(at), c


def agree(name, spark, cut_pages):
    at, c = cut_pages
    want = c.sql(oracle.oracle_sql()[name])
    got = queries.queries()[name](spark, at).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_references_cut_off_in_titles(spark, cut_pages):
    agree("page_basics", spark, cut_pages)


@pytest.mark.parametrize("name", ["page_signals", "page_rule_scores", "page_audits"])
def test_references_cut_off_in_texts(name, spark, cut_pages):
    agree(name, spark, cut_pages)


def test_whole_references_only():
    page = "<p title='&lt'>a &lt &lt; &ampx; &#65 &#65; &notit; &nosuch; &copy</p>"
    assert html.Tree(page, bare=False).body.text() == "a &lt < &ampx; &#65 A &notit; &nosuch; &copy"
    assert html.Tree(page).body.text() == "a < < &x; A A ¬it; &nosuch; ©"
