"""Plain tokens, read by patterns, against html.parser's own methods."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from test_sources import PAGE

from lumenaudit.sources import html

PARTS = """<p>|</p>|<P>|<div id="root">|</div>|<li>|<ul>|</ul>|<table>|<td>|</table>|<svg>|<svg/>|</svg >|<a href="/x">|<a href='/y#f'>|<a href=z>|<a hr\tef>|</a>|<br/>|<img src="a" alt="b">|<img src='a&lt;' SRC="b"
 alt>|<form action="/s">|<script>|</script>|<script type="application/ld+json">{"@type": "Person"}</ script >|<style>x</style>|<title>T &amp; t</title>|<body>|<body class="c" class="d">|</body>|<html lang="x">|<main>|</main>|<h2>Is it?</h2>|<!-- c -->|<!doctype html>|<|< a|</|a > b|<x toolname="t">|<a b="c"d>|<a b="x|&amp|&copy; x|word""".split("|")


def _shape(page: str, scripts: bool, bare: bool) -> list:
    tree = html.Tree(page, scripts, bare)
    return [(n.tag, n.attrs, n.parent and n.parent.tag, [c if isinstance(c, str) else c.tag for c in n.children]) for n in (tree.root, *tree.nodes)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.just(PAGE), st.lists(st.sampled_from(PARTS), max_size=25).map("".join)), st.booleans(), st.booleans())
def test_plain_tokens_are_those_of_the_parser(page, scripts, bare):
    plain, patterns = html._TOKEN, re.compile("([^<]*)(?:(?!)(.)(.)(.)(.))?")
    fast = _shape(page, scripts, bare)
    html._TOKEN = patterns
    try:
        assert _shape(page, scripts, bare) == fast
    finally:
        html._TOKEN = plain


def test_long_attributes_are_not_kept():
    html._attributes.cache_clear()
    long = "x" * (2 * html.SHORT)
    tree = html.Tree(f'<p class="a"><p class="a"><img src="{long}">')
    assert [n.attrs for n in tree.nodes] == [{"class": "a"}, {"class": "a"}, {"src": long}]
    assert (html._attributes.cache_info().hits, html._attributes.cache_info().currsize) == (1, 1)
