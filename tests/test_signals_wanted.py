"""Signals that nobody asks for aren't made."""

from __future__ import annotations

import pytest
from test_sources import PAGE

from lumenaudit import schema
from lumenaudit.plans import inputs
from lumenaudit.sources import html


@pytest.mark.parametrize("rendered", [None, PAGE.replace("</main>", "<p>more words</main>")])
def test_each_signal_alone_is_that_of_all(rendered):
    take = lambda out: {**{k: v for k, v in out.items() if k != "aso"}, **{f"aso.{k}": v for k, v in out.get("aso", {}).items()}}
    whole = take(html._extracted("https://acme.example/w", PAGE, rendered, True))
    assert set(whole) == {*html.SIGNALS, *html.RENDERING}
    for name in html.SIGNALS:
        assert take(html._extracted("https://acme.example/w", PAGE, rendered, True, only=frozenset([name]))) == {name: whole[name]}
    assert html._extracted("https://acme.example/w", PAGE, rendered, True, only=frozenset(html.RENDERING)) == {k: whole[k] for k in html.RENDERING}


def test_agents_signals_need_neither_links_nor_data(monkeypatch, spark, sf_dir):
    asked, real = [], html.extract
    monkeypatch.setattr(inputs.html, "extract", lambda *a, **k: asked.append(k.get("only")) or real(*a, **k))
    assert inputs.markup_agents(spark, sf_dir).count() > 0

    def never(*a):
        raise AssertionError(a)

    for name in ("links_of", "host_of", "Structured", "_icons"):
        monkeypatch.setattr(html, name, never)
    out = html._extracted("https://acme.example/w", PAGE, None, True, only=frozenset(asked[0]))
    assert out["aso"]["agent_usable_forms"] == 1


def test_columns_of_what_is_asked(spark):
    pages = spark.createDataFrame([("a", "https://a.example/", None, 200, 0, PAGE, None)], schema.struct(schema.CAPTURE))
    some = html.extract(pages, only=("aso.webmcp", "title", "aso.openapi_links"))
    assert some.columns == ["audit_id", "url", "title", "aso"]
    assert some.select("aso.*").columns == ["webmcp", "openapi_links"]
    whole = html.extract(pages)
    assert some.select("title", "aso.webmcp", "aso.openapi_links").collect() == whole.select("title", "aso.webmcp", "aso.openapi_links").collect()
    assert html.extract(pages, only=("aso",)).schema["aso"].dataType == whole.schema["aso"].dataType
    with pytest.raises(ValueError, match="nosuch"):
        html.extract(pages, only=("nosuch",))


def test_rendered_pages_need_counts_only(monkeypatch, spark, sf_dir):
    asked, real = [], html.extract
    monkeypatch.setattr(inputs.html, "extract", lambda *a, **k: asked.append(k.get("only")) or real(*a, **k))
    assert inputs.rendered_pages(spark, sf_dir).count() > 0
    monkeypatch.setattr(html, "SIGNALS", {k: f if k in asked[0] else pytest.fail for k, f in html.SIGNALS.items()})
    out = html._extracted("https://acme.example/w", PAGE, PAGE.replace("</main>", "<p>two more</main>"), True, only=frozenset(asked[0]))
    assert out["rendered_word_count"] == out["word_count"] == out["raw_word_count"] + 2
