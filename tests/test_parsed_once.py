"""How often a page is parsed."""

from __future__ import annotations

import pytest

from lumenaudit.sources import html


@pytest.mark.parametrize(("rendered", "trees"), [(None, 1), ("<p>two words</p>", 2)])
def test_a_short_page_is_parsed_once(monkeypatch, rendered, trees):
    made, real = [], html.Tree.__init__
    monkeypatch.setattr(html.Tree, "__init__", lambda self, *a, **k: made.append(1) or real(self, *a, **k))
    out = html._extracted("https://a.example/", "<body><div id='root'></div><p>short</p>", rendered, True)
    assert len(made) == trees
    assert out["render_mode"] == ("csr" if rendered is None else "ssr")
