"""What a worker holds while it parses pages."""

from __future__ import annotations

import gc

import pyarrow as pa

from lumenaudit.sources import html


def test_signals_of_some_pages_at_once():
    n = 2 * html.AT_ONCE + 7
    names = ("audit_id", "url", "final_url", "status_code", "redirects", "html", "rendered_html")
    row = lambda k: dict(zip(names, ("a", None, f"https://a.example/{k}", 200, 0, f"<title>{k}</title><p>x", None), strict=True))
    batch = pa.RecordBatch.from_pylist([row(k) for k in range(n)], pa.schema([(c, pa.int32() if c in ("status_code", "redirects") else pa.string()) for c in names]))
    got = list(html._parsed(iter([batch]), html._extracted, True, True))
    assert [len(g) for g in got] == [html.AT_ONCE, html.AT_ONCE, 7]
    assert [r["title"] for g in got for r in g] == [str(k) for k in range(n)]


def test_trees_go_without_a_search_for_cycles():
    gc.collect()
    gc.disable()
    try:
        for k in range(20):
            html._extracted("https://a.example/", f"<main><p>{k}<b>x</b></main>", f"<main><p>{k} more</main>" if k % 2 else None, True)
        assert sum(isinstance(x, html.Node) for x in gc.get_objects()) == 0
    finally:
        gc.enable()
