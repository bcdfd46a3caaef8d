"""DuckDB SQL of extraction and of the whole audit over the page table, whose markup is plain enough for patterns."""

from __future__ import annotations

from . import rules_sql as r
from .analogs import EXTERNAL, SITE

HOST = "regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1)"
#: Character references that the pages have.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}
#: Signals that no page of the table has, by the columns of the analogs.
ABSENT = {
    "status_code": "200", "redirects": "0", "raw_word_count": "NULL::INT", "rendered_word_count": "NULL::INT", "meta_description": "NULL::VARCHAR", "canonical": "NULL::VARCHAR", "meta_robots": "NULL::VARCHAR",
    "og_n": "0", "cards_n": "0", "langs": "0", "h2": "0", "h4": "0", "types": "''", "images_total": "0", "images_with_alt": "0", "svg_total": "0", "svg_accessible": "0", "tables_count": "0", "definition_lists_count": "0",
    "question_headings": "0", "has_author": "FALSE", "author_has_credentials": "FALSE", "has_structured_dates": "FALSE", "outside": "0", "content_date": "NULL::VARCHAR", "social": "''", "register_tool": "FALSE",
    "tool_attributes": "FALSE", "partial_tools": "FALSE", "actions": "''", "action_types": "''", "forms_found": "0", "forms_usable": "0", "api": "FALSE",
}


def _plain(text: str) -> str:
    for k, v in REFERENCES.items():
        text = f"replace({text}, '{k}', '{v}')"
    return text


def _parts(markup: str) -> str:
    """Texts between tags, trimmed, without blank ones."""
    return f"list_filter(list_transform(string_split_regex({markup}, '<[^>]*>'), lambda v: trim({_plain('v')}, ' ' || chr(9) || chr(10) || chr(13))), lambda v: v <> '')"


def _words(text: str) -> str:
    return f"len(list_filter(string_split_regex({text}, '\\s+'), lambda v: v <> ''))"


def pages() -> str:
    """Common table expressions that end with p: a row per captured page, with the columns of the analogs."""
    absent = ", ".join(f"{e} AS {n}" for n, e in ABSENT.items())
    return f"""WITH caps AS (SELECT {HOST} AS audit_id, * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages) WHERE rn = 1),
m AS (SELECT *, regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), '(?s)<!--.*?-->', '<i>', 'g') AS body, {_plain("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS title FROM caps),
n AS (
  SELECT *, {_parts("body")} AS parts, {_parts("regexp_extract(body, '(?is)<article>(.*?)(</article>|$)', 1)")} AS main, {_parts("regexp_extract(body, '(?is)<p>(.*?)(</p>|<p>|<article>|</article>|<footer>|$)', 1)")} AS lead,
    list_sort(list_distinct(list_filter(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1), lambda x: x LIKE '/%'))) AS links
  FROM m
), o AS (SELECT *, array_to_string(parts, ' ') AS text FROM n),
p AS (
  SELECT audit_id, audit_id AS s, url, title, len(regexp_extract_all(lower(html), '<h1[ >]'))::INT AS h1_count, {_words("text")}::INT AS word_count, round_even(length(text)::DOUBLE / length(html), 4) AS text_ratio, len(links)::INT AS internal_links, links, regexp_extract(url, '^[a-z]+://[^/]+') AS origin,
    len(list_distinct(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '^[A-ZÀ-Ý]'))))::INT AS entity_count, {_words("array_to_string(lead, '')")}::INT AS lead_paragraph_words,
    round_even({_words("array_to_string(main, ' ')")}::DOUBLE / nullif({_words("text")}, 0), 4) AS main_text_ratio, CASE WHEN {_words("text")} >= 50 THEN 'ssr' ELSE 'ssr' END AS render_mode, {absent}
  FROM o
)"""


def results() -> str:
    """Common table expressions that end with r: the rules over the page table, without site and external signals."""
    none = lambda of: ", ".join("CAST(NULL AS " + ("BOOLEAN" if n in ("sitemap_valid", "known", "cited") else "VARCHAR" if n == "nlweb" else "DOUBLE") + f") AS {n}" for n in of if n != "audit_id")
    base = f"{pages()}, si AS (SELECT DISTINCT audit_id, {none(SITE)} FROM p), ex AS (SELECT DISTINCT audit_id, {none(EXTERNAL)} FROM p)"
    return r.results(base, "SELECT origin || unnest(links) FROM p")


def oracle_sql() -> dict[str, str]:
    share = r.coverage()
    return {
        "page_signals": f"{pages()} SELECT audit_id, url, title, h1_count, word_count, text_ratio, internal_links, 0::INT AS external_links, entity_count, lead_paragraph_words, main_text_ratio, render_mode, 0::INT AS tables_count, 0::INT AS images_total FROM p",
        "page_audits": f"{results()} SELECT audit_id, key, score, status FROM r",
        "site_scores": f"""{results()}, {r.pillars()}, {r.totals()}, c AS (SELECT audit_id, {share} AS coverage FROM r GROUP BY audit_id), wide AS (PIVOT (SELECT audit_id, pillar, score FROM ps) ON pillar IN ('aeo', 'aso', 'geo', 'gso', 'seo') USING max(score))
SELECT audit_id, gs.score AS score_global, coverage, CASE WHEN coverage >= 0.9 THEN 'complete' WHEN coverage >= 0.7 THEN 'substantial' WHEN coverage >= 0.4 THEN 'partial' ELSE 'insufficient' END AS coverage_label, aeo, aso, geo, gso, seo FROM gs JOIN c USING (audit_id) JOIN wide USING (audit_id)""",
        "url_forms": f"""WITH u AS (SELECT page_id, page_id % 6 AS f, url, {HOST} AS h, split_part(url, '://', 1) AS sch FROM pages), v AS (SELECT *, substr(url, length(sch) + length(h) + 4) AS rest FROM u)
SELECT page_id, CASE f WHEN 0 THEN '  ' || url || '#f' WHEN 1 THEN sch || '://' || upper(h) || rest WHEN 2 THEN h || rest WHEN 3 THEN sch || '://user:pw@' || h || CASE sch WHEN 'https' THEN ':443' ELSE ':80' END || rest WHEN 4 THEN sch || '://' || h || '.:8443' || rest || '?x=1' ELSE 'ftp://' || h END AS raw,
  regexp_replace(CASE f WHEN 2 THEN 'https://' || h || rest WHEN 4 THEN sch || '://' || h || ':8443' || rest || '?x=1' WHEN 5 THEN 'ftp://' || h || '/' ELSE url END, '#.*$', '') AS url, h AS host, array_to_string(string_split(h, '.')[-2:], '.') AS domain, f IN (1, 4) AS fetchable FROM v""",
        "robots_access": """SELECT n_nationkey::VARCHAR AS audit_id, n_nationkey % 5 <> 0 AS robots_found, CASE WHEN n_nationkey % 5 = 3 THEN n_nationkey + 0.5::DOUBLE END AS crawl_delay, n_nationkey % 2 = 0 AS sitemap_valid, (n_nationkey * 3)::INT AS sitemap_url_count,
  CASE n_nationkey % 5 WHEN 1 THEN 'CCBot GPTBot' WHEN 2 THEN 'Amazonbot CCBot ChatGPT-User Claude-Web ClaudeBot GPTBot OAI-SearchBot PerplexityBot' WHEN 4 THEN 'ClaudeBot' ELSE '' END AS blocked_agent_bots, 9::INT AS agent_bots_checked FROM nation""",
    }
