"""DuckDB SQL of the queries of inputs.py."""

from __future__ import annotations

from ..operators import prompts
from . import rules_sql as r
from .analogs import sql, url_of
from .inputs import HOSTS, WORDS

KEYS = "k AS (SELECT p_partkey AS k, p_partkey % 13 AS s, 'shop' || (p_partkey % 13) || '.example' AS audit_id, 'https://shop' || (p_partkey % 13) || '.example/p/' || p_partkey AS url FROM part)"
#: Words of a markup page's main part; its navigation has three more.
MAIN = "(2 * CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END + 3 * (k % 3) + k % 2 + k % 12 + (k % 3 = 2)::INT + 2 * (k % 4 = 3)::INT + (k % 5 = 1)::INT + (k % 6 >= 1)::INT + 2 * (k % 6 >= 2)::INT + (k % 3 >= 1)::INT + 2 * (k % 3 >= 2)::INT + (k % 10 = 0)::INT)"
DAYS = """d AS (
  SELECT ts::DATE AS day, user_id::VARCHAR AS key, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS impressions FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL
), days AS (SELECT *, (clicks % 7 + impressions % 5 + 1)::DOUBLE AS position FROM d)"""


def _windows(n: int) -> str:
    return f"""{DAYS}, w AS (
  SELECT period, key, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, coalesce(sum(position * impressions) / nullif(sum(impressions), 0), avg(position)) AS position
  FROM days JOIN (VALUES ('current', DATE '2024-01-30'), ('previous', DATE '2024-01-30' - {n})) p(period, e) ON day BETWEEN e - {n} AND e GROUP BY ALL
)"""


def oracle_sql() -> dict[str, str]:
    fr = {"critical": "à corriger", "warning": "à améliorer"}
    en = {"critical": "to be mended", "warning": "to be improved"}
    said = lambda t: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items())
    issue = r.results() + """, i AS (
  SELECT audit_id, key, status AS severity, CASE WHEN weight < 1 THEN 1 WHEN weight < 1.8 THEN 2 ELSE 3 END AS impact, """ + _effort() + """ AS effort FROM r WHERE status IN ('warning', 'critical') AND evidence_tier = 'standard'
), j AS (SELECT *, round_even(impact * CASE severity WHEN 'critical' THEN 2 ELSE 1 END / effort::DOUBLE, 2) AS priority FROM i),
q AS (SELECT *, CASE WHEN priority >= 3 THEN 'high' WHEN priority >= 1 THEN 'medium' ELSE 'low' END AS bucket FROM j)"""
    worded = ", ".join(f"({k + 1}, '{i}', {q}, '{t}')" for k, (i, q, t) in enumerate(prompts.MINIMAL))
    parity = "CASE WHEN rendered_word_count <= 0 THEN 1.0 ELSE least(1.0, raw_word_count::DOUBLE / rendered_word_count) END"
    return {
        "markup_heads": f"""WITH {KEYS} SELECT audit_id, url, 'Part ' || k || ' & more' AS title, CASE WHEN k % 2 = 0 THEN 'About part ' || k END AS meta_description, CASE WHEN k % 3 = 0 THEN 'noindex, follow' END AS meta_robots,
  CASE WHEN k % 4 = 1 THEN url END AS canonical, (k % 4)::INT AS og, CASE WHEN k % 4 >= 1 THEN 'T' || k END AS og_title, (k % 3)::INT AS cards, CASE WHEN k % 5 = 0 THEN 'en x-default' ELSE '' END AS langs, CASE WHEN k % 5 = 0 THEN '/en/' || k END AS english FROM k""",
        "markup_bodies": f"""WITH {KEYS} SELECT audit_id, url, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS h1_count, (k % 3)::INT AS h2, (k % 2)::INT AS h4, ({MAIN} + 3)::INT AS word_count, round_even({MAIN}::DOUBLE / ({MAIN} + 3), 4) AS main_text_ratio,
  (k % 12)::INT AS lead_paragraph_words, (k % 3)::INT AS question_headings, (k % 5)::INT AS images_total, least(k % 5, k % 3)::INT AS images_with_alt, (k % 4)::INT AS svg_total, least(k % 4, k % 2)::INT AS svg_accessible,
  (k % 3 = 2)::INT AS tables_count, (k % 4 = 3)::INT AS definition_lists_count, CASE WHEN k % 11 = 0 THEN 'csr' ELSE 'ssr' END AS render_mode, 'heuristic' AS render_source FROM k""",
        "markup_links": f"""WITH {KEYS}, l AS (SELECT *, list_sort(list_filter([CASE WHEN k % 10 = 0 THEN 'OpenAPI.json' END, CASE WHEN k % 6 >= 1 THEN 'l1' END, CASE WHEN k % 6 >= 2 THEN 'l2' END], lambda x: x IS NOT NULL)) AS own FROM k)
SELECT audit_id, url, len(own)::INT AS internal_links, (k % 3)::INT AS external_links, array_to_string(list_transform(own, lambda x: 'https://' || audit_id || '/' || x), ' ') AS targets,
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'out1.example' ELSE 'out1.example out2.example' END AS outside, CASE WHEN k % 10 = 0 THEN '/OpenAPI.json' ELSE '' END AS openapi FROM l""",
        "markup_data": f"""WITH {KEYS} SELECT audit_id, url, CASE k % 6 WHEN 0 THEN 'Product' WHEN 1 THEN 'Article Person TechArticle' WHEN 3 THEN 'Organization SearchAction' ELSE '' END AS types, k % 6 IN (1, 3) AS has_author, k % 6 = 1 AS author_has_credentials, k % 6 = 1 AS has_structured_dates,
  CASE WHEN k % 6 = 1 THEN '2026-01-0' || (1 + k % 9) END AS content_date, CASE WHEN k % 6 = 3 THEN 'github' ELSE '' END AS platforms, CASE WHEN k % 6 = 3 THEN 'SearchAction' ELSE '' END AS actions, CASE WHEN k % 6 = 0 THEN 'Product' ELSE '' END AS action_types FROM k""",
        "markup_agents": f"""WITH {KEYS} SELECT audit_id, url, k % 9 = 0 AS has_register_tool, k % 8 = 0 AS has_tool_attributes, (k % 8 = 0)::INT AS tool_count, FALSE AS partial_signals, (k % 5 = 1)::INT AS forms_usable, (k % 5 > 0)::INT AS forms_found, (k % 5 = 2)::INT AS forms_no_action, (k % 5 = 3)::INT AS forms_no_fields, (k % 5 = 4)::INT AS forms_no_label FROM k""",
        "rendered_pages": f"""WITH {KEYS}, n AS (SELECT *, {MAIN} + 3 AS raw, {MAIN} + 3 + 40 * (k % 5) AS after FROM k) SELECT audit_id, url, CASE WHEN after >= 1.5 * raw AND after - raw >= 100 THEN 'csr' ELSE 'ssr' END AS render_mode, 'dom_diff' AS render_source, raw::INT AS raw_word_count, after::INT AS rendered_word_count, after::INT AS word_count FROM n""",
        "content_kinds": f"""{sql()} SELECT audit_id, CASE WHEN bool_or(list_contains(string_split(types, ','), 'Product')) THEN 'ecommerce' WHEN bool_or(types LIKE '%DefinedTerm%' OR types LIKE '%FAQPage%' OR types LIKE '%HowTo%') THEN 'knowledge_base' ELSE 'general' END AS content_type FROM p GROUP BY audit_id""",
        "sitemap_files": """WITH n AS (SELECT s_suppkey % 25 AS n, count(*) AS c FROM supplier GROUP BY 1)
SELECT n::VARCHAR AS audit_id, 'https://n' || n || '.example/' || f AS url, f <> 'extra.xml' AS valid, f = 'sitemap.xml' AS is_index, (CASE f WHEN 'list.xml' THEN c + 1 WHEN 'sitemap.xml' THEN 1 ELSE 0 END)::INT AS locations FROM n, (VALUES ('list.xml'), ('sitemap.xml'), ('extra.xml')) t(f)""",
        "crawl_frontiers": """WITH u AS (
  SELECT n_nationkey AS n, 0 AS step, 'https://n' || n_nationkey || '.example/' AS url FROM nation UNION ALL
  SELECT s_suppkey % 25, 1, 'https://n' || (s_suppkey % 25) || '.example/s/' || s_suppkey FROM supplier WHERE s_suppkey % 25 % 5 = 0 OR NOT starts_with(s_suppkey::VARCHAR, '1') OR starts_with(s_suppkey::VARCHAR, '10')
)
SELECT n::VARCHAR AS audit_id, url, row_number() OVER (PARTITION BY n ORDER BY step, url)::INT AS place FROM u WHERE n IN (SELECT n_nationkey FROM nation)""",
        "guarded_requests": f"""WITH r AS (
  SELECT page_id AS k, page_id % 12 AS kind, page_id // 12 % 8 AS hops, (page_id // 96 % 3 = 1)::INT AS inside, CASE page_id % 12 {" ".join(f"WHEN {n} THEN 'https://{h}'" for n, h in enumerate(HOSTS))} WHEN 10 THEN 'ftp://ok.example' ELSE 'https://me@ok.example' END AS origin FROM pages
), f AS (SELECT *, origin || '/p' || k AS url, CASE WHEN kind < 4 THEN least(hops + inside, 5) ELSE 0 END AS n FROM r)
SELECT k AS request_id, url, CASE WHEN kind >= 4 OR n = 0 THEN url WHEN hops + inside <= 5 AND inside = 1 THEN 'https://169.254.169.254/x' ELSE origin || '/c' || n || '-' || k END AS final_url, n::INT AS redirects,
  CASE WHEN kind >= 4 OR hops + inside <= 5 AND inside = 1 THEN NULL WHEN hops + inside > 5 THEN 302 ELSE 200 END::INT AS status,
  CASE WHEN kind = 10 THEN 'scheme' WHEN kind = 11 THEN 'user' WHEN kind = 9 THEN 'name' WHEN kind = 8 THEN 'unresolved' WHEN kind >= 4 THEN 'address' WHEN hops + inside > 5 THEN 'redirects' WHEN inside = 1 THEN 'address' END AS refused FROM f""",
        "robots_verdicts": """WITH p AS (SELECT (s_suppkey % 25)::VARCHAR AS audit_id, s_suppkey % 25 % 3 = 0 AS free, s_suppkey::VARCHAR AS k, CASE s_suppkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '?x' ELSE '' END AS e FROM supplier)
SELECT audit_id, 'https://n.example/s/' || k || e AS url, asked, coalesce(CASE WHEN free THEN TRUE WHEN asked = 'anyone' THEN e <> '.pdf' AND (NOT starts_with(k, '1') OR starts_with(k, '10')) ELSE regexp_matches(k || e, '^2.*5') END, TRUE) AS allowed FROM p, (VALUES ('GPTBot/1.2'), ('anyone')) a(asked)""",
        "paged_searches": f"""WITH {DAYS}, s AS (SELECT day::VARCHAR AS day, key, clicks, impressions, clicks / 100::DOUBLE AS ctr, position FROM days)
SELECT * FROM s WHERE day BETWEEN '2024-01-08' AND '2024-01-10' UNION ALL SELECT * FROM s WHERE key IN ('3', '14', '15') AND day > '2024-01-20' AND day <= '2024-01-31'""",
        "incremental_scores": f"{r.results(sql('WHERE o_orderkey % 10 <> 3'))} SELECT audit_id, key, score, status FROM r",
        "locale_order": f"""WITH w(o, word) AS (VALUES {", ".join(f"({k}, '{w}')" for k, w in enumerate(WORDS))}), p AS (SELECT p_size::VARCHAR AS size, o, word || ' ' || lpad(p_partkey::VARCHAR, 9, '0') AS name FROM part JOIN w ON o = (p_partkey * 5 + p_size) % {len(WORDS)} WHERE contains(lower(word), 'é'))
SELECT size, name, row_number() OVER (PARTITION BY size ORDER BY o, name)::INT AS place FROM p""",
        "stored_artifacts": "SELECT DISTINCT 'projects/' || (page_id % 5) || '/runs/r1/html_raw/' || sha256(html) || '.html.gz' AS object_key, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages",
        "structured_data": """SELECT 'a' || (p_partkey % 7) AS audit_id, 'u' || p_partkey AS url, CASE p_partkey % 5 WHEN 0 THEN 'BuyAction EntryPoint Offer Product Thing' WHEN 1 THEN 'Article Person' WHEN 2 THEN '' ELSE 'Inner' END AS types, CASE p_partkey % 5 WHEN 0 THEN 'BuyAction EntryPoint' ELSE '' END AS actions,
  CASE p_partkey % 5 WHEN 2 THEN 'https://github.com/' || p_partkey || ' https://x.com/y' ELSE '' END AS same_as, CASE p_partkey % 5 WHEN 1 THEN '2026-01-0' || (1 + p_partkey % 9) END AS newest, p_partkey % 5 IN (1, 4) AS has_author, p_partkey % 5 = 1 AS has_credentials FROM part WHERE p_partkey % 5 <> 3""",
        "engine_answers": """WITH c AS (SELECT *, (conv_id + turn) % 4 AS e, 'www.a' || turn || '.example' AS d FROM conversations WHERE role = 'assistant')
SELECT ['openai', 'anthropic', 'gemini', 'perplexity'][e + 1] AS engine, 'm' || (e + 1) AS model, conv_id::VARCHAR AS prompt_id, turn::INT AS repetition, text || CASE WHEN e = 2 THEN '!' ELSE '' END AS response_text,
  CASE e WHEN 1 THEN '1:' || d || ':t,2:' || d || ':t' WHEN 3 THEN '1:b.example:-,2:' || d || ':-' ELSE '1:' || d || ':t' END AS cites FROM c""",
        "tracking_metrics": """WITH c AS (
  SELECT CASE (conv_id + turn) % 4 WHEN 0 THEN 'openai' ELSE 'perplexity' END AS engine, conv_id, turn, turn = 1 AS cited, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])') AS said
  FROM conversations WHERE role = 'assistant' AND (conv_id + turn) % 4 IN (0, 3) AND turn BETWEEN 1 AND 8
), p AS (SELECT engine, conv_id, count(*) AS n, count(*) FILTER (cited) AS cited, count(*) FILTER (said) AS said, count(*) FILTER (engine = 'perplexity') AS rivals, sum(CASE WHEN cited THEN CASE engine WHEN 'openai' THEN 1 ELSE 2 END END) AS pos FROM c GROUP BY ALL)
SELECT coalesce(engine, 'all') AS engine, sum(n)::BIGINT AS responses, round_even(sum(cited)::DOUBLE / sum(n), 4) AS citation_rate, round_even(sum(said)::DOUBLE / sum(n), 4) AS mention_rate, round_even(sum(cited)::DOUBLE / nullif(sum(cited) + sum(rivals), 0), 4) AS share_of_voice,
  round_even(sum(pos)::DOUBLE / nullif(sum(cited), 0), 2) AS average_position, max(n)::BIGINT AS repetitions, count(DISTINCT conv_id) AS prompts FROM p GROUP BY GROUPING SETS ((), (engine))""",
        "entity_matches": """WITH t AS (
  SELECT p_partkey, p_partkey % 4 > 0 AS hit, list_distinct(regexp_extract_all(lower(CASE WHEN p_partkey % 3 = 0 THEN 'Other Firm' ELSE p_name END), '\\w+')) AS n, list_distinct(regexp_extract_all(lower(p_name || ' Ltd'), '\\w+')) AS m, p_name || ' Ltd' AS label,
    list_distinct(regexp_extract_all(lower(CASE WHEN p_partkey % 2 = 0 THEN 'Fine ' || p_type || ' things' ELSE 'nothing of the kind' END), '\\w+')) AS d, list_distinct(regexp_extract_all(lower(p_type || ' goods'), '\\w+')) AS e FROM part
)
SELECT p_partkey, CASE WHEN hit THEN 'Q' || p_partkey END AS id, CASE WHEN hit THEN label END AS label, CASE WHEN hit AND len(list_intersect(n, m))::DOUBLE / greatest(least(len(n), len(m)), 1) >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS name,
  CASE WHEN hit AND len(list_intersect(d, e))::DOUBLE / greatest(len(list_distinct(list_concat(d, e))), 1) >= 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS description FROM t""",
        "discovery_files": """SELECT p_partkey, p_partkey % 7 <> 0 AND length(trim(substr(p_name, 1, 11))) >= 3 AND length(trim(repeat(p_type, p_partkey % 5))) >= 20 AS summary, p_partkey % 7 <> 0 AND length(p_name) >= 3 AND p_partkey % 3 > 0 AS service,
  p_partkey % 7 <> 0 AND length(trim(repeat(p_name, p_partkey % 3))) >= 10 AND length(trim(repeat(p_type, p_partkey % 4))) >= 20 AS faq, CASE WHEN p_partkey % 3 = 0 THEN 'absent' WHEN p_partkey % 2 = 0 THEN 'conformant' ELSE 'present' END AS nlweb FROM part""",
        "probe_searches": """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'shop' || c_custkey END AS b FROM customer) SELECT c_custkey, place::INT AS place, CASE place WHEN 0 THEN b WHEN 1 THEN 'what is ' || b ELSE b || ' review' END AS query FROM b, range(3) t(place)""",
        "search_windows": f"WITH {_windows(7)} SELECT period, key, clicks, impressions, round(coalesce(clicks::DOUBLE / nullif(impressions, 0), 0), 6) AS ctr, round(position, 6) AS position FROM w",
        "rank_changes": f"""WITH {_windows(14)}, s AS (SELECT sum(clicks) FILTER (period = 'current')::BIGINT AS cc, sum(clicks) FILTER (period = 'previous')::BIGINT AS pc, sum(impressions) FILTER (period = 'current')::BIGINT AS ci, sum(impressions) FILTER (period = 'previous')::BIGINT AS pi FROM w)
SELECT cc AS current_clicks, pc AS previous_clicks, cc - pc AS clicks_delta, ci AS current_impressions, pi AS previous_impressions, ci - pi AS impressions_delta, round_even(cc::DOUBLE / ci, 4) AS current_ctr, round_even(pc::DOUBLE / pi, 4) AS previous_ctr FROM s""",
        "search_payloads": f"WITH {DAYS} SELECT day::VARCHAR AS audit_id, key, clicks, impressions, round_even(clicks / 100.0::DOUBLE, 4) AS ctr, round_even(position, 1) AS position FROM days WHERE key <> '7'",
        "scorecard_gates": """WITH s AS (SELECT s_suppkey AS k FROM supplier), p AS (SELECT k::VARCHAR AS pair_id, k AS a, k + 2 AS b FROM s UNION ALL SELECT 'n' || k, k, k + 1 FROM s),
d AS (SELECT pair_id, list_filter([CASE WHEN (a % 4 = 3) <> (b % 4 = 3) THEN 'active_connectors' END, CASE WHEN (a % 9 = 0) <> (b % 9 = 0) THEN 'pillar_weights' END, CASE WHEN a // 20 <> b // 20 THEN 'rule_catalog_digest' END, CASE WHEN a % 2 <> b % 2 THEN 'tool_version' END], lambda x: x IS NOT NULL) AS d FROM p WHERE b IN (SELECT k FROM s)),
c AS (SELECT pair_id, d, CASE WHEN len(d) = 0 THEN 'exact' WHEN list_has_any(d, ['pillar_weights', 'rule_catalog_digest']) THEN 'incompatible' WHEN list_contains(d, 'active_connectors') THEN 'intersection' ELSE 'compatible' END AS kind FROM d)
SELECT pair_id, kind AS comparability, array_to_string(d, ' ') AS differences, CASE kind WHEN 'incompatible' THEN 'descriptive' WHEN 'intersection' THEN 'intersection descriptive' ELSE 'strict intersection descriptive' END AS allowed_modes FROM c""",
        "stored_reports": f"""{issue}, {r.pillars()}, {r.totals()},
c AS (SELECT audit_id, count(*)::INT AS criteria, min(key) AS first_rule, {r.coverage()} AS coverage FROM r GROUP BY audit_id),
o AS (SELECT audit_id, count(*)::INT AS issues, arg_min(key, {{'p': -priority, 'k': key}}) AS first_issue FROM q GROUP BY audit_id)
SELECT audit_id, gs.score AS score_global, c.coverage, criteria, issues, first_rule, first_issue, ps.score AS seo FROM gs JOIN c USING (audit_id) JOIN o USING (audit_id) JOIN ps USING (audit_id) WHERE pillar = 'seo'""",
        "markdown_reports": f"""{issue}, {r.pillars()}, {r.totals()},
c AS (SELECT audit_id, {r.coverage()} AS coverage FROM r GROUP BY audit_id),
k AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY priority DESC, key) AS rank FROM q),
i2 AS (SELECT audit_id, string_agg('| ' || concat_ws(' | ', rank, key, severity, priority, bucket) || ' |', chr(10) ORDER BY rank) AS rows FROM k GROUP BY audit_id),
p2 AS (SELECT audit_id, string_agg('| ' || concat_ws(' | ', pillar, score, coverage, measured, excluded) || ' |', chr(10) ORDER BY pillar) AS rows FROM ps GROUP BY audit_id)
SELECT audit_id, '# Audit of ' || audit_id || chr(10) || chr(10) || 'Score: ' || gs.score || ', coverage ' || coverage || ' (' || CASE WHEN coverage >= 0.9 THEN 'complete' WHEN coverage >= 0.7 THEN 'substantial' WHEN coverage >= 0.4 THEN 'partial' ELSE 'insufficient' END || ')' || chr(10) || chr(10) || '## Pillars' || chr(10) || chr(10)
  || '| pillar | score | coverage | measured | excluded |' || chr(10) || '|---|---|---|---|---|' || chr(10) || p2.rows || chr(10) || chr(10) || '## Issues' || chr(10) || chr(10) || '| rank | rule | severity | priority | bucket |' || chr(10) || '|---|---|---|---|---|' || chr(10) || coalesce(i2.rows, '') || chr(10) AS document
FROM gs JOIN c USING (audit_id) JOIN p2 USING (audit_id) LEFT JOIN i2 USING (audit_id)""",
        "html_reports": f"""{issue}, {r.pillars()}, {r.totals()},
c AS (SELECT audit_id, {r.coverage()} AS coverage FROM r GROUP BY audit_id),
k AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY priority DESC, key) AS rank FROM q),
i2 AS (SELECT audit_id, string_agg('<tr><td>' || concat_ws('</td><td>', rank, key, severity, priority, bucket) || '</td></tr>', '' ORDER BY rank) AS rows FROM k GROUP BY audit_id),
p2 AS (SELECT audit_id, string_agg('<tr><td>' || concat_ws('</td><td>', pillar, score) || '</td></tr>', '' ORDER BY pillar) AS rows FROM ps GROUP BY audit_id)
SELECT audit_id, '<!doctype html><html lang="en"><meta charset="utf-8"><title>Audit of ' || audit_id || '</title><h1>Audit of ' || audit_id || '</h1><p>Score ' || gs.score || ', coverage ' || coverage || '</p><h2>Pillars</h2><table><tr><th>pillar</th><th>score</th></tr>' || p2.rows
  || '</table><h2>Issues</h2><table><tr><th>rank</th><th>key</th><th>severity</th><th>priority</th><th>bucket</th></tr>' || coalesce(i2.rows, '') || '</table></html>' AS document
FROM gs JOIN c USING (audit_id) JOIN p2 USING (audit_id) LEFT JOIN i2 USING (audit_id)""",
        "affected_by_issue": f"""{issue}, gone AS (SELECT audit_id, url FROM (SELECT *, min(url) OVER (PARTITION BY s) AS home FROM p) WHERE url <> home AND url NOT IN (SELECT {url_of('linked')} FROM p WHERE linked IS NOT NULL)),
e AS (
  SELECT audit_id, key, url, 10 AS most FROM ({r.page_scores()}) WHERE score < 80 UNION ALL SELECT audit_id, 'links.orphans', url, 10 FROM gone UNION ALL
  SELECT audit_id, 'geo.primary_sources', url, 30 FROM p WHERE word_count >= 300 AND outside = 0 UNION ALL SELECT audit_id, 'geo.ssr', url, 1000000000 FROM p WHERE render_mode = 'csr'
)
SELECT audit_id, key, least(count(*), any_value(most))::INT AS pages, CASE WHEN key <> 'geo.ssr' THEN min(url) END AS first_page FROM e JOIN q USING (audit_id, key) GROUP BY audit_id, key""",
        "page_table": f"""{sql()} SELECT audit_id, url, status_code::INT AS http, render_mode AS render, word_count::INT AS words, (rendered_word_count - raw_word_count)::INT AS js_delta, (images_total - images_with_alt)::INT AS alt_missing, images_total::INT AS alt_total, (svg_total - svg_accessible)::INT AS svg_unnamed, svg_total::INT AS svg_total, forms_usable::INT AS forms_usable, forms_found::INT AS forms_total FROM p""",
        "script_words": f"{sql()} SELECT audit_id, url, raw_word_count::INT AS raw_words, rendered_word_count::INT AS rendered_words, (rendered_word_count - raw_word_count)::INT AS delta, CASE WHEN raw_word_count IS NOT NULL THEN round_even({parity} * 100, 0)::INT END AS parity_pct FROM p WHERE render_mode = 'csr'",
        "issue_texts": f"""{issue}, l AS (SELECT *, substr(audit_id, 5)::INT % 2 = 0 AS fr FROM q)
SELECT audit_id, key, CASE WHEN fr THEN key || ' : ' || CASE severity {said(fr)} END || ', priorité ' || bucket ELSE key || ': ' || CASE severity {said(en)} END || ', priority ' || bucket END AS line,
  CASE bucket WHEN 'high' THEN CASE WHEN fr THEN 'd''abord' ELSE 'first' END WHEN 'medium' THEN CASE WHEN fr THEN 'ensuite' ELSE 'next' END ELSE CASE WHEN fr THEN 'plus tard' ELSE 'later' END END AS "when", 'no.such.key' AS unknown FROM l""",
        "connector_costs": """WITH c AS (SELECT DISTINCT c_custkey::VARCHAR AS audit_id, unnest([['dataforseo', 'serpapi', 'llm_citation', 'psi'][c_custkey % 4 + 1], 'psi']) AS connector FROM customer),
u AS (SELECT *, CASE connector WHEN 'dataforseo' THEN 2 WHEN 'serpapi' THEN 3 WHEN 'llm_citation' THEN 0 ELSE 1 END AS calls, CASE connector WHEN 'dataforseo' THEN 0.01::DOUBLE WHEN 'serpapi' THEN 0.015::DOUBLE ELSE 0.0::DOUBLE END AS unit_usd FROM c) SELECT *, round_even(calls * unit_usd, 4) AS total_usd FROM u""",
        "tracking_volumes": """SELECT (conv_id % 10)::VARCHAR AS audit_id, count(*) AS prompt_count, (count(*) * 9)::BIGINT AS call_volume, round_even(count(*) * 3 * (40 / 1e6 * 0.15 + 400 / 1e6 * 0.60 + 0.01) + count(*) * 3 * (40 / 1e6 * 0.075 + 400 / 1e6 * 0.30), 4)::DOUBLE AS total_usd FROM conversations WHERE role = 'user' GROUP BY 1""",
        "minimal_prompts": f"""WITH w(place, intent, quality, t) AS (VALUES {worded}), c AS (SELECT c_custkey::VARCHAR AS audit_id, 'shop' || c_custkey || '.example' AS d, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS b FROM customer)
SELECT audit_id, place::INT AS place, intent, quality::DOUBLE AS quality, replace(replace(t, '{{d}}', d), '{{b}}', coalesce(b, d)) AS text FROM c, w""",
        "connectors_in_use": f"""{sql()} SELECT audit_id, array_to_string(list_filter([CASE WHEN cited THEN 'citations' END, 'gsc', CASE WHEN rank IS NOT NULL THEN 'opr' END, 'psi', CASE WHEN overview IS NOT NULL THEN 'serp' END, CASE WHEN known IS NOT NULL THEN 'wikidata' END], lambda x: x IS NOT NULL), ' ') AS connectors FROM ex""",
        "text_words": "SELECT conv_id, turn, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''))::INT AS words FROM conversations",
    }


def _effort() -> str:
    from ..operators.scoring import EFFORT

    listed = lambda n: ", ".join(f"'{k}'" for k, e in EFFORT.items() if e == n)
    return f"CASE WHEN key IN ({listed(1)}) THEN 1 WHEN key IN ({listed(3)}) THEN 3 ELSE 2 END"
