"""DuckDB SQL of the engine's queries."""

from __future__ import annotations

from . import inputs_sql, pages_sql
from . import rules_sql as r
from ..operators import prompts
from ..operators.prompts import STOP_WORDS
from ..operators.scoring import EFFORT
from .analogs import sql, url_of

HOST = "regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1)"
TITLE = "replace(replace(replace(replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
DOMAIN = "array_to_string(string_split(regexp_replace({}, '^www\\.', ''), '.')[-2:], '.')"
#: Captures of the page table: one per URL.
CAPTURES = f"caps AS (SELECT {HOST} AS audit_id, * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages) WHERE rn = 1)"
PAIRS = "pairs AS (SELECT 'p' || s AS pair_id, 'site' || s AS left_id, 'site' || ((s + 1) % 97) AS right_id FROM sites)"
HISTORY = "hist AS (SELECT 'h' || o_custkey AS host, lpad(o_orderkey::VARCHAR, 12, '0') AS audit_id, o_orderdate AS started_at, o_totalprice AS score_global FROM orders)"


def _side(side: str) -> str:
    return f"""{side}_rows AS (SELECT pair_id AS audit_id, r.* EXCLUDE (audit_id) FROM r JOIN pairs ON r.audit_id = {side}_id JOIN common USING (pair_id, key)),
{r.pillars(f"{side}_rows", f"_{side}")}, {r.totals(f"ps_{side}", f"gs_{side}")}"""


def _compare() -> str:
    return f"""{r.results()}, {PAIRS},
common AS (SELECT pair_id, a.key FROM pairs JOIN r a ON a.audit_id = left_id AND a.{r.MEASURED} JOIN r b ON b.audit_id = right_id AND b.key = a.key AND b.{r.MEASURED}),
{_side("left")}, {_side("right")}"""


def _deltas() -> str:
    return f"""{r.results()}, {PAIRS},
d AS (
  SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.key, y.key) AS key, x.score AS left_score, y.score AS right_score, round_even(y.score - x.score, 2) AS delta, x.status AS left_status, y.status AS right_status
  FROM (SELECT pair_id, r.* FROM pairs JOIN r ON audit_id = left_id) x FULL JOIN (SELECT pair_id, r.* FROM pairs JOIN r ON audit_id = right_id) y ON x.pair_id = y.pair_id AND x.key = y.key
)"""


def _effort() -> str:
    listed = lambda n: ", ".join(f"'{k}'" for k, e in EFFORT.items() if e == n)
    return f"CASE WHEN key IN ({listed(1)}) THEN 1 WHEN key IN ({listed(3)}) THEN 3 ELSE 2 END"


def oracle_sql() -> dict[str, str]:
    page_scores = f"""
WITH {CAPTURES}, f AS (
  SELECT audit_id, url, {TITLE} AS title, len(regexp_extract_all(lower(html), '<h1[ >]')) AS h1,
    len(list_distinct(list_filter(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1), lambda x: x LIKE '/%'))) AS links
  FROM caps
), s AS (
  SELECT audit_id, count(*) AS n,
    round_even(avg(CASE WHEN title = '' THEN 0.0 WHEN length(title) < 30 THEN 60.0 WHEN length(title) > 60 THEN 70.0 ELSE 100.0 END), 2) AS title,
    round_even(CAST(count(DISTINCT lower(title)) AS DOUBLE) / count(*) * 100, 2) AS uniq,
    round_even(avg(CASE h1 WHEN 0 THEN 0.0 WHEN 1 THEN 100.0 ELSE 50.0 END), 2) AS h1,
    round_even(avg(CASE WHEN links = 0 THEN 0.0 WHEN links BETWEEN 3 AND 100 THEN 100.0 ELSE 60.0 END), 2) AS links,
    round_even(CAST(count(*) FILTER (url LIKE 'https://%') AS DOUBLE) / count(*) * 100, 2) AS secure
  FROM f GROUP BY audit_id
), v AS (
  SELECT audit_id, unnest(['meta.title', 'meta.title_unique', 'struct.h1', 'links.internal', 'crawl.https', 'links.orphans', 'crawl.indexable']) AS key,
    unnest([title, uniq, h1, links, secure, CASE WHEN n > 1 THEN 0.0::DOUBLE END, 100.0::DOUBLE]) AS score FROM s
)
SELECT audit_id, key, coalesce(score, 0.0::DOUBLE) AS score, CASE WHEN score IS NULL THEN 'not_measured' WHEN score >= 80 THEN 'ok' WHEN score >= 50 THEN 'warning' ELSE 'critical' END AS status FROM v"""
    basics = f"""
WITH {CAPTURES}
SELECT audit_id, url, {TITLE} AS title, len(regexp_extract_all(lower(html), '<h1[ >]'))::INT AS h1_count,
  len(list_distinct(list_filter(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1), lambda x: x LIKE '/%')))::INT AS internal_links,
  len(regexp_extract_all(lower(html), '<img[ >]'))::INT AS images_total, len(regexp_extract_all(lower(html), '<table[ >]'))::INT AS tables_count
FROM caps"""
    segments = "list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
    hosts = f"""
SELECT host, {DOMAIN.format("host")} AS domain,
  CASE WHEN len(seg) = 0 THEN 'root' WHEN len(seg) > 1 AND regexp_full_match(seg[1], '[A-Za-z]{{2}}') THEN seg[2] ELSE seg[1] END AS family, count(*) AS pages, count(*) FILTER (url LIKE 'https://%') AS secure
FROM (SELECT url, {HOST} AS host, {segments} AS seg FROM pages) GROUP BY ALL"""
    wave = """,
r{0} AS (SELECT s, j, row_number() OVER (PARTITION BY s ORDER BY 'u' || j) AS n FROM ({1})),
t{0} AS (SELECT r.s, j FROM r{0} r LEFT JOIN (SELECT s, count(*) AS c FROM g GROUP BY s) USING (s) WHERE n + coalesce(c, 0) <= 300),
g{0} AS (SELECT s, j, {0} AS depth FROM t{0} SEMI JOIN o USING (s, j))"""
    waves = "WITH o AS (SELECT o_orderkey % 20 AS s, o_orderkey // 20 AS j, CASE WHEN o_orderkey % 40 IN (SELECT unnest(range(0, 40, 2))) THEN 7 ELSE 4 END AS w FROM orders), e AS (SELECT s, j, j * w + unnest(range(1, w + 1)) AS d FROM o)"
    for n in range(4):
        below = "SELECT s, j FROM o WHERE j = 0" if not n else f"SELECT DISTINCT s, d AS j FROM g{n - 1} JOIN e USING (s, j) ANTI JOIN (" + " UNION ALL ".join(f"SELECT s, j AS d FROM t{i}" for i in range(n)) + ") x USING (s, d)"
        before = " UNION ALL ".join(f"SELECT s FROM g{i}" for i in range(n)) or "SELECT s FROM o WHERE FALSE"
        waves += wave.format(n, below).replace("FROM g GROUP", f"FROM ({before}) GROUP")
    waves += " SELECT 's' || s AS audit_id, 'u' || j AS url, depth FROM (" + " UNION ALL ".join(f"FROM g{n}" for n in range(4)) + ")"
    counts = ", ".join(f"'{w}'" for w in STOP_WORDS)
    topics = f"""
WITH {CAPTURES}, t AS (SELECT audit_id, url, {TITLE} AS title FROM caps),
home AS (SELECT audit_id, arg_min(title, url) AS title FROM t GROUP BY audit_id),
b AS (SELECT audit_id, list_concat(string_split_regex(lower(CASE WHEN contains(title, '|') THEN split_part(title, '|', 1) WHEN contains(title, ':') THEN split_part(title, ':', 1) WHEN contains(title, '-') THEN split_part(title, '-', 1) ELSE title END), '[\\s_-]+'), string_split_regex(split_part({DOMAIN.format("audit_id")}, '.', 1), '[\\s_-]+')) AS words FROM home),
w AS (SELECT audit_id, unnest(regexp_extract_all(lower(title), '[a-zà-ÿ0-9]+')) AS term FROM t),
c AS (SELECT audit_id, term, count(*) AS n FROM w JOIN b USING (audit_id) WHERE length(term) >= 4 AND term NOT IN ({counts}) AND NOT list_contains(words, term) GROUP BY audit_id, term)
SELECT audit_id, term, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 12"""
    fold = lambda c: f"replace(lower(strip_accents({c})), 'ß', 'ss')"
    part = " ".join(f"WHEN contains(title, '{x}') AND trim(split_part(title, '{x}', 1)) <> '' THEN trim(split_part(title, '{x}', 1))" for x in prompts.SEPARATORS)
    single = [(k, i, prompts.WORDING[i]) for k, i in enumerate(i for i in prompts.WORDING if i != "comparative")]
    kinds = ", ".join(f"('{i}', {k}, {round(share * prompts.TARGET)}, {q}::DOUBLE)" for k, (i, (share, q)) in enumerate(prompts.INTENTS.items()))
    says = lambda of: f"coalesce(trim({of}) <> '' AND regexp_matches(' ' || f || ' ', '[^\\p{{L}}\\p{{N}}_]' || regexp_escape({of}) || '[^\\p{{L}}\\p{{N}}_]'), FALSE)"
    first, second = prompts.WORDING["comparative"].split("{x}")[1].split("{y}")
    sets = f"""
WITH {CAPTURES}, t AS (SELECT audit_id, url, {TITLE} AS title FROM caps),
home AS (SELECT audit_id, arg_min(title, url) AS title, split_part({DOMAIN.format("audit_id")}, '.', 1) AS label FROM t GROUP BY audit_id),
b AS (SELECT audit_id, label, CASE WHEN title = '' THEN NULL {part} ELSE trim(title) END AS brand FROM home),
known AS (SELECT audit_id, {fold("brand")} AS brand, label, list_filter(string_split_regex({fold("concat_ws(' ', brand, label)")}, '[\\s_-]+'), lambda w: w <> '') AS words FROM b),
w AS (SELECT audit_id, unnest(regexp_extract_all(lower(title), '{prompts.TOPIC}')) AS term FROM t),
topics AS (
  SELECT audit_id, term, row_number() OVER (PARTITION BY audit_id ORDER BY n DESC, term) AS rank FROM (SELECT audit_id, term, count(*) AS n FROM w WHERE length(term) >= 4 AND term NOT IN ({counts}) GROUP BY ALL)
  JOIN known USING (audit_id) WHERE NOT list_contains(words, {fold("term")}) QUALIFY rank <= {prompts.TOPICS}
), e AS (SELECT audit_id, unnest(regexp_extract_all(title, '{prompts.ENTITY}')) AS term FROM t),
entities AS (
  SELECT audit_id, term, row_number() OVER (PARTITION BY audit_id ORDER BY n DESC, term) AS rank FROM (SELECT audit_id, term, count(*) AS n FROM e WHERE length(term) >= 3 GROUP BY ALL)
  JOIN known USING (audit_id) WHERE NOT list_has_any(words, string_split_regex({fold("term")}, '\\s+')) QUALIFY rank <= {prompts.ENTITIES}
), enough AS (SELECT audit_id FROM entities GROUP BY audit_id HAVING count(*) >= 2),
subjects AS (SELECT * FROM entities SEMI JOIN enough USING (audit_id) UNION ALL SELECT * FROM topics ANTI JOIN enough USING (audit_id)),
every AS (
  SELECT audit_id, step, intent, replace(wording, '{{x}}', term) AS text, term AS slot, rank, 0 AS other FROM topics, (VALUES {", ".join(f"({k}, '{i}', '{x}')" for k, i, x in single)}) v(step, intent, wording)
  UNION ALL SELECT x.audit_id, {len(single)}, 'comparative', x.term || '{first}' || y.term || '{second}', x.term || ' ' || y.term, x.rank, y.rank FROM subjects x JOIN subjects y ON x.audit_id = y.audit_id AND x.rank < y.rank
), once AS (SELECT *, {fold("text")} AS f FROM every QUALIFY row_number() OVER (PARTITION BY audit_id, {fold("text")} ORDER BY step, rank, other) = 1),
pool AS (
  SELECT audit_id, intent, text, place, quota, round_even(least(1.0::DOUBLE, q + CASE WHEN contains(trim(slot), ' ') THEN 0.1::DOUBLE ELSE 0 END), 4) AS quality
  FROM once LEFT JOIN known USING (audit_id) JOIN (VALUES {kinds}) k(intent, place, quota, q) USING (intent) WHERE NOT {says("brand")} AND NOT {says("label")}
), spared AS (SELECT *, (row_number() OVER (PARTITION BY audit_id, intent ORDER BY quality DESC, text) > quota)::INT AS spare FROM pool),
chosen AS (SELECT * FROM spared QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY spare, quality DESC, text) <= {prompts.TARGET})
SELECT audit_id, row_number() OVER (PARTITION BY audit_id ORDER BY place, quality DESC, text)::INT AS place, intent, text, quality FROM chosen"""
    cites = f"""
WITH x AS (
  SELECT 'a' || (conv_id % 5) AS audit_id, 'e' || (conv_id % 3) AS engine, conv_id, turn % 4 <> 3 AS web, (conv_id + turn) % 4 AS kind,
    coalesce(regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])the($|[^\\p{{L}}\\p{{N}}_])'), FALSE) AS said
  FROM conversations WHERE role = 'assistant'
), z AS (SELECT *, (kind IN (1, 2))::INT AS own, CASE kind WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS rivals, CASE kind WHEN 1 THEN 1 WHEN 2 THEN 2 END AS place FROM x
), cell AS (
  SELECT audit_id, engine, conv_id AS prompt_id, count(*) AS n, count(*) FILTER (web) AS ret, count(*) FILTER (web AND own > 0) AS cited, count(*) FILTER (said) AS said, count(*) FILTER (said AND NOT web) AS known,
    sum(CASE WHEN web THEN own ELSE 0 END) AS hits, sum(CASE WHEN web THEN rivals ELSE 0 END) AS rivals, sum(CASE WHEN web THEN place END) AS pos, count(CASE WHEN web THEN place END) AS placed
  FROM z GROUP BY ALL
)
SELECT audit_id, coalesce(engine, 'all') AS engine, sum(n)::BIGINT AS responses, coalesce(round_even(sum(cited)::DOUBLE / nullif(sum(ret), 0), 4), 0) AS citation_rate, round_even(sum(said)::DOUBLE / sum(n), 4) AS mention_rate,
  round_even(sum(known)::DOUBLE / nullif(sum(n) - sum(ret), 0), 4) AS knowledge_presence, coalesce(round_even({r._steady("CASE WHEN cited > 0 THEN cited::DOUBLE / ret END")} / nullif(count(CASE WHEN cited > 0 THEN 1 END), 0), 4), 0) AS citation_confidence,
  round_even(sum(hits)::DOUBLE / nullif(sum(hits) + sum(rivals), 0), 4) AS share_of_voice, round_even(sum(pos)::DOUBLE / nullif(sum(placed), 0), 2) AS average_position, max(n)::BIGINT AS repetitions, count(DISTINCT prompt_id) AS prompts
FROM cell GROUP BY GROUPING SETS ((audit_id), (audit_id, engine))"""
    mentions = """
WITH x AS (SELECT 'e' || (conv_id % 3) AS engine, conv_id, turn % 4 <> 3 AS web, coalesce(regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the($|[^\\p{L}\\p{N}_])'), FALSE) AS said FROM conversations WHERE role = 'assistant'),
c AS (SELECT engine, conv_id, count(*) AS n, count(*) FILTER (said) AS said, count(*) FILTER (NOT web) AS closed, count(*) FILTER (said AND NOT web) AS known FROM x GROUP BY ALL)
SELECT coalesce(engine, 'all') AS engine, sum(n)::BIGINT AS responses, round_even(sum(said)::DOUBLE / sum(n), 4) AS mention_rate, round_even(sum(known)::DOUBLE / nullif(sum(closed), 0), 4) AS knowledge_presence, max(n)::BIGINT AS repetitions, count(DISTINCT conv_id) AS prompts
FROM c GROUP BY GROUPING SETS ((), (engine))"""
    P = "1073741824e0"
    periods = f"""
WITH q AS (
  SELECT ts >= '2024-01-16' AS cur, user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS i, sum(user_id % 30)::DOUBLE / count(*) + 1 AS pos
  FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL
), s AS (
  SELECT sum(c) FILTER (cur) AS cc, sum(i) FILTER (cur) AS ci, round_even({r._steady("CASE WHEN cur THEN round_even(pos, 1) END", P)} / count(CASE WHEN cur THEN 1 END), 1) AS cp, sum(c) FILTER (NOT cur) AS pc, sum(i) FILTER (NOT cur) AS pi, round_even({r._steady("CASE WHEN NOT cur THEN pos END", P)} / count(CASE WHEN NOT cur THEN 1 END), 1) AS pp FROM q
), t AS (SELECT *, round_even(cc::DOUBLE / ci, 4) AS cr, round_even(pc::DOUBLE / pi, 4) AS pr FROM s)
SELECT 'e' AS audit_id, cc::BIGINT AS current_clicks, ci::BIGINT AS current_impressions, cr AS current_ctr, cp AS current_avg_position, pc::BIGINT AS previous_clicks, pi::BIGINT AS previous_impressions, pr AS previous_ctr, pp AS previous_avg_position,
  (cc - pc)::BIGINT AS clicks_delta, (ci - pi)::BIGINT AS impressions_delta, round_even(cr - pr, 4) AS ctr_delta, round_even(cp - pp, 1) AS position_delta FROM t"""
    serp = """
found AS (SELECT 'a' || (c_custkey % 50) AS audit_id, c_name AS query, c_custkey % 5 IN (0, 1, 3) AS triggered, c_custkey % 5 IN (0, 1) AS cited, CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS position FROM customer)"""
    speed = """
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND ok THEN 1500 + p_partkey % 3000 END::DOUBLE AS lcp, CASE WHEN p_partkey % 4 <> 0 AND ok THEN round_even((p_partkey % 40) / 100::DOUBLE, 4) END AS cls, CASE WHEN p_partkey % 5 <> 0 AND ok THEN 100 + p_partkey % 600 END::DOUBLE AS inp,
  CASE WHEN p_partkey % 6 <> 0 AND ok THEN (p_partkey % 101) / 100::DOUBLE END AS lighthouse_performance
FROM (SELECT p_partkey, p_partkey % 11 <> 0 AS ok FROM part)"""
    authority = """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 100) / 10::DOUBLE END AS page_rank,
  CASE WHEN s_suppkey % 4 <> 0 THEN round_even(least(10.0::DOUBLE, (s_suppkey * 7 % 1100) / 100::DOUBLE), 2) WHEN s_suppkey % 5 > 0 THEN round_even(least(10.0::DOUBLE, log10(CASE WHEN s_suppkey % 5 = 1 THEN 0 ELSE s_suppkey * s_suppkey % 100000 END + 1.0::DOUBLE) * 2.5), 2) END AS authority
FROM supplier"""
    view = "(SELECT audit_id, url, rendered_word_count - raw_word_count AS js_delta, images_total - images_with_alt AS alt_missing, svg_total - svg_accessible AS svg_unnamed, render_mode FROM p)"
    family = "CASE k % 4 WHEN 0 THEN 'models' WHEN 1 THEN 'glossary' WHEN 2 THEN 'compare' ELSE 'blog' END"
    parity = "CASE WHEN rendered_word_count <= 0 THEN 1.0 ELSE least(1.0, raw_word_count::DOUBLE / rendered_word_count) END"
    title = "CASE WHEN coalesce(title, '') = '' THEN 0 WHEN length(title) < 30 THEN 60 WHEN length(title) > 60 THEN 70 ELSE 100 END"
    measured = r.MEASURED
    made = {
        "page_basics": basics,
        "page_rule_scores": page_scores,
        "host_pages": hosts,
        "crawl_waves": waves,
        "rule_scores": f"{r.results()} SELECT audit_id, key, pillars, score, status, weight::DOUBLE AS weight, evidence_tier FROM r",
        "pillar_scores": f"{r.results()}, {r.pillars()} SELECT * FROM ps",
        "global_scores": f"""{r.results()}, {r.pillars()}, {r.totals()},
c AS (SELECT audit_id, {r.coverage()} AS coverage FROM r GROUP BY audit_id)
SELECT audit_id, gs.score AS score_global, coverage, CASE WHEN coverage >= 0.9 THEN 'complete' WHEN coverage >= 0.7 THEN 'substantial' WHEN coverage >= 0.4 THEN 'partial' ELSE 'insufficient' END AS coverage_label FROM gs JOIN c USING (audit_id)""",
        "issue_plan": f"""{r.results()}, i AS (
  SELECT audit_id, key, status AS severity, CASE WHEN weight < 1 THEN 1 WHEN weight < 1.8 THEN 2 ELSE 3 END AS impact, {_effort()} AS effort FROM r WHERE status IN ('warning', 'critical') AND evidence_tier = 'standard'
), j AS (SELECT *, round_even(impact * CASE severity WHEN 'critical' THEN 2 ELSE 1 END / effort::DOUBLE, 2) AS priority FROM i)
SELECT audit_id, row_number() OVER (PARTITION BY audit_id ORDER BY priority DESC, key)::INT AS rank, key, severity, impact::INT AS impact, effort::INT AS effort, priority, CASE WHEN priority >= 3 THEN 'high' WHEN priority >= 1 THEN 'medium' ELSE 'low' END AS bucket FROM j""",
        "agent_readiness": f"""{sql()}, g AS (
  SELECT audit_id, bool_or(register_tool OR tool_attributes) AS has_webmcp, bool_or(actions <> '') AS pot, bool_or(action_types <> '') AS typ, bool_or(forms_usable > 0) AS has_agent_forms, bool_or(api) AS has_openapi FROM p GROUP BY audit_id
), h AS (SELECT *, pot::INT + has_agent_forms::INT + has_openapi::INT AS n FROM g)
SELECT audit_id, CASE WHEN has_webmcp AND n >= 2 THEN 'advanced' WHEN has_webmcp OR n >= 2 THEN 'ready' WHEN n >= 1 THEN 'basic' ELSE 'none' END AS readiness_level, has_webmcp OR n >= 2 AS agent_ready, has_webmcp, pot OR typ AS has_action_schema, has_agent_forms, has_openapi, n::INT AS action_signals,
  coalesce(endpoints, 0)::INT AS ai_discovery_endpoints, coalesce(nlweb = 'conformant', FALSE) AS has_nlweb, CASE WHEN brand = 2 THEN 50.0::DOUBLE END AS brand_coherence_score, blocked::INT AS blocked_agent_bots
FROM h JOIN si USING (audit_id) JOIN ex USING (audit_id)""",
        "rule_evidence": f"""{sql()}, e AS ({r.page_scores()})
SELECT audit_id, key, string_agg(url, ' ' ORDER BY url) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY audit_id, key ORDER BY url) AS n FROM e WHERE score < 80) WHERE n <= 10 GROUP BY audit_id, key""",
        "orphan_pages": f"{sql()} SELECT audit_id, url FROM (SELECT *, min(url) OVER (PARTITION BY s) AS home FROM p) WHERE url <> home AND url NOT IN (SELECT {url_of('linked')} FROM p WHERE linked IS NOT NULL)",
        "render_routes": f"""{sql()}, c AS (SELECT audit_id, {family} AS path, count(*) AS pages, count(*) FILTER (render_mode = 'ssr') AS ssr, count(*) FILTER (render_mode = 'csr') AS csr FROM p WHERE render_mode IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY csr DESC, pages DESC, path)::INT AS rank FROM c) WHERE rank <= 12""",
        "render_offenders": f"""{sql()}, c AS (SELECT audit_id, url, raw_word_count::INT AS raw_words, rendered_word_count::INT AS rendered_words, (rendered_word_count - raw_word_count)::INT AS delta, {parity} AS parity FROM p WHERE render_mode = 'csr' AND raw_word_count IS NOT NULL)
SELECT * EXCLUDE (parity), round_even(parity * 100, 0)::INT AS parity_pct FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY parity, delta DESC, url)::INT AS rank FROM c) WHERE rank <= 10""",
        "pages_explorer": f"{sql()} SELECT audit_id, url, js_delta, alt_missing, svg_unnamed FROM {view} WHERE contains(lower(url), 'models') ORDER BY coalesce(js_delta, -1) DESC, audit_id, url LIMIT 50",
        "pages_totals": f"{sql()} SELECT audit_id, count(*) AS pages, sum(alt_missing)::BIGINT AS alt_missing, sum(svg_unnamed)::BIGINT AS svg_unnamed, count(*) FILTER (render_mode = 'csr') AS csr FROM {view} GROUP BY audit_id",
        "criteria_groups": f"""{r.results()} SELECT split_part(pillars, ' ', 1) AS "group", count(*) AS n, count(*) FILTER (status = 'critical') AS critical FROM r WHERE {measured} AND list_contains(string_split(pillars, ' '), 'geo') GROUP BY ALL""",
        "pillar_criteria": f"""{r.results()}, e AS (SELECT *, unnest(string_split(pillars, ' ')) AS pillar FROM r) SELECT pillar, split_part(pillars, ' ', 1) AS "group", count(*) AS n, count(*) FILTER ({measured}) AS measured FROM e GROUP BY ALL""",
        "json_reports": f"""{r.results()}, {r.pillars()}, {r.totals()}, i AS (
  SELECT audit_id, key, round_even(CASE WHEN weight < 1 THEN 1 WHEN weight < 1.8 THEN 2 ELSE 3 END * CASE status WHEN 'critical' THEN 2 ELSE 1 END / {_effort()}::DOUBLE, 2) AS priority FROM r WHERE status IN ('warning', 'critical') AND evidence_tier = 'standard'
), o AS (SELECT audit_id, arg_min(key, {{'p': -priority, 'k': key}}) AS first_issue, max(priority) AS first_priority FROM i GROUP BY audit_id)
SELECT audit_id, audit_id AS named, count(*)::INT AS criteria, any_value(gs.score) AS score_global, any_value(ps.score) AS geo, max(key) AS last_rule, arg_max(status, key) AS last_status, any_value(first_issue) AS first_issue, any_value(first_priority) AS first_priority
FROM r JOIN gs USING (audit_id) JOIN (SELECT * FROM ps WHERE pillar = 'geo') ps USING (audit_id) JOIN o USING (audit_id) GROUP BY audit_id""",
        "compare_totals": f"""{_compare()} SELECT pair_id, coalesce(l.score, 0) AS left_global, coalesce(x.score, 0) AS right_global, round_even(coalesce(x.score, 0) - coalesce(l.score, 0), 2) AS global_delta, TRUE AS recomputed
FROM pairs LEFT JOIN gs_left l ON l.audit_id = pair_id LEFT JOIN gs_right x ON x.audit_id = pair_id""",
        "compare_pillars": f"""{_compare()} SELECT pair_id, pillar, coalesce(l.score, 0) AS left_score, coalesce(x.score, 0) AS right_score, round_even(coalesce(x.score, 0) - coalesce(l.score, 0), 2) AS delta
FROM (SELECT pair_id, pillar FROM pairs, {r.PILLAR_TABLE}) g LEFT JOIN ps_left l ON l.audit_id = pair_id AND l.pillar = g.pillar LEFT JOIN ps_right x ON x.audit_id = pair_id AND x.pillar = g.pillar""".replace("SELECT pair_id, pillar, coalesce", "SELECT pair_id, g.pillar, coalesce"),
        "compare_criteria": f"{_deltas()} SELECT * FROM d",
        "compare_changes": f"{_deltas()} SELECT pair_id, rank::INT AS rank, key, delta FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY abs(delta) DESC, key) AS rank FROM d WHERE delta <> 0) WHERE rank <= 15",
        "scorecard_comparison": f"""{r.results()}, {r.pillars()}, {r.totals()}, x AS (SELECT * FROM r WHERE audit_id = 'site4'), y AS (SELECT * FROM r WHERE audit_id = 'site8')
SELECT 'site4|site8' AS pair_id, x.key, x.score AS left_score, y.score AS right_score, round_even(y.score - x.score, 2) AS delta, x.status AS left_status, y.status AS right_status, round_even((SELECT score FROM gs WHERE audit_id = 'site8') - (SELECT score FROM gs WHERE audit_id = 'site4'), 2) AS global_delta, 'exact' AS comparability FROM x JOIN y USING (key)""",
        "domain_audits": f"WITH {HISTORY}, n AS (SELECT lpad(l_orderkey::VARCHAR, 12, '0') AS audit_id, count(*) AS c FROM lineitem GROUP BY 1) SELECT audit_id, strftime(started_at, '%Y-%m-%d') AS started_on, coalesce(c, 0) AS criteria FROM hist LEFT JOIN n USING (audit_id) WHERE host = 'h1'",
        "latest_audits": f"WITH {HISTORY} SELECT host, audit_id, score_global, audits FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY started_at DESC, audit_id DESC) AS n, count(*) OVER (PARTITION BY host) AS audits FROM hist) WHERE n = 1",
        "successive_audits": f"WITH {HISTORY} SELECT left_id || '|' || right_id AS pair_id, left_id, right_id FROM (SELECT audit_id AS right_id, lag(audit_id) OVER (PARTITION BY host ORDER BY started_at, audit_id) AS left_id FROM hist) WHERE left_id IS NOT NULL",
        "recalculated_scores": f"{r.results()}, {r.pillars()}, {r.totals()} SELECT audit_id, score AS score_global FROM gs",
        "citation_metrics": cites,
        "mention_rates": mentions,
        "run_costs": """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') * (conv_id % 4 + 1) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS run_id, n * (conv_id % 5) AS calls, round_even(CASE WHEN conv_id % 5 > 0 THEN n * (40 / 1e6 * 0.15 + 400 / 1e6 * 0.60 + 0.01) ELSE 0 END + CASE WHEN conv_id % 5 > 2 THEN n * (40 / 1e6 * 0.075 + 400 / 1e6 * 0.30) ELSE 0 END + CASE WHEN conv_id % 5 > 3 THEN n * (40 / 1e6 + 400 / 1e6 + 0.005) ELSE 0 END, 4) AS total_usd FROM c""",
        "search_periods": periods,
        "serp_overviews": f"WITH {serp} SELECT audit_id, query, triggered, cited, position::DOUBLE AS position FROM found",
        "serp_metrics": f"WITH {serp} SELECT audit_id, avg(cited::INT) AS presence_rate, avg(triggered::INT) AS trigger_rate, avg(position) AS avg_position, count(*)::INT AS query_count FROM found GROUP BY audit_id",
        "page_speed": speed,
        "authority": authority,
        "theme_topics": topics,
        "prompt_sets": sets,
        "artifact_store": f"SELECT DISTINCT 'projects/' || {HOST} || '/runs/r1/html_raw/' || sha256(html) || '.html.gz' AS object_key, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes FROM pages",
        "event_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS from_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    } | inputs_sql.oracle_sql() | pages_sql.oracle_sql()
    return {k: r.binary(v) for k, v in made.items()}
