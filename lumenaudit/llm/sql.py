"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .substring import LEAST

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"regexp_extract_all(" + LOWERED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = r"""
WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*|[.!?\n]+') AS p FROM documents)
), placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a,
         array_to_string(regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM pieces
), units AS (
  SELECT doc_id, a, length(piece) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, row_number() OVER (PARTITION BY norm ORDER BY doc_id, a) AS r FROM placed WHERE norm <> ''
), runs AS (
  SELECT doc_id, min(a) AS a, max(a + n) AS b, count(*) AS units
  FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM units WHERE r > 1)
  GROUP BY doc_id, g HAVING sum(n) >= {least}
), kept AS (
  SELECT p.doc_id, string_agg(piece, '' ORDER BY i) AS text FROM placed p LEFT JOIN runs r ON r.doc_id = p.doc_id AND p.a >= r.a AND p.a < r.b WHERE r.doc_id IS NULL GROUP BY p.doc_id
), gone AS (
  SELECT doc_id, sum(units)::INT AS n_removed, sum(b - a)::BIGINT AS removed_chars, string_agg(concat(a, '-', b), ',' ORDER BY a) AS spans FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars, length(coalesce(k.text, ''))::BIGINT AS kept_chars, coalesce(spans, '') AS spans, coalesce(k.text, '') AS text
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, len({SPACED})::BIGINT AS size, md5(concat(coalesce(doc_id::VARCHAR, 'null'), ':', md5(coalesce(text, '')))) AS k FROM documents
), s AS (
  SELECT *, 3 * source_size AS cap, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM s WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, coalesce(least(w * lv, cap::DOUBLE), 0) AS target, floor(coalesce(least(w * lv, cap::DOUBLE), 0) + 0.5)::BIGINT AS budget
  FROM (SELECT *, max(level) FILTER (level <= cap / w) OVER () AS lv FROM l)
), p AS (
  SELECT d.*, source_size, target, budget, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken FROM p
"""



def _op6() -> str:
    """The templates as a table; a word of a template votes for a start, and key words and all words are counted."""
    from .licenses import SHARE, TEMPLATES

    rows = ", ".join(f"('{t.label}', {str(t.base).upper()}, {k}, '{w}', {len(t.words)}, {t.key[0]}, {t.key[1]})" for t in TEMPLATES for k, w in enumerate(t.words))
    return rf"""
WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
t(label, base, off, word, n, a, b) AS (VALUES {rows}),
found AS (
  SELECT doc_id, label, base, i - off + a AS start, count(*)::DOUBLE / n AS share
  FROM x JOIN t USING (word) GROUP BY doc_id, label, base, i - off, n, a, b
  HAVING count(*) FILTER (off >= a AND off < b) = b - a AND count(*)::DOUBLE / n >= {SHARE}
), s AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM found GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (doc_id)
"""


OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

OP9 = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents
), full_lines AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), windows AS (
  SELECT doc_id, k, line AS l0, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, k) AS r FROM windows WHERE l2 IS NOT NULL) WHERE r > 1
), covered AS (
  SELECT DISTINCT doc_id, k + j AS k FROM later, (VALUES (0), (1), (2)) t(j)
), runs AS (
  SELECT c.doc_id, min(f.i) AS a, max(f.i) AS b
  FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM covered) c JOIN full_lines f USING (doc_id, k)
  GROUP BY c.doc_id, g
), marked AS (
  SELECT l.doc_id, l.i, l.line, EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = l.doc_id AND l.i BETWEEN r.a AND r.b) AS cut FROM lines l
)
SELECT m.doc_id, count(*)::INT AS n_lines, count(*) FILTER (cut)::INT AS n_removed,
       coalesce((SELECT string_agg(concat(a, '-', b), ',' ORDER BY a) FROM runs r WHERE r.doc_id = m.doc_id), '') AS spans,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') AS kept_text
FROM marked m GROUP BY m.doc_id
"""

OP10 = rf"""
WITH dw AS (SELECT doc_id, {ALNUM} AS w FROM documents), bw AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM items),
places AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, k, n, item_id FROM places JOIN items USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS x FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _op11() -> str:
    """A step of the recursion is a row of a conversation: the cheapest way into each of the four states, with its audit and rows."""
    add = lambda x, cost, letter, out="": f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {f'list_append({x}.o, {out})' if out else f'{x}.o'}}}"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    none = "{'c': 1000000000::BIGINT, 'a': '', 'o': []::VARCHAR[]}"
    on = lambda cost, letter, out, to: least(*(add(x, cost, letter, out.format(role="user" if to == "u" else "assistant")) for x in (("s", "m", "a") if to == "u" else ("u",))))
    stays = lambda way: f"CASE WHEN gone THEN {none} ELSE {way} END"
    kept = lambda kind, way: f"CASE WHEN gone OR kind <> '{kind}' THEN {none} ELSE {way} END"
    step = {
        "s": add("s", 2, "D"),
        "m": least(add("m", 2, "D"), kept("s", add("s", "more", "K", "role || ':' || text"))),
        "u": least(add("u", 2, "D"), stays(on("more + 1", "R", "'{role}:' || text", "u")), kept("u", on("more", "K", "role || ':' || text", "u"))),
        "a": least(add("a", 2, "D"), stays(on("more + 1", "R", "'{role}:' || text", "a")), kept("a", on("more", "K", "role || ':' || text", "a"))),
    }
    closed = lambda source: f"SELECT conv_id, i, s, m, u, {least('a', add('u', 5, 'I', chr(39) + 'assistant:' + chr(39)))} AS a FROM (SELECT conv_id, i, s, m, {least('u', *(add(x, 5, 'I', chr(39) + 'user:' + chr(39)) for x in ('s', 'm', 'a')))} AS u, a FROM ({source}))"
    begin = f"SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS s, {none} AS m, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM rows_)"
    next_ = f"SELECT r.conv_id, r.i, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1"
    return f"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS code
  FROM conversations, t
), damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM coded)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i, left(role, 1) AS first, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown FROM damaged
), faults AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(first) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), rows_ AS (SELECT *, first AS kind, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM faults
), w AS ({closed(begin)} UNION ALL {closed(next_)}),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id
), best AS (SELECT sums.*, list_min([s, a]) AS x FROM sums JOIN w ON w.conv_id IS NOT DISTINCT FROM sums.conv_id AND w.i = n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit,
  sha256(coalesce(array_to_string(x.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS own, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring": OP3.replace("{least}", str(LEAST)),
        "op4_topk": OP4,
        "op5_mixing": OP5,
        "op6_licenses": _op6(),
        "op7_warc": OP7,
        "op9_linewindows": OP9,
        "op10_decontam": OP10,
        "op11_conversations": _op11(),
        "op13_negatives": OP13,
    }
