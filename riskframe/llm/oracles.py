"""DuckDB SQL for the operators that SQL can express (small tables only: pairs and
windows are written out in full)."""

from __future__ import annotations

#: Words of every document; none for a null text.
_WORDS = r"""words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""

SUBSTRING_DEDUP = f"""
WITH {_WORDS},
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM words),
windows AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 49), ' ')) AS h FROM starts),
firsts AS (SELECT h, MIN(doc_id) AS lo FROM windows GROUP BY h),
gone AS (SELECT DISTINCT w.doc_id, unnest(range(w.s, w.s + 50)) AS p FROM windows w JOIN firsts f ON f.h = w.h WHERE f.lo < w.doc_id),
marked AS (SELECT doc_id, list(p ORDER BY p) AS ps,
                  COUNT(*) FILTER (WHERE NOT touching) AS runs
           FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) = p - 1, false) AS touching FROM gone)
           GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n, coalesce(len(ps), 0) AS cut, coalesce(runs, 0) AS runs,
                array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ') AS body
         FROM words w LEFT JOIN marked m ON m.doc_id = w.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(cut AS BIGINT) AS n_removed, sha256(body) AS kept_sha256,
       CAST(runs AS INTEGER) AS n_repeats
FROM kept"""


def _components(nodes: str, links: str) -> str:
    """CTEs ``closure`` for the smallest node reachable over ``links(a, b)``, given in
    both directions."""
    return f"""closure AS (
  SELECT id AS node, id AS reached FROM {nodes}
  UNION
  SELECT c.node, l.b FROM closure c JOIN {links} l ON l.a = c.reached),
component AS (SELECT node, MIN(reached) AS component_id FROM closure GROUP BY node)"""


NEAR_DUPLICATES = f"""
WITH RECURSIVE {_WORDS},
shingles AS (
  SELECT doc_id, shingle, COUNT(*) AS c FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1),
                                         lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) AS shingle
    FROM words WHERE len(ws) > 0)
  GROUP BY doc_id, shingle),
sizes AS (SELECT doc_id, SUM(c) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, SUM(least(x.c, y.c)) AS n
           FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
          WHERE s.n >= 0.8 * (x.n + y.n - s.n)),
nodes AS (SELECT doc_id AS id FROM documents),
{_components("nodes", "links")}
SELECT node AS doc_id, component_id, node = component_id AS kept FROM component"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.id <> y.id AND len(x.v) = len(y.v)
          WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_components("nodes", "links")}
SELECT c.node AS vec_id, (SELECT COUNT(*) FROM links l WHERE l.a = c.node) AS n_links, c.component_id,
       c.node = c.component_id AS kept
FROM component c"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5"""

_NONE = "{'c': CAST(1000000000 AS BIGINT), 'a': ''}"


def _edit(state: str, cost: str, initial: str, allowed: str = "true") -> str:
    """(cost, audit) of a state extended by one edit, or out of reach."""
    return f"CASE WHEN {allowed} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}'}} ELSE {_NONE} END"


def _after_row(state: str, before: str) -> str:
    """Best (cost, audit) of a state after row r, before any insert, from the states w."""
    options = [_edit(f"w.{state}", "3", "D")]
    for b in before:
        options.append(_edit(f"w.{b}", "r.late", "K", f"NOT r.forced AND r.initial = '{state}'"))
        if state in "ua":
            options.append(_edit(f"w.{b}", "2 + r.late", "R", "NOT r.forced"))
    return f"least({', '.join(options)}) AS {state}"


def _inserts(source: str) -> str:
    """States z (nothing yet), s, u, a with up to two inserts after them."""
    u = f"least(u, {_edit('z', '2', 'I')}, {_edit('s', '2', 'I')}, {_edit('a', '2', 'I')})"
    return f"""SELECT key, i, z, s, u, least(a, {_edit('u', '2', 'I')}) AS a
  FROM (SELECT key, i, z, s, a, {u} AS u FROM ({source}))"""


CONVERSATION_REPAIR = rf"""
WITH RECURSIVE hit AS (
  SELECT *, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                       lambda x: CAST(ord(x) AS BIGINT)),
                        lambda crc, b: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, b)),
                        4294967295) AS crc
  FROM conversations),
damaged AS (
  SELECT coalesce('=' || conv_id, '') AS key, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END))
        FROM (SELECT *, xor(crc, 4294967295) % 20 AS kind FROM hit))),
ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, md5(text)) AS i
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(initial) OVER (PARTITION BY key ORDER BY i) || initial AS pair
  FROM ordered),
classed AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS forced, CAST(coalesce(fault = 'truncated', false) AS BIGINT) AS late FROM faults),
conversation AS (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS key FROM conversations),
walk AS (
  {_inserts(f"SELECT key, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS z, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM conversation")}
  UNION ALL
  {_inserts(f"SELECT w.key, r.i, {_after_row('z', '')}, {_after_row('s', 'z')}, {_after_row('u', 'zsa')}, {_after_row('a', 'u')} FROM walk w JOIN classed r ON r.key = w.key AND r.i = w.i + 1")}),
best AS (
  SELECT key, least(z, a) AS goal FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1),
letters AS (
  SELECT key, unnest(string_split(goal.a, '')) AS edit, generate_subscripts(string_split(goal.a, ''), 1) AS j FROM best WHERE goal.a <> ''),
placed AS (
  SELECT l.key, l.edit, l.j, SUM(CASE WHEN l.edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY l.key ORDER BY l.j) AS i FROM letters l),
outs AS (
  SELECT p.key, p.j, p.edit, c.role, CASE WHEN p.edit = 'I' THEN '' ELSE c.text END AS text,
         row_number() OVER (PARTITION BY p.key ORDER BY p.j) AS k,
         first_value(p.edit = 'K' AND c.initial = 's') OVER (PARTITION BY p.key ORDER BY p.j) AS has_s
  FROM placed p LEFT JOIN classed c ON c.key = p.key AND c.i = p.i WHERE p.edit <> 'D'),
repaired AS (
  SELECT key, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - CAST(has_s AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
                         || ':' || text, chr(10) ORDER BY j) AS body
  FROM outs GROUP BY key),
counts AS (
  SELECT key, coalesce(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank,
         COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate, COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated,
         COUNT(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM classed GROUP BY key)
SELECT v.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
       coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, b.goal.c AS cost, b.goal.a AS audit,
       sha256(coalesce(r.body, '')) AS repaired_sha256
FROM conversation v JOIN best b ON b.key = v.key LEFT JOIN counts n ON n.key = v.key LEFT JOIN repaired r ON r.key = v.key"""
