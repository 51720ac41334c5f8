"""DuckDB SQL for the operators that SQL can express, from their contracts alone."""

from __future__ import annotations

from graphloom.llm.chat_format import BUDGET, CLOSE, FRAME_TOKENS, HISTORY_TOKENS, HISTORY_TURNS, OPEN, PART_TURNS
from graphloom.llm.secrets import BASE_RULES, MORE_RULES

_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS1 = rf"regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS1}, []) AS w FROM documents), b AS (SELECT item_id, {_WORDS1} AS w FROM benchmark),
  win AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[p:p + 9] END AS v FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT len(v) AS n FROM win), here AS (SELECT doc_id, p, n, w[p:p + n - 1] AS v FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
  hit AS (SELECT doc_id, p, n, item_id FROM here JOIN win USING (v)),
  cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
  its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

SUBSTRINGS = r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
  win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
  dup AS (SELECT doc_id, p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
  cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM dup),
  wd AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
  kept AS (SELECT wd.doc_id, count(cov.p) AS n_removed, string_agg(x, ' ' ORDER BY wd.p) FILTER (cov.p IS NULL) AS t FROM wd LEFT JOIN cov ON cov.doc_id = wd.doc_id AND cov.p = wd.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _found(k: int, r) -> str:
    regex = ("(?i)" if r.ignore_case else "") + r.regex.replace("'", "''")
    return f"""SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, list_sum([len(x) for x in g[1:i]]) + coalesce(list_sum([len(x) for x in m[1:i - 1]]), 0) AS s, len(m[i]) AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(t, '{regex}') AS g, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {r.group}) AS q FROM x)) WHERE len(q[i]) >= {r.least}"""


SECRETS = f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(_found(k, r) for k, r in enumerate(BASE_RULES + MORE_RULES))}),
  z AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || (s + n) AS v FROM f)
SELECT x.doc_id, {', '.join(f"count(*) FILTER (rank = {k})::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE_RULES))}, sha256(coalesce(string_agg(v, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg(v, ',' ORDER BY s, rank), '') AS spans FROM x LEFT JOIN z USING (doc_id) GROUP BY 1"""


#: By the layout that ``chat_format.windows`` states, without its text: what each window holds, and how long that is.
CHAT = rf"""WITH base AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
  t AS (SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\x20\x09-\x0D\p{{L}}\p{{N}}]')) + {FRAME_TOKENS} AS tok,
    {len(OPEN) + len(CLOSE) + 1} + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS size FROM base),
  o AS (SELECT *, row_number() OVER w AS place, first(role) OVER w = 'system' AS sys, first(tok) OVER w AS tok1, first(size) OVER w AS size1 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  r AS (SELECT *, (place - 1) // {PART_TURNS} AS part, sys AND place = 1 AS head, {BUDGET} - CASE WHEN sys THEN tok1 ELSE 0 END AS room, CASE WHEN sys AND place = 1 THEN 0 ELSE tok END AS own FROM o),
  q AS (SELECT *, row_number() OVER w AS seq, coalesce(sum(own) OVER (PARTITION BY conv_id, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM r WINDOW w AS (PARTITION BY conv_id, part ORDER BY place)),
  c AS (SELECT *, floor(pre / stride)::BIGINT AS cell FROM (SELECT *, greatest(1, floor(room / 2))::BIGINT AS stride FROM q)),
  v AS (SELECT *, 2 * cell + CASE WHEN sum(own) OVER (PARTITION BY conv_id, part, cell) > room AND pre + own > (cell + 1) * stride THEN 1 ELSE 0 END AS win FROM c),
  f AS (SELECT conv_id, part, win, min(seq) AS seq, min(pre) AS pre, least({HISTORY_TOKENS}, max(room) - sum(own)) AS spare, bool_or(head) AS there, max(CASE WHEN sys THEN size1 END) AS head FROM v GROUP BY 1, 2, 3),
  h AS (SELECT f.conv_id, sum(v.size) AS chars FROM f JOIN v ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.part = f.part AND v.seq BETWEEN f.seq - {HISTORY_TURNS} AND f.seq - 1 AND f.pre - v.pre <= f.spare AND NOT v.head GROUP BY 1),
  g AS (SELECT conv_id, sum(head) AS chars FROM f WHERE NOT there GROUP BY 1)
SELECT v.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(size) + coalesce(any_value(h.chars), 0) + coalesce(any_value(g.chars), 0))::BIGINT AS formatted_chars
FROM v LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id GROUP BY v.conv_id"""

HARD_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS y
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.y, b.y)::BIGINT AS s FROM e a JOIN e b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
  n AS (SELECT p.a, p.b, p.s AS ps, s.b AS neg, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, b AS positive_id, r::INTEGER AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10"""
