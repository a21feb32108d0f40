"""SQL for the queries of this subpackage that SQL can state, in DuckDB's dialect."""

from __future__ import annotations

from fairtender.llm.chat import CONTROL
from fairtender.llm.urls import LOWER, UPPER


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


REPLY_TREES = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  t AS (SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS told,
    string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS loss,
    sum(length({_escaped("role")}) + length({_escaped("text")}) + length('<s>[INST] ') + length(' [/INST]') + length('</s>')) AS size
    FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(size AS BIGINT) AS formatted_chars FROM t"""

NEAR_COPIES = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
      '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS t FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
      ELSE list_transform(range(1, len(t) - 1), lambda i: concat(t[i], ' ', t[i + 1], ' ', t[i + 2])) END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
  e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
  r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS least_id FROM r GROUP BY x) m ON d.doc_id = m.x"""


def url_verdicts(rules: tuple[tuple[str, str], ...]) -> str:
    """Canonical links are read in their usual written form only."""
    listed = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    host = f"coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    address = f"CASE WHEN contains(url, '://') THEN concat({host}, coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1), ''), '/')) END"
    best = "SELECT {0}, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM {1} JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY {0}"
    return f"""WITH RECURSIVE rules(verdict, rule, h, s) AS (VALUES {listed}),
  p AS (SELECT row_number() OVER () AS k, page_id, {host} AS host, {path} AS path, {address} AS address, html FROM pages),
  u AS (SELECT address AS a, unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"]*://[^"]*)"', 1)) AS url FROM p),
  e AS (SELECT a, {address} AS b FROM u WHERE a IS NOT NULL),
  b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r AS (SELECT a, b FROM b UNION SELECT r.a, b.b FROM r JOIN b ON r.b = b.a),
  own AS ({best.format("k", "p")}),
  named AS (SELECT DISTINCT b AS node, split_part(b, '/', 1) AS host, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS path FROM r),
  known AS ({best.format("node", "named")}),
  shared AS (SELECT r.a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM r JOIN known ON r.b = node GROUP BY r.a)
SELECT page_id, host, path, own.rule, coalesce(own.verdict, shared.verdict, 'allow') AS verdict,
  CASE WHEN own.rule IS NOT NULL THEN 'rule' WHEN shared.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM p LEFT JOIN own USING (k) LEFT JOIN shared ON p.address = shared.a"""
