"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_REST = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc_of_nibble(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


_NIBBLES = "[" + ", ".join(str(_crc_of_nibble(n)) for n in range(16)) + "]::BIGINT[]"
_HALF = f"xor(xor(a, x) >> 4, ({_NIBBLES})[(xor(a, x) & 15) + 1])"
_CRC32 = f"xor(list_reduce(list_transform(regexp_extract_all({{0}}, '..'), lambda c: ('0x' || c)::BIGINT), lambda a, x: xor({_HALF} >> 4, ({_NIBBLES})[({_HALF} & 15) + 1]), 4294967295::BIGINT), 4294967295)"

ORACLES: dict[str, str] = {
    "op1_sharding": f"""
WITH raw AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, source, len(h) // 2 + 16 AS size, {_CRC32.format("h")} AS text_crc32, ('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '~' || (len(h) // 2 + 16) || {_CRC32.format("h")})), 1, 10))::BIGINT AS hash FROM raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id, size, text_crc32) AS k, count(*) OVER (PARTITION BY source) AS n FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY (2 * k - 1) / (2 * n)::DOUBLE, coalesce('=' || source, ''), k) - 1 AS p, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (p * 40) // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, p - (shard * total + 39) // 40 AS slot, CAST(NULL AS INT) AS grown_shard, source FROM cut""",
    "op8_url_filter": f"""
WITH cut AS (SELECT page_id, url, {_REST} AS rest FROM pages),
parts AS (
  SELECT page_id, url, coalesce({_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS params
  FROM cut),
canon AS (
  SELECT *, CASE WHEN url IS NULL THEN NULL ELSE regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
  FROM parts),
listed AS (SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host, '(adult|ads-|casino|bets|pills|spam)')),
ruled AS (
  SELECT page_id, host, path, canonical,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM canon)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  listed.canonical IS NOT NULL AS is_listed
FROM ruled LEFT JOIN listed ON ruled.canonical = listed.canonical""",
    "op11_extraction": r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM inner_html),
plain AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM bare)
SELECT page_id, url, text, CAST(len(text) AS BIGINT) AS n_chars FROM plain""",
    "op12_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id AS id, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score FROM v AS a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'r': role, 'x': text}} ORDER BY turn NULLS FIRST, md5(role || chr(0) || text)) AS s, {_CRC32.format("hex(encode(CAST(conv_id AS VARCHAR)))")} % 6 AS h FROM t GROUP BY conv_id),
built AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.s, 1, c.h), []), list_slice(c.s, c.h + 1, len(c.s))) AS q FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
rows_ AS (SELECT conv_id, len(q) AS n, d, md5(CAST(to_json(list_slice(q, 1, d)) AS VARCHAR)) AS k, md5(CAST(to_json(list_slice(q, 1, d - 1)) AS VARCHAR)) AS above, CASE WHEN d > 0 THEN len(q[d].x) ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(0, len(q) + 1)) AS d FROM built)),
nodes AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, any_value(above) AS above, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM rows_ GROUP BY d, k),
children AS (SELECT d - 1 AS d, above AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
told AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, k)),
under AS (SELECT DISTINCT a.d, a.k, b.d AS low_d, b.k AS low_k FROM rows_ AS a JOIN rows_ AS b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT under.d, under.k, sum(CAST(told.n_children = 0 AS INT)) AS leaves, sum((told.n - 1) * told.chars) AS saved FROM under JOIN told ON told.d = low_d AND told.k = low_k GROUP BY under.d, under.k)
SELECT told.conv_id, told.d AS depth, up.conv_id AS parent_conv_id, told.n AS n_convs, told.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, told.ends AS ends_sha256
FROM told JOIN sums USING (d, k) LEFT JOIN nodes AS up ON up.d = told.d - 1 AND up.k = told.above AND told.d > 0""",
}
