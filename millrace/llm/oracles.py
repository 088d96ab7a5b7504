"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_decontamination"] = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, w[i : i + least(len(w), 10) - 1] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, i, w[i : i + k - 1] AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
),
hits AS (SELECT DISTINCT r, dw.k AS k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_QUINTET = "('0x' || substr(h, {j} * 5 + 1, 5))::INT"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_QUINTET.format(j=j)} >> {shift}) & 31) + 1, 1)" for j in range(8) for shift in (15, 10, 5, 0)
)

ORACLES["op2_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
r AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h,
    row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS k,
    first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST) AS f
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM r
"""

_AFTER = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = f"coalesce({_LOW.format('regexp_extract(' + _AFTER + ', ' + chr(39) + '^([^/?#]*)' + chr(39) + ', 1)')}, '')"
_PATH = f"coalesce(regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1), '')"
_BARE = "regexp_replace({u}, '#[\\s\\S]*$', '')"
_HEAD = f"regexp_extract({_BARE}, '^([^/?#]*://[^/?#]*)', 1)"
_NODE = f"CASE WHEN {_HEAD} != '' THEN {_LOW.format(_HEAD)} || substr({_BARE}, length({_HEAD}) + 1) END"
_RULE = "(SELECT struct_pack(rule := rh || rp, says := says) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1)"

ORACLES["op6_url_filters"] = rf"""
WITH RECURSIVE rules(rh, rp, says) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
),
said AS (
  SELECT url, replace(link, '&amp;', '&') AS link FROM (
    SELECT url, unnest([
      regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS link
    FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')
  ) WHERE link != ''
),
full_links AS (
  SELECT url, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '^([^/?#]*)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) || link
    WHEN regexp_extract(url, '^([^/?#]*://[^/?#]*(?:/[^/?#]*)*/)', 1) != '' THEN regexp_extract(url, '^([^/?#]*://[^/?#]*(?:/[^/?#]*)*/)', 1) || link
    ELSE regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) || '/' || link END AS target FROM said
),
pairs AS (SELECT DISTINCT {_NODE.format(u="url")} AS a, {_NODE.format(u="target")} AS b FROM full_links),
edges AS (SELECT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
reach(n, m) AS (SELECT a, a FROM edges UNION SELECT n, b FROM reach JOIN edges ON m = a),
named AS (SELECT DISTINCT n, {_HOST.format(u="n")} AS host, {_PATH.format(u="n")} AS path FROM reach),
own AS (SELECT n, {_RULE}.says AS says FROM named),
alias AS (SELECT reach.n, bool_or(says = 'allow') AS allowed, bool_or(says = 'block') AS blocked FROM reach JOIN own ON reach.m = own.n GROUP BY reach.n),
p AS (SELECT page_id, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path, {_NODE.format(u="url")} AS name FROM pages),
r AS (SELECT p.*, {_RULE} AS hit FROM p)
SELECT page_id, host, path, hit.rule AS rule,
  coalesce(hit.says, CASE WHEN alias.blocked AND NOT coalesce(alias.allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN alias ON r.name = alias.n
"""
