"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from tabloom.llm import license_scan, line_rules, source_audit, url_reputation

SPACE = r"[\x20\x09-\x0D]"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda x: x <> '')"


LINE_RULES = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {words('text')} AS ws FROM t),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
repeated AS (SELECT r, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(0, 8)) AS j) GROUP BY r),
l AS (SELECT r, line, {words('line')} AS ws FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t)),
b AS (
  SELECT r, line, len(ws) AS n, length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars,
    len(list_filter(ws, lambda x: x IN ({', '.join(f"'{s}'" for s in line_rules.SEPARATORS)}))) > greatest(0.25 * len(ws), 1)
    OR (len(ws) >= {line_rules.UNPUNCTUATED_WORDS} AND NOT regexp_matches(line, '{line_rules.CLOSING}'))
    OR (len(ws) BETWEEN 1 AND {line_rules.BOILERPLATE_WORDS}
      AND regexp_matches({LOWER.format('line')}, '{'|'.join(line_rules.BOILERPLATE)}')) AS bad
  FROM l
),
s AS (
  SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, coalesce(sum(chars) FILTER (bad), 0) AS lost
  FROM b GROUP BY r
),
c AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN s USING (r) LEFT JOIN repeated USING (r)
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT * EXCLUDE (lost), NOT base_failed AND NOT lost > {line_rules.MAX_LOST} * word_chars AS kept FROM f
"""

OWN_WORDS = rf"list_filter(regexp_split_to_array({LOWER.format('text')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = rf"""
WITH i AS (SELECT item_id, {OWN_WORDS} AS ws FROM benchmark),
m AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS gram
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM m)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({OWN_WORDS}, []) AS ws FROM documents),
g AS (SELECT r, k, p, array_to_string(ws[p:p + k - 1], ' ') AS gram
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win))),
h AS (SELECT r, g.k, p, item_id FROM g JOIN win ON win.k = g.k AND win.gram = g.gram),
n AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM h)) GROUP BY r),
s AS (SELECT r, count(DISTINCT item_id) AS items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""


def _rules() -> tuple[str, str]:
    name, verdict = "NULL", "NULL"
    for rule in sorted(url_reputation.RULES, key=lambda r: len(r.name)):
        fits = f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '/{rule.path}')"
        fits = fits if rule.path else f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}'))"
        name, verdict = f"CASE WHEN {fits} THEN '{rule.name}' ELSE {name} END", f"CASE WHEN {fits} THEN '{rule.verdict}' ELSE {verdict} END"
    return name, verdict


def _strength(level: str) -> str:
    low, high = url_reputation.STRENGTH_RANGE
    default = url_reputation.DEFAULT_STRENGTH
    return f"""(SELECT CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN {default} WHEN sum(x) / sum(n - 1) <= 0 THEN {high}
      ELSE least(greatest(sum(n - 1) / sum(x) - 1, {low}), {high}) END AS strength
    FROM (SELECT n, n * (g / n - above) * (g / n - above) / (above * (1 - above)) - 1 AS x FROM {level} WHERE n > 1))"""


TWO = ", ".join(f"'{s}'" for s in url_reputation.TWO_LABEL_SUFFIXES)
LAST = lambda n: f"array_to_string(string_split(name, '.')[-{n}:], '.')"
ADDRESS = r"(regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') OR starts_with(name, '['))"


def _spread(strength: str, above: str) -> str:
    mean = f"((g + {strength} * above) / (n + {strength}))"
    return f"({mean} * (1 - {mean}) + {strength} * {strength} / (n + {strength}) * {above}) / (n + {strength} + 1)"


URL_REPUTATION = rf"""
WITH p AS (
  SELECT page_id, {LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
),
o AS (
  SELECT host, quality = 1 AND toxic = 0 AS good FROM p
  JOIN labels ON doc_id = try_cast(nullif(regexp_extract(path, '/(\d{{1,18}})(?:\.html|/)?$', 1), '') AS BIGINT)
),
h0 AS (SELECT host, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(g) AS DOUBLE) AS g, regexp_replace(host, ':[0-9]*$', '') AS name FROM (
  SELECT host, 1 AS n, CAST(good AS INT) AS g FROM o WHERE good IS NOT NULL UNION ALL SELECT host, 0, 0 FROM p) GROUP BY host),
h1 AS (
  SELECT host, n, g, CASE WHEN {ADDRESS} THEN name WHEN {LAST(2)} IN ({TWO}) THEN {LAST(3)} ELSE {LAST(2)} END AS domain,
    CASE WHEN {ADDRESS} THEN '{url_reputation.ADDRESSES}' WHEN {LAST(2)} IN ({TWO}) THEN {LAST(2)} ELSE {LAST(1)} END AS suffix FROM h0
),
top AS (SELECT (coalesce(sum(g), 0) + {url_reputation.DEFAULT_GOOD * url_reputation.DEFAULT_STRENGTH})
  / (coalesce(sum(n), 0) + {url_reputation.DEFAULT_STRENGTH}) AS mean, coalesce(sum(n), 0) AS labels FROM h1),
s1 AS (SELECT suffix, sum(n) AS n, sum(g) AS g, any_value(mean) AS above,
  any_value(mean * (1 - mean) / (labels + {url_reputation.DEFAULT_STRENGTH} + 1)) AS unsure FROM h1, top GROUP BY suffix),
s2 AS (SELECT s1.*, strength, {_spread('strength', 'unsure')} AS v FROM s1, {_strength('s1')}),
d1 AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(g) AS g FROM h1 GROUP BY domain),
d2 AS (SELECT d1.*, (s2.g - d1.g + strength * s2.above) / (s2.n - d1.n + strength) AS above,
  {url_reputation.PRIOR_SHARE} * (s2.n - d1.n + strength) AS bound, s2.v AS suffix_v FROM d1 JOIN s2 USING (suffix)),
d3 AS (SELECT d2.*, least(strength, bound) AS k FROM d2, {_strength('d2')}),
d4 AS (SELECT d3.*, {_spread('k', 'suffix_v')} AS v FROM d3),
h2 AS (SELECT h1.*, (d4.g - h1.g + k * d4.above) / (d4.n - h1.n + k) AS above,
  {url_reputation.PRIOR_SHARE} * (d4.n - h1.n + k) AS bound, d4.v AS domain_v FROM h1 JOIN d4 USING (domain)),
h3 AS (SELECT h2.*, least(strength, bound) AS k, above * (1 - above) AS own FROM h2, {_strength('h2')}),
h4 AS (SELECT *, CASE WHEN n > 0 THEN k ELSE own / ((own + k * domain_v) / (k + 1)) - 1 END AS prior FROM h3),
h5 AS (SELECT host, g + prior * above AS a, n - g + prior * (1 - above) AS b FROM h4),
bad AS (SELECT host FROM h5 WHERE a / (a + b) + {url_reputation.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {url_reputation.MIN_GOOD})
SELECT page_id, host, path, {_rules()[0]} AS rule,
  coalesce({_rules()[1]}, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""

JACCARD = rf"""
WITH RECURSIVE t AS (SELECT doc_id, {words(LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM t WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(low, t.doc_id)) AS component_id,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = t.doc_id LEFT JOIN l ON l.a = t.doc_id
"""


def _bigrams(text: str) -> str:
    own = rf"list_filter(regexp_split_to_array({LOWER.format(text)}, '[\x00-/:-`{{-\x7f]+'), lambda x: x <> '')"
    return f"list_distinct(list_zip(({own})[:-2], ({own})[2:]))"


_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in license_scan.TEMPLATES.items())

LICENSES = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT r, unnest(string_split(text, chr(10))) AS unit, 1 AS line FROM t
  UNION ALL SELECT r, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')), 0 FROM t
  UNION ALL SELECT r, text, 0 FROM t
),
b AS (SELECT row_number() OVER () AS i, r, line, {_bigrams('unit')} AS bi FROM u),
l AS (SELECT name, {_bigrams('words')} AS bi FROM (VALUES {_TEMPLATES}) AS v(name, words)),
m AS (
  SELECT i, r, line, name, 2.0 * len(list_intersect(b.bi, l.bi)) / (len(b.bi) + len(l.bi)) AS dice
  FROM b JOIN l ON len(b.bi) BETWEEN 0.5 * len(l.bi) AND 2 * len(l.bi)
),
h AS (SELECT * FROM m WHERE dice >= {license_scan.MIN_DICE}),
s AS (
  SELECT r, first(name ORDER BY dice DESC, name) AS license, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
    count(DISTINCT i) FILTER (line = 1) AS n_lines FROM h GROUP BY r
)
SELECT doc_id, license, CAST(dice AS DOUBLE) AS dice, coalesce(licenses, '') AS licenses, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
FROM t LEFT JOIN s USING (r)
"""


SOURCE_AUDIT = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {source_audit.MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(t.total), 0)::HUGEINT AS total, coalesce(any_value(v.v), 0)::HUGEINT AS v
  FROM d LEFT JOIN t USING (lang, source) LEFT JOIN v ON v.lang = d.lang GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS p,
    1 + 1000000000 * (k.n + 2) // (v.total + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o
WHERE part = 'pair' OR rank <= {source_audit.TOP_TERMS}
"""
