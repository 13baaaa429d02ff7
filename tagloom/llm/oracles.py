"""DuckDB SQL of the queries that SQL can say whole: URL filters, n-gram join, reply trees, quality rules, decontamination, vector codes, divergence."""

from __future__ import annotations

from . import divergence, quality, reply_trees, url_filters, vector_codes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, between: str, lower: bool) -> str:
    """The list of a text's words."""
    t = f"coalesce({text}, '')"
    t = f"translate({t}, '{UPPER}', '{LOWER}')" if lower else t
    return f"list_filter(string_split_regex({t}, '{between}'), lambda x: x <> '')"


LETTERS, SPACES = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x20\x09-\x0D]+"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filters.RULES)

URLS = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fit AS (
  SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS nth
  FROM split s LEFT JOIN rules r
    ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE nth = 1
"""

NGRAMS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", SPACES, True)} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
-- one document of each set, so that copies are not paired
digest AS (SELECT doc_id, n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM sets JOIN sizes USING (doc_id) GROUP BY doc_id, n),
rep AS (SELECT h, n, min(doc_id) AS rep FROM digest GROUP BY h, n),
one AS (SELECT s.* FROM sets s JOIN rep ON s.doc_id = rep.rep),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM one a JOIN one b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT rep, rep FROM rep UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
component AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(g.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN digest g ON g.doc_id = d.doc_id LEFT JOIN rep ON rep.h = g.h AND rep.n = g.n LEFT JOIN component c ON c.x = rep.rep
WHERE d.doc_id IS NOT NULL
"""

_SAID = "</s>[INST] ok [/INST]"
CHAT = rf"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')),
formed AS (
  SELECT *, length('{reply_trees.BEGIN}') + length(url_encode(role)) + 1 + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length('{reply_trees.END}') AS chars FROM every)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM formed GROUP BY conv_id
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, {_words("text", SPACES, False)} AS w FROM documents),
n AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
-- words in windows of three that a text holds twice
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
f AS (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM n LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEATED_PERCENT} * n_words AS base_failed FROM f),
r AS (SELECT *, base_failed OR 100 * n_symbols > {quality.SYMBOLS_PERCENT} * word_chars OR 100 * n_dup_lines > {quality.DUP_LINES_PERCENT} * n_lines AS rule_failed FROM b),
hosts AS (SELECT host, count(*) AS n, CAST(sum(CASE WHEN rule_failed THEN 1 ELSE 0 END) AS DOUBLE) AS k FROM r GROUP BY host),
m AS (SELECT avg(k / n) AS mean, var_pop(k / n) AS var FROM hosts),
prior AS (SELECT mean, CASE WHEN var > 0 AND var < mean * (1 - mean) THEN mean * (1 - mean) / var - 1 ELSE 2.0e0 END AS size FROM m),
rates AS (SELECT host, (k + mean * size) / (n + size) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT rule_failed AND host_rate < {quality.HOST_RATE} AS kept, rule_failed, round(host_rate, 9) AS host_rate
FROM r JOIN rates ON rates.host IS NOT DISTINCT FROM r.host
"""

LEAKS = f"""
WITH d AS (SELECT doc_id, {_words("text", LETTERS, True)} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words("text", LETTERS, True)} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, len(s) AS n, array_to_string(s, ' ') AS s FROM (SELECT item_id, unnest([w[k:k + 9] for k in range(1, greatest(1, len(w) - 9) + 1)]) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN lens)),
hits AS (SELECT doc_id, k, p.n, item_id FROM places p JOIN wins v ON v.s = p.s AND v.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _codes() -> str:
    """Assignments and means, a CTE each, as recursion allows no aggregates."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    ctes = [f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, vec_id, k AS part, v[k * len(v) // {parts} + 1:(k + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(k)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {entries})),
book0 AS MATERIALIZED (SELECT part, e, min(x) AS c FROM cut JOIN first USING (vec_id) GROUP BY part, e)"""]
    for n in range(vector_codes.ROUNDS + 1):
        ctes.append(f"""
far{n} AS MATERIALIZED (
  SELECT r, part, min((d, e)) AS best FROM (
    SELECT r, part, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut JOIN book{n} USING (part))
  GROUP BY r, part)""")
        if n < vector_codes.ROUNDS:
            ctes.append(f"""
mean{n} AS (
  SELECT part, e, list(c ORDER BY i) AS c FROM (
    SELECT part, f.best[2] AS e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS c
    FROM cut JOIN far{n} f USING (r, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY part, f.best[2], i)
  GROUP BY part, e),
book{n + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} m USING (part, e))""")
    last = vector_codes.ROUNDS
    return f"""WITH {",".join(ctes)},
coded AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM far{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM book{last}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SHARE = "1 + (1000000000 * (CAST({0} AS HUGEINT) + 2)) // ({1} + 2 * V)"
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_words("text", _TERMS, True)} AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS V, sum(n) AS NL FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(group_n, 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS group_n FROM c GROUP BY ALL) USING (lang, source)),
-- every group with every kept word of its language
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format("coalesce(c.n, 0)", "group_n")} AS p, {_SHARE.format("k.n", "NL")} AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

ORACLE_SQL = {
    "op5_ngram_join": NGRAMS, "op7_reply_trees": CHAT, "op8_host_rules": QUALITY, "op9_decontaminate": LEAKS, "op10_url_filter": URLS,
    "op11_vector_codes": _codes(), "op13_divergence": DIVERGENCE,
}
