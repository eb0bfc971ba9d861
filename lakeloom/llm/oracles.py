"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import SEED, TEMPER
from .quality import LEVELS, METRICS, MIN_GROUP

SPACE = r"[^\x20\x09-\x0D]+"
BENCH = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{BENCH}') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, regexp_extract_all({LOWER}, '{BENCH}') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS t FROM b, unnest(range(1, len(w) - size + 2)) u(i)),
g AS (SELECT doc_id, i AS start, size, array_to_string(w[i : i + size - 1], ' ') AS t FROM d, (SELECT DISTINCT size FROM win) s, unnest(range(1, len(w) - size + 2)) u(i)),
h AS (SELECT doc_id, start, g.size, item_id FROM g JOIN win ON g.t = win.t AND g.size = win.size),
hit AS (SELECT doc_id, count(DISTINCT start + k) AS n_hit FROM h, unnest(range(0, size)) v(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def quality_sql() -> str:
    ratio = lambda a, b: f"(1000 * {a}) // greatest({b}, 1)"
    values = {"symbols": ratio("n_symbols", "word_chars"), "repeats": ratio("n_repeat_words", "n_words"), "dup_lines": ratio("n_dup_lines", "n_lines"), "word_length": ratio("word_chars", "n_words")}
    union = " UNION ALL ".join(f"SELECT la, so, '{m}' AS metric, {v} AS x FROM c WHERE NOT base_failed" for m, v in values.items())
    bucket = lambda x: f"(({x}) >> greatest(length(bin({x})) - 8, 0)) << greatest(length(bin({x})) - 8, 0)"
    at = ", ".join(f"min(bucket) FILTER (100 * cum >= {p} * total) AS q{p}" for p in LEVELS)
    levels = lambda by: f"SELECT {by}metric, max(total) AS total, {at} FROM (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {by}metric) AS total FROM (SELECT {by}metric, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL"
    picked = ", ".join(f"CASE WHEN a.total >= {MIN_GROUP} THEN a.q{p} WHEN b.total >= {MIN_GROUP} THEN b.q{p} ELSE e.q{p} END AS q{p}" for p in LEVELS)
    inside = []
    for m, (high, low, reach) in METRICS.items():
        for p, sign in ((high, "<="), (low, ">=")):
            if p is not None:
                inside.append(f"coalesce({bucket(values[m])} {sign} (SELECT q{p} + {reach} * (q{p} - q50) FROM f WHERE f.la = c.la AND f.so = c.so AND metric = '{m}'), true)")
    return rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, 'null') AS la, coalesce('=' || source, 'null') AS so, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{SPACE}')) AS ls FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM d, unnest(range(1, len(w) - 1)) u(i)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g), (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
  SELECT doc_id, la, so, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
   CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id))),
sk AS (SELECT la, so, metric, {bucket('x')} AS bucket, count(*) AS n FROM ({union}) GROUP BY ALL),
f AS (SELECT k.la, k.so, k.metric, {picked} FROM (SELECT DISTINCT la, so, metric FROM sk) k JOIN ({levels('la, so, ')}) a USING (la, so, metric) JOIN ({levels('la, ')}) b USING (la, metric) JOIN ({levels('')}) e USING (metric))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(inside)} AS kept FROM c"""


def mixing_sql() -> str:
    dims = ("so", "la", "topic")
    target = lambda d: f"(SELECT {d}, pow(sum(tokens), {TEMPER}) * (SELECT sum(t) / sum(pow(t, {TEMPER})) FROM (SELECT sum(tokens) AS t FROM cells GROUP BY {d})) AS t_{d} FROM cells GROUP BY {d})"
    parts = ["w0 AS (SELECT so, la, topic, tokens, CAST(tokens AS DOUBLE) AS w, t_so, t_la, t_topic FROM cells JOIN " + " JOIN ".join(f"{target(d)} USING ({d})" for d in dims) + ")"]
    n = 0
    for _ in range(12):  # as good as converged
        for d in dims:
            parts.append(f"w{n + 1} AS (SELECT * REPLACE (w * t_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM w{n})")
            n += 1
    return rf"""
WITH c AS (SELECT doc_id, text, so, la, n_tokens, CASE WHEN contains(text, '|') THEN 'table' WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM (
  SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, 'null') AS so, coalesce('=' || lang, 'null') AS la, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACE}')) AS BIGINT) AS n_tokens FROM documents)),
cells AS (SELECT so, la, topic, CAST(sum(greatest(n_tokens, 1)) AS BIGINT) AS tokens FROM c GROUP BY ALL), {', '.join(parts)},
z AS (SELECT so, la, topic, w / tokens AS ratio, max(w / tokens) OVER () AS top, sum(w) OVER () / sum(tokens) OVER () AS total FROM w{n})
SELECT doc_id, n_tokens, topic, round(ratio / total, 6) AS weight, round(ratio / top, 6) AS keep_prob, ('0x' || substr(md5('{SEED}' || doc_id || ':' || md5(text)), 1, 13))::BIGINT / 4503599627370496.0 < ratio / top AS kept FROM c JOIN z USING (so, la, topic)"""


OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS m FROM p),
s AS (SELECT *, unhex(h)::BIT::VARCHAR AS bits FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0b' || substr(bits, CAST(i * 5 + 1 AS BIGINT), 5))::BIGINT + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM s"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACE}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
l AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL) WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m AS component_id FROM s JOIN (SELECT doc_id, min(reach) AS m FROM r GROUP BY doc_id) USING (doc_id)"""

ORACLES = {"op2_decontamination": OP2, "op3_quality_rules": quality_sql(), "op6_mixing": mixing_sql(), "op9_warc": OP9, "op10_jaccard_join": OP10}
