"""DuckDB SQL for the opN_ queries that SQL can express."""

from __future__ import annotations

from fragloom.llm import chat as c
from fragloom.llm import host_reputation as h
from fragloom.llm import quality_rules as q
from fragloom.llm.queries import HOSTILE, URL_RULES

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP7 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""

OP10 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_WS}), {_UP}, {_LOW}) AS key FROM l),
d AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, d.last IS NOT NULL AND k.doc_id <> d.last AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _op1() -> str:
    tests = " UNION ALL ".join(
        f"SELECT stratum, '{name}' AS rule, c.cutoff AS cutoff, count(*) AS n, count(*) FILTER (WHERE 100 * {num} > c.cutoff * {den}) AS k FROM good, (SELECT unnest({list(q.CUTOFFS)}) AS cutoff) c GROUP BY ALL"
        for name, num, den in q.RULES
    )
    over = " OR ".join(f"(v.rule = '{name}' AND 100 * b.{num} > v.cutoff * b.{den})" for name, num, den in q.RULES)
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS ws FROM t),
tri AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM tri),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS m FROM win) WHERE m > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t),
dl AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE trim(line, {_WS}) <> '' GROUP BY doc_id),
m AS (
  SELECT t.doc_id, coalesce('=' || t.lang, '') AS stratum, len(w.ws) AS n_words, length(array_to_string(w.ws, '')) AS word_chars,
         length(t.x) - length(regexp_replace(t.x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t.x) - length(regexp_replace(t.x, '[A-Z]', '', 'g')) AS n_upper,
         coalesce(dl.n_dup_lines, 0) AS n_dup_lines, coalesce(dl.n_lines, 0) AS n_lines, coalesce(cov.n_repeat_words, 0) AS n_repeat_words
  FROM t JOIN w ON t.doc_id = w.doc_id LEFT JOIN dl ON t.doc_id = dl.doc_id LEFT JOIN cov ON t.doc_id = cov.doc_id),
b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
good AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
trial AS ({tests}),
strata AS (SELECT count(DISTINCT stratum) * {len(q.RULES)} AS family FROM good),
p AS (SELECT stratum, rule, cutoff, n, k, k < n * {q.ALPHA} AND (
        SELECT sum(exp(lgamma(n + 1) - coalesce(lgamma(i + 1), 0) - lgamma(n - i + 1) + i * ln({q.ALPHA}) + (n - i) * ln(1 - {q.ALPHA})))
        FROM (SELECT unnest(range(0, k + 1)) AS i)) <= {q.DELTA} / family AS ok
      FROM trial, strata),
v AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM (
        SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS pass FROM p) WHERE pass GROUP BY ALL),
r AS (SELECT DISTINCT b.doc_id FROM b JOIN v ON b.stratum = v.stratum AND ({over}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM r) AS kept
FROM b
"""


def _op4() -> str:
    """The same counts and priors, level by level; the tails are the power series of the incomplete beta function."""
    at = h.MAX_BAD
    shrink = lambda k: f"(bad + {k} * mean) / (n + {k})"
    low, high = h.STRENGTH
    moment = (
        "SELECT least(greatest(CASE WHEN coalesce(base, 0) <> 0 AND over / base > 0 THEN base / over - 1 ELSE {1} END, {0}), {1}) AS k FROM "
        "(SELECT sum((bad - n * mean) ** 2 - n * mean * (1 - mean)) AS over, sum(n * (n - 1.0) * mean * (1 - mean)) AS base FROM {2})"
    ).format
    long = ", ".join(f"'{x}'" for x in h.LONG_SUFFIXES)
    last = lambda k: f"array_to_string(list_slice(string_split(host, '.'), -{k}, -1), '.')"
    rules = sorted(URL_RULES, key=lambda r: (-len(r), r))
    parts = [(r, *r.partition("/")[::2]) for r in rules]
    rule = "CASE " + " ".join(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '/{prefix}') THEN '{r}'" for r, of, prefix in parts) + " END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{URL_RULES[r]}'" for r in rules) + " END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {_UP}, {_LOW}) AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(l.bad) AS n, coalesce(sum(l.bad), 0) AS bad FROM u LEFT JOIN l ON u.page_id = l.page_id WHERE host <> '' GROUP BY host),
h1 AS (SELECT *, regexp_matches(host, '^[0-9.:\\[\\]]+$') AS addr, CASE WHEN {last(2)} IN ({long}) THEN 2 ELSE 1 END AS w, len(string_split(host, '.')) AS parts FROM h0),
h2 AS (SELECT host, n, bad, CASE WHEN addr THEN '' WHEN w = 2 THEN {last(2)} ELSE {last(1)} END AS suffix,
              CASE WHEN addr OR parts <= w THEN host WHEN w = 2 THEN {last(3)} ELSE {last(2)} END AS domain FROM h1),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h2 GROUP BY suffix, domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY suffix),
s1 AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM s0) AS mean FROM s0),
ks AS ({moment(low, high, "s1")}),
s2 AS (SELECT suffix, {shrink("k")} AS mean FROM s1, ks),
d1 AS (SELECT d0.*, s2.mean FROM d0 JOIN s2 ON d0.suffix = s2.suffix),
kd AS ({moment(low, high, "d1")}),
d2 AS (SELECT suffix, domain, {shrink("k")} AS mean FROM d1, kd),
h3 AS (SELECT h2.*, d2.mean FROM h2 JOIN d2 ON h2.suffix = d2.suffix AND h2.domain = d2.domain),
kh AS ({moment(low, high, "h3")}),
h4 AS (SELECT host, bad + k * mean AS a, n - bad + k * (1 - mean) AS b FROM h3, kh),
h5 AS (SELECT *, lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln({at}) + b * ln(1 - {at}) - ln(a) AS front FROM h4),
g AS (SELECT host, a, b, front, unnest(range((4 * (a + b) + 400)::BIGINT)) AS i FROM h5),
bad AS (SELECT host FROM g GROUP BY host
        HAVING 1 - sum(exp(front + lgamma(a + b + i) - lgamma(a + b) - lgamma(a + 1 + i) + lgamma(a + 1) + i * ln({at}))) >= {h.CONFIDENCE}),
v AS (SELECT *, {rule} AS rule FROM u)
SELECT page_id, host, path, rule, coalesce({said}, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""


def _op6() -> str:
    other = sum(map(len, (c.ROLE, c.TEXT, c.END)))
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in c.TURNS.items())
    escaped = lambda x: f"length({x}) + length(regexp_replace({x}, '[^\\\\\\\\<\\[]', '', 'g'))"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
             {escaped("text")} + CASE role {marks} ELSE {other} + {escaped("role")} END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{c.LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = '{c.LOSS_ROLE}'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_UP}, {_LOW}) AS x FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN v ON t.lang = v.lang AND t.term = v.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, v.term, v.c, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p,
             1 + (1000000000::HUGEINT * (v.c + 2)) // (l.n + 2 * l.v) AS q
      FROM g JOIN l ON g.lang = l.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""


OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, e.vec_id, e.label, list_dot_product(a.x, e.x)::BIGINT AS score FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT * FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1(), "op4_url_filters": _op4(), "op6_chat_formatting": _op6(), "op7_exact_dedup": OP7, "op10_line_dedup": OP10, "op11_source_divergence": OP11, "op12_hard_negatives": OP12}
