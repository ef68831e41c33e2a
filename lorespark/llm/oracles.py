"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from .chat import END, SEP, START
from .common import LOWER, UPPER
from .decontaminate import WIDTH
from .quality_rules import SPREAD, TOP, TWO_SIDED

_SAID = "<|im_end|><|im_start|>assistant ok"
_esc = "replace(replace({0}, '&', '&amp;'), '<|', '&lt;|')".format
_O = "ORDER BY turn, role, text"
OP5 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id {_O}) AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_O})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_O}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_esc('text')}) + CASE WHEN before = role THEN {len(SEP)} ELSE {len(START) + len(END) + 2} + length(replace({_esc('role')}, chr(10), '&nl;')) END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM
  (SELECT item_id, w, least(len(w), {WIDTH}) AS n, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN p ON p.n = dw.n AND p.phrase = dw.phrase),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_MEASURES = {"m_symbols": "1000 * n_symbols // greatest(word_chars, 1)", "m_repeat": "1000 * n_repeat_words // greatest(n_words, 1)", "m_dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)", "m_upper": "1000 * n_upper // greatest(word_chars, 1)", "m_word_len": "10 * word_chars // greatest(n_words, 1)"}


def _fences(keys: str) -> str:
    """The bounds of each key, a struct f of docs and of every measure's low and high bound."""
    on = f"{keys}, " if keys else ""
    by = f"PARTITION BY {on}measure"
    bounds = ", ".join(f"max(q3 + 3 * greatest(q3 - q1, {s})) FILTER (measure = '{m}') AS hi_{m}" for m, s in SPREAD.items())
    bounds += "".join(f", max(q1 - 3 * greatest(q3 - q1, {SPREAD[m]})) FILTER (measure = '{m}') AS lo_{m}" for m in TWO_SIDED)
    return (
        f"SELECT {on}max(docs) AS docs, {bounds} FROM (SELECT {on}measure, min(value) FILTER (4 * cum >= docs) AS q1, min(value) FILTER (4 * cum >= 3 * docs) AS q3, max(docs) AS docs FROM "
        f"(SELECT *, sum(n) OVER ({by} ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER ({by}) AS docs FROM (SELECT {on}measure, value, sum(n) AS n FROM hist GROUP BY {on}measure, value)) GROUP BY {on}measure){f' GROUP BY {keys}' if keys else ''}"
    )


_BOUNDS = [f"hi_{m}" for m in SPREAD] + [f"lo_{m}" for m in TWO_SIDED]
_OUT = " OR ".join([f"coalesce({m} > hi_{m}, false)" for m in SPREAD] + [f"coalesce({m} < lo_{m}, false)" for m in TWO_SIDED])
OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS l, coalesce(source, '') AS s, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
tri AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM tri) WHERE times > 1) GROUP BY 1),
st AS (SELECT doc_id, l, s, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, {', '.join(f'CAST(least({TOP}, {e}) AS INT) AS {k}' for k, e in _MEASURES.items())}, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM st),
hist AS ({' UNION ALL '.join(f"SELECT l, s, '{k}' AS measure, {k} AS value, count(*) AS n FROM m WHERE NOT base_failed GROUP BY l, s, {k}" for k in SPREAD)}),
own AS ({_fences('l, s')}), lang AS ({_fences('l')}), every AS ({_fences('')}),
lim AS (SELECT own.l, own.s, {', '.join(f'CASE WHEN own.docs >= 50 THEN own.{b} WHEN lang.docs >= 50 THEN lang.{b} WHEN every.docs >= 50 THEN every.{b} END AS {b}' for b in _BOUNDS)} FROM own JOIN lang USING (l), every)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_OUT}) AS kept, {', '.join(SPREAD)} FROM m LEFT JOIN lim USING (l, s)
"""

_KW = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"({_KW})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _spans(kind: str, order: int, pattern: str, value: str, least: int, measure: str) -> str:
    """The matches of a pattern with their places, from the texts between and the matches themselves."""
    return (
        f"SELECT doc_id, source, lang, '{kind}' AS kind, {order} AS ord, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v FROM (SELECT *, "
        "sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM ("
        f"SELECT doc_id, source, lang, i, ms[i] AS m, gaps[i] AS gap, vs[i] AS v FROM (SELECT doc_id, source, lang, ms, gaps, vs, unnest(range(1, len(ms) + 1)) AS i FROM ("
        f"SELECT doc_id, source, lang, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', {value}) AS vs FROM x)))) WHERE length({measure}) >= {least}"
    )


_TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
OP1 = f"""
WITH x AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
base AS ({_spans('assign', 0, _ASSIGN, '2', 8, 'v')} UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+', '0', 16, 'm')} UNION ALL {_spans('hex', 2, '[0-9a-f]+', '0', 32, 'm')}),
tok AS ({_spans('live', 3, _TOKEN, '0', 20, 'm')}),
live AS (SELECT * FROM tok t WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND len(list_distinct(string_split(v, ''))) >= 12
  AND NOT regexp_matches(v, '(?i)example|sample|placeholder|changeme|your|xxxx|1234567|abcdef') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.s < t.e AND t.s < b.e)),
al AS (SELECT * FROM base UNION ALL SELECT * FROM live),
own AS (SELECT v, count(DISTINCT source) > 1 OR count(DISTINCT (source, lang)) > 3 AS copied FROM al GROUP BY 1),
j AS (SELECT * FROM al JOIN own USING (v) WHERE kind <> 'live' OR NOT copied),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3), '')) AS base_sha256, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
  count(*) FILTER (NOT copied) AS n_owned, count(*) FILTER (copied) AS n_copied FROM j GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied FROM x LEFT JOIN g USING (doc_id)
"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT k, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS w FROM benchmark)),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM c) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p WHERE t IN (SELECT t FROM q) GROUP BY t),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * (SELECT n_docs FROM c)) // (SELECT n_terms FROM c) AS m FROM d WHERE len(w) > 0),
s AS (SELECT k, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN wt USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""

_STEP = "substr(filter_order, step, 1)"
_BIT = "(1 << (ascii({0}) - 65))".format
OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY 1),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, {_BIT(_STEP)} AS own, list_sum(list_transform(string_split(substr(filter_order, 1, step), ''), lambda y: {_BIT('y')})) - {_BIT(_STEP)} AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, own,
  CAST(sum(n) FILTER (mask & (before + own) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & own != 0 AND mask & before = 0) AS BIGINT) AS removed,
  CAST(sum(n) FILTER (mask & own != 0 AND mask & before != 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (mask = own) AS BIGINT) AS unique_fails,
  CAST(sum(good) FILTER (mask & own != 0 AND mask & before = 0) AS BIGINT) AS good_lost, CAST(sum(bad) FILTER (mask & own != 0 AND mask & before = 0) AS BIGINT) AS toxic_lost
  FROM (SELECT filter_order, step, own, CAST(before AS BIGINT) AS before FROM s), n GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

ORACLES = {"op1_secrets": OP1, "op5_chat": OP5, "op7_decontamination": OP7, "op10_quality_rules": OP10, "op11_lexical_search": OP11, "op12_filter_audit": OP12}
