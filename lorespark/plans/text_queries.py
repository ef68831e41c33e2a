"""Queries of projections, predicates and scalar functions over documents and questions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark import constants as K
from lorespark.functions import paths, text
from lorespark.operators import classify
from lorespark.plans import standins as S
from lorespark.plans.registry import query

# ---- paths -----------------------------------------------------------------------------------------------------------

#: Paths with parts and names that the rules are about, made from documents
_ODD = ["/src/", "/out/", "/.git/", "/node_modules/x/", "/a/build/", "/lib/"]
_NAMES = [".py", ".pyc", ".min.js", ".pem", ".tar.gz", "", ".lock", ".png"]
_PATHS = "odd AS (SELECT node_id, source || " + S.pick_sql("node_id % 6", _ODD) + " || 'f' || node_id || " + S.pick_sql("(node_id // 6) % 8", _NAMES) + " AS path FROM docs)"


def odd(spark, sf):
    at = lambda i, v: F.element_at(F.array(*map(F.lit, v)), (i + 1).cast("int"))
    n = F.col("node_id")
    path = F.concat("source", at(n % 6, _ODD), F.lit("f"), n.cast("string"), at(F.floor(n / 6) % 8, _NAMES))
    return S.docs(spark, sf).select("node_id", path.alias("path"))


def _glob(column: str, pattern: str) -> str:
    return f"{column} GLOB '{pattern}'"


_BASE = "regexp_extract(path, '[^/]*$')"
_PLAIN = " OR ".join(f"contains(path, '{p}')" for p in K.EXCLUDE_PATTERNS if "*" not in p)
_STARS = " OR ".join(_glob(_BASE, p) for p in K.EXCLUDE_PATTERNS if "*" in p)
_ANY = " OR ".join(f"contains(path, '{p}') OR {_glob(_BASE, p)}" for p in K.EXCLUDE_PATTERNS)
_part = lambda names: f"list_has_any(string_split(path, '/'), {names!r})"


@query("b01_path_exclusion", S.sql("docs", f"SELECT node_id, path, ({_PLAIN} OR {_STARS}) AS excluded FROM odd", _PATHS))
def b01(spark, sf):
    return odd(spark, sf).select("node_id", "path", paths.excluded(F.col("path")).alias("excluded"))


@query("b02_graph_exclusion", S.sql("docs", f"SELECT node_id, path FROM odd WHERE NOT ({_part(K.GRAPH_EXCLUDE_DIRS)} OR {_PLAIN} OR {_STARS})", _PATHS))
def b02(spark, sf):
    return odd(spark, sf).filter(~paths.graph_excluded(F.col("path")))


@query("b03_watch_exclusion", S.sql("docs", f"SELECT node_id, path FROM odd WHERE NOT ({_part(K.WATCH_EXCLUDE_DIRS)} OR {_ANY})", _PATHS))
def b03(spark, sf):
    return odd(spark, sf).filter(~paths.watch_excluded(F.col("path")))


@query("b04_agent_exclusion", S.sql("docs", "SELECT node_id, path FROM odd WHERE NOT (path GLOB '*.py' OR path GLOB 'src1*x*' OR len(list_filter(string_split(path, '/'), lambda p: p GLOB '*.py' OR p GLOB 'src1*x*' OR p GLOB 'build')) > 0)", _PATHS))
def b04(spark, sf):
    return odd(spark, sf).filter(~paths.agent_excluded(F.col("path"), ["*.py", "src1*x*", "build"]))


_EXT = "regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)"
_LANG = S.case(f"'.' || lower({_EXT})", K.EXTENSION_LANGUAGE)


@query("b05_language_filter", S.sql("docs", f"SELECT node_id, {_LANG} AS language FROM (SELECT node_id, file_path AS path FROM docs) WHERE {_LANG} IS NOT NULL"))
def b05(spark, sf):
    return S.docs(spark, sf).select("node_id", paths.language(F.col("file_path")).alias("language")).filter("language is not null")


@query("b06_size_filter", S.sql("docs", "SELECT node_id, CASE WHEN file_size <= 5000 THEN sha256(text) END AS sha256 FROM docs"))
def b06(spark, sf):
    return S.docs(spark, sf).select("node_id", F.when(F.col("file_size") <= 5000, F.sha2("text", 256)).alias("sha256"))


_RX = [p.replace("'", "''") for p in K.SENSITIVE]
_SENSITIVE = " OR ".join(f"regexp_matches(text, '{p}')" for p in _RX)
_REDACTED = "text"
for _p in _RX:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p}', '[REDACTED]', 'g')"


@query("b07_sensitive_text", S.sql("docs", f"SELECT node_id, ({_SENSITIVE}) AS sensitive FROM docs"))
def b07(spark, sf):
    return S.docs(spark, sf).select("node_id", text.is_sensitive(F.col("text")).alias("sensitive"))


@query("h02_redact", S.sql("docs", f"SELECT node_id, sha256({_REDACTED}) AS redacted FROM docs"))
def h02(spark, sf):
    return S.docs(spark, sf).select("node_id", F.sha2(text.redact(F.col("text")), 256).alias("redacted"))


@query("b08_blocked_names", S.sql("docs", "SELECT node_id, path, (lower(regexp_extract(path, '[^/]*$')) IN (" + ", ".join(map(repr, K.BLOCKED_NAMES)) + ") OR ends_with(lower(path), '.pem')) AS blocked FROM odd", _PATHS))
def b08(spark, sf):
    return odd(spark, sf).select("node_id", "path", paths.blocked(F.col("path")).alias("blocked"))


_PY = ["if", "is", "in", "or", "and", "for", "from", "with", "as", "not"]
_WORD = "word AS (SELECT node_id, string_split(text, ' ')[2] AS name FROM docs WHERE len(string_split(text, ' ')) > 1)"


@query("b09_identifier_validity", S.sql("docs", f"SELECT node_id, name, (length(name) BETWEEN 2 AND 128 AND regexp_matches(name, '^[a-zA-Z_$][a-zA-Z0-9_$.:]*$') AND name NOT IN ({', '.join(map(repr, _PY))})) AS valid FROM word", _WORD))
def b09(spark, sf):
    w = S.docs(spark, sf).select("node_id", F.get(F.split("text", " "), F.lit(1)).alias("name")).filter("name is not null")
    return w.select("node_id", "name", paths.valid_identifier(F.col("name"), _PY).alias("valid"))


@query("b26_is_code", S.sql("docs", f"SELECT node_id, CASE WHEN {_EXT} IN ({', '.join(map(repr, K.CODE_EXTENSIONS))}) THEN 'code' ELSE 'document' END AS node_type FROM (SELECT node_id, file_path AS path FROM docs)"))
def b26(spark, sf):
    return S.docs(spark, sf).select("node_id", paths.is_code(F.col("file_path")).alias("node_type"))


@query("h17_path_parts", S.sql("docs", f"SELECT node_id, {_BASE} AS base, regexp_replace({_BASE}, '^(.+)\\.[^.]*$', '\\1') AS stem, {_EXT} AS ext FROM odd", _PATHS))
def h17(spark, sf):
    p = F.col("path")
    return odd(spark, sf).select("node_id", paths.basename(p).alias("base"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"))


@query("h18_path_suffixes", S.sql("docs", "SELECT node_id, array_to_string(p[i:], '/') AS suffix FROM (SELECT node_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT node_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM odd))", _PATHS))
def h18(spark, sf):
    return odd(spark, sf).select("node_id", F.explode(paths.suffixes(F.col("path"))).alias("suffix"))


@query("h19_lookup_candidates", S.sql("docs", (
    "SELECT node_id, CAST(i - 1 AS INT) AS ord, c[i] AS candidate FROM (SELECT node_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT node_id, [path, base, stem] || "
    "CASE WHEN ext IN ('py', '') THEN [path || '.py', replace(path, '.', '/') || '.py', stem || '.py'] ELSE [] END || CASE WHEN ext IN ('rs', '') THEN [path || '.rs', stem || '.rs'] ELSE [] END AS c "
    f"FROM (SELECT node_id, path, {_BASE} AS base, regexp_replace({_BASE}, '^(.+)\\.[^.]*$', '\\1') AS stem, {_EXT} AS ext FROM odd)))"
), _PATHS))
def h19(spark, sf):
    return odd(spark, sf).select("node_id", F.posexplode(paths.lookup_candidates(F.col("path"))).alias("ord", "candidate"))


@query("h23_slugs", S.sql("docs", "SELECT node_id, replace(replace(lower(name), '/', '-'), ' ', '-') AS library, left(replace(lower(topic), ' ', '-'), 50) AS topic FROM (SELECT node_id, 'Lib/' || source || ' X' AS name, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS topic FROM docs)"))
def h23(spark, sf):
    d = S.docs(spark, sf).select("node_id", F.concat(F.lit("Lib/"), "source", F.lit(" X")).alias("name"), F.regexp_replace("text", "[^a-zA-Z ]", "").alias("topic"))
    return d.select("node_id", text.slug(F.col("name")).alias("library"), text.slug(F.col("topic"), 50).alias("topic"))


@query("h25_glob_match", S.sql("docs", f"SELECT node_id, {_BASE} GLOB 'f?*.p[yn]*' AS fits FROM odd", _PATHS))
def h25(spark, sf):
    return odd(spark, sf).select("node_id", paths.glob_match(paths.basename(F.col("path")), "f?*.p[yn]*").alias("fits"))


# ---- texts -----------------------------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(query), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '" + K.FILLER + "', ' ', 'g'), '\\s+', ' ', 'g'), '\\s*([.,;:!?])\\s*', '\\1', 'g'), '" + K.TRIM_CHARS.replace("'", "''") + "')"


@query("h01_normalize_query", S.sql("queries", f"SELECT query_id, {_NORM} AS normalized FROM queries"))
def h01(spark, sf):
    return S.queries(spark, sf).select("query_id", text.normalize_query(F.col("query")).alias("normalized"))


@query("h03_snippet", S.sql("docs", "SELECT node_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS snippet FROM docs"))
def h03(spark, sf):
    return S.docs(spark, sf).select("node_id", text.snippet(F.col("text")).alias("snippet"))


@query("h04_context_truncation", S.sql("docs", "SELECT node_id, left(text, 2500 * 4 // 5 // 2) AS chunk FROM docs"))
def h04(spark, sf):
    return S.docs(spark, sf).select("node_id", F.left("text", F.lit(text.context_chars(2500, 5))).alias("chunk"))


_FRESH = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (node_id % 300)::DOUBLE / 168.0::DOUBLE))"


@query("h05_prompt_chunk", S.sql("docs", f"SELECT node_id, '[' || file_name || ' (' || CASE WHEN f > 0.7 THEN 'fresh' WHEN f > 0.3 THEN 'recent' ELSE 'stale' END || ', score=' || printf('%.2f', (node_id % 100)::DOUBLE / 100) || ')]' || chr(10) || text AS chunk FROM (SELECT *, {_FRESH} AS f FROM docs)"))
def h05(spark, sf):
    n = F.col("node_id")
    return S.docs(spark, sf).select("node_id", text.prompt_chunk(F.col("file_name"), (n % 100).cast("double") / 100, text.freshness((n % 300).cast("double")), F.col("text")).alias("chunk"))


@query("h06_freshness", S.sql("docs", f"SELECT node_id, CASE WHEN node_id % 13 = 0 THEN 0.5::DOUBLE ELSE {_FRESH} END AS freshness FROM docs"))
def h06(spark, sf):
    n = F.col("node_id")
    return S.docs(spark, sf).select("node_id", text.freshness(F.when(n % 13 != 0, (n % 300).cast("double"))).alias("freshness"))


@query("h08_sha256", S.sql("docs", "SELECT node_id, sha256(text) AS sha256 FROM docs"))
def h08(spark, sf):
    return S.docs(spark, sf).select("node_id", F.sha2("text", 256).alias("sha256"))


@query("h09_cache_key", S.sql("queries", "SELECT query_id, left(sha256('search:' || query || ':{\"top_k\": 5}'), 16) AS key FROM queries"))
def h09(spark, sf):
    return S.queries(spark, sf).select("query_id", text.cache_key(F.lit("search"), F.col("query"), F.lit(5)).alias("key"))


@query("h10_exact_key", S.sql("queries", "SELECT query_id, left(sha256(query || ':5'), 16) AS key FROM queries"))
def h10(spark, sf):
    return S.queries(spark, sf).select("query_id", text.exact_key(F.col("query"), F.lit(5)).alias("key"))


@query("h11_token_estimate", S.sql("docs", "SELECT node_id, length(text) / 4.0::DOUBLE AS tokens FROM docs"))
def h11(spark, sf):
    return S.docs(spark, sf).select("node_id", (F.length("text") / 4.0).alias("tokens"))


def _first(which: int) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(query), '{p}') THEN regexp_extract(lower(query), '{p}', {which}) END" for p in K.PAIR_PATTERNS) + ")"


@query("h26_structural_pair", S.sql("queries", f"SELECT query_id, {_first(1)} AS source, {_first(2)} AS target, CASE WHEN regexp_matches(lower(query), '{K.TOPIC_PATTERN}') THEN regexp_extract(lower(query), '{K.TOPIC_PATTERN}', 1) END AS topic FROM queries"))
def h26(spark, sf):
    q = F.col("query")
    return S.queries(spark, sf).select("query_id", text.pair(q, 1).alias("source"), text.pair(q, 2).alias("target"), text.topic(q).alias("topic"))


@query("h28_source_tags", "SELECT vec_id AS node_id, CASE WHEN label < 5 THEN '[YOUR CODE]' WHEN label < 8 THEN '[KIT' || label || ' SDK]' ELSE '[OTHER]' END AS tag FROM embeddings")
def h28(spark, sf):
    v = S.vectors(spark, sf)
    source = F.when(F.col("label") < 5, "local").when(F.col("label") < 8, F.concat(F.lit("shared:kit"), F.col("label").cast("string"))).otherwise("other")
    return v.select("node_id", text.source_tag(source).alias("tag"))


@query("h29_result_parser", S.sql("docs", "SELECT node_id, CAST(regexp_extract(b, '^\\[([0-9]+)\\]', 1) AS INT) AS pos, regexp_extract(b, '^\\[[0-9]+\\] (\\S+) \\(score:', 1) AS name FROM (SELECT node_id, unnest(string_split('[1] ' || file_name || ' (score: 0.5)' || chr(10) || 'x' || chr(10) || chr(10) || '[2] other.md (score: 0.4)' || chr(10) || 'y', chr(10) || chr(10))) AS b FROM docs)"))
def h29(spark, sf):
    said = F.concat(F.lit("[1] "), "file_name", F.lit(" (score: 0.5)\nx\n\n[2] other.md (score: 0.4)\ny"))
    b = S.docs(spark, sf).select("node_id", F.explode(F.split(said, "\n\n")).alias("b"))
    return b.select("node_id", F.regexp_extract("b", r"^\[([0-9]+)\]", 1).cast("int").alias("pos"), F.regexp_extract("b", r"^\[[0-9]+\] (\S+) \(score:", 1).alias("name"))


_ERR = ["401 Unauthorized", "Rate limit hit", "request timed out", "boom"]


@query("h31_error_class", S.sql("raw_fact", f"SELECT event_id, {S.pick_sql('event_id % 4', ['auth', 'rate_limit', 'timeout', 'unknown'])} AS error FROM raw_fact"))
def h31(spark, sf):
    said = F.element_at(F.array(*map(F.lit, _ERR)), (F.col("event_id") % 4 + 1).cast("int"))
    return S.fact(spark, sf).select("event_id", text.error_class(said).alias("error"))


@query("h33_toc_anchor", "SELECT n_name AS title, replace(replace(lower(n_name || '/' || n_regionkey || ' X'), ' ', '-'), '/', '-') AS anchor FROM nation")
def h33(spark, sf):
    n = S.read(spark, sf, "nation")
    return n.select(F.col("n_name").alias("title"), text.slug(F.concat("n_name", F.lit("/"), F.col("n_regionkey").cast("string"), F.lit(" X"))).alias("anchor"))


@query("h34_mask", S.sql("docs", "SELECT node_id, CASE WHEN node_id % 9 = 0 THEN '(none)' ELSE '***' || right(file_name, 4) END AS masked FROM docs"))
def h34(spark, sf):
    return S.docs(spark, sf).select("node_id", text.mask(F.when(F.col("node_id") % 9 == 0, F.lit("")).otherwise(F.col("file_name"))).alias("masked"))


@query("b25_scope", S.sql("queries", "SELECT query_id, scope, (scope IN ('all', 'local') OR scope IN ('shared:kit')) AS valid FROM (SELECT query_id, " + S.pick_sql("length(query) % 4", ["all", "local", "shared:kit", "shared:none"]) + " AS scope FROM queries)"))
def b25(spark, sf):
    scope = F.element_at(F.array(*map(F.lit, ["all", "local", "shared:kit", "shared:none"])), (F.length("query") % 4 + 1).cast("int"))
    q = S.queries(spark, sf).select("query_id", scope.alias("scope"))
    return q.select("query_id", "scope", classify.scope_valid(F.col("scope"), ["kit"]).alias("valid"))


@query("k16_chunk_router", S.sql("docs", f"SELECT node_id, CASE WHEN ext = '.py' THEN 'python' WHEN ext IN ('.ts', '.tsx', '.js', '.jsx', '.rs', '.go') THEN 'syntax' ELSE 'text' END AS chunker FROM docs"))
def k16(spark, sf):
    e = paths.extension(F.col("file_path"))
    return S.docs(spark, sf).select("node_id", F.when(e == "py", "python").when(e.isin("ts", "tsx", "js", "jsx", "rs", "go"), "syntax").otherwise("text").alias("chunker"))


@query("j19_extractor_router", S.sql("docs", "SELECT node_id, CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'syntax' WHEN '.rs' THEN 'syntax' WHEN '.go' THEN 'syntax' ELSE 'none' END AS extractor FROM docs"))
def j19(spark, sf):
    lang = paths.language(F.col("file_path"))
    return S.docs(spark, sf).select("node_id", F.when(lang == "python", "python").when(lang.isin("typescript", "javascript", "rust", "go"), "syntax").when(lang.isin("c", "cpp"), "cpp").when(lang == "astro", "astro").otherwise("none").alias("extractor"))


# ---- classification and routing -----------------------------------------------------------------------------------------

_LQ = "lower(query)"
_sum = lambda kws, c=_LQ: "(" + " + ".join(f"CAST(contains({c}, '{k}') AS INT)" for k in kws) + ")"
_or = lambda kws, c=_LQ: "(" + " OR ".join(f"contains({c}, '{k}')" for k in kws) + ")"
_HITS = _sum(K.STRUCTURAL_KEYWORDS)
_HOW = f"(contains({_LQ}, 'how do') AND {_or(K.HOW_DO_VERBS)})"
_CONF = f"CASE WHEN {_or(K.STRONG_PHRASES)} THEN 0.95 WHEN {_HITS} >= 3 THEN 0.85 WHEN {_or(K.STRUCTURAL_PHRASES)} THEN 0.8 WHEN {_HOW} THEN 0.75 WHEN {_HITS} = 2 THEN 0.65 WHEN {_HITS} = 1 THEN 0.6 ELSE 0.9 END::DOUBLE"
_LABEL = f"CASE WHEN {_or(K.STRONG_PHRASES)} OR {_HITS} >= 2 OR {_or(K.STRUCTURAL_PHRASES)} OR {_HOW} THEN 'structural' ELSE 'semantic' END"


@query("d20_keyword_hits", S.sql("queries", f"SELECT query_id, {_HITS} AS hits FROM queries"))
def d20(spark, sf):
    return S.queries(spark, sf).select("query_id", text.keyword_hits(F.lower("query"), K.STRUCTURAL_KEYWORDS).alias("hits"))


@query("l01_quick_check", S.sql("queries", f"SELECT query_id, CASE WHEN {_or(K.STRONG_PHRASES)} OR {_HITS} >= 2 OR {_or(K.STRUCTURAL_PHRASES)} OR {_HOW} THEN 'structural' WHEN {_HITS} = 0 THEN 'semantic' END AS label FROM queries"))
def l01(spark, sf):
    return S.queries(spark, sf).select("query_id", classify.quick_check(F.col("query")).alias("label"))


@query("l02_keyword_confidence", S.sql("queries", f"SELECT query_id, {_LABEL} AS label, {_CONF} AS confidence FROM queries"))
def l02(spark, sf):
    c = classify.keyword_confidence(F.col("query"))
    return S.queries(spark, sf).select("query_id", c["label"].alias("label"), c["confidence"].alias("confidence"))


@query("l06_classify_keyword", S.sql("queries", f"SELECT query_id, {_LABEL} AS label FROM queries"))
def l06(spark, sf):
    return S.queries(spark, sf).select("query_id", F.coalesce(classify.quick_check(F.col("query")), F.lit("semantic")).alias("label"))


_W = f"string_split(trim(regexp_replace({_LQ}, '\\s+', ' ', 'g')), ' ')"
_POS = f"coalesce(list_min(list_transform(list_filter(range(1, len({_W}) + 1), lambda i: {_or(K.CLASSIFIER_KEYWORDS, f'{_W}[i]')}), lambda i: (i - 1)::DOUBLE / len({_W}))), 1.0::DOUBLE)"


@query("l03_features", S.sql("queries", f"SELECT query_id, round({_sum(K.CLASSIFIER_KEYWORDS)}::DOUBLE / {len(K.CLASSIFIER_KEYWORDS)}, 6) AS f0, round({_sum(K.SEMANTIC_KEYWORDS)}::DOUBLE / {len(K.SEMANTIC_KEYWORDS)}, 6) AS f1, least(len({_W})::DOUBLE / 20.0::DOUBLE, 1.0::DOUBLE) AS f2, CASE WHEN {_or(K.STRUCTURAL_PHRASES)} THEN 1.0 ELSE 0.0 END::DOUBLE AS f3, CASE WHEN {_HOW} THEN 1.0 ELSE 0.0 END::DOUBLE AS f4, starts_with({_LQ}, 'how')::INT::DOUBLE AS f5, starts_with({_LQ}, 'what')::INT::DOUBLE AS f6, starts_with({_LQ}, 'show')::INT::DOUBLE AS f7, contains(query, '?')::INT::DOUBLE AS f8, round({_POS}, 6) AS f9 FROM queries"))
def l03(spark, sf):
    f = classify.features(F.col("query"))
    q = S.queries(spark, sf).select("query_id", f.alias("f"))
    return q.select("query_id", *[F.round(F.get("f", F.lit(i)), 6).alias(f"f{i}") for i in range(10)])


_NET = classify.train_mlp()  # 30 examples
_F = (
    f"[{_sum(K.CLASSIFIER_KEYWORDS)}::DOUBLE / {len(K.CLASSIFIER_KEYWORDS)}, {_sum(K.SEMANTIC_KEYWORDS)}::DOUBLE / {len(K.SEMANTIC_KEYWORDS)}, least(len({_W})::DOUBLE / 20.0::DOUBLE, 1.0::DOUBLE), {_or(K.STRUCTURAL_PHRASES)}::INT::DOUBLE, {_HOW}::INT::DOUBLE, "
    f"starts_with({_LQ}, 'how')::INT::DOUBLE, starts_with({_LQ}, 'what')::INT::DOUBLE, starts_with({_LQ}, 'show')::INT::DOUBLE, contains(query, '?')::INT::DOUBLE, {_POS}]"
)


def _dot(vector: str, weights, bias: float) -> str:
    return f"list_dot_product({vector}, [{', '.join(S.double(float(w)) for w in weights)}]::DOUBLE[]) + {S.double(float(bias))}"


def _net_sql(table: str) -> str:
    """query_id, other columns of table and a, the difference of the two outputs: the softmax of semantic is 1 / (1 + e^-a)."""
    hidden = ", ".join(f"greatest(0.0::DOUBLE, {_dot('f', _NET['w1'][:, k], _NET['b1'][k])})" for k in range(classify.HIDDEN))
    return f"SELECT * EXCLUDE (f, h), ({_dot('h', _NET['w2'][:, 1], _NET['b2'][1])}) - ({_dot('h', _NET['w2'][:, 0], _NET['b2'][0])}) AS a FROM (SELECT *, [{hidden}] AS h FROM (SELECT *, {_F} AS f FROM {table}))"


@query("l04_mlp_inference", S.sql("queries", f"SELECT query_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(a)), 6) AS structural, round(1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + exp(a)), 6) AS semantic FROM ({_net_sql('queries')})"))
def l04(spark, sf):
    net = classify.train_mlp()
    q = S.queries(spark, sf).select("query_id", classify.mlp(classify.features(F.col("query")), net).alias("p"))
    return q.select("query_id", F.round(F.get("p", F.lit(0)), 6).alias("structural"), F.round(F.get("p", F.lit(1)), 6).alias("semantic"))


@query("l05_mlp_training")
def l05(spark, sf):
    """Learned from all questions whose words are sure."""
    net = classify.train_on(classify.sure_examples(S.queries(spark, sf)))
    rows = [(name, i, float(v)) for name, w in net.items() for i, v in enumerate(w.ravel())]
    return spark.createDataFrame(rows, "layer string, pos int, weight double")


_NCONF, _NLABEL = (x.replace(_LQ, "normalized") for x in (_CONF, _LABEL))
_NEURAL = "CASE WHEN a < 0 THEN 'structural' ELSE 'semantic' END"
# the network reads the normalized question, which is in lower case already
_COMBINED = f"SELECT query_id, CASE WHEN confidence >= 0.75 THEN label ELSE {_NEURAL} END AS label, CASE WHEN confidence >= 0.75 THEN confidence WHEN label = {_NEURAL} THEN greatest(confidence, 0.7::DOUBLE) ELSE 0.6::DOUBLE END AS confidence FROM ({_net_sql('named')})"
_NAMED = f"named AS (SELECT query_id, normalized AS query, {_NLABEL} AS label, {_NCONF} AS confidence FROM (SELECT query_id, {_NORM} AS normalized FROM queries))"


@query("l07_combined_classify", S.sql("queries", _COMBINED, _NAMED))
def l07(spark, sf):
    c = classify.combined(F.col("query"), classify.train_mlp())
    return S.queries(spark, sf).select("query_id", c["label"].alias("label"), c["confidence"].alias("confidence"))


@query("l07_combined_keyword", S.sql("queries", f"SELECT query_id, {_NLABEL} AS label, {_NCONF} AS confidence FROM (SELECT query_id, {_NORM} AS normalized FROM queries)"))
def l07_keyword(spark, sf):
    """Without a trained network, the words alone decide."""
    c = classify.combined(F.col("query"))
    return S.queries(spark, sf).select("query_id", c["label"].alias("label"), c["confidence"].alias("confidence"))


_CODE = f"({_sum(K.CODE_KEYWORDS)} + {_sum(K.PROJECT_TRIGGERS)})"
_NON = "(" + " OR ".join(f"regexp_matches({_LQ}, '{p}')" for p in K.NON_CODE_PATTERNS) + ")"


@query("l13_activation_gate", S.sql("queries", f"SELECT query_id, NOT non AS should_use, CASE WHEN non THEN 0.9::DOUBLE WHEN n = 0 THEN 0.5::DOUBLE WHEN n >= 2 THEN least(round(0.5::DOUBLE + n * 0.1::DOUBLE, 6), 1.0::DOUBLE) ELSE 0.6::DOUBLE END AS confidence FROM (SELECT query_id, {_CODE} AS n, {_NON} AS non FROM queries)"))
def l13(spark, sf):
    g = classify.activation(F.col("query"))
    return S.queries(spark, sf).select("query_id", g["should_use"].alias("should_use"), g["confidence"].alias("confidence"))


_KW = "kw(artifact_id, ord, keyword) AS (VALUES " + ", ".join(f"('{a}', {i}, '{k}')" for i, (a, ks) in enumerate(K.ARTIFACT_KEYWORDS.items()) for k in ks) + ")"


@query("c12_artifact_keyword_join", S.sql("queries", "SELECT query_id, artifact_id, keyword FROM queries JOIN kw ON contains(lower(query), keyword)", _KW))
def c12(spark, sf):
    return classify.artifact_hits(S.queries(spark, sf)).select("query_id", "artifact_id", "keyword")


_BEST = "SELECT query_id, arg_min(artifact_id, ord - 1000 * n) AS artifact_id, CAST(max(n) AS BIGINT) AS score FROM (SELECT query_id, artifact_id, ord, count(*) AS n FROM queries JOIN kw ON contains(lower(query), keyword) GROUP BY ALL) GROUP BY query_id"


@query("e08_best_artifact", S.sql("queries", _BEST, _KW))
def e08(spark, sf):
    return classify.best_artifact(classify.artifact_hits(S.queries(spark, sf)))


@query("l08_static_artifact_match", S.sql("queries", f"SELECT q.query_id, b.artifact_id FROM queries q LEFT JOIN ({_BEST}) b USING (query_id)", _KW))
def l08(spark, sf):
    q = S.queries(spark, sf)
    return q.join(classify.best_artifact(classify.artifact_hits(q)).select("query_id", "artifact_id"), "query_id", "left").select("query_id", "artifact_id")


_CATALOGUE = f"SELECT DISTINCT 'n' || n_nationkey AS artifact_id, n_nationkey AS ord, unnest(string_split(lower(replace(n_name, '_', ' ') || ' ' || {S.pick_sql('n_nationkey % 8', S.LEADS)}), ' ')) AS keyword FROM nation"


@query("l09_dynamic_artifact_match", S.sql("queries", f"SELECT query_id, arg_min(artifact_id, ord - 1000 * n) AS artifact_id, CAST(max(n) AS BIGINT) AS score FROM (SELECT query_id, artifact_id, ord, count(*) AS n FROM ({_CATALOGUE}) JOIN queries ON keyword <> '' AND contains(lower(query), keyword) GROUP BY ALL) GROUP BY query_id"))
def l09(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, S.LEADS)), (F.col("n_nationkey") % 8 + 1).cast("int"))
    words = S.read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("artifact_id"), F.col("n_nationkey").alias("ord"), F.explode(F.split(F.lower(F.concat_ws(" ", F.replace("n_name", F.lit("_"), F.lit(" ")), lead)), " ")).alias("keyword"))
    return classify.best_artifact(classify.keyword_hits(S.queries(spark, sf), words.filter("keyword <> ''").distinct()))


@query("l11_route_decision", S.sql("queries", f"SELECT q.query_id, CASE WHEN a.artifact_id IS NOT NULL THEN 'artifact' WHEN {_LABEL} = 'structural' AND {_CONF} >= 0.85 THEN 'graph' WHEN {_LABEL} = 'structural' AND {_CONF} >= 0.5 THEN 'hybrid' ELSE 'vector' END AS routed_to FROM queries q LEFT JOIN ({_BEST}) a USING (query_id)", _KW))
def l11(spark, sf):
    return classify.route(S.queries(spark, sf)).select("query_id", "routed_to")


@query("b23_question_filter", "SELECT item_id, text FROM benchmark WHERE item_id = 3")
def b23(spark, sf):
    return S.read(spark, sf, "benchmark").filter("item_id = 3")


@query("e03_newest_n", S.sql("fact", "SELECT query_type, event_id FROM fact QUALIFY row_number() OVER (PARTITION BY query_type ORDER BY timestamp DESC, event_id DESC) <= 3"))
def e03(spark, sf):
    w = Window.partitionBy("query_type").orderBy(F.desc("timestamp"), F.desc("event_id"))
    return S.fact(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("query_type", "event_id")
