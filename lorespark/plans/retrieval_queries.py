"""Queries of retrieval, caches, prepared answers, events and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorespark import constants as K
from lorespark.operators import cache, report, retrieval, vector_index
from lorespark.operators.tables import shared_folder
from lorespark.plans import standins as S
from lorespark.plans.graph_queries import with_classes
from lorespark.plans.registry import query
from lorespark.streaming import file_events, state

# ---- retrieval ---------------------------------------------------------------------------------------------------------


def questions(spark, sf):
    """All benchmark items that have a vector: questions with a text and a vector each."""
    v = S.vectors(spark, sf).select(F.col("node_id").alias("query_id"), "embedding")
    return v.join(S.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")


_COS = "round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i] * b.embedding[i])) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x * x)))), 6)"
_SCORED = f"scored AS (SELECT a.node_id AS query_id, b.node_id, {_COS} AS score FROM vectors a, vectors b WHERE a.node_id IN (SELECT item_id FROM benchmark))"


def _vs(k: int) -> str:
    return f"SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INT) AS rank FROM scored QUALIFY rank <= {k}"


@query("h07_cosine", S.sql("vectors", "SELECT query_id, node_id, score FROM scored", _SCORED.replace("a.node_id IN (SELECT item_id FROM benchmark)", "a.node_id % 20 = 0")))
def h07(spark, sf):
    v = S.vectors(spark, sf)
    return retrieval.cosines(v, v.filter("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "embedding"))  # a stated set of queries


@query("c10_query_similarity_join", S.sql("vectors", _vs(10), _SCORED))
def c10(spark, sf):
    return retrieval.vector_search(S.vectors(spark, sf), questions(spark, sf), 10)


@query("k01_vector_search", S.sql("vectors", _vs(10), _SCORED))
def k01(spark, sf):
    return retrieval.vector_search(S.vectors(spark, sf), questions(spark, sf), 2 * 5)


@query("e07_top_k_per_query", S.sql("vectors", _vs(3), _SCORED))
def e07(spark, sf):
    return retrieval.vector_search(S.vectors(spark, sf), questions(spark, sf), 3)


@query("e01_result_numbering", S.sql("vectors", f"SELECT query_id, '[' || rank || '] ' || node_id AS line FROM ({_vs(5)})", _SCORED))
def e01(spark, sf):
    r = retrieval.vector_search(S.vectors(spark, sf), questions(spark, sf), 5)
    return r.select("query_id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("node_id").cast("string")).alias("line"))


@query("f06_router_fetch", S.sql("vectors", _vs(10), _SCORED))
def f06(spark, sf):
    return retrieval.vector_search(S.vectors(spark, sf), questions(spark, sf), 2 * 5)


@query("c11_cached_query_match", S.sql("vectors", "SELECT query_id, arg_min(node_id, (-score, node_id)) AS cached_id, max(score) AS score FROM scored WHERE node_id NOT IN (SELECT item_id FROM benchmark) AND score >= 0.3 GROUP BY 1", _SCORED))
def c11(spark, sf):
    asked = questions(spark, sf)
    cached = S.vectors(spark, sf).join(asked.select(F.col("query_id").alias("node_id")), "node_id", "left_anti")
    return retrieval.vector_search(cached, asked, 1, least=0.3).select("query_id", F.col("node_id").alias("cached_id"), "score")


_TOK = "tok AS (SELECT node_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM docs)"
_ASK = "ask AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings))"
_POST = "post AS (SELECT term, node_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT node_id, len(t) AS dl, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM ask) GROUP BY 1, 2)"
_BM = (
    "bm AS (SELECT query_id, node_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score "
    "FROM post JOIN (SELECT term, count(*) AS df FROM post GROUP BY 1) USING (term) JOIN ask USING (term), (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok) GROUP BY 1, 2)"
)
_BMK = "SELECT query_id, node_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS INT) AS rank FROM bm QUALIFY rank <= 5"


@query("k04_tokens", S.sql("docs", "SELECT node_id, CAST(len(t) AS INT) AS tokens, array_to_string(t[1:5], ' ') AS head FROM tok", _TOK))
def k04(spark, sf):
    t = retrieval.tokens(F.col("text"))
    return S.docs(spark, sf).select("node_id", F.size(t).alias("tokens"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@query("k03_bm25", S.sql("docs", _BMK, _TOK, _ASK, _POST, _BM))
def k03(spark, sf):
    return retrieval.bm25(S.docs(spark, sf), questions(spark, sf), 5)


_HYB = f"SELECT query_id, node_id, score, origin, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS INT) AS rank FROM (SELECT *, 0 AS tier, 'vector' AS origin FROM vs UNION ALL SELECT *, 1, 'bm25' FROM ({_BMK})) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) <= 5"
_HYB7 = f"SELECT query_id, node_id, score, origin, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS INT) AS rank FROM (SELECT * FROM (SELECT *, 0 AS tier, 'vector' AS origin FROM vs WHERE rank <= 3 UNION ALL SELECT *, 1, 'bm25' FROM ({_BMK})) QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY tier, rank) = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) <= 7"
_VS = f"vs AS ({_vs(10)})"
_ALL = (_SCORED, _VS, _TOK, _ASK, _POST, _BM)


@query("k05_hybrid_search", S.sql("docs vectors", _HYB, *_ALL))
def k05(spark, sf):
    return retrieval.hybrid_search(S.docs(spark, sf), S.vectors(spark, sf), questions(spark, sf), 5)


@query("g05_ordered_union", S.sql("docs vectors", _HYB7, *_ALL))
def g05(spark, sf):
    q = questions(spark, sf)
    return retrieval.hybrid(retrieval.vector_search(S.vectors(spark, sf), q, 3), retrieval.bm25(S.docs(spark, sf), q, 5), 7)


@query("f05_overfetch_unique", S.sql("vectors", _vs(5), _SCORED))
def f05(spark, sf):
    r = retrieval.vector_search(S.vectors(spark, sf), questions(spark, sf), 10)
    return retrieval.top_k(r.drop("rank").dropDuplicates(["query_id", "node_id"]), 5)


@query("k06_vector_only", S.sql("vectors", "SELECT query_id, node_id, score, 'vector' AS origin, rank FROM (" + _vs(5) + ")", _SCORED))
def k06(spark, sf):
    return retrieval.hybrid_search(S.docs(spark, sf), S.vectors(spark, sf), questions(spark, sf), 5, words=False)


_REL = "rel AS (SELECT DISTINCT source, target FROM (SELECT m.entity_key AS source, c.entity_key AS target FROM wc m JOIN wc c ON m.entity_type = 'method' AND c.entity_type = 'class' AND c.file_path = m.file_path AND c.name = m.class_name))"
_WC = "wc AS (SELECT e.entity_key, e.name, e.entity_type, e.file_path, CASE WHEN e.entity_type = 'method' THEN coalesce(c.first, e.class_name) END AS class_name FROM entities e LEFT JOIN (SELECT file_path, min(name) AS first FROM entities WHERE entity_type = 'class' GROUP BY 1) c USING (file_path))"


def relations(spark, sf):
    e = with_classes(spark, sf)
    c = e.filter("entity_type = 'class'").select("file_path", F.col("name").alias("class_name"), F.col("entity_key").alias("target"))
    return e.filter("entity_type = 'method'").select("file_path", "class_name", F.col("entity_key").alias("source")).join(c, ["file_path", "class_name"]).select("source", "target").distinct()


@query("c15_entity_neighbours", S.sql("entities", "SELECT neighbour, way FROM (SELECT target AS neighbour, 'out' AS way FROM rel WHERE source = (SELECT min(target) FROM rel) UNION ALL SELECT source, 'in' FROM rel WHERE target = (SELECT min(target) FROM rel)) ORDER BY 1, 2 LIMIT 10", _WC, _REL))
def c15(spark, sf):
    r = relations(spark, sf)
    return retrieval.entity_neighbours(r, r.agg(F.min("target")).first()[0], 10)


@query("f07_neighbour_cap", S.sql("entities", "SELECT neighbour, way FROM (SELECT source AS neighbour, 'in' AS way FROM rel WHERE target = (SELECT max(target) FROM rel)) ORDER BY 1, 2 LIMIT 5", _WC, _REL))
def f07(spark, sf):
    r = relations(spark, sf)
    return retrieval.entity_neighbours(r, r.agg(F.max("target")).first()[0], 5)


_ENDS = "ends AS (SELECT source AS entity_key, target AS other FROM rel UNION ALL SELECT target, source FROM rel)"


@query("k07_graph_context", S.sql("entities", "SELECT query_id, string_agg('- connected: ' || other, chr(10) ORDER BY rn) AS lines FROM (SELECT f.query_id, other, row_number() OVER (PARTITION BY f.query_id ORDER BY other) AS rn FROM first f JOIN ends USING (entity_key) QUALIFY rn <= 5) GROUP BY 1", _WC, _REL, _ENDS, "first AS (SELECT DISTINCT target AS query_id, target AS entity_key FROM rel)"))
def k07(spark, sf):
    r = relations(spark, sf)
    return retrieval.graph_lines(r.select(F.col("target").alias("query_id"), F.col("target").alias("entity_key")).distinct(), r, 5)


_RED = "text"
for _p in K.SENSITIVE:
    _RED = "regexp_replace(" + _RED + ", '" + _p.replace("'", "''") + "', '[REDACTED]', 'g')"


@query("k08_context_assembly", S.sql("docs vectors", f"SELECT query_id, string_agg('[' || file_name || ']' || chr(10) || left({_RED}, 1000), chr(10) || chr(10) ORDER BY rank) AS context FROM ({_HYB}) JOIN docs USING (node_id) GROUP BY 1", *_ALL))
def k08(spark, sf):
    d = S.docs(spark, sf)
    return retrieval.context(retrieval.hybrid_search(d, S.vectors(spark, sf), questions(spark, sf), 5), d, 5)


_SHARED = "sh AS (SELECT CASE WHEN b.label < 5 THEN 'local' ELSE 'shared:sdk' END AS source, s.query_id, s.node_id, score FROM scored s JOIN vectors b USING (node_id))"


def shared(spark, sf):
    v = S.vectors(spark, sf)
    r = retrieval.vector_search(v, questions(spark, sf), 40)
    return r.join(v.select("node_id", "label"), "node_id").select("query_id", F.when(F.col("label") < 5, "local").otherwise("shared:sdk").alias("source"), "node_id", "score")


@query("f01_merge_by_score", S.sql("vectors", "SELECT query_id, source, node_id, score, CASE source WHEN 'local' THEN '[YOUR CODE]' ELSE '[SDK SDK]' END AS tag FROM sh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, node_id) <= 8", _SCORED, _SHARED))
def f01(spark, sf):
    return retrieval.merged(shared(spark, sf), 8)


@query("k09_federated_merge", S.sql("vectors", "SELECT query_id, source, count(*) AS n, max(score) AS best FROM (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, node_id) <= 20) GROUP BY 1, 2", _SCORED, _SHARED))
def k09(spark, sf):
    return retrieval.merged(shared(spark, sf), 20).groupBy("query_id", "source").agg(F.count("*").alias("n"), F.max("score").alias("best"))


_IDX = "idx AS (SELECT n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'text-embedding-3-large' ELSE 'text-embedding-3-small' END AS model FROM nation)"


def indexes(spark, sf):
    model = F.when(F.col("n_nationkey") % 3 == 0, "text-embedding-3-large").otherwise("text-embedding-3-small")
    return S.read(spark, sf, "nation").select(F.col("n_name").alias("name"), model.alias("model"))


@query("c18_model_compatibility", S.sql("", "SELECT * FROM idx WHERE model = 'text-embedding-3-small'", _IDX))
def c18(spark, sf):
    return retrieval.compatible(indexes(spark, sf), K.EMBEDDING_MODEL)


@query("k10_shared_index_load", S.sql("docs", "SELECT name, count(*) AS documents FROM idx JOIN docs ON ext = CASE length(name) % 2 WHEN 0 THEN '.md' ELSE '.txt' END WHERE model = 'text-embedding-3-small' GROUP BY 1", _IDX))
def k10(spark, sf):
    i = retrieval.compatible(indexes(spark, sf), K.EMBEDDING_MODEL).withColumn("ext", F.when(F.length("name") % 2 == 0, ".md").otherwise(".txt"))
    return S.docs(spark, sf).groupBy("ext").agg(F.count("*").alias("documents")).join(i, "ext").select("name", "documents")


@query("a11_index_table", S.sql("docs vectors", "SELECT node_id, file_name, CAST(len(embedding) AS INT) AS size FROM docs JOIN vectors USING (node_id)"))
def a11(spark, sf):
    return S.docs(spark, sf).join(S.vectors(spark, sf), "node_id").select("node_id", "file_name", F.size("embedding").alias("size"))


@query("k02_lsh_search")
def k02(spark, sf):
    return retrieval.lsh_search(S.vectors(spark, sf), questions(spark, sf), 5)


_EMB = (
    "slot AS (SELECT node_id, ('0x' || left(md5(term), 7))::BIGINT % 256 AS slot, count(*) AS n FROM (SELECT node_id, unnest(t) AS term FROM tok) GROUP BY 1, 2), "
    "emb AS (SELECT node_id, sqrt(sum(n * n)::DOUBLE) AS norm, map_from_entries(list({'k': slot, 'v': n})) AS m FROM slot GROUP BY 1)"
)


@query("k11_hashing_embedder", S.sql("docs", "SELECT node_id, list_transform(range(256), lambda i: round(coalesce(m[i], 0) / norm, 9)) AS embedding FROM emb", _TOK, _EMB))
def k11(spark, sf):
    return retrieval.hashing_embedder(S.docs(spark, sf)).select("node_id", F.transform("embedding", lambda x: F.round(x, 9)).alias("embedding"))


# ---- caches and prepared answers --------------------------------------------------------------------------------------------

_TTL = "CASE query_type WHEN 'search' THEN 3600 WHEN 'query' THEN 7200 WHEN 'rag' THEN 7200 WHEN 'artifact' THEN 86400 ELSE 3600 END * 24"
_NOW = "1706659200"
NOW = int(_NOW)


@query("b19_ttl_filter", S.sql("cache_rows", f"SELECT event_id, query_type FROM cache_rows WHERE {_NOW} - stored_at <= {_TTL}"))
def b19(spark, sf):
    return cache.fresh(S.cache_rows(spark, sf), NOW, 24).select("event_id", "query_type")


@query("i13_cleanup_sweep", S.sql("cache_rows", f"SELECT query_type, count(*) AS expired FROM cache_rows WHERE {_NOW} - stored_at > {_TTL} GROUP BY 1"))
def i13(spark, sf):
    return cache.expired(S.cache_rows(spark, sf), NOW, 24).groupBy("query_type").agg(F.count("*").alias("expired"))


@query("b20_invalidate_by_type", S.sql("cache_rows", "SELECT event_id, query_type FROM cache_rows WHERE query_type <> 'search'"))
def b20(spark, sf):
    return cache.without_type(S.cache_rows(spark, sf), "search").select("event_id", "query_type")


@query("d16_cache_stats", S.sql("cache_rows", "SELECT coalesce(CASE WHEN event_id % 9 > 0 THEN query_type END, 'unknown') AS query_type, count(*) AS n FROM cache_rows GROUP BY 1"))
def d16(spark, sf):
    return cache.counts(S.cache_rows(spark, sf).withColumn("query_type", F.when(F.col("event_id") % 9 > 0, F.col("query_type"))))


@query("e04_fifo_eviction", S.sql("cache_rows", "SELECT event_id, stored_at FROM cache_rows ORDER BY stored_at DESC, event_id DESC LIMIT 128"))
def e04(spark, sf):
    return cache.newest(S.cache_rows(spark, sf), 128).select("event_id", "stored_at")


@query("a12_cache_entry_scan", S.sql("cache_rows", "SELECT event_id, query, query_type, result FROM cache_rows"))
def a12(spark, sf):
    """Through the JSON form of the cache files."""
    entry = F.to_json(F.struct("query", "query_type", "result"))
    r = S.cache_rows(spark, sf).select("event_id", F.from_json(entry, "query string, query_type string, result string").alias("e"))
    return r.select("event_id", "e.*")


@query("l12_cached_wrapper", S.sql("cache_rows", f"SELECT a.query, a.query_type, coalesce(c.result || chr(10) || '[Cache Hit]', 'computed') AS result, c.result IS NOT NULL AS hit FROM (SELECT DISTINCT query, query_type FROM cache_rows) a LEFT JOIN (SELECT query, query_type, arg_max(result, (stored_at, event_id)) AS result FROM cache_rows WHERE {_NOW} - stored_at <= {_TTL} GROUP BY 1, 2) c USING (query, query_type)"))
def l12(spark, sf):
    c = S.cache_rows(spark, sf)
    return cache.lookup(c.select("query", "query_type").distinct().withColumn("answer", F.lit("computed")), c, NOW, 24)


_REPLAY = "RECURSIVE st(query, t, id) AS (SELECT query, min(stored_at) AS t, arg_min(event_id, (stored_at, event_id)) AS id FROM cache_rows GROUP BY 1 UNION ALL SELECT c.query, min(c.stored_at), arg_min(c.event_id, (c.stored_at, c.event_id)) FROM st JOIN cache_rows c ON c.query = st.query AND c.stored_at - st.t > 3600 GROUP BY c.query)"


@query("i11_cache_replay", S.sql("cache_rows", "SELECT query, event_id, event_id NOT IN (SELECT id FROM st) AS hit FROM cache_rows", _REPLAY))
def i11(spark, sf):
    return cache.replayed(S.cache_rows(spark, sf), 3600)


_SDK = "sdk AS (SELECT query_type AS library, topic, max(stored_at) AS fetched_at, 7 AS ttl_days, 'doc ' || query_type || ' ' || topic AS doc FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'general' ELSE 't' || (event_id % 40) END AS topic FROM cache_rows WHERE NOT (query_type = 'rag' AND event_id % 4 = 0)) GROUP BY 1, 2, 5)"


def sdk_docs(spark, sf):
    e = F.col("event_id")
    c = S.cache_rows(spark, sf).filter("not (query_type = 'rag' and event_id % 4 = 0)").withColumn("topic", F.when(e % 4 == 0, "general").otherwise(F.concat(F.lit("t"), (e % 40).cast("string"))))
    return c.groupBy(F.col("query_type").alias("library"), "topic").agg(F.max("stored_at").alias("fetched_at")).select("library", "topic", "fetched_at", F.lit(7).alias("ttl_days"), F.concat(F.lit("doc "), "library", F.lit(" "), "topic").alias("doc"))


_ASOF = "1706400000"


@query("a17_sdk_listing", S.sql("cache_rows", f"SELECT library, {_ASOF} - max(fetched_at) < max(ttl_days) * 86400 AS fresh, count(DISTINCT topic) AS topics, count(*) AS docs FROM sdk GROUP BY 1", _SDK))
def a17(spark, sf):
    return report.library_listing(sdk_docs(spark, sf), int(_ASOF))


@query("h24_sdk_freshness", S.sql("cache_rows", "SELECT library, topic, 1707200000 - fetched_at < ttl_days * 86400 AS fresh FROM sdk", _SDK))
def h24(spark, sf):
    return sdk_docs(spark, sf).select("library", "topic", (F.lit(1707200000) - F.col("fetched_at") < F.col("ttl_days") * 86400).alias("fresh"))


@query("l14_sdk_get", S.sql("cache_rows", (
    "SELECT w.library, w.topic, CASE WHEN t.f THEN t.doc WHEN g.f THEN g.doc ELSE coalesce(t.doc, g.doc) END AS doc, CASE WHEN t.f THEN 'topic' WHEN g.f THEN 'general' WHEN t.doc IS NOT NULL THEN 'stale topic' WHEN g.doc IS NOT NULL THEN 'stale general' END AS how "
    "FROM (SELECT query_type AS library, 't' || event_id AS topic FROM cache_rows) w LEFT JOIN (SELECT *, 1707200000 - fetched_at < ttl_days * 86400 AS f FROM sdk) t USING (library, topic) LEFT JOIN (SELECT *, 1707200000 - fetched_at < ttl_days * 86400 AS f FROM sdk WHERE topic = 'general') g ON g.library = w.library"
), _SDK))
def l14(spark, sf):
    wanted = S.cache_rows(spark, sf).select(F.col("query_type").alias("library"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("topic"))
    return cache.sdk_get(wanted, sdk_docs(spark, sf), 1707200000)


def current(spark, sf):
    return S.cur_hash(spark, sf)


_A = "artifact_deps cur_hash"


@query("a13_artifact_manifest", S.sql(_A, "SELECT artifact_id, count(*) AS sources FROM artifact_deps GROUP BY 1"))
def a13(spark, sf):
    return S.artifact_deps(spark, sf).groupBy("artifact_id").agg(F.count("*").alias("sources"))


@query("l10_artifact_staleness", S.sql(_A, "SELECT artifact_id, bool_or(c.sha256 IS NULL OR c.sha256 <> expected) AS stale FROM artifact_deps d LEFT JOIN cur_hash c USING (path) GROUP BY 1"))
def l10(spark, sf):
    return cache.stale_artifacts(S.artifact_deps(spark, sf), current(spark, sf))


_CHANGED = "ch AS (SELECT file_path AS path FROM docs WHERE node_id % 7 = 0)"


@query("c09_changed_file_dependency", S.sql("artifact_deps", "SELECT artifact_id, path FROM artifact_deps JOIN ch USING (path)", _CHANGED))
def c09(spark, sf):
    ch = S.docs(spark, sf).filter("node_id % 7 = 0").select(F.col("file_path").alias("path"))
    return S.artifact_deps(spark, sf).join(ch, "path").select("artifact_id", "path")


@query("i12_artifact_invalidation", S.sql("artifact_deps", "SELECT artifact_id, min(path) AS path FROM artifact_deps JOIN ch USING (path) WHERE artifact_id <> 'code_chunking' GROUP BY 1", _CHANGED))
def i12(spark, sf):
    ch = S.docs(spark, sf).filter("node_id % 7 = 0").select(F.col("file_path").alias("path"))
    return cache.invalidated(S.artifact_deps(spark, sf), ch, spark.createDataFrame([("code_chunking",)], "artifact_id string"))


@query("l16_artifact_rebuild", S.sql(_A, "SELECT artifact_id, path, sha256 AS expected FROM artifact_deps JOIN cur_hash USING (path)"))
def l16(spark, sf):
    return cache.rebuilt(S.artifact_deps(spark, sf), current(spark, sf))


# ---- events and reports --------------------------------------------------------------------------------------------------------

_PARTS = lambda c: "list_has_any(string_split(" + c + ", '/'), " + repr(K.WATCH_EXCLUDE_DIRS) + ") OR " + " OR ".join(f"contains({c}, '{p}') OR regexp_extract({c}, '[^/]*$') GLOB '{p}'" for p in K.EXCLUDE_PATTERNS)
_EV = f"ev AS (SELECT * FROM file_events WHERE NOT ({_PARTS('path')}) OR (kind = 'moved' AND dest IS NOT NULL AND NOT ({_PARTS('dest')})))"


@query("i01_relevant_file_events", S.sql("file_events", "SELECT event_id, kind, path FROM ev", _EV))
def i01(spark, sf):
    return file_events.relevant(S.file_events(spark, sf)).select("event_id", "kind", "path")


@query("i02_debounced_bursts", S.sql("file_events", "SELECT path, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS events FROM (SELECT *, sum(brk) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM file_events)) GROUP BY path, burst"))
def i02(spark, sf):
    return file_events.debounced(S.file_events(spark, sf), "6 hours")


@query("i01_daily_kind_counts", S.sql("file_events", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, kind, count(*) AS events FROM file_events GROUP BY 1, 2"))
def i01_daily(spark, sf):
    return file_events.daily_counts(S.file_events(spark, sf))


@query("i10_circuit_breaker", (
    "SELECT user_id AS key, event_id AS call_id, CAST(n AS BIGINT) AS failures, n >= 2 AS open FROM (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM "
    "(SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events)))"
))
def i10(spark, sf):
    calls = S.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), "ts", (F.col("event_type") == "error").alias("failed"))
    return state.breaker_states(calls, 2)


_SEC = "sec AS (SELECT r_regionkey AS doc_id, n_nationkey AS priority, n_name AS title, 'Region ' || r_name AS body FROM nation JOIN region ON r_regionkey = n_regionkey)"
_MD = "SELECT doc_id, '# Handoff' || chr(10) || chr(10) || string_agg('- [' || title || '](#' || replace(replace(lower(title), ' ', '-'), '/', '-') || ')', chr(10) ORDER BY priority) || chr(10) || chr(10) || string_agg('## ' || title || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY priority) || chr(10) AS markdown FROM sec GROUP BY 1"


def sections(spark, sf):
    n, r = S.read(spark, sf, "nation"), S.read(spark, sf, "region")
    return n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("doc_id"), F.col("n_nationkey").alias("priority"), F.col("n_name").alias("title"), F.concat(F.lit("Region "), "r_name").alias("body"))


@query("m05_handoff_document", S.sql("", _MD, _SEC))
def m05(spark, sf):
    return report.handoff(sections(spark, sf), "Handoff")


@query("a23_markdown_sink", S.sql("", f"SELECT doc_id, length(markdown) AS chars FROM ({_MD})", _SEC))
def a23(spark, sf):
    return report.handoff(sections(spark, sf), "Handoff").select("doc_id", F.length("markdown").cast("long").alias("chars"))


@query("f08_section_priority", S.sql("", "SELECT priority, title FROM sec ORDER BY priority DESC", _SEC))
def f08(spark, sf):
    return sections(spark, sf).select("priority", "title").orderBy(F.desc("priority"))


@query("d17_registry_status", "SELECT count(*) AS total, count(*) FILTER (e) AS existing, count(*) FILTER (e AND i) AS indexed, count(*) FILTER (e AND NOT i) AS unindexed, count(*) FILTER (NOT e) AS missing FROM (SELECT n_nationkey % 4 > 0 AS e, n_nationkey % 3 > 0 AS i FROM nation)")
def d17(spark, sf):
    k = F.col("n_nationkey")
    return report.project_status(S.read(spark, sf, "nation").select((k % 4 > 0).alias("exists"), (k % 3 > 0).alias("has_index"), F.lit(True).alias("has_config")))


@query("a20_project_discovery", S.sql("docs", "SELECT DISTINCT '/' || source AS project FROM docs WHERE node_id % 5 = 0"))
def a20(spark, sf):
    marked = F.when(F.col("node_id") % 5 == 0, F.concat(F.lit("/"), "source", F.lit("/.lore/config.json"))).otherwise(F.col("file_path"))
    return report.discovered(S.docs(spark, sf).select(marked.alias("path")), ".lore/config.json").filter("project is not null")


@query("g09_distinct_projects", S.sql("docs", "SELECT DISTINCT source AS project FROM docs"))
def g09(spark, sf):
    return S.docs(spark, sf).select(F.col("source").alias("project")).dropDuplicates()


_SCAN = "NOT (" + " OR ".join(f"contains(file_path, '{p}')" for p in K.EXCLUDE_PATTERNS if "*" not in p) + ")"


@query("a01_docs_scan", S.sql("docs", f"SELECT node_id, 'file://' || file_path AS doc_id, sha256(text) AS sha256 FROM docs WHERE {_SCAN}"))
def a01(spark, sf):
    from lorespark.functions.paths import excluded

    return S.docs(spark, sf).filter(~excluded(F.col("file_path"))).select("node_id", F.concat(F.lit("file://"), "file_path").alias("doc_id"), F.sha2("text", 256).alias("sha256"))


@query("a02_code_scan", S.sql("docs", "SELECT file_name AS id, file_size FROM docs WHERE ext IN ('.py', '.ts', '.rs', '.go')"))
def a02(spark, sf):
    from lorespark.functions.paths import is_code

    return S.docs(spark, sf).filter(is_code(F.col("file_name")) == "code").select(F.col("file_name").alias("id"), "file_size")


@query("a03_single_file", S.sql("docs", "SELECT file_name, file_path, text FROM docs WHERE node_id = 3"))
def a03(spark, sf):
    return S.docs(spark, sf).filter("node_id = 3").select("file_name", "file_path", F.decode(F.encode("text", "UTF-8"), "UTF-8").alias("text"))


@query("a04_docstore", S.sql("docs", "SELECT node_id::VARCHAR AS id_, file_path, file_size FROM docs"))
def a04(spark, sf):
    """Through the JSON form of the store: a map of documents for each source, exploded again."""
    from lorespark.sources.files import NODE

    node = F.struct(F.col("node_id").cast("string").alias("id_"), F.struct("file_path", "file_name", "file_size").alias("metadata"))
    said = S.docs(spark, sf).select(F.to_json(F.create_map(F.col("node_id").cast("string"), node)).alias("j"))
    got = said.select(F.explode(F.from_json("j", f"map<string, {NODE}>")).alias("k", "n"))
    return got.select("n.id_", "n.metadata.file_path", "n.metadata.file_size")


@query("a05_relations", S.sql("edges_w", "SELECT source, target, edge_type FROM edges_w"))
def a05(spark, sf):
    """Through the JSON form of the relations file."""
    one = F.to_json(F.struct(F.array(F.struct("source", "target", F.col("edge_type").alias("relation_type"))).alias("relationships")))
    got = S.edges_w(spark, sf).select(F.from_json(one, "relationships array<struct<source: string, target: string, relation_type: string>>").alias("f"))
    return got.select(F.explode("f.relationships").alias("r")).select("r.source", "r.target", F.col("r.relation_type").alias("edge_type"))


@query("a07_server_metric_source", S.sql("fact", "SELECT event_id, stamp FROM (SELECT event_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS stamp FROM fact) WHERE left(stamp, 19) >= '2024-01-20T00:00:00'"))
def a07(spark, sf):
    f = S.fact(spark, sf).select("event_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))
    return f.filter(F.substring("stamp", 1, 19) >= "2024-01-20T00:00:00")


@query("a08_append_sink", S.sql("fact", "SELECT event_id, query_type, cost FROM fact"))
def a08(spark, sf):
    """The rows as the sink writes and the source reads them."""
    line = F.to_json(F.struct("event_id", "query_type", "cost"))
    return S.fact(spark, sf).select(F.from_json(line, "event_id long, query_type string, cost double").alias("r")).select("r.*")


@query("h27_path_rendering", S.sql("edges_w", "SELECT source, '[Graph Path]' || chr(10) || string_agg('  ' || rn || '. ' || source || ' --' || edge_type || '--> ' || target, chr(10) ORDER BY rn) AS said FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target, edge_type) AS rn FROM edges_w) GROUP BY 1"))
def h27(spark, sf):
    g = S.edges_w(spark, sf).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("target", "edge_type"))).alias("s"))
    line = lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.col("source"), F.lit(" --"), x["edge_type"], F.lit("--> "), x["target"])
    return g.select("source", F.concat(F.lit("[Graph Path]\n"), F.array_join(F.transform("s", line), "\n")).alias("said"))


@query("k02_vector_index")
def k02_index(spark, sf):
    """Vectors whose id is divisible by 20 against all, through cells and quantised residuals; 26 of 32 cells are looked at."""
    v = S.vectors(spark, sf)
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    quantiser = vector_index.train(v, cells=32)
    vector_index.add(v, quantiser, folder)
    asked = v.filter("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    return vector_index.search(spark, folder, quantiser, asked, 10, probes=26, refine=200)
