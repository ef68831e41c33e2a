"""Logical tables of the engine, mapped from the standard test tables: once as DataFrames, once as SQL for the oracle.

All times are relative to AS_OF; nothing depends on the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark import constants as K
from lorespark.operators import costs

AS_OF = "2024-01-31 00:00:00"
EXTENSIONS = [".py", ".ts", ".rs", ".go", ".md", ".txt"]
MODELS = ["google/gemini-3.1-flash-lite-preview", "openai/gpt-4o-mini", "anthropic/claude-3.5-haiku", "unlisted/model"]
TYPES = {"view": "search", "click": "query", "signup": "rag", "purchase": "agent", "error": "index"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed documents: node_id, file_name, file_path, ext, text, file_size, lang, source."""
    d = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    d = d.withColumn("ext", ext).withColumn("file_name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.col("ext")))
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("file_name"))
    return d.select(F.col("doc_id").alias("node_id"), "file_name", path.alias("file_path"), "ext", "text", F.col("n_chars").alias("file_size"), "lang", "source")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost log, priced from the dimension tables."""
    e = read(spark, sf_dir, "events")
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(
        "event_id", F.col("ts").alias("timestamp"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id",
        kinds[F.col("event_type")].alias("query_type"),
        F.element_at(F.array(*map(F.lit, MODELS)), (F.col("event_id") % 4 + 1).cast("int")).alias("model"),
        (100 + k * 10).alias("tokens_in"), (k * 3).alias("tokens_out"), (k % 10).alias("docs_retrieved"), F.floor(F.col("value") * 100).cast("long").alias("duration_ms"), k.alias("k"),
    )
    return costs.priced_by_estimate(rows)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: all benchmark items and user turns."""
    b = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"))
    c = read(spark, sf_dir, "conversations").filter("role = 'user'")
    c = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("query"))
    both = b.unionByName(c)
    # prefixes and middles bring in the phrases that routing looks for
    n = F.length("query") % 8
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (n + 1).cast("int"))
    return both.select("query_id", F.concat(lead, F.col("query")).alias("query"))


LEADS = [
    "", "Can you explain how the path from ", "what is ", "How do I connect to ", "please show me the link between auth and ", "depends on ",
    "reindex the cache of ", "how does the graph call from main to utils ",
]


def edges_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph P: source, target, edge_type over the order tables."""
    r = lambda n: read(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    parts = [
        r("nation").select(key("n", "n_nationkey").alias("source"), key("r", "n_regionkey").alias("target"), F.lit("has_method").alias("edge_type")),
        r("customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), F.lit("imports_from")),
        r("supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey"), F.lit("inherits_from")),
        r("orders").select(key("o", "o_orderkey"), key("c", "o_custkey"), F.lit("calls")),
        r("lineitem").select(key("p", "l_partkey"), key("s", "l_suppkey"), F.lit("imports_module")).distinct(),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def edges_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph W: links between pages and their targets, some of them marked external."""
    p = read(spark, sf_dir, "pages")
    href = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    target = F.when(F.length("href") % 7 == 0, F.concat(F.lit("external:"), F.col("href"))).otherwise(F.col("href"))
    kind = F.element_at(F.array(*map(F.lit, ["calls", "imports_from", "imports_module", "inherits_from", "other"])), (F.length("href") % 5 + 1).cast("int"))
    return href.select(F.concat(F.lit("/page/"), F.col("page_id").cast("string")).alias("source"), target.alias("target"), kind.alias("edge_type")).distinct()


def edges_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph T, a tree: suppliers under nations under regions under one hub."""
    r = lambda n: read(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c).cast("string"))
    top = r("region").select(key("r", "r_regionkey").alias("source"), F.lit("hub").alias("target"))
    return top.union(r("nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"))).union(r("supplier").select(key("s", "s_suppkey"), key("n", "s_nationkey")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code entities: entity_key, name, entity_type, file_path, class_name."""
    r = lambda n: read(spark, sf_dir, n)
    raw = (
        r("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("class").alias("entity_type"), F.lit(None).cast("string").alias("class_name"))
        .union(r("nation").select(F.col("n_nationkey").cast("long"), "n_name", F.lit("class"), F.lit(None).cast("string")))
        .union(r("customer").select("c_custkey", "c_name", F.lit("function"), F.lit(None).cast("string")))
        .union(r("supplier").select("s_suppkey", "s_name", F.lit("function"), F.lit(None).cast("string")))
        .union(r("part").select("p_partkey", "p_name", F.lit("method"), "p_brand"))
    )
    d = docs(spark, sf_dir)
    placed = raw.withColumn("slot", F.col("id") % max(1, d.count())).join(d.select(F.col("node_id").alias("slot"), "file_path", "file_name"), "slot")
    path = F.when(F.col("id") % 3 == 0, F.col("file_name")).otherwise(F.col("file_path"))
    return placed.select(F.concat(path, F.lit("::"), F.col("name")).alias("entity_key"), "name", "entity_type", path.alias("file_path"), "class_name")


def prev_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).filter("node_id % 10 <> 0").select(F.col("file_path").alias("path"), F.sha2("text", 256).alias("sha256"))


def cur_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("node_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return docs(spark, sf_dir).filter("node_id % 11 <> 0").select(F.col("file_path").alias("path"), F.sha2(text, 256).alias("sha256"))


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File events: event_id, ts, kind, path, dest."""
    kind = F.create_map(*map(F.lit, ["view", "created", "click", "modified", "error", "deleted", "purchase", "moved", "signup", "modified"]))
    e = read(spark, sf_dir, "events")
    top = F.element_at(F.array(*map(F.lit, ["/f", "/f/.git", "/f/src", "/f/node_modules", "/f/out"])), (F.col("event_id") % 5 + 1).cast("int"))
    path = F.concat(top, F.lit("/"), F.col("user_id").cast("string"), F.lit(".py"))
    k = kind[F.col("event_type")]
    return e.select("event_id", "ts", k.alias("kind"), path.alias("path"), F.when(k == "moved", F.concat(F.lit("/f/src/"), F.col("user_id").cast("string"), F.lit("_new.py"))).alias("dest"))


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached results: key, query, query_type, result, epoch seconds."""
    f = fact(spark, sf_dir)
    return f.select(
        "event_id", F.concat(F.lit("q"), (F.col("user_id") % 50).cast("string")).alias("query"), "query_type",
        F.unix_timestamp("timestamp").alias("stored_at"), F.concat(F.lit("result "), F.col("event_id").cast("string")).alias("result"),
    )


def artifact_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact_id, ord, path, expected): the source files that each prepared answer depends on, with their hashes when built."""
    d = docs(spark, sf_dir)
    names = list(K.ARTIFACT_KEYWORDS)
    slot = (F.col("node_id") % len(names)).cast("int")
    return d.select(F.element_at(F.array(*map(F.lit, names)), slot + 1).alias("artifact_id"), slot.alias("ord"), F.col("file_path").alias("path"), F.sha2("text", 256).alias("expected"))


def case(column: str, values: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {a!r} THEN {b!r}" for a, b in values.items()) + f" ELSE {default} END"


def pick_sql(index: str, values: list[str]) -> str:
    return f"(CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


def double(v: float) -> str:
    return f"{v:.10e}"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    spell = lambda v: "NULL" if v is None else double(v) if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(spell, r)) + ")" for r in rows) + ")"


_EST = f"coalesce(est.type, '{K.DEFAULT_ESTIMATE}')"
#: Common table expressions by name: the names they need, and their SQL
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), f"docs AS (SELECT doc_id AS node_id, 'doc_' || doc_id || ext AS file_name, '/' || source || '/doc_' || doc_id || ext AS file_path, ext, text, n_chars AS file_size, lang, source FROM (SELECT *, {pick_sql('doc_id % 6', EXTENSIONS)} AS ext FROM documents))"),
    "dim_models": ((), values("dim_models", "model, rate_in, rate_out", [(m, *r) for m, r in K.MODEL_COSTS.items()])),
    "dim_estimates": ((), values("dim_estimates", "type, embedding_tokens, context_tokens, llm_in, llm_out", [(t, *r) for t, r in K.TOKEN_ESTIMATES.items()])),
    "dim_trad": ((), values("dim_trad", "query_type, tokens", list(K.TRADITIONAL_TOKENS.items()))),
    "dim_trad_srv": ((), values("dim_trad_srv", "query_type, tokens", list(K.TRADITIONAL_TOKENS_SERVER.items()))),
    "dim_weight": ((), values("dim_weight", "edge_type, weight", list(K.EDGE_WEIGHTS.items()))),
    "raw_fact": ((), f"raw_fact AS (SELECT event_id, ts AS timestamp, strftime(ts, '%Y-%m-%d') AS day, user_id, {case('event_type', TYPES)} AS query_type, {pick_sql('event_id % 4', MODELS)} AS model, 100 + k * 10 AS tokens_in, k * 3 AS tokens_out, k % 10 AS docs_retrieved, CAST(floor(value * 100) AS BIGINT) AS duration_ms, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"),
    "fact": (("raw_fact", "dim_models", "dim_estimates"), (
        "fact AS (SELECT *, round(embedding_cost + llm_input_cost + llm_output_cost, 6) AS cost FROM (SELECT f.*, "
        f"round(e.embedding_tokens / 1000.0::DOUBLE * {double(K.MODEL_COSTS[K.EMBEDDING_MODEL][0])}, 6) AS embedding_cost, "
        "round(e.llm_in / 1000.0::DOUBLE * m.rate_in, 6) AS llm_input_cost, round(e.llm_out / 1000.0::DOUBLE * m.rate_out, 6) AS llm_output_cost "
        f"FROM raw_fact f JOIN dim_estimates e ON e.type = CASE WHEN f.query_type IN (SELECT type FROM dim_estimates) THEN f.query_type ELSE '{K.DEFAULT_ESTIMATE}' END "
        f"JOIN dim_models m ON m.model = CASE WHEN f.model IN (SELECT model FROM dim_models) THEN f.model ELSE '{K.DEFAULT_MODEL}' END))"
    )),
    "vectors": ((), "vectors AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS embedding, label FROM embeddings)"),
    "queries": ((), "queries AS (SELECT query_id, " + pick_sql("length(query) % 8", LEADS) + " || query AS query FROM (SELECT 'b' || item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT 'c' || conv_id || '_' || turn, text FROM conversations WHERE role = 'user'))"),
    "edges_p": ((), "edges_p AS (SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'has_method' AS edge_type FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'imports_from' FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'inherits_from' FROM supplier UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'calls' FROM orders UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'imports_module' FROM lineitem)"),
    "edges_w": ((), "edges_w AS (SELECT DISTINCT '/page/' || page_id AS source, CASE WHEN length(href) % 7 = 0 THEN 'external:' || href ELSE href END AS target, " + pick_sql("length(href) % 5", ["calls", "imports_from", "imports_module", "inherits_from", "other"]) + " AS edge_type FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages))"),
    "edges_t": ((), "edges_t AS (SELECT 'r:' || r_regionkey AS source, 'hub' AS target FROM region UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier)"),
    "entities": (("docs",), "entities AS (SELECT p.file_path || '::' || name AS entity_key, name, entity_type, p.file_path, class_name FROM (SELECT r.*, CASE WHEN id % 3 = 0 THEN d.file_name ELSE d.file_path END AS file_path FROM (SELECT r_regionkey::BIGINT AS id, r_name AS name, 'class' AS entity_type, NULL::VARCHAR AS class_name FROM region UNION ALL SELECT n_nationkey::BIGINT, n_name, 'class', NULL FROM nation UNION ALL SELECT c_custkey, c_name, 'function', NULL FROM customer UNION ALL SELECT s_suppkey, s_name, 'function', NULL FROM supplier UNION ALL SELECT p_partkey, p_name, 'method', p_brand FROM part) r JOIN docs d ON r.id % (SELECT count(*) FROM docs) = d.node_id) p)"),
    "prev_hash": (("docs",), "prev_hash AS (SELECT file_path AS path, sha256(text) AS sha256 FROM docs WHERE node_id % 10 <> 0)"),
    "cur_hash": (("docs",), "cur_hash AS (SELECT file_path AS path, sha256(CASE WHEN node_id % 7 = 0 THEN text || 'x' ELSE text END) AS sha256 FROM docs WHERE node_id % 11 <> 0)"),
    "file_events": ((), "file_events AS (SELECT event_id, ts, kind, top || '/' || user_id || '.py' AS path, CASE WHEN kind = 'moved' THEN '/f/src/' || user_id || '_new.py' END AS dest FROM (SELECT *, " + case("event_type", {"view": "created", "click": "modified", "error": "deleted", "purchase": "moved", "signup": "modified"}) + " AS kind, " + pick_sql("event_id % 5", ["/f", "/f/.git", "/f/src", "/f/node_modules", "/f/out"]) + " AS top FROM events))"),
    "cache_rows": (("fact",), "cache_rows AS (SELECT event_id, 'q' || (user_id % 50) AS query, query_type, CAST(floor(epoch(timestamp)) AS BIGINT) AS stored_at, 'result ' || event_id AS result FROM fact)"),
    "artifact_deps": (("docs",), "artifact_deps AS (SELECT " + pick_sql("node_id % 6", list(K.ARTIFACT_KEYWORDS)) + " AS artifact_id, CAST(node_id % 6 AS INT) AS ord, file_path AS path, sha256(text) AS expected FROM docs)"),
}


def sql(names: str, body: str, *more: str) -> str:
    """body with the common table expressions it names, those they need, and further ones given as SQL."""
    order: list[str] = []

    def need(n: str) -> None:
        for d in CTES[n][0]:
            need(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [CTES[n][1] for n in order] + list(more)
    recursive = "RECURSIVE " if any("RECURSIVE" in m for m in more) else ""
    return (f"WITH {recursive}" + ",\n".join(p.replace("RECURSIVE ", "") for p in parts) + "\n" if parts else "") + body
