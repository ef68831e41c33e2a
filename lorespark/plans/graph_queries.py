"""Queries over graphs, entities and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorespark import constants as K
from lorespark.functions import paths
from lorespark.operators import centrality, changes, graph, graph_search, retrieval
from lorespark.operators.tables import removed_at_exit, shared_folder, written
from lorespark.plans import standins as S
from lorespark.plans.registry import query
from lorespark.sources.log_table import LogTable

# ---- change detection ----------------------------------------------------------------------------------------------------

_DIFF = "SELECT path, CASE WHEN p.sha256 IS NULL THEN 'added' WHEN c.sha256 IS NULL THEN 'deleted' WHEN p.sha256 <> c.sha256 THEN 'modified' ELSE 'unchanged' END AS change, p.sha256 AS old, c.sha256 AS new FROM prev_hash p FULL JOIN cur_hash c USING (path)"
_CHG = f"chg AS (SELECT * FROM ({_DIFF}) WHERE change <> 'unchanged')"
_H = "prev_hash cur_hash"


def diff(spark, sf):
    return changes.diff(S.prev_hash(spark, sf), S.cur_hash(spark, sf))


@query("c01_hash_diff", S.sql(_H, f"SELECT * FROM ({_DIFF}) WHERE change <> 'unchanged'"))
def c01(spark, sf):
    return diff(spark, sf)


@query("i03_change_detection", S.sql(_H, "SELECT change, count(*) AS n FROM chg GROUP BY 1", _CHG))
def i03(spark, sf):
    return diff(spark, sf).groupBy("change").agg(F.count("*").alias("n"))


@query("g01_added_deleted", S.sql(_H, "SELECT path, 'added' AS side FROM (SELECT path FROM cur_hash EXCEPT SELECT path FROM prev_hash) UNION ALL SELECT path, 'deleted' FROM (SELECT path FROM prev_hash EXCEPT SELECT path FROM cur_hash)"))
def g01(spark, sf):
    p, c = S.prev_hash(spark, sf), S.cur_hash(spark, sf)
    return changes.added(p, c).withColumn("side", F.lit("added")).unionByName(changes.added(c, p).withColumn("side", F.lit("deleted")))


@query("g03_modified", S.sql(_H, "SELECT path FROM prev_hash p JOIN cur_hash c USING (path) WHERE p.sha256 <> c.sha256"))
def g03(spark, sf):
    return changes.modified(S.prev_hash(spark, sf), S.cur_hash(spark, sf))


@query("g04_tracked_vs_indexed", S.sql(_H, "SELECT 'both' AS side, count(*) AS n FROM (SELECT path FROM prev_hash INTERSECT SELECT path FROM cur_hash) UNION ALL SELECT 'indexed', count(*) FROM (SELECT path FROM prev_hash EXCEPT SELECT path FROM cur_hash) UNION ALL SELECT 'tracked', count(*) FROM (SELECT path FROM cur_hash EXCEPT SELECT path FROM prev_hash)"))
def g04(spark, sf):
    p, c = S.prev_hash(spark, sf).select("path"), S.cur_hash(spark, sf).select("path")
    n = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(p.intersect(c), "both").unionByName(n(p.subtract(c), "indexed")).unionByName(n(c.subtract(p), "tracked"))


@query("b28_git_tracked", S.sql(_H, "SELECT path, p.sha256 IS NOT NULL AS indexed, c.sha256 IS NOT NULL AS tracked FROM prev_hash p FULL JOIN cur_hash c USING (path)"))
def b28(spark, sf):
    d = changes.diff(S.prev_hash(spark, sf), S.cur_hash(spark, sf), unchanged=True)
    return d.select("path", F.col("old").isNotNull().alias("indexed"), F.col("new").isNotNull().alias("tracked"))


@query("g06_manifest_union", S.sql(_H, "SELECT path FROM prev_hash UNION SELECT path FROM cur_hash"))
def g06(spark, sf):
    return S.prev_hash(spark, sf).select("path").union(S.cur_hash(spark, sf).select("path")).distinct()


@query("g08_purge_set", S.sql(_H, "SELECT path FROM chg WHERE change IN ('deleted', 'modified')", _CHG))
def g08(spark, sf):
    return changes.purge_set(diff(spark, sf))


_UPSERT = "SELECT path, sha256 FROM prev_hash WHERE path NOT IN (SELECT path FROM chg WHERE change IN ('deleted', 'modified')) UNION ALL SELECT path, sha256 FROM cur_hash WHERE path IN (SELECT path FROM chg WHERE change IN ('added', 'modified'))"


@query("i04_incremental_upsert", S.sql(_H, _UPSERT, _CHG))
def i04(spark, sf):
    return changes.upsert(S.prev_hash(spark, sf), S.cur_hash(spark, sf), diff(spark, sf))


@query("i04_merge_on_read", S.sql(_H, _UPSERT, _CHG))
def i04_log(spark, sf):
    """The same through a merge-on-read table: the changes are two deltas over the base, and reading puts them together."""
    delta = written(diff(spark, sf), "delta")
    table = LogTable(spark, removed_at_exit(spark, f"{shared_folder(spark)}/i04-{uuid.uuid4().hex}"), "path")
    table.replace(S.prev_hash(spark, sf).select("path", "sha256"))
    table.merge(S.cur_hash(spark, sf).select("path", "sha256").join(delta.filter("change <> 'deleted'"), "path", "left_semi"), tidy=False)
    table.merge(gone=delta.filter("change = 'deleted'"), tidy=False)
    return table.read()


@query("i05_upsert_by_id", S.sql("docs", "SELECT node_id, CASE WHEN node_id % 7 = 0 THEN file_size + 1 ELSE file_size END AS file_size FROM docs WHERE node_id % 10 <> 0 OR node_id % 7 = 0"))
def i05(spark, sf):
    d = S.docs(spark, sf).select("node_id", "file_size")
    fresh = d.filter("node_id % 7 = 0").withColumn("file_size", F.col("file_size") + 1)
    return d.filter("node_id % 10 <> 0").join(fresh, "node_id", "left_anti").unionByName(fresh)


@query("i06_remove_file", S.sql("docs", "SELECT node_id, file_path FROM docs WHERE node_id <> 17 AND file_path NOT IN (SELECT file_path FROM docs WHERE node_id = 18)"))
def i06(spark, sf):
    d = S.docs(spark, sf).select("node_id", "file_path")
    path = F.broadcast(d.filter("node_id = 18").select("file_path"))  # one row
    return changes.remove(d, "17").join(path, "file_path", "left_anti").select("node_id", "file_path")


@query("i07_remove_directory", S.sql("docs", "SELECT node_id, file_path FROM docs WHERE NOT starts_with(file_path, '/src1/')"))
def i07(spark, sf):
    return changes.remove_directory(S.docs(spark, sf).select("node_id", "file_path"), "/src1", "file_path")


@query("c19_files_under_directory", S.sql("docs", "SELECT node_id, file_path FROM docs WHERE starts_with(file_path, '/src2/')"))
def c19(spark, sf):
    return changes.under(S.docs(spark, sf).select("node_id", "file_path"), "/src2/", "file_path")


_MAN = "SELECT regexp_replace(file_path, '/[^/]*$', '') AS directory, count(DISTINCT file_path) AS file_count, count(*) AS document_count FROM docs GROUP BY 1"


@query("d19_manifest_totals", S.sql("docs", f"SELECT CAST(sum(document_count) AS BIGINT) AS total_documents FROM ({_MAN})"))
def d19(spark, sf):
    return changes.manifest(S.docs(spark, sf)).agg(F.sum("document_count").alias("total_documents"))


@query("a09_manifest", S.sql("docs", _MAN))
def a09(spark, sf):
    return changes.manifest(S.docs(spark, sf))


@query("i09_manifest_update", S.sql("docs", f"SELECT directory, n AS document_count FROM (SELECT directory, CAST(greatest(0, document_count - CASE WHEN directory IN ('/src1', '/src2') THEN 100000 ELSE 1 END) AS BIGINT) AS n FROM ({_MAN})) WHERE n > 0"))
def i09(spark, sf):
    m = changes.manifest(S.docs(spark, sf)).select("directory", "document_count")
    return changes.manifest_update(m, m.select("directory", F.when(F.col("directory").isin("/src1", "/src2"), -100000).otherwise(-1).alias("change")))


@query("a21_manifest_scan", S.sql("docs", "SELECT directory, path FROM (SELECT regexp_replace(file_path, '/[^/]*$', '') AS directory, file_path AS path FROM docs) WHERE ends_with(path, '.py') OR ends_with(path, '.rs')"))
def a21(spark, sf):
    m = S.docs(spark, sf).groupBy(F.regexp_replace("file_path", "/[^/]*$", "").alias("directory")).agg(F.collect_list("file_path").alias("files"))
    return m.select("directory", F.explode("files").alias("path")).filter(paths.extension(F.col("path")).isin("py", "rs"))


@query("d18_index_stats", S.sql("docs", "SELECT count(*) AS documents, count(DISTINCT file_path) AS files FROM docs"))
def d18(spark, sf):
    return S.docs(spark, sf).agg(F.count("*").alias("documents"), F.count_distinct("file_path").alias("files"))


@query("d27_newest_change", S.sql("raw_fact", "SELECT coalesce(CAST(floor(max(epoch(timestamp))) AS BIGINT), 0) AS newest FROM raw_fact"))
def d27(spark, sf):
    return S.fact(spark, sf).agg(F.coalesce(F.max(F.unix_timestamp("timestamp")), F.lit(0)).alias("newest"))


@query("f09_sorted_walk", S.sql("docs", "SELECT file_path FROM docs ORDER BY file_path"))
def f09(spark, sf):
    return S.docs(spark, sf).select("file_path").orderBy("file_path")


@query("g02_distinct_seen", S.sql("edges_p", "SELECT DISTINCT target, edge_type FROM edges_p"))
def g02(spark, sf):
    return S.edges_p(spark, sf).select("target", "edge_type").dropDuplicates()


@query("g07_extractor_union", S.sql("entities", "SELECT entity_key, CAST(count(*) AS BIGINT) AS seen, max(entity_type) AS entity_type FROM (SELECT entity_key, entity_type FROM entities UNION ALL SELECT entity_key, 'z-' || entity_type FROM entities WHERE entity_type = 'class') GROUP BY 1"))
def g07(spark, sf):
    e = S.entities(spark, sf).select("entity_key", "entity_type")
    later = e.filter("entity_type = 'class'").withColumn("entity_type", F.concat(F.lit("z-"), "entity_type"))
    return e.unionByName(later).groupBy("entity_key").agg(F.count("*").alias("seen"), F.max("entity_type").alias("entity_type"))


@query("i08_incremental_graph_merge", S.sql("docs entities " + _H, "SELECT entity_key, file_path FROM entities WHERE file_path NOT IN (SELECT path FROM chg WHERE change IN ('deleted', 'modified')) UNION ALL SELECT entity_key || '_v2', file_path FROM entities WHERE file_path IN (SELECT path FROM chg WHERE change = 'modified')", _CHG))
def i08(spark, sf):
    e, d = S.entities(spark, sf).select("entity_key", "file_path"), diff(spark, sf)
    mod = d.filter("change = 'modified'").select(F.col("path").alias("file_path"))
    fresh = e.join(mod, "file_path", "left_semi").select(F.concat("entity_key", F.lit("_v2")).alias("entity_key"), "file_path")
    none = spark.createDataFrame([], "source string, target string, edge_type string")
    return changes.merge_graph(e, none, d, fresh, none)[0]


# ---- graph -----------------------------------------------------------------------------------------------------------------

_DEG = "deg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM {0} UNION ALL SELECT target FROM {0}) GROUP BY 1)"
_DEGP, _DEGW = _DEG.format("edges_p"), _DEG.format("edges_w")


@query("d10_degree", S.sql("edges_p", "SELECT * FROM deg", _DEGP))
def d10(spark, sf):
    return graph.degree(S.edges_p(spark, sf))


@query("b10_min_degree_nodes", S.sql("edges_p", "SELECT * FROM deg WHERE degree >= 20", _DEGP))
def b10(spark, sf):
    return graph.nodes_of_degree(S.edges_p(spark, sf), 20)


_B11 = "SELECT e.* FROM edges_p e JOIN deg a ON a.node = source JOIN deg b ON b.node = target WHERE a.degree >= 5 AND b.degree >= 5"


@query("b11_edge_endpoint_degree", S.sql("edges_p", _B11, _DEGP))
def b11(spark, sf):
    return graph.edges_between_degree(S.edges_p(spark, sf), 5)


@query("c05_edges_join_degree", S.sql("edges_w", "SELECT e.source, e.target, e.edge_type, a.degree AS source_degree, b.degree AS target_degree FROM edges_w e JOIN deg a ON a.node = source JOIN deg b ON b.node = target", _DEGW))
def c05(spark, sf):
    e = S.edges_w(spark, sf)
    d = graph.degree(e)
    as_ = lambda c: d.select(F.col("node").alias(c), F.col("degree").alias(f"{c}_degree"))
    return e.join(as_("source"), "source", "left").join(as_("target"), "target", "left").select("source", "target", "edge_type", F.coalesce("source_degree", F.lit(0)).alias("source_degree"), F.coalesce("target_degree", F.lit(0)).alias("target_degree"))


_B12 = "SELECT * FROM edges_p WHERE source IN (SELECT node FROM deg WHERE degree >= 5) AND target IN (SELECT node FROM deg WHERE degree >= 5)"


@query("b12_induced_subgraph", S.sql("edges_p", _B12, _DEGP))
def b12(spark, sf):
    e = S.edges_p(spark, sf)
    return graph.induced(e, graph.nodes_of_degree(e, 5))


@query("c04_edges_semi_nodes", S.sql("edges_w", "SELECT * FROM edges_w WHERE source IN (SELECT node FROM deg WHERE degree >= 3) AND target IN (SELECT node FROM deg WHERE degree >= 3)", _DEGW))
def c04(spark, sf):
    e = S.edges_w(spark, sf)
    return graph.induced(e, graph.nodes_of_degree(e, 3))


@query("c20_client_edge_validity", S.sql("edges_w", "SELECT * FROM edges_w WHERE target IN (SELECT target FROM edges_w GROUP BY 1 HAVING count(*) > 1)"))
def c20(spark, sf):
    e = S.edges_w(spark, sf)
    return e.join(e.groupBy("target").agg(F.count("*").alias("n")).filter("n > 1").select("target"), "target", "left_semi").select("source", "target", "edge_type")


@query("b13_summary_projection", S.sql("edges_w", "SELECT node FROM deg", _DEGW))
def b13(spark, sf):
    return graph.degree(S.edges_w(spark, sf)).select("node")


@query("b14_external_exclusion", S.sql("edges_w", "SELECT * FROM edges_w WHERE NOT starts_with(source, 'external:') AND NOT starts_with(target, 'external:')"))
def b14(spark, sf):
    return graph.internal(S.edges_w(spark, sf))


@query("b16_edge_visibility", S.sql("edges_w", "SELECT * FROM edges_w WHERE edge_type NOT IN ('calls', 'imports_module')"))
def b16(spark, sf):
    return graph.visible(S.edges_w(spark, sf), {"calls": False, "imports_from": True, "imports_module": False, "inherits_from": True})


@query("b17_entity_required_fields", S.sql("entities", "SELECT entity_key, coalesce(CASE WHEN length(entity_key) % 3 > 0 THEN name END, string_split(entity_key, '::')[-1]) AS name FROM entities WHERE length(entity_key) % 5 > 0 AND length(name) % 4 > 0"))
def b17(spark, sf):
    n = F.length("entity_key")
    raw = S.entities(spark, sf).withColumns({"file_path": F.when(n % 5 > 0, F.col("file_path")), "entity_type": F.when(F.length("name") % 4 > 0, F.col("entity_type")), "name": F.when(n % 3 > 0, F.col("name"))})
    return graph.valid_entities(raw).select("entity_key", "name")


@query("b24_result_highlight", S.sql("docs", "SELECT node_id, file_name FROM docs WHERE contains(file_path, 'src3/') OR file_name = 'src3/'"))
def b24(spark, sf):
    return graph.highlighted(S.docs(spark, sf), "src3/")


@query("b21_entity_term_search", S.sql("queries entities", "SELECT q.query_id, min(entity_key) AS entity_key FROM (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(query), '[^a-z0-9]+')) AS term FROM queries) q JOIN entities e ON length(term) > 3 AND contains(lower(entity_key), term) GROUP BY 1"))
def b21(spark, sf):
    return retrieval.entity_search(S.queries(spark, sf), S.entities(spark, sf))


_FE = "fe AS (SELECT d.node_id, d.file_path, e.entity_key, e.name, e.entity_type, e.class_name FROM docs d JOIN entities e ON e.file_path = d.file_path OR e.file_path = d.file_name)"


@query("c02_child_counts", S.sql("docs entities", "SELECT d.node_id, count(*) FILTER (entity_type = 'function') AS function_count, count(*) FILTER (entity_type = 'class') AS class_count, count(*) FILTER (entity_type IN ('function', 'class')) AS total_children FROM docs d LEFT JOIN fe USING (node_id) WHERE d.ext IN ('.py', '.ts', '.rs', '.go') GROUP BY 1", _FE))
def c02(spark, sf):
    return graph.child_counts(S.docs(spark, sf), S.entities(spark, sf))


@query("d15_counts_per_file", S.sql("entities", "SELECT file_path, count(*) FILTER (entity_type = 'function') AS functions, count(*) FILTER (entity_type = 'class') AS classes, count(*) AS total FROM entities GROUP BY 1"))
def d15(spark, sf):
    is_ = lambda t: F.count_if(F.col("entity_type") == t)
    return S.entities(spark, sf).groupBy("file_path").agg(is_("function").alias("functions"), is_("class").alias("classes"), F.count("*").alias("total"))


@query("c06_module_children", S.sql("docs entities", "SELECT node_id, entity_key, name, entity_type FROM fe WHERE entity_type IN ('function', 'class')", _FE))
def c06(spark, sf):
    return graph.module_children(S.docs(spark, sf), S.entities(spark, sf))


def with_classes(spark, sf):
    """Entities in which methods name a class of their file."""
    e = S.entities(spark, sf)
    cls = e.filter("entity_type = 'class'").groupBy("file_path").agg(F.min("name").alias("first"))
    return e.join(cls, "file_path", "left").withColumn("class_name", F.when(F.col("entity_type") == "method", F.coalesce("first", "class_name"))).drop("first").select("entity_key", "name", "entity_type", "file_path", "class_name")


_WC = "wc AS (SELECT e.entity_key, e.name, e.entity_type, e.file_path, CASE WHEN e.entity_type = 'method' THEN coalesce(c.first, e.class_name) END AS class_name FROM entities e LEFT JOIN (SELECT file_path, min(name) AS first FROM entities WHERE entity_type = 'class' GROUP BY 1) c USING (file_path))"
_WFE = "wfe AS (SELECT d.node_id, d.file_path, e.entity_key, e.entity_type, e.class_name FROM docs d JOIN wc e ON e.file_path = d.file_path OR e.file_path = d.file_name)"
_METH = "SELECT m.node_id, m.entity_key AS source, m.file_path || '::' || m.class_name AS target FROM wfe m WHERE m.entity_type = 'method' AND (m.node_id, m.file_path || '::' || m.class_name) IN (SELECT (node_id, entity_key) FROM wfe WHERE entity_type = 'class')"


@query("c07_method_to_class", S.sql("docs entities", _METH, _WC, _WFE))
def c07(spark, sf):
    return graph.method_edges(S.docs(spark, sf), with_classes(spark, sf))


@query("j04_module_children", S.sql("docs entities", f"SELECT node_id, 'node' AS kind, entity_key AS source, '' AS target FROM wfe WHERE entity_type IN ('function', 'class') UNION ALL SELECT node_id, 'edge', source, target FROM ({_METH})", _WC, _WFE))
def j04(spark, sf):
    d, e = S.docs(spark, sf), with_classes(spark, sf)
    kids = graph.module_children(d, e).select("node_id", F.lit("node").alias("kind"), F.col("entity_key").alias("source"), F.lit("").alias("target"))
    return kids.unionByName(graph.method_edges(d, e).select("node_id", F.lit("edge").alias("kind"), "source", "target"))


@query("c08_node_labels", S.sql("docs entities edges_w", "SELECT node, coalesce(d.file_name, e.name, CASE WHEN starts_with(node, 'external:') THEN string_split(substr(node, 10), '.')[-1] END, node) AS label, coalesce(d.file_path, e.file_path) AS file_path FROM nodes LEFT JOIN docs d ON d.node_id::VARCHAR = node LEFT JOIN (SELECT entity_key, min(name) AS name, min(file_path) AS file_path FROM entities GROUP BY 1) e ON entity_key = node", "nodes AS (SELECT node_id::VARCHAR AS node FROM docs UNION SELECT entity_key FROM entities UNION SELECT target FROM edges_w)"))
def c08(spark, sf):
    d, e = S.docs(spark, sf), S.entities(spark, sf)
    nodes = d.select(F.col("node_id").cast("string").alias("node")).union(e.select("entity_key")).union(S.edges_w(spark, sf).select("target")).distinct()
    return graph.labels(nodes, d, e)


_REFS = ["/src0/doc_0.py", "doc_7.ts", "doc_8", "src14/doc_14.rs", "x/doc_21.go::Thing", "external:os.path", "nowhere.f::g", "doc_12.py::C.m", "external:doc_30"]
_SUF = "suf AS (SELECT suffix, arg_min(node_id, file_path) AS id FROM (SELECT node_id, file_path, array_to_string(p[i:], '/') AS suffix FROM (SELECT node_id, file_path, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT node_id, file_path, list_filter(string_split(file_path, '/'), lambda x: x <> '') AS p FROM docs))) GROUP BY 1)"


def _cands(ref: str) -> str:
    base, ext = f"regexp_extract({ref}, '[^/]*$')", f"regexp_extract(regexp_extract({ref}, '[^/]*$'), '^.+\\.([^.]*)$', 1)"
    stem = f"regexp_replace({base}, '^(.+)\\.[^.]*$', '\\1')"
    return f"([{ref}, {base}, {stem}] || CASE WHEN {ext} IN ('py', '') THEN [{ref} || '.py', replace({ref}, '.', '/') || '.py', {stem} || '.py'] ELSE [] END || CASE WHEN {ext} IN ('rs', '') THEN [{ref} || '.rs', {stem} || '.rs'] ELSE [] END)"


_RES = "res AS (SELECT r.ref, coalesce(f.id::VARCHAR, 'entity:' || replace(r.ref, '::', '.')) AS id FROM refs r LEFT JOIN (SELECT ref, arg_min(s.id, i) AS id FROM (SELECT ref, c[i] AS cand, i FROM (SELECT ref, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT ref, " + _cands("ref") + " || " + _cands("string_split(ref, '::')[1]") + " AS c FROM refs))) JOIN suf s ON s.suffix = cand GROUP BY 1) f ON f.ref = r.ref WHERE f.id IS NOT NULL OR NOT starts_with(r.ref, 'external:'))"


@query("c03_endpoint_resolution", S.sql("docs", "SELECT * FROM res", "refs(ref) AS (VALUES " + ", ".join(f"('{r}')" for r in _REFS) + ")", _SUF, _RES))
def c03(spark, sf):
    return graph.resolve(spark.createDataFrame([(r,) for r in _REFS], "ref string"), S.docs(spark, sf))


_RELS = "rels AS (SELECT source || '/x' AS source, target, edge_type FROM edges_w UNION ALL SELECT 'doc_' || node_id, 'doc_' || (node_id * 3 % 400) || '::f', 'calls' FROM docs)"


@query("j01_graph_build", S.sql("docs edges_w", "SELECT a.id AS source, b.id AS target, edge_type FROM rels JOIN res a ON a.ref = source JOIN res b ON b.ref = target", _RELS, "refs AS (SELECT source AS ref FROM rels UNION SELECT target FROM rels)", _SUF, _RES))
def j01(spark, sf):
    d = S.docs(spark, sf)
    rels = S.edges_w(spark, sf).withColumn("source", F.concat("source", F.lit("/x"))).unionByName(
        d.select(F.concat(F.lit("doc_"), F.col("node_id").cast("string")).alias("source"), F.concat(F.lit("doc_"), (F.col("node_id") * 3 % 400).cast("string"), F.lit("::f")).alias("target"), F.lit("calls").alias("edge_type"))
    )
    return graph.build(rels, d)


@query("j05_node_resolution", S.sql("docs", "SELECT ref, id FROM res WHERE NOT starts_with(id, 'entity:')", "refs AS (SELECT 'doc_' || node_id || '::x' AS ref FROM docs)", _SUF, _RES))
def j05(spark, sf):
    d = S.docs(spark, sf)
    refs = d.select(F.concat(F.lit("doc_"), F.col("node_id").cast("string"), F.lit("::x")).alias("ref"))
    return graph.resolve(refs, d).filter(~F.startswith("id", F.lit("entity:")))


@query("d11_graph_stats", S.sql("edges_w entities", "SELECT (SELECT count(*) FROM deg) AS total_nodes, (SELECT count(*) FROM edges_w) AS total_edges, (SELECT count(*) FROM entities) AS total_entities", _DEGW))
def d11(spark, sf):
    return graph.stats(S.edges_w(spark, sf), S.entities(spark, sf))


@query("d12_by_relation_type", S.sql("edges_p", "SELECT edge_type, count(*) AS n FROM edges_p GROUP BY 1"))
def d12(spark, sf):
    return graph.by_relation(S.edges_p(spark, sf))


_EXT = "regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+\\.([^.]*)$', 1)"


@query("d13_entities_by_language", S.sql("entities", f"SELECT CASE WHEN {_EXT} = 'py' THEN 'python' WHEN {_EXT} IN ('ts', 'tsx') THEN 'typescript' WHEN {_EXT} = 'rs' THEN 'rust' WHEN {_EXT} = 'go' THEN 'go' ELSE 'other' END AS language, count(*) AS n FROM entities GROUP BY 1"))
def d13(spark, sf):
    return graph.by_language(S.entities(spark, sf))


@query("d14_extraction_stats", S.sql("edges_w", "SELECT edge_type, coalesce(lang, 'python') AS lang, count(*) AS n FROM (SELECT edge_type, CASE length(target) % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'go' END AS lang FROM edges_w) GROUP BY 1, 2"))
def d14(spark, sf):
    lang = F.when(F.length("target") % 3 == 0, "rust").when(F.length("target") % 3 == 1, "go")
    return S.edges_w(spark, sf).withColumn("lang", lang).groupBy("edge_type", F.coalesce("lang", F.lit("python")).alias("lang")).agg(F.count("*").alias("n"))


@query("f02_top_connected", S.sql("edges_p", "SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 10", _DEGP))
def f02(spark, sf):
    return graph.top_connected(S.edges_p(spark, sf))


@query("h15_edge_weight", S.sql("edges_w dim_weight", f"SELECT source, target, coalesce(weight, {K.EDGE_WEIGHT_DEFAULT}::DOUBLE) AS weight FROM edges_w LEFT JOIN dim_weight USING (edge_type)"))
def h15(spark, sf):
    return S.edges_w(spark, sf).select("source", "target", graph.weight(F.col("edge_type")).alias("weight"))


@query("h16_edge_display", S.sql("edges_w", "SELECT source, target, edge_type, 'e-' || left(source, 8) || '-' || left(target, 8) || '-' || left(edge_type, 4) AS id, replace(edge_type, '_', ' ') AS label FROM edges_w"))
def h16(spark, sf):
    return graph.edge_display(S.edges_w(spark, sf))


@query("h21_entity_key_split", S.sql("entities", "SELECT entity_key, string_split(entity_key, '::')[1] AS file, string_split(entity_key, '::')[-1] AS last, 'entity:' || replace(entity_key, '::', '.') AS id FROM entities"))
def h21(spark, sf):
    parts = F.split("entity_key", "::")
    return S.entities(spark, sf).select("entity_key", F.element_at(parts, 1).alias("file"), F.element_at(parts, -1).alias("last"), F.concat(F.lit("entity:"), F.replace("entity_key", F.lit("::"), F.lit("."))).alias("id"))


@query("h32_node_size", S.sql("edges_p", "SELECT node, CAST(least(120, 40 + 8 * degree) AS BIGINT) AS size FROM deg", _DEGP))
def h32(spark, sf):
    return graph.degree(S.edges_p(spark, sf)).select("node", graph.node_size(F.col("degree")).cast("long").alias("size"))


@query("e02_first_by_path", S.sql("docs", "SELECT source || ext AS file_path, min(node_id) AS node_id FROM docs GROUP BY 1"))
def e02(spark, sf):
    return graph.first_by_path(S.docs(spark, sf).withColumn("file_path", F.concat("source", "ext")))


@query("j12_node_edges", S.sql("edges_p", "SELECT 'out' AS way, target AS node, edge_type FROM edges_p WHERE source = 'c:7' UNION ALL SELECT 'in', source, edge_type FROM edges_p WHERE target = 'c:7'"))
def j12(spark, sf):
    e = S.edges_p(spark, sf)
    return e.filter("source = 'c:7'").select(F.lit("out").alias("way"), F.col("target").alias("node"), "edge_type").union(e.filter("target = 'c:7'").select(F.lit("in"), "source", "edge_type"))


_WALK = "walk AS (SELECT source AS here, target AS node, edge_type, 'outgoing' AS direction, source, target, 0 AS way FROM {0} UNION ALL SELECT target, source, edge_type, 'incoming', source, target, 1 FROM {0})"
_L1 = "l1 AS (SELECT node, min((source, target, edge_type, way)) AS o, arg_min(edge_type, (source, target, edge_type, way)) AS edge_type, arg_min(direction, (source, target, edge_type, way)) AS direction FROM walk WHERE here = '{0}' AND node <> '{0}' GROUP BY 1)"
_L2 = "l2 AS (SELECT w.node, arg_min(w.edge_type, (l.o, (w.source, w.target, w.edge_type, w.way))) AS edge_type, arg_min(w.direction, (l.o, (w.source, w.target, w.edge_type, w.way))) AS direction FROM walk w JOIN l1 l ON l.node = w.here WHERE w.node <> '{0}' AND w.node NOT IN (SELECT node FROM l1) GROUP BY 1)"


@query("j03_neighbours", S.sql("edges_w", "SELECT node, 1 AS level, edge_type, direction FROM l1 UNION ALL SELECT node, 2, edge_type, direction FROM l2", _WALK.format("edges_w"), _L1.format("/page/1"), _L2.format("/page/1")))
def j03(spark, sf):
    return graph_search.neighbours(S.edges_w(spark, sf), "/page/1", 2)


@query("b15_relation_type_filter", S.sql("edges_w", "SELECT node, 1 AS level, edge_type, direction FROM l1 WHERE edge_type = 'calls' UNION ALL SELECT node, 2, edge_type, direction FROM l2 WHERE edge_type = 'calls'", _WALK.format("edges_w"), _L1.format("/page/1"), _L2.format("/page/1")))
def b15(spark, sf):
    return graph_search.neighbours(S.edges_w(spark, sf), "/page/1", 2, "calls")


@query("c16_frontier_expansion", S.sql("edges_p", "SELECT node, edge_type FROM l1", _WALK.format("edges_p"), _L1.format("c:7")))
def c16(spark, sf):
    return graph_search.neighbours(S.edges_p(spark, sf), "c:7", 1).select("node", "edge_type")


_DIST = "RECURSIVE dist(node, d) USING KEY (node) AS (SELECT 'o:0' AS node, 0.0::DOUBLE AS d UNION (SELECT w.there, min(dist.d + w.w) AS d FROM dist JOIN w ON w.here = dist.node LEFT JOIN recurring.dist r ON r.node = w.there WHERE r.d IS NULL OR dist.d + w.w < r.d GROUP BY 1))"
_W = f"w AS (SELECT here, there, min(weight) AS w FROM (SELECT source AS here, target AS there, coalesce(weight, {K.EDGE_WEIGHT_DEFAULT}) AS weight FROM edges_p LEFT JOIN dim_weight USING (edge_type) UNION ALL SELECT target, source, coalesce(weight, {K.EDGE_WEIGHT_DEFAULT}) FROM edges_p LEFT JOIN dim_weight USING (edge_type)) GROUP BY 1, 2)"


@query("c17_relaxation", S.sql("edges_p dim_weight", "SELECT node, d AS dist FROM dist", _W, _DIST))
def c17(spark, sf):
    return graph_search.distances(S.edges_p(spark, sf), "o:0").select("node", "dist")


@query("j02_shortest_path", S.sql("edges_p dim_weight", "SELECT d AS total_cost FROM dist WHERE node = 'p:9'", _W, _DIST))
def j02(spark, sf):
    return graph_search.shortest_path(S.edges_p(spark, sf), "o:0", "p:9").select("total_cost").distinct()


_WALK = (
    # edges on a shortest path; a node's previous one is the least of those that were near first, in the fewest hops
    f"tight AS (SELECT w.here, w.there, w.w, arg_min(e.edge_type, (e.weight, e.edge_type)) AS edge_type FROM w JOIN dist a ON a.node = w.here JOIN dist b ON b.node = w.there JOIN (SELECT source AS here, target AS there, edge_type, coalesce(weight, {K.EDGE_WEIGHT_DEFAULT}) AS weight FROM edges_p LEFT JOIN dim_weight USING (edge_type) UNION ALL SELECT target, source, edge_type, coalesce(weight, {K.EDGE_WEIGHT_DEFAULT}) FROM edges_p LEFT JOIN dim_weight USING (edge_type)) e ON e.here = w.here AND e.there = w.there WHERE a.d + w.w = b.d GROUP BY 1, 2, 3)",
    "hop(node, h) USING KEY (node) AS (SELECT 'o:0', 0 UNION (SELECT t.there, min(hop.h) + 1 FROM hop JOIN tight t ON t.here = hop.node LEFT JOIN recurring.hop r ON r.node = t.there WHERE r.node IS NULL GROUP BY 1))",
    "prior AS (SELECT t.there AS node, arg_min(t.here, t.here) AS here, arg_min(t.edge_type, t.here) AS edge_type, arg_min(t.w, t.here) AS w FROM tight t JOIN hop a ON a.node = t.here JOIN hop b ON b.node = t.there WHERE a.h = b.h - 1 GROUP BY 1)",
    "walk(back, node, edge_type, w) AS (SELECT 0, 'p:9', NULL::VARCHAR, NULL::DOUBLE UNION ALL SELECT back + 1, p.here, p.edge_type, p.w FROM walk JOIN prior p USING (node))",
)


@query("j02_path_steps", S.sql("edges_p dim_weight", "SELECT CAST((SELECT max(back) FROM walk) - back AS BIGINT) AS step, node, edge_type, w AS edge_cost, (SELECT d FROM dist WHERE node = 'p:9') AS total_cost FROM walk WHERE EXISTS (SELECT 1 FROM dist WHERE node = 'p:9')", _W, _DIST, *_WALK))
def j02_steps(spark, sf):
    return graph_search.shortest_path(S.edges_p(spark, sf), "o:0", "p:9")


_LINK = "lk AS (SELECT source AS a, target AS b FROM edges_w UNION SELECT target, source FROM edges_w)"
_COMP = "RECURSIVE comp(node, c) USING KEY (node) AS (SELECT a AS node, min(a) AS c FROM lk GROUP BY 1 UNION (SELECT lk.b, min(comp.c) AS c FROM comp JOIN lk ON lk.a = comp.node JOIN recurring.comp r ON r.node = lk.b WHERE comp.c < r.c GROUP BY 1))"


@query("j06_components", S.sql("edges_w", "SELECT node, c AS component FROM comp", _LINK, _COMP))
def j06(spark, sf):
    return graph_search.components(S.edges_w(spark, sf))


_COUNTS = "SELECT CAST(sum(n) AS BIGINT) AS nodes, (SELECT count(*) FROM edges_w) AS edges, count(*) FILTER (n > 1) AS clusters, count(*) FILTER (n = 1) AS isolated FROM (SELECT c, count(*) AS n FROM comp GROUP BY 1)"


@query("d26_component_counts", S.sql("edges_w", _COUNTS, _LINK, _COMP))
def d26(spark, sf):
    return graph_search.component_counts(S.edges_w(spark, sf))


@query("j09_insight", S.sql("edges_w", f"SELECT CASE WHEN clusters > 1 THEN clusters || ' connected clusters.' ELSE 'Fully connected codebase.' END || ' Graph density: ' || printf('%.3f', 2.0::DOUBLE * edges / (nodes * (nodes - 1))) || '.' AS insight FROM ({_COUNTS})", _LINK, _COMP))
def j09(spark, sf):
    return graph.insight(graph_search.component_counts(S.edges_w(spark, sf)))


def _between(edges: str) -> tuple[str, ...]:
    """bc(node, score): Brandes' algorithm. far counts the shortest paths from every s, level by level; back sums the shares
    of pairs from the last level to the first; each recursion sees the level before."""
    return (
        f"link AS (SELECT source AS a, target AS b FROM {edges} WHERE source <> target UNION SELECT target, source FROM {edges} WHERE source <> target)",
        "RECURSIVE far(s, v, d, paths) USING KEY (s, v) AS (SELECT DISTINCT a, a, 0, 1.0::DOUBLE FROM link UNION (SELECT f.s, link.b, min(f.d) + 1, sum(f.paths) FROM far f JOIN link ON link.a = f.v LEFT JOIN recurring.far r ON r.s = f.s AND r.v = link.b WHERE r.v IS NULL GROUP BY f.s, link.b))",
        "every AS MATERIALIZED (SELECT * FROM far)",
        "back(d, s, v, paths, share) AS (SELECT d, s, v, paths, 0.0::DOUBLE FROM every WHERE d = (SELECT max(d) FROM every) UNION ALL (SELECT e.d, e.s, e.v, e.paths, coalesce(sum(e.paths / w.paths * (1 + w.share)), 0.0) FROM (SELECT max(d) AS top FROM back) t JOIN every e ON e.d = t.top - 1 LEFT JOIN link ON link.a = e.v LEFT JOIN back w ON w.s = e.s AND w.v = link.b GROUP BY e.d, e.s, e.v, e.paths))",
        "bc AS (SELECT v AS node, round(coalesce(sum(share) FILTER (s <> v), 0.0) / greatest(1.0, (n - 1.0) * (n - 2.0)), 9) AS score FROM back, (SELECT count(DISTINCT a) AS n FROM link) GROUP BY v, n)",
    )


@query("j07_betweenness", S.sql("edges_w", "SELECT node, score FROM bc", *_between("edges_w")))
def j07(spark, sf):
    return graph_search.betweenness(S.edges_w(spark, sf))


@query("j07_betweenness_rounds", S.sql("edges_w", "SELECT node, score FROM bc", *_between("edges_w")))
def j07_rounds(spark, sf):
    """The form for graphs of any size."""
    return centrality.betweenness(S.edges_w(spark, sf))


@query("f03_bridges", S.sql("edges_w", "SELECT node, score FROM bc WHERE score > 0.01 ORDER BY score DESC, node LIMIT 5", *_between("edges_w")))
def f03(spark, sf):
    return graph_search.bridges(S.edges_w(spark, sf))


@query("j08_articulation", S.sql("edges_t", "SELECT node, score, degree FROM bc JOIN (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges_t UNION ALL SELECT target FROM edges_t) GROUP BY 1) USING (node) WHERE score > 0.5 AND degree >= 2", *_between("edges_t")))
def j08(spark, sf):
    return graph_search.articulation(S.edges_t(spark, sf))


@query("j10_layout")
def j10(spark, sf):
    return graph_search.layout(S.edges_w(spark, sf))
