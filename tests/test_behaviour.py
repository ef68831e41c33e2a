"""Literal cases of the behaviour that results must agree on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions import paths, text
from lorespark.operators import cache, changes, chunking, classify, costs, extract, graph, graph_search, metrics, retrieval


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_normalize(spark):
    said = "Can you explain how the auth module works?"
    once = column(spark, [said], text.normalize_query)[0]
    assert "can you" not in once and "explain" not in once and all(w in once for w in ("auth", "module", "work"))
    assert column(spark, [once], text.normalize_query)[0] == once


def test_confidence(spark):
    a, b, c = column(spark, ["connect to the database from auth", "how do modules work", "caching"], classify.keyword_confidence)
    assert a.label == "structural" and a.confidence >= 0.7
    assert b.confidence < 0.75
    assert (c.label, c.confidence) == ("semantic", 0.9)


def test_quick_check(spark):
    assert column(spark, ["Path from main to utils", "What is the purpose of caching?"], classify.quick_check) == ["structural", "semantic"]


def test_freshness(spark):
    got = column(spark, [0.0, None, 720.0, 84.0], text.freshness, "double")
    assert got[0] >= 0.99 and got[1] == 0.5 and got[2] == 0.0 and 0.4 <= got[3] <= 0.6


def test_exclusion(spark):
    assert column(spark, [".git/config", "node_modules/package.json", "image.png", "readme.md", "src/layout.py"], paths.excluded) == [True, True, True, False, True]


@pytest.mark.parametrize(("values", "want"), [(["a/.env", "x/key.PEM", "readme"], [True, True, False])])
def test_blocked(spark, values, want):
    assert column(spark, values, paths.blocked) == want


def test_sensitive(spark):
    values = ["api_key = abc", "http://localhost/x", "go to 10.0.0.1 now", "internal.corp.net", "-----BEGIN PRIVATE KEY-----", "plain"]
    assert column(spark, values, text.is_sensitive) == [True] * 5 + [False]
    assert column(spark, ["password: x1 ok"], text.redact) == ["[REDACTED] ok"]


def test_recorded_actual_tokens(spark):
    row = [("query", "openai/gpt-4o", 0, 0, 500, 200, 100)]
    r = costs.recorded(spark.createDataFrame(row, "query_type string, model string, tokens_in long, tokens_out long, actual_prompt long, actual_completion long, actual_embedding long")).first()
    assert (r.tokens_in, r.tokens_out) == (600, 200) and r.cost == round(0.000002 + 0.00125 + 0.002, 6)


def test_empty_log(spark):
    none = spark.createDataFrame([], "day string, query_type string, cost double, tokens_in long, tokens_out long, embedding_cost double, llm_input_cost double, llm_output_cost double, docs_retrieved long, duration_ms long")
    r = metrics.summary(none).first()
    assert (r.total_queries, r.total_cost, r.savings_percent) == (0, 0.0, 0.0)
    assert metrics.by_type(none).count() == metrics.server_daily(none).count() == 0


def test_fifo(spark):
    rows = spark.createDataFrame([(i, 100 + i) for i in range(5)], "event_id long, stored_at long")
    assert sorted(r.event_id for r in cache.newest(rows, 3).collect()) == [2, 3, 4]


def test_manifest_counts(spark):
    counts = spark.createDataFrame([("d", 2)], "directory string, document_count long")
    up = changes.manifest_update(counts, spark.createDataFrame([("d", 1), ("e", 1), ("e", -5)], "directory string, change int"))
    assert [(r.directory, r.document_count) for r in up.collect()] == [("d", 3)]


def test_diff_and_upsert(spark):
    s = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    prev, cur = s([("a", "1"), ("b", "1"), ("c", "1")]), s([("a", "1"), ("b", "2"), ("d", "1")])
    d = changes.diff(prev, cur)
    assert {(r.path, r.change) for r in d.collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}
    assert sorted(tuple(r) for r in changes.upsert(prev, cur, d).collect()) == [("a", "1"), ("b", "2"), ("d", "1")]


EDGES = [("a", "b", "calls"), ("b", "c", "imports_module"), ("a", "c", "imports_module"), ("c", "external:x", "calls"), ("d", "e", "calls"), ("a", "a", "calls")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "source string, target string, edge_type string")


def test_degree_counts_loops_twice(edges):
    assert {r.node: r.degree for r in graph.degree(edges).collect()} == {"a": 4, "b": 2, "c": 3, "external:x": 1, "d": 1, "e": 1}


def test_shortest_path(edges):
    p = graph_search.shortest_path(edges, "b", "c").orderBy("step").collect()
    assert [(r.node, r.edge_type, r.edge_cost) for r in p] == [("b", "imports_module", 3.0), ("c", None, None)] and p[0].total_cost == 3.0
    assert graph_search.shortest_path(edges, "a", "a").count() == 1
    assert graph_search.shortest_path(edges, "a", "e").count() == 0
    assert graph_search.shortest_path(edges, "a", "external:x").count() == 0


def test_neighbours(edges):
    n = {r.node: (r.level, r.direction) for r in graph_search.neighbours(edges, "b", 9).collect()}
    assert n == {"a": (1, "incoming"), "c": (1, "outgoing"), "external:x": (2, "outgoing")}
    assert graph_search.neighbours(edges, "zz", 2).count() == 0


def test_components_and_insight(spark, edges):
    c = {r.node: r.component for r in graph_search.components(edges).collect()}
    assert c["external:x"] == c["b"] == "a" and c["e"] == "d"
    assert graph.insight(graph_search.component_counts(edges)).first()[0].startswith("2 connected clusters.")
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", "calls") for i in range(120)], "source string, target string, edge_type string")
    assert {r.component for r in graph_search.components(chain).collect()} == {"n000"}


def test_betweenness_of_a_star(spark):
    star = spark.createDataFrame([("hub", f"l{i}", "calls") for i in range(5)], "source string, target string, edge_type string")
    assert {r.node: r.score for r in graph_search.betweenness(star).collect()}["hub"] == 1.0
    xy = graph_search.force_layout(6, np.array([(0, i) for i in range(1, 6)]), 50)
    assert xy.shape == (6, 2) and np.isfinite(xy).all() and xy.min() == 50


def test_vector_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, [1.0, 1.0]), (6, None)], "node_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = [(r.node_id, r.score) for r in retrieval.vector_search(v, q, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (5, 0.707107), (2, 0.0)]
    assert retrieval.vector_search(v, q.limit(0), 3).count() == 0
    assert retrieval.vector_search(v.limit(0), q, 3).count() == 0


def test_hybrid_fills_only_what_is_missing(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "query_id long, node_id long, score double, rank int")
    got = retrieval.hybrid(ranked([(0, 1, 0.9, 1), (0, 2, 0.8, 2)]), ranked([(0, 2, 7.0, 1), (0, 9, 6.0, 2)]), 3)
    assert [(r.node_id, r.origin) for r in got.orderBy("rank").collect()] == [(1, "vector"), (2, "vector"), (9, "bm25")]


def test_mlp_learns_its_examples():
    net = classify.train_mlp()
    right = 0
    for q, label in classify.TRAINING:
        h = np.maximum(0, np.array(classify._features_of(q)) @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]
        right += int(h.argmax()) == label
    assert right >= 25


def test_routes(spark):
    said = [("a", "reindex the files"), ("b", "what depends on main"), ("c", "link between x"), ("d", "tell a lie")]
    got = {r.query_id: r.routed_to for r in classify.route(spark.createDataFrame(said, "query_id string, query string")).collect()}
    assert got == {"a": "indexing_architecture" and "artifact", "b": "graph", "c": "hybrid", "d": "vector"}


SAMPLE = "def top():\n    return 1\n\nclass Box(Base):\n    def one(self):\n        return self.a.go()\n\n    def two(self):\n        return top()\n"


def test_python_sample():
    kinds = [(c.type, c.name) for c in chunking.chunk("x.py", SAMPLE)]
    assert kinds == [("function", "top"), ("class", "Box"), ("method", "one"), ("method", "two")]
    found = list(extract.findings("x.py", SAMPLE))
    assert [r[4] for r in found if r[1] == "entity"] == ["Box", "one", "two"]
    assert {r[4] for r in found if r[2] == "calls"} >= {"self.a.go", "top"}
    assert [(c.type, c.name) for c in chunking.chunk("x.py", "def (")] == [("module", "x")]
    assert list(extract.findings("x.py", "def (")) == [] and list(extract.findings("x.bin", None)) == []


def test_packed_lines_keep_the_text():
    said = "".join(f"line {i}\n" for i in range(3000))
    parts = chunking.packed_lines(said, "t", 6000)
    assert "".join(c.content for c in parts) == said and max(len(c.content) for c in parts) <= 6000
    assert parts[0].start_line == 1 and parts[-1].end_line == 3000 and all(a.end_line + 1 == b.start_line for a, b in zip(parts, parts[1:]))


def test_candidates(spark):
    got = column(spark, ["a/b.py", "os.path", "x.rs"], paths.lookup_candidates)
    assert got[0] == ["a/b.py", "b.py", "b", "a/b.py.py", "a/b/py.py", "b.py"]
    assert got[1] == ["os.path", "os.path", "os"] and got[2][-2:] == ["x.rs.rs", "x.rs"]


def test_artifact_staleness(spark):
    deps = spark.createDataFrame([("a", "p", "1"), ("b", "q", "1"), ("c", "gone", "1"), ("d", "p", "1")], "artifact_id string, path string, expected string")
    now = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha256 string")
    age = spark.createDataFrame([("d", 4000)], "artifact_id string, age_seconds long")
    assert {r.artifact_id: r.stale for r in cache.stale_artifacts(deps, now, age).collect()} == {"a": False, "b": True, "c": True, "d": True}


def test_sdk_fallbacks(spark):
    docs = spark.createDataFrame([("l", "t", "T", 0, 7), ("l", "general", "G", 10**6, 7), ("m", "t", "M", 0, 7)], "library string, topic string, doc string, fetched_at long, ttl_days int")
    wanted = spark.createDataFrame([("l", "t"), ("l", "u"), ("m", "t"), ("z", "t")], "library string, topic string")
    got = {(r.library, r.topic): r.how for r in cache.sdk_get(wanted, docs, 10**6 + 5).collect()}
    assert got == {("l", "t"): "general", ("l", "u"): "general", ("m", "t"): "stale topic", ("z", "t"): None}


def test_lsh_recall(spark):
    from lorespark.plans import standins

    v = standins.vectors(spark, "/root/testdata/sf0.01")
    q = v.filter("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    pairs = lambda df: {(r.query_id, r.node_id) for r in df.collect()}
    want = pairs(retrieval.vector_search(v, q, 5))
    assert len(want & pairs(retrieval.lsh_search(v, q, 5))) >= 0.9 * len(want)


def test_entity_search(spark):
    q = spark.createDataFrame([("a", "What does Config do"), ("b", "go to it"), ("c", None)], "query_id string, query string")
    e = spark.createDataFrame([("src/config.py::MyConfig",), ("a/CONFIGURE.py::X",), ("abc",), (None,)], "entity_key string")
    assert [tuple(r) for r in retrieval.entity_search(q, e).collect()] == [("a", "a/CONFIGURE.py::X")]


def test_all_cosines_need_no_pair_join(spark, monkeypatch):
    """Every pair once, in blocks of any size, with the rows of the plain expression also for odd vectors."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "ROWS", 3)
    said = [[1.0, 2.0], [2.0, -1.0], [-3.0, 0.5], [0.0, 0.0], [1.0], [], None, [1.0, None], [1e-11, 0.0], [4.0, 8.0]]
    v = spark.createDataFrame(list(enumerate(said)), "node_id long, embedding array<double>")
    q = v.withColumnRenamed("node_id", "query_id")
    pairs = v.crossJoin(q.withColumnRenamed("embedding", "q")).select("query_id", "node_id", F.round(text.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    got = retrieval.cosines(v, q)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, pairs.collect())))
    assert "Join" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert retrieval.cosines(v.limit(0), q).count() == 0 and retrieval.cosines(v, q.limit(0)).count() == 0
