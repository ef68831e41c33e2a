"""Betweenness in rounds against a plain breadth-first loop and the broadcast form."""

import random
from collections import defaultdict, deque

import pytest

from lorespark.operators import centrality, graph_search


def brute(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    score = dict.fromkeys(near, 0.0)
    for s in near:
        far, paths, order, queue = {s: 0}, defaultdict(int, {s: 1}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        share = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if far[v] == far[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    n = len(near)
    return {k: v / max(1.0, (n - 1) * (n - 2)) for k, v in score.items()}


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source string, target string, edge_type string")


def graph(n, m, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(n)}", f"n{min(int(r.paretovariate(0.8)), n)}") for _ in range(m)]
    return pairs + [("x1", "x2"), ("x2", "x3"), ("x3", "x3"), ("x1", "x2"), ("x2", "x1")]


def test_rounds_against_brute_force(spark):
    pairs = graph(40, 60, 1)
    e = frame(spark, pairs)
    want = brute(pairs)
    for got in (centrality.betweenness(e), centrality.betweenness(e, state_rows=700), graph_search.betweenness(e)):
        scores = {r.node: r.score for r in got.collect()}
        assert scores == pytest.approx(want, abs=1e-8)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(6)]
    monkeypatch.setattr(graph_search, "MAX_BETWEENNESS_EDGES", 3)
    assert {r.node: r.score for r in graph_search.betweenness(frame(spark, pairs)).collect()} == pytest.approx(brute(pairs), abs=1e-8)


def test_samples_are_within_the_error(spark):
    pairs = graph(60, 90, 2)
    want = brute(pairs)
    got = {r.node: r.score for r in centrality.sampled(frame(spark, pairs), error=0.3, failure=0.05).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) <= 0.3
    every = {r.node: r.score for r in centrality.sampled(frame(spark, pairs), error=0.01).collect()}  # as many as there are
    assert every == pytest.approx(want, abs=1e-8)


def test_small_graphs(spark):
    assert centrality.betweenness(frame(spark, [("a", "a")])).count() == 0
    assert {r.node: r.score for r in centrality.betweenness(frame(spark, [("a", "b")])).collect()} == {"a": 0.0, "b": 0.0}
    assert centrality.betweenness(frame(spark, [("a", "b")]).limit(0)).count() == 0


def test_nodes_with_the_same_neighbours_are_one(spark, monkeypatch):
    """Twins of several sizes, next to each other's classes and on their own, have the scores of the plain loop."""
    r = random.Random(3)
    kinds = [r.sample(range(9), r.randint(1, 3)) for _ in range(7)]
    pairs = [(f"p{k}-{i}", f"t{t}") for k, ts in enumerate(kinds) for i in range(1 + 2 * k) for t in ts]
    pairs += [(f"t{i}", f"l{i}-{j}") for i in range(0, 9, 4) for j in range(4)] + [("t1", "t2"), ("s", "s1"), ("s", "s2"), ("s", "s3")]
    want, e = brute(pairs), frame(spark, pairs)
    for got in (centrality.betweenness(e), centrality.betweenness(e, state_rows=300), graph_search.betweenness(e)):
        assert {x.node: x.score for x in got.collect()} == pytest.approx(want, abs=1e-8)
    of, nodes, links = centrality.merged(centrality.undirected(e))
    assert nodes.count() < of.count() / 2 and links.count() < 2 * len(pairs) / 2


def test_many_twins_stay_within_the_broadcast_bound(spark, monkeypatch):
    """The bound is on the classes' edges: a graph with more edges than it, of few classes, needs no rounds."""
    pairs = [(f"p{i}", f"t{(i % 3) + j}") for i in range(60) for j in range(2)]
    monkeypatch.setattr(graph_search, "MAX_BETWEENNESS_EDGES", 20)
    monkeypatch.setattr(centrality, "_levels", None)
    assert {r.node: r.score for r in graph_search.betweenness(frame(spark, pairs)).collect()} == pytest.approx(brute(pairs), abs=1e-8)
