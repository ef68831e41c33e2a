"""The registered queries without SQL, compared with plain Python."""

import datetime as dt
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lorespark.operators import classify, graph_search
from lorespark.plans import standins as S
from lorespark.plans.all_queries import QUERIES

CHECKED = ["i02_debounced_stream", "i11_semantic_cache_stream", "j10_layout", "k02_lsh_search", "k02_vector_index", "l05_mlp_training"]


@pytest.fixture(scope="module")
def events(sf):
    return duckdb.sql(f"select event_id, ts, event_type, user_id from '{sf}/events.parquet' order by ts, event_id").fetchall()


def test_debounced_stream(spark, sf, events):
    """Bursts by path with gaps of at most six hours, of those that end before the last event less a day."""
    gap, last, bursts = dt.timedelta(hours=6), max(e[1] for e in events), []
    by = defaultdict(list)
    for _, ts, _, user in events:
        by[f"/f/{user}"].append(ts)
    for path, times in by.items():
        held = [times[0]]
        for t in [*times[1:], None]:
            if t is None or t - held[-1] > gap:
                bursts.append((path, held[0], held[-1] + gap, len(held)))
                held = []
            held.append(t)
    closed = {b for b in bursts if b[2] <= last - dt.timedelta(days=1)}
    got = {(r["path"], r["start"].replace(tzinfo=None), r["end"].replace(tzinfo=None), r["events"]) for r in QUERIES["i02_debounced_stream"](spark, sf).collect()}
    assert got == closed and len(got) > 50


def test_semantic_cache_stream(spark, sf, events):
    """A plain loop over all calls in order of time, with a list of entries for each session."""
    vectors = dict(duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall())
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    stores, want = defaultdict(list), {}
    for event, ts, kind, user in events:
        store, words, vec = stores[user % 20], f"{kind} of {user % 300}", event % 700
        late = lambda e, now=ts: now - e[0] > dt.timedelta(days=1)
        same = next((e for e in store if e[2] == words), None)
        while same is not None and late(same):
            store.remove(same)
            same = next((e for e in store if e[2] == words), None)
        if same is not None:
            want[event] = (True, same[1], 1.0)
            continue
        sims = [(float(unit[vec] @ unit[e[3]]), -k, e) for k, e in enumerate(store) if vec in unit and e[3] in unit and not late(e)]
        best = max(sims, default=(0, 0, None), key=lambda x: x[:2])
        if best[0] >= 0.3:
            want[event] = (True, best[2][1], round(best[0], 6))
            continue
        want[event] = (False, None, None)
        if len(store) >= 128:
            store.pop(0)
        store.append((ts, event, words, vec))
    got = {r.id: (r.hit, r.of, r.similarity) for r in QUERIES["i11_semantic_cache_stream"](spark, sf).collect()}
    assert set(got) == set(want)
    assert all(got[k][:2] == want[k][:2] and (want[k][2] is None or abs(got[k][2] - want[k][2]) < 2e-6) for k in want)
    assert {h for h, *_ in want.values()} == {True, False} and any(s is not None and s < 1 for *_, s in want.values())


def test_layout(spark, sf):
    """Every node has a place, neighbours are nearer than other nodes, and the same graph gives the same picture."""
    edges = S.edges_w(spark, sf)
    at = {r.node: (r.x, r.y) for r in QUERIES["j10_layout"](spark, sf).collect()}
    pairs = [(r.source, r.target) for r in edges.collect() if r.source != r.target]
    assert set(at) == {n for p in pairs for n in p}
    assert min(x for x, _ in at.values()) == pytest.approx(50) and min(y for _, y in at.values()) == pytest.approx(50)
    r, names = random.Random(1), sorted(at)
    far = lambda p: math.dist(at[p[0]], at[p[1]])
    assert np.mean([far(p) for p in pairs]) < 0.6 * np.mean([far(r.sample(names, 2)) for _ in range(2000)])
    assert at == {x.node: (x.x, x.y) for x in graph_search.layout(edges).collect()}


def test_lsh_search(spark, sf):
    """At least nine of ten of the true neighbours, each with its exact cosine."""
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    got = QUERIES["k02_lsh_search"](spark, sf).collect()
    asked = {r.query_id for r in got}
    want = {q: sorted(((-round(float(unit[q] @ v), 6), n) for n, v in unit.items()))[:5] for q in asked}
    found = {(r.query_id, r.node_id) for r in got}
    assert sum((q, n) in found for q, best in want.items() for _, n in best) >= 0.9 * 5 * len(asked)
    assert all(abs(r.score - float(unit[r.query_id] @ unit[r.node_id])) < 2e-6 for r in got)


def test_vector_index(spark, sf):
    """At least 0.95 of the true ten neighbours."""
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    ids, unit = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    got = QUERIES["k02_vector_index"](spark, sf).collect()
    want = {int(q): {int(ids[n]) for n in np.lexsort((ids, -np.round(unit @ unit[i], 6)))[:10]} for i, q in enumerate(ids) if q % 20 == 0}
    assert {r.query_id for r in got} == set(want)
    assert sum(r.node_id in want[r.query_id] for r in got) >= 0.95 * 10 * len(want)


def test_mlp_training_on_the_driver():
    """Gradient descent in plain loops from the same start."""
    start = np.random.RandomState(classify.SEED)
    h = classify.HIDDEN
    w1, w2 = (start.randn(10, h) * 0.1).tolist(), (start.randn(h, 2) * 0.1).tolist()
    b1, b2 = [0.0] * h, [0.0] * 2
    for _ in range(classify.EPOCHS):
        for q, label in classify.TRAINING:
            x = classify._features_of(q)
            a = [max(0.0, sum(x[i] * w1[i][j] for i in range(10)) + b1[j]) for j in range(h)]
            o = [math.exp(sum(a[j] * w2[j][c] for j in range(h)) + b2[c]) for c in range(2)]
            d2 = [o[c] / sum(o) - (c == label) for c in range(2)]
            d1 = [sum(w2[j][c] * d2[c] for c in range(2)) * (a[j] > 0) for j in range(h)]
            for j in range(h):
                for c in range(2):
                    w2[j][c] -= classify.RATE * a[j] * d2[c]
                for i in range(10):
                    w1[i][j] -= classify.RATE * x[i] * d1[j]
                b1[j] -= classify.RATE * d1[j]
            b2 = [b2[c] - classify.RATE * d2[c] for c in range(2)]
    got = {(name, i): float(v) for name, w in classify.train_mlp().items() for i, v in enumerate(w.ravel())}
    want = {("w1", i * h + j): w1[i][j] for i in range(10) for j in range(h)} | {("w2", j * 2 + c): w2[j][c] for j in range(h) for c in range(2)} | {("b1", j): b1[j] for j in range(h)} | {("b2", c): b2[c] for c in range(2)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mlp_training(spark, sf):
    """The query against steps over every single question, in plain loops; the network tells the sure questions apart."""
    from pyspark.sql import functions as F

    from lorespark.plans import standins as S

    rows = S.queries(spark, sf).select(classify.features(F.col("query")).alias("f"), classify.quick_check(F.col("query")).alias("label")).filter("label is not null").collect()
    said = [(np.array(r.f), int(r.label == "semantic")) for r in rows]
    share = [0.5 / sum(y == c for _, y in said) for c in range(2)]
    start = np.random.RandomState(classify.SEED)
    net = [start.randn(10, classify.HIDDEN) * 0.1, np.zeros(classify.HIDDEN), start.randn(classify.HIDDEN, 2) * 0.1, np.zeros(2)]
    speed = [np.zeros_like(v) for v in net]
    for _ in range(classify.ROUNDS):
        total = [np.zeros_like(v) for v in net]
        for x, y in said:
            h = np.maximum(0, x @ net[0] + net[1])
            o = np.exp(h @ net[2] + net[3])
            d2 = (o / o.sum() - np.eye(2)[y]) * share[y]
            d1 = (net[2] @ d2) * (h > 0)
            for t, g in zip(total, (np.outer(x, d1), d1, np.outer(h, d2), d2), strict=True):
                t += g
        speed = [classify.MOMENTUM * s - classify.STEP * t for s, t in zip(speed, total, strict=True)]
        net = [v + s for v, s in zip(net, speed, strict=True)]
    got = {(r.layer, r.pos): r.weight for r in QUERIES["l05_mlp_training"](spark, sf).collect()}
    want = {(name, i): v for name, w in zip(("w1", "b1", "w2", "b2"), net, strict=True) for i, v in enumerate(w.ravel())}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    right = [int((np.maximum(0, x @ net[0] + net[1]) @ net[2] + net[3]).argmax()) == y for x, y in said]
    for c in range(2):
        part = [ok for ok, (_, y) in zip(right, said, strict=True) if y == c]
        assert sum(part) >= 0.9 * len(part)


def test_mlp_training_without_examples(spark):
    none = classify.sure_examples(spark.createDataFrame([(None,)], "query string"))
    one = classify.sure_examples(spark.createDataFrame([("tell a lie",), ("tell a lie",)], "query string"))
    assert none.count() == 0 and [(r.y, r.w) for r in one.collect()] == [(1, 1.0)]
    start, after = classify.train_on(none, rounds=1), classify.train_on(one, rounds=1)
    assert np.allclose(start["b2"], 0) and after["b2"][1] > 0 > after["b2"][0]


def test_features_on_both_sides(spark):
    """The features of a question as an expression and on the driver."""
    from pyspark.sql import functions as F

    asked = [q for q, _ in classify.TRAINING]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", classify.features(F.col("q")).alias("f")).collect()
    assert all(np.allclose(r.f, classify._features_of(r.q)) for r in rows)
