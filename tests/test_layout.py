import __spark_entry__
from lorespark.operators import graph_search
from lorespark.plans import standins as S


def test_the_registered_layout_is_a_finished_one(spark, sf):
    got = sorted(map(tuple, __spark_entry__.queries()["j10_layout"](spark, sf).collect()))
    edges = S.edges_w(spark, sf)
    assert got == sorted(map(tuple, graph_search.layout(edges, 200).collect()))
    assert got != sorted(map(tuple, graph_search.layout(edges, 50).collect()))


def test_a_layout_has_no_bound(spark, monkeypatch):
    """Beyond the driver's bound every node still has a place, the same again, and neighbours are near."""
    import math
    import random

    pairs = [(f"p{i}", f"h{(i * 7 + j * j) % 12}") for i in range(150) for j in range(2)] + [("a", "a"), ("b", "b"), ("x", "y")]
    e = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source string, target string, edge_type string")
    monkeypatch.setattr(graph_search, "LAYOUT_NODES", 20)
    monkeypatch.setattr(graph_search, "LAYOUT_REFINED", 2)
    at, again = ({r.node: (r.x, r.y) for r in graph_search.layout(d, 100).collect()} for d in (e, e.repartition(5)))
    assert at == again and set(at) == {n for p in pairs for n in p}
    assert min(x for x, _ in at.values()) == 50 and min(y for _, y in at.values()) == 50 and all(map(math.isfinite, sum(at.values(), ())))
    r, names = random.Random(1), sorted(at)
    far = lambda a, b: math.dist(at[a], at[b])
    assert sum(far(*p) for p in pairs) / len(pairs) < 0.8 * sum(far(*r.sample(names, 2)) for _ in range(2000)) / 2000
