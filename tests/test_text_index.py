"""The inverted index against brute force: many chunks, skipped blocks, updates by document."""

import math
import random
import re
from collections import Counter

import numpy as np

from lorespark.operators import text_index as X
from lorespark.operators.tables import written


def tok(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def brute(docs, asked, k):
    counted = [(i, Counter(tok(t)), len(tok(t))) for i, t in docs]
    n, mean = len(counted), sum(s for *_, s in counted) / len(counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = {}
    for q, text in asked:
        scored = []
        for i, c, size in counted:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size / mean)) for w in sorted(set(tok(text))) if c[w])
            if s > 0:
                scored.append((-round(s, 6), i))
        out |= {(q, r): x for r, x in enumerate(sorted(scored)[:k], 1)}
    return out


def rows(df):
    return {(r.query_id, r["rank"]): (-r.score, r.node_id) for r in df.collect()}


def same(got, want):
    return set(got) == set(want) and all(got[x][1] == want[x][1] and abs(got[x][0] - want[x][0]) < 2e-6 for x in want)


def corpus(n=600, seed=3):
    r = random.Random(seed)
    say = lambda a, b: " ".join(f"w{min(int(r.paretovariate(0.6)), 300)}" for _ in range(r.randint(a, b)))
    docs = [(i * 3 - 50, say(0, 40)) for i in range(n)]
    return docs + [(i + 10_000, t) for i, t in docs[:50]], [(q, say(1, 8)) for q in range(30)]


def frames(spark, docs, asked):
    return spark.createDataFrame(docs, "node_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")


def test_many_chunks(spark, monkeypatch):
    docs, asked = corpus()
    d, q = frames(spark, docs, asked)
    want = brute(docs, asked, 6)
    assert len(want) > 150
    for chunk in (X.CHUNK_DOCS, 20):
        assert same(rows(X.bm25(d, q, 6, chunk)), want)
    monkeypatch.setattr(X, "FEW_TERMS", 0)
    assert same(rows(X.bm25(d, q, 6)), want)


def test_bounds_skip_chunks():
    """Once a question has its k best, a chunk that cannot reach them is not read."""
    chunk = lambda nodes, most: [{"term": None, "nodes": nodes, "sizes": [4] * len(nodes)}, {"term": "a", "most": most, "least": 4, "p": (np.arange(len(nodes)), np.full(len(nodes), most))}]
    best = X._Best(2)
    for rows_ in (chunk([1, 2], 3), chunk([3, 4], 1), chunk([5], 3), chunk([0], 4)):
        X._score_chunk(rows_, [{7: [("a", 1.0)]}], best, 4.0)
    assert best.skipped == 1 and best.of[7][1].tolist() == [0, 1]


def test_updates_and_buckets(spark, tmp_path):
    docs, asked = corpus(200, seed=9)
    d, q = frames(spark, docs, asked)
    folder = f"file://{tmp_path}/index"
    X.save(X.blocks(d, chunk_docs=30), folder, buckets=16)
    files = sorted(p.name for p in (tmp_path / "index/postings/gen=0").glob("*/*.parquet"))
    assert same(rows(X.search(X.load(spark, folder, buckets=16), q, 5)), brute(docs, asked, 5))
    now = dict(docs)
    for gen, (changed, removed) in enumerate([([(docs[0][0], "w1 new words w2"), (-999, "w3 w3 w3")], [docs[5][0], docs[6][0]]), ([(docs[0][0], "w1"), (docs[5][0], "back w2 w2")], [-999, 123456])], 1):
        X.update(spark, folder, spark.createDataFrame(changed, "node_id long, text string"), spark.createDataFrame([(x,) for x in removed], "node_id long"), gen, buckets=16)
        now = {k: v for k, v in now.items() if k not in removed} | dict(changed)
        terms = sorted({w for _, t in asked for w in tok(t)})
        assert same(rows(X.search(X.load(spark, folder, terms, buckets=16), q, 5)), brute(list(now.items()), asked, 5))
    assert files == sorted(p.name for p in (tmp_path / "index/postings/gen=0").glob("*/*.parquet"))  # updates write beside
    one = X.load(spark, folder, ["w1"], buckets=16)
    assert {r.term for r in one.select("term").distinct().collect()} == {None, "w1"}
    assert "PartitionFilters: [" in (plan := one._jdf.queryExecution().executedPlan().toString()) and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "cat dog"), (3, "cat dog"), (None, "cat"), (-4, "cat " * 5000)]
    d, q = frames(spark, docs, [(1, "cat"), (1, "dog"), (None, "cat"), (2, None), (3, "?")])
    got = X.search(written(X.blocks(d), "blocks"), q, 9).collect()
    assert sorted((r.query_id, r.node_id) for r in got) == [(1, -4), (1, 3), (1, 3)]
    assert X.bm25(d.limit(0), q, 3).count() == 0 and X.bm25(d, q.limit(0), 3).count() == 0
