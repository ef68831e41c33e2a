"""The vector index against all cosines: recall, exact ranks, rows added later, odd rows."""

import numpy as np

from lorespark.operators import vector_index as V


def rows_of(sf):
    import duckdb

    return duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()


def brute(rows, asked, k):
    ids, m = np.array([i for i, _ in rows]), V.unit(np.array([v for _, v in rows], float))
    out = {}
    for q, v in asked:
        s = np.round(m @ (np.array(v) / np.linalg.norm(v)), 6)
        out[q] = [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -s))[:k]]
    return out


def frames(spark, rows, asked):
    return spark.createDataFrame(rows, "node_id long, embedding array<double>"), spark.createDataFrame(asked, "query_id long, embedding array<double>")


def recall(got, want):
    found = {(r.query_id, r.node_id) for r in got}
    return sum((q, n) in found for q, best in want.items() for n, _ in best) / sum(map(len, want.values()))


def test_recall_and_exact_scores(spark, sf, tmp_path):
    rows = rows_of("/root/testdata/sf0.1")
    asked = [(i, v) for i, v in rows if i % 20 == 0]
    v, q = frames(spark, rows, asked)
    later = v.filter("node_id % 7 = 3")
    quantiser = V.train(v.filter("node_id % 7 <> 3"), cells=32)
    folder = f"file://{tmp_path}/vectors"
    V.add(v.filter("node_id % 7 <> 3"), quantiser, folder)
    V.add(later, quantiser, folder)  # new rows, without training again
    want = brute(rows, asked, 10)
    got = V.search(spark, folder, quantiser, q, 10, probes=26, refine=200).collect()
    assert recall(got, want) >= 0.95
    cosine = {x: dict(best) for x, best in brute(rows, asked, len(rows)).items()}
    assert all(abs(r.score - cosine[r.query_id][r.node_id]) < 2e-6 for r in got)
    every = V.search(spark, folder, quantiser, q, 10, probes=32, refine=len(rows)).collect()
    assert recall(every, want) >= 0.999  # all cells, all candidates: exact but for ties in float32


def test_a_cell_is_read_only_when_it_is_looked_at(spark, tmp_path):
    r = np.random.default_rng(1)
    centers = np.eye(8)
    rows = [(i, (centers[i % 8] + 0.05 * r.standard_normal(8)).tolist()) for i in range(400)]
    v, q = frames(spark, rows, [(1, centers[3].tolist())])
    quantiser = V.train(v, cells=8, subs=4)
    V.add(v, quantiser, f"file://{tmp_path}/x")
    found = V.search(spark, f"file://{tmp_path}/x", quantiser, q, 5, probes=1, refine=50)
    assert {x.node_id % 8 for x in found.collect()} == {3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (None, [1.0, 0.0]), (5, [0.6, 0.8])]
    v, q = frames(spark, rows, [(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])])
    quantiser = V.train(v)
    folder = f"file://{tmp_path}/odd"
    V.add(v, quantiser, folder)
    got = sorted((r.query_id, r["rank"], r.node_id, r.score) for r in V.search(spark, folder, quantiser, q, 9).collect())
    assert [(a, c, d) for a, _, c, d in got if a == 1] == [(1, 1, 1.0), (1, 1, 1.0), (1, 5, 0.6), (1, 2, 0.0)] and {a for a, *_ in got} == {1, 2}
    assert V.train(v.limit(0)) is None and V.search(spark, folder, quantiser, q.limit(0)).count() == 0
