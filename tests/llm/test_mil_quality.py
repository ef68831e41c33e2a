import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import mil_quality as M
from lorespark.llm.common import table


def test_features_cover_the_whole_text():
    a = M.features("plain words of text " * 100)
    assert a.shape == (-(-400 // M.PASSAGE), M.FEATURES)
    b = M.features("plain words of text " * 100 + "### $$$ " * 40)
    assert len(b) > len(a) and b[-1, 8] > 0.2 and np.isfinite(b).all()
    assert np.array_equal(M.features(None), M.features("  \n")) and M.features("").shape == (1, M.FEATURES) and not M.features("").any()
    assert M.features("é" * 9).shape == (1, M.FEATURES)


def test_gradient():
    rng = np.random.default_rng(1)
    f, h, a = 5, 4, 3
    p = {"W": rng.normal(size=(f, h)), "bw": rng.normal(size=h), "V": rng.normal(size=(h, a)), "U": rng.normal(size=(h, a)), "w": rng.normal(size=a), "c": rng.normal(size=h), "b": rng.normal(size=1)}
    x, begin, bag, y = rng.normal(size=(7, f)), np.array([0, 3, 4]), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = M._forward(p, x, begin, bag)["y"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in M._gradient(p, x, begin, bag, y).items():
        for i in np.ndindex(p[name].shape):
            keep = p[name][i]
            p[name][i] = keep + 1e-6
            up = loss()
            p[name][i] = keep - 1e-6
            assert abs((up - loss()) / 2e-6 - g[i]) < 1e-6
            p[name][i] = keep


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(2)
    bags, labels = [], []
    for i in range(200):
        b = rng.normal(size=(6, M.FEATURES)).astype(np.float32) * 0.1
        if i % 2:
            b[rng.integers(6), 8] += 3
        bags.append(b)
        labels.append(float(1 - i % 2))
    net = M.fit(bags, np.array(labels, np.float32))
    s = net.scores(bags)
    assert ((s > 0.5) == (np.array(labels) > 0.5)).mean() > 0.97
    x = (bags[1] - net.mean) / net.scale
    f = M._forward(net.p, x, np.array([0]), np.zeros(6, int))
    assert f["a"].sum() == pytest.approx(1, abs=1e-5)
    assert M.fit(bags[:3], np.ones(3, np.float32)) is None
    assert np.array_equal(M.fit(bags, np.array(labels, np.float32)).p["W"], net.p["W"])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = M.score(docs, M.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    wins = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None]).mean()
    assert wins > 0.97 and (good.predicted == 1).mean() > 0.97


def test_labels_of_held_out_documents_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    other = labels.withColumn("quality", F.when(M.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = M.train(docs, labels), M.train(docs, other)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_edges(spark, make, clash):
    rows = [(1, "some words"), (1, "some words"), (2, None), (3, ""), (None, "x")]
    d = clash(make(rows))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = M.score(d, M.train(d, none)).collect()
    assert {r.score for r in got} == {0.5} and len(got) == 5 and {r.held_out for r in got if r.doc_id is None} == {False}
    assert M.score(d.limit(0), None).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 7), (3, 0), (4, 1)], "doc_id long, quality int")
    net = M.train(d, odd)
    scores = [r.score for r in M.score(d, net).collect()]
    assert all(0 <= s <= 1 for s in scores)


def naive_features(text):
    """Passage by passage and byte by byte."""
    raw = (text or "").encode()
    words = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    if not words:
        return np.zeros((1, M.FEATURES))
    lines, begin, twice = raw.split(b"\n"), 0, set()
    for x in lines:
        if lines.count(x) > 1 and x.strip(b" \t\n\r\x0b\x0c"):
            twice |= set(range(begin, min(len(raw), begin + len(x) + 1)))
        begin += len(x) + 1
    out = []
    of = lambda k: max(sum(m.start() <= k for m in words) - 1, 0) // M.PASSAGE
    low = [b + 32 if 65 <= b <= 90 else b for b in raw]
    for i in range(-(-len(words) // M.PASSAGE)):
        mine = [k for k in range(len(raw)) if of(k) == i]
        row = np.zeros(M.FEATURES)
        for k in mine:
            row[M._CLASS[raw[k]]] += 1
            if k > 0:
                row[M._CLASSES + M._MERGED[M._CLASS[raw[k - 1]]] * 8 + M._MERGED[M._CLASS[raw[k]]]] += 1
            if 0 < k < len(raw) - 1:
                a, b, c = low[k - 1 : k + 2]
                row[M._GRAMS_AT + ((((a * 65599 + b) * 65599 + c) * 2654435761) % 2**32 >> 24)] += 1
        row[M._LINES + 4] = sum(k in twice for k in mine)
        row /= len(mine)
        w = [m[0] for m in words[i * M.PASSAGE : (i + 1) * M.PASSAGE]]
        row[M._LINES : M._LINES + 4] = sum(map(len, w)) / len(w) / 10, max(map(len, w)) / 40, len(set(w)) / len(w), len(w) / M.PASSAGE
        out.append(row)
    return np.array(out)


def naive_score(net, text):
    """One document's score by the formulas of the network, in plain loops."""
    p, enc, att = net.p, [], []
    for row in naive_features(text):
        x = (row - net.mean) / net.scale
        h = [math.tanh(sum(x[f] * p["W"][f, j] for f in range(len(x))) + p["bw"][j]) for j in range(M.HIDDEN)]
        v = [math.tanh(sum(h[j] * p["V"][j, a] for j in range(M.HIDDEN))) for a in range(M.ATTENTION)]
        u = [1 / (1 + math.exp(-sum(h[j] * p["U"][j, a] for j in range(M.HIDDEN)))) for a in range(M.ATTENTION)]
        enc.append(h)
        att.append(sum(v[a] * u[a] * p["w"][a] for a in range(M.ATTENTION)))
    weight = [math.exp(a) / sum(map(math.exp, att)) for a in att]
    z = [sum(w * h[j] for w, h in zip(weight, enc, strict=True)) for j in range(M.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(z[j] * p["c"][j] for j in range(M.HIDDEN)) + p["b"][0])))


def test_scores_by_brute_force(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    net = M.train(docs, labels)
    got = {r.doc_id: (r.score, r.predicted, r.n_passages) for r in M.score(docs, net).collect()}
    for r in docs.filter("length(text) < 3000 or text is null").orderBy("doc_id").limit(40).collect():
        want = naive_score(net, r.text)
        assert abs(got[r.doc_id][0] - want) < 1e-4 and got[r.doc_id][2] == len(naive_features(r.text))
        assert abs(want - 0.3) < 1e-4 or got[r.doc_id][1] == int(want >= 0.3)


def test_the_sample_is_bounded(spark, make):
    """Of a long text evenly spaced passages, of repeated rows one, of an id with both labels none."""
    assert M.sampled(np.arange(100), 4).tolist() == [0, 25, 50, 75] and M.sampled(np.arange(3), 4).tolist() == [0, 1, 2]
    rows = [(1, "good words here " * 3000), (2, "### $$$ " * 50), (3, "both"), (4, "more of the good words")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    a, b = M.train(make(rows), labels), M.train(make(rows + rows[:2] * 5), labels)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)
    c = M.train(make(rows[:2] + rows[3:]), labels)
    assert all(np.array_equal(a.p[k], c.p[k]) for k in a.p)
