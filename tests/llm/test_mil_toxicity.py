import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import mil_toxicity as M


def test_gradient():
    texts = ["you fool. nice day", "nice day! good", "what a fool of a fool", "", None, "good day. fine\nwell"]
    bags, label = M.Bags.of(texts), np.array([1, 0, 1, 0, 0, 0])
    rng = np.random.default_rng(1)
    w, b = rng.standard_normal(1 << M.BITS) * 0.1, -0.5
    _, g, gb = bags.loss(w, b, label)
    for k in [*np.flatnonzero(g)[:: max(1, len(np.flatnonzero(g)) // 12)], 0]:
        d = np.zeros_like(w)
        d[k] = 1e-5
        assert g[k] == pytest.approx((bags.loss(w + d, b, label)[0] - bags.loss(w - d, b, label)[0]) / 2e-5, abs=1e-7)
    assert gb == pytest.approx((bags.loss(w, b + 1e-5, label)[0] - bags.loss(w, b - 1e-5, label)[0]) / 2e-5, abs=1e-7)


def test_sentences_cover_all_words():
    text = "One two. three!  four\n\n" + " ".join(f"w{i}" for i in range(150)) + "… end。last"
    found = M.sentences(text)
    assert [text[s:e].strip() for s, e, _ in found[:3]] == ["One two.", "three!", "four"]
    assert [len(w) for _, _, w in found[3:6]] == [64, 64, 22] and [text[s:e] for s, e, _ in found[6:]] == [" end。", "last"]
    assert [w for _, _, ws in found for w in ws] == [w.lower() for w in M._WORD.findall(text)]
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert M.sentences(None) == M.sentences("") == M.sentences(" .\n") == []


def corpus(n, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdegiklmnorstu") for _ in range(r.randint(2, 7)))
    common = [word() for _ in range(300)]
    rows = []
    for i in range(n):
        said = [[r.choice(common) for _ in range(r.randint(3, 9))] for _ in range(r.randint(2, 12))]
        toxic = i % 4 == 0
        if toxic:
            said[r.randrange(len(said))].insert(1, r.choice(["scoundrel", "blockhead", "villain"]))
        rows.append((i, ". ".join(" ".join(s) for s in said) + ".", int(toxic)))
    return rows


def test_held_out_accuracy_and_places(spark, make):
    rows = corpus(600)
    docs = make([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = M.train(docs, labels)
    got = {r.doc_id: r for r in M.score(docs, model).collect()}
    held = [(i, t, y) for i, t, y in rows if got[i].held_out]
    assert 80 < len(held) < 160 and all(got[i].predicted == y for i, _, y in held)
    for i, t, y in held:  # the offending sentences are those with the insult
        said = [t[s.start : s.end] for s in got[i].offending]
        assert bool(said) == bool(y) and all(any(w in x for w in ("scoundrel", "blockhead", "villain")) for x in said)


def test_scores_equal_a_plain_loop(spark, make):
    rows = corpus(120, seed=3)
    model = M.fit([t for _, t, _ in rows], [y for *_, y in rows])
    got = {r.doc_id: r for r in M.score(make([(i, t) for i, t, _ in rows]), model).collect()}
    for i, t, _ in rows:
        clean = 1.0
        for _, _, words in M.sentences(t):
            z = model.bias + sum(model.weights.get(g, 0.0) for w in words for g in M.grams(w))
            clean *= 1 - 1 / (1 + np.exp(-z))
        assert got[i].score == pytest.approx(1 - clean, abs=1e-9) and got[i].predicted == int(1 - clean >= 0.5)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, make):
    rows = corpus(200, seed=5)
    docs = make([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = M.train(docs, labels), M.train(docs.withColumn("lang", F.lit("xx")), flipped)
    assert a == b and a.weights


def test_odd_rows(spark, make, clash):
    rows = corpus(150, seed=7)
    base = [(i, t) for i, t, _ in rows]
    odd = [(None, "scoundrel"), (1000, None), (1001, ""), (1002, "?! ..."), (1003, "blockhead " * 30_000), (1003, "x" * 300_000), (1004, "ok. scoundrel you are"), (1004, "ok. scoundrel you are")]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1000, 1), (1, None), (2, 1), (2, 0), (9999, 1)], "doc_id long, toxic int")
    docs = clash(make(base + odd))
    model = M.train(docs, labels)
    got = M.score(docs, model).filter("doc_id >= 1000 or doc_id is null").collect()
    assert len(got) == len(odd) and sorted(r.score for r in got if r.doc_id in (1000, 1001, 1002)) == [0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1004}) == 1
    assert all(r.held_out is not None for r in got)
    assert M.train(docs.limit(0), labels) is None and M.train(docs, labels.limit(0)) is None
    assert M.train(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in M.score(docs, None).collect()} == {0.5}
    assert M.score(docs.limit(0), model).count() == 0


def test_features_of_many_words_equal_those_of_each(monkeypatch):
    r = random.Random(2)
    words = ["", "a", "漢", "\ud800b", "straße", "x" * 500, "aaaaaaaaaa", *("".join(r.choice("abcß²é漢字𝔘\ud800_0") for _ in range(r.randint(1, 12))) for _ in range(500))]
    want = [(k << M.BITS) + g for k, w in enumerate(words) for g in M.grams(w)]
    keep = np.arange(1 << M.BITS) % 3 == 0
    for step in (M.STEP, 7, 1):
        monkeypatch.setattr(M, "STEP", step)
        assert M.hashed(words).tolist() == want
        assert M.hashed(words, keep).tolist() == [x for x in want if keep[x & ((1 << M.BITS) - 1)]]
    assert len(M.hashed([])) == 0 and list(M.Model({}, 0.0).judge(["a b", None])) == [(0.5, 1, [(0, 3, 0.5)]), (0.0, 0, [])]


def test_texts_may_be_lowered_as_a_whole():
    """All but two characters stay one character, of the same kind, in lower case."""
    every = [chr(c) for c in range(0x110000)]
    assert [c for c in every if len(c.lower()) != 1] == ["\u0130"]
    assert all(bool(M._WORD.match(c)) == bool(M._WORD.match(c.lower())) for c in every if c != "\u0130")
    text = "ΟΔΟΣ'Α ὈΔΟΣ. İSTANBUL Iı? ÀÉ ÀÉ\n" + "Σ İx " * 40
    assert [w for _, _, ws in M.sentences(text) for w in ws][:7] == ["οδος", "α", "ὀδος", "i̇stanbul", "iı", "àé", "σ"]
    assert M.sentences("Ab CD. eF")[0] == (0, 6, ["ab", "cd"]) and all(text[s:e].strip() for s, e, _ in M.sentences(text))


def test_groups_of_texts_and_the_cache_change_nothing(monkeypatch):
    rows = corpus(120, seed=4)
    texts = [t for _, t, _ in rows] + [None, "", "y" * 150 + " scoundrel", "villain"]
    model = M.fit(texts[:120], [y for *_, y in rows], 40)
    want = [x for t in texts for x in M.Model(model.weights, model.bias).judge([t])]
    monkeypatch.setattr(M, "CACHE", 50)
    for size in (1, 300, 10**6):
        monkeypatch.setattr(M, "GROUP", size)
        assert [t for g in M._groups(iter(texts)) for t in g] == texts
        assert [x for g in M._groups(iter(texts)) for x in model.judge(g)] == want
        assert not any(len(w) >= 100 for w in model.known)


def test_scoring_costs_less_than_a_loop_over_grams():
    r = random.Random(6)
    text = ". ".join(" ".join("".join(r.choice("abdegiklmnorstu") for _ in range(r.randint(5, 12))) for _ in range(12)) for _ in range(2500))
    model = M.Model({7: 0.5, 99: -0.25}, -4.0)
    list(model.judge(["warm up"]))

    def plain():
        for _, _, words in M.sentences(text):
            for w in words:
                sum(model.weights.get(g, 0.0) for g in M.grams(w))

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    assert min(seconds(lambda: list(M.Model(model.weights, model.bias).judge([text]))) for _ in range(2)) < 0.6 * seconds(plain)


def test_one_large_text_is_hashed_in_bounded_steps():
    """A text of very many words takes little more memory than its words."""
    text = " ".join(f"{i:x}longword{i * 7919:x}" for i in range(300_000))
    model = M.Model({7: 0.5, 99: -0.25}, -4.0)
    words = [w for _, _, said in M.sentences(text) for w in said]
    tracemalloc.start()
    model.learn(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.known) == len(words) == 300_000 and peak < 100e6
