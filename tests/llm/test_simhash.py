import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorespark.llm import simhash as S
from lorespark.llm.common import table


def brute_fp(text):
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {node: fingerprint}; the least node reachable over links of 2 bits or fewer."""
    nodes = sorted(fps)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint():
    for t in (None, "", " ", "one", "One TWO", "a b c d e f É\u00a0x", "\x1cx y\x85z", "w " * 500):
        assert S.fingerprint(t) == brute_fp(t)


def test_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(1000))
    monkeypatch.setattr(S, "_PIECE", 7)
    assert S.fingerprint(text) == brute_fp(text)


def test_links_and_components(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1 << 63]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(6):  # chains, and stars
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(x)
            fps.add(b ^ (1 << r.randrange(64)))
    fps = list(fps)
    r.shuffle(fps)
    want = brute_components(dict(enumerate(fps)))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = {x.node: x.root for x in S.components(S.links(df)).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_a_long_chain(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n + 5, n + 6)], "u long, v long")
    got = {x.node: x.root for x in S.components(e).collect()}
    assert {got[i] for i in range(1, n + 1)} == {0} and got[n + 6] == n + 5


def test_classes_on_documents(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = brute_components({i: brute_fp(t) for i, t in texts.items()})
    got = S.classes(docs).select("doc_id", S.hex16(F.col("fp")).alias("f"), "component_id").collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(int(r.f, 16) == brute_fp(texts[r.doc_id]) and len(r.f) == 16 for r in got)


def test_edges(make, clash):
    rows = [(5, "same text of words here"), (3, "Same  TEXT of words here"), (3, "same text of words here"), (9, None), (8, ""), (None, "same text of words here"), (None, "alone and far away from all else")]
    d = clash(make(rows))
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in S.classes(d).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert S.classes(d.limit(0)).count() == 0


def test_a_row_without_an_id_links_others(spark, monkeypatch):
    fps = [(1, 0), (None, 3), (3, 15), (None, 1 << 40), (9, 7 << 50)]
    monkeypatch.setattr(S, "fingerprints", lambda docs, words: docs)
    got = {(r.doc_id, r.fp): r.component_id for r in S.classes(spark.createDataFrame(fps, "doc_id long, fp long")).collect()}
    assert got == {(1, 0): 1, (None, 3): 1, (3, 15): 1, (None, 1 << 40): 1, (9, 7 << 50): 9}


@pytest.mark.parametrize("size", [400])
def test_a_group_of_near_copies_stays_linear(spark, size):
    r = random.Random(2)
    centre = r.getrandbits(64)
    fps = list({centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(size)})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    assert S.links(df).count() < 65 * len(fps)
    want = brute_components(dict(enumerate(fps)))
    got = {x.node: x.root for x in S.components(S.links(df)).collect()}
    assert {n: got.get(n, n) for n in want} == want
