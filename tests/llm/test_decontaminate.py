import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm import decontaminate as D


def brute(text, items, width=10):
    w = D.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        b = D.words_of(t)
        for k in range(max(1, len(b) - width + 1) if b else 0):
            win = b[k : k + width]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found |= {item} - {None}
    return len(w), sorted(hit), found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(2, 6), min_size=1, max_size=80), st.integers(0, 3))
def test_suffix_array_and_index(symbols, gaps):
    s = np.array(symbols)
    s[:: 7 + gaps] = D.GAP
    s = np.append(s, D.END).astype(np.int64)
    gap = np.cumsum(s == D.GAP)
    key = [[(1, 0, int(x)) if x > 1 else (0, int(gap[i]), int(x)) for i, x in enumerate(s)][i:] for i in range(len(s))]
    sa = D.suffix_array(s)
    plain = lambda i: [(-1, 0)] if s[i] == 0 else [(0, int(gap[j])) if s[j] == 1 else (1, int(s[j])) if s[j] else (-1, 0) for j in range(i, len(s))]
    assert list(sa) == sorted(range(len(s)), key=plain) and key
    f = D.FMIndex(s, 7)
    for n in (1, 2, 3):
        for i in range(len(s) - n):
            p = s[i : i + n]
            if (p > 1).all():
                lo, hi = f.search(p[None].astype(np.int64), np.array([n]))
                want = [j for j in range(len(s) - n + 1) if (s[j : j + n] == p).all()]
                assert sorted(f.locate(np.arange(lo[0], hi[0]))) == want


def test_search_against_brute_force():
    r = random.Random(4)
    vocab = ["alpha", "beta", "Gamma", "d", "é", "x1"]
    items = [(str(i), " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 9, 10, 14, 30])))) for i in range(12)] + [(None, "beta beta beta")]
    texts = [None, "", "no words of it", "!!!"] + [" ".join(r.choice(vocab + ["other"]) for _ in range(r.randint(0, 60))) for _ in range(60)] + [items[6][1] + ", " + (items[7][1] or "z")]
    for p in (D.Blocks([D.Phrases(D.windows_of(items, 10))]), D.Blocks([D.Phrases(D.windows_of([i], 10)) for i in items])):
        for t, (n, hit, found) in zip(texts, D.search(texts, p), strict=True):
            assert (n, hit.tolist(), found) == brute(t, items)


def test_shards_and_pieces(monkeypatch):
    items = [("a", " ".join(f"w{i}" for i in range(25)))]
    p = D.Blocks([D.Phrases(D.windows_of(items, 10))])
    texts = ["x " * 50 + items[0][1].upper() + " y" * 9] * 5 + [items[0][1][:40]]
    want = [(n, h.tolist(), f) for n, h, f in D.search(texts, p)]
    monkeypatch.setattr(D, "_PIECE", 11)
    assert [(n, h.tolist(), f) for n, h, f in D.search(texts, p)] == want and want[0][1] == list(range(50, 75))
    assert D.search([], p) == []


def test_shards_keep_rows_in_order(monkeypatch):
    texts = ["x" * n if n else None for n in (3, 0, 9, 40, 1, 1, 1, 30, 0, 5, 5, 5)]
    table = pa.table({"k": list(range(len(texts))), "text": texts})
    for size in (1, 5, 12, 1000):
        monkeypatch.setattr(D, "SHARD_BYTES", size)
        for rows in (1, 3, 50):
            out = list(D.shards(iter(table.to_batches(max_chunksize=rows)), 1))
            assert [x for b in out for x in b.column(0).to_pylist()] == list(range(len(texts)))
            sizes = [sum(len(t or "") for t in b.column(1).to_pylist()) for b in out]
            last = [len(b.column(1)[-1].as_py() or "") for b in out]
            assert all(s >= size and s - x < size for s, x in zip(sizes[:-1], last[:-1], strict=True)) and sizes[-1] - last[-1] < size
    assert list(D.shards(iter(table.slice(0, 0).to_batches()), 1)) == []


def test_spans_and_removal():
    passage = "The Quick-brown fox; jumps over the lazy dog again and again"
    p = D.Blocks([D.Phrases(D.windows_of([("a", passage)], 10))])
    text = f"Before it. {passage}! After é it."
    (found,) = D.search([text], p)
    spans = D.spans_of(text, found[1])
    assert [text[a:b] for a, b in spans] == [passage]
    assert D.without(text, p) == "Before it.  ! After é it."
    words = passage.split()
    nested = " ".join(words[:6] + passage.split() + words[6:])
    (left,) = D.search([D.without(nested, p)], p)
    assert not len(left[1])


def test_on_frames(spark, make, clash):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(7, passage), (7, passage), (8, "only three words"), (None, "null item here"), (9, None), (10, "")], "item_id long, text string")
    rows = [(1, f"a {passage} b"), (1, f"a {passage} b"), (2, None), (3, ""), (4, "Only THREE words and null item here"), (None, "clean")]
    d = clash(make(rows))
    got = sorted(((r.doc_id or 0, r.n_words, len(r.hit), r["items"]) for r in D.find(d, bench).collect()), key=str)
    assert got == sorted([(1, 14, 12, ["7"]), (1, 14, 12, ["7"]), (2, 0, 0, []), (3, 0, 0, []), (4, 7, 6, ["8"]), (0, 1, 0, [])], key=str)
    small = make([(1, f"a {passage} b only three words"), (4, "Only THREE words"), (5, "clean")])
    one = {r.doc_id: (r.n_words, r.hit, r["items"], r.spans) for r in D.find(small, bench).collect()}
    many = {r.doc_id: (r.n_words, r.hit, r["items"], r.spans) for r in D.find(small, bench, block_phrases=1).collect()}
    assert one == many
    out = D.remove(d, bench)
    assert out.columns == d.columns
    texts = [r[0] for r in out.toDF(*[f"c{i}" for i in range(len(d.columns))]).select("c1").collect()]
    assert sorted(map(str, texts)) == sorted(["a   b", "a   b", "None", "", "  and  ", "clean"])
    assert D.find(d.limit(0), bench).count() == 0 and D.find(make([(1, "x")]), bench.limit(0)).first().hit == []


def test_blocks_change_nothing(spark, make):
    """Null and repeated ids with different texts, and phrases that a cut of another block's phrase joins up."""
    first, second = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    a, b = first.split(), second.split()
    bench = spark.createDataFrame([("1", first), ("2", second), ("3", "c c c")], "item_id string, text string")
    rows = [(None, f"x {first}"), (None, f"{second} y y"), (7, f"{first} z"), (7, f"z z {second}"), (7, "clean"),
            (1, " ".join(a[:4] + b + a[4:])), (2, " ".join(b[:4] + a + b[4:])), (3, "q " + " ".join(a[:5] + ["c"] * 3 + a[5:]) + " q")]
    d = make(rows)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(D.find(d, bench)) == key(D.find(d, bench, block_phrases=1))
    one, many = D.remove(d, bench), D.remove(d, bench, block_phrases=1)
    assert key(one) == key(many)
    assert all(not hit for (hit,) in D.find(many, bench).select("hit").collect())
    assert [r.n_words for r in D.find(many, bench).filter("doc_id in (1, 2, 3)").orderBy("doc_id").collect()] == [0, 0, 2]
