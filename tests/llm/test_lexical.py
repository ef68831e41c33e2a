import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm import lexical as X
from lorespark.llm.common import LOWER, UPPER


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))


def brute(docs, items, k=10):
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(s for _, _, s in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in counted:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) & set(c))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def frames(spark, docs, items, parts=3):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string")


def corpus(seed, n=300, vocabulary=60):
    r = random.Random(seed)
    say = lambda a, b: " ".join(f"{r.choice(['w', 'Ä', 'ß'])}{min(int(r.paretovariate(0.7)), vocabulary)}" for _ in range(r.randint(a, b)))
    ids = r.sample(range(10_000), n)
    docs = [(i, say(0, 60)) for i in ids]
    return docs + [(i + 20_000, t) for i, t in docs[:40]], [(i, say(1, 12)) for i in range(25)]


def test_against_brute_force(spark):
    docs, items = corpus(1)
    d, q = frames(spark, docs, items)
    want = brute(docs, items)
    assert rows(X.rank(d, q)) == want and len(want) > 200
    index = X.build_index(d, shard_bytes=500)  # many shards
    assert index.select("shard").distinct().count() > 10
    assert rows(X.search(index, q)) == want
    assert rows(X.search(index, q, block_terms=20)) == want  # many blocks of queries
    assert rows(X.search(index, q, k=3)) == brute(docs, items, 3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=40, unique_by=lambda x: x[0]), max_size=8), st.integers(1, 6))
def test_merge_finds_the_best(lists, k):
    """Documents that the largest contributions rule out are the only ones left out; ties go to the smaller document."""
    total = Counter()
    for x in lists:
        for d, g in x:
            total[d] += g
    given_ = [(max(g for _, g in x), X.array("q", [d for d, _ in sorted(x)]), X.array("q", [g for _, g in sorted(x)])) for x in lists]
    assert X.best(given_, k) == sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:k]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**55), min_size=1, max_size=50))
def test_packed_round_trip(values):
    data, ends = X.packed(np.array(values, np.int64))
    assert X.unpacked(data.tobytes()).tolist() == values and len(ends) == len(values) and ends[-1] == len(data)


def test_odd_rows(spark, clash):
    docs = [(1, None), (2, ""), (3, "!? "), (None, "cat dog"), (4, "cat dog"), (4, "cat dog"), (5, "CAT İstanbul cat"), (6, "long " * 50_000 + "cat"), (7, "Kelvin kelvin")]
    items = [(1, "cat"), (1, "cat"), (None, "dog dog"), (2, None), (3, "nothing here"), (4, "İstanbul KELVIN"), (5, "long")]
    d, q = frames(spark, docs, items, 1)
    assert rows(X.rank(clash(d), q)) == brute(docs, items)
    assert X.rank(d.limit(0), q).count() == 0 and X.rank(d, q.limit(0)).count() == 0
