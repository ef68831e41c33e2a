import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm import oracles, quality_rules as Q
from tests.compare import assert_same, connect


def brute(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return (0,) * 5
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i : i + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in " \t\n\v\f\r" for c in line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|\x85\xa0\u2028", max_size=60)))
def test_statistics(text):
    assert Q.text_stats(text)[:5] == brute(text)


def test_long_texts_are_counted_alike(monkeypatch):
    r = random.Random(3)
    text = " ".join(r.choice("abcdefgh") for _ in range(3000))
    want = Q.text_stats(text)
    monkeypatch.setattr(Q, "_MANY", 5)
    assert Q.text_stats(text) == want and want[4] == brute(text)[4]


def fences(rows, fence=3):
    """Quartiles by sorting, for one group."""
    out = {}
    for m in Q.SPREAD:
        v = sorted(r[m] for r in rows)
        q = lambda f: v[-(-len(v) * f // 4) - 1]
        reach = fence * max(q(3) - q(1), Q.SPREAD[m])
        out[m] = (q(1) - reach if m in Q.TWO_SIDED else None, q(3) + reach)
    return out


def test_verdicts_against_brute_force(spark, make):
    r = random.Random(5)
    rows = []
    for i in range(400):
        lang, source = ("en", "s1") if i % 3 else ("de", f"t{i % 7}")
        words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9))) for _ in range(r.randint(40, 120))]
        if i % 17 == 0:
            words = [w + "###$$" for w in words]
        rows.append((i, " ".join(words), lang, source))
    got = {x.doc_id: x for x in Q.judge(make(rows)).collect()}
    groups, langs = defaultdict(list), defaultdict(list)
    for i, _, lang, source in rows:
        if not got[i].base_failed:
            groups[lang, source].append(got[i])
            langs[lang].append(got[i])
    for i, _, lang, source in rows:
        own = groups[lang, source]
        f = fences(own if len(own) >= 50 else langs[lang])
        out = any(got[i][m] > hi or lo is not None and got[i][m] < lo for m, (lo, hi) in f.items())
        assert got[i].kept == (not got[i].base_failed and not out), i
    assert not any(got[i].kept for i in range(0, 400, 17))


def test_edges(make, clash):
    good = " ".join(f"word{i}x" for i in range(60))
    rows = [(1, good, None, None), (1, good, None, None), (2, None, "en", "s"), (3, "", "en", "s"), (None, good, "en", None), (5, "a b c " * 30)]
    got = sorted(((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in Q.judge(clash(make(rows))).collect()))
    assert got == [(0, 60, False, True), (1, 60, False, True), (1, 60, False, True), (2, 0, True, False), (3, 0, True, False), (5, 90, True, False)]
    assert Q.judge(make(rows).limit(0)).count() == 0
    d = clash(make(rows))
    kept = Q.keep_good(d)
    assert kept.columns == d.columns and kept.count() == 3
    assert [str(x) for x in kept.toDF(*range_names(d)).select("c10").distinct().collect()] == [str(x) for x in d.toDF(*range_names(d)).select("c10").distinct().collect()]


def range_names(df):
    return [f"c{i}" for i in range(len(df.columns))]


def test_shuffled_thresholds_agree(make, monkeypatch):
    rows = [(i, " ".join(f"w{i}{k}" for k in range(60)) + " #" * (i % 9), "en", f"s{i % 3}") for i in range(200)]
    want = sorted((r.doc_id, r.kept) for r in Q.judge(make(rows)).collect())
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.kept) for r in Q.judge(make(rows)).collect()) == want


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracles(spark, sf, name):
    from lorespark.llm import queries

    assert_same(queries.queries()[name](spark, sf), connect(sf), oracles.ORACLES[name])
