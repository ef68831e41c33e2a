import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from lorespark.llm import filter_audit as A

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, bad = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    fails = []
    for d, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [e for e, other, _ in rows if (other or "") == text and d is not None and e is not None and e < d]
        f = {x for x, c in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), re.search(r"[#$%&*|]", text), copies)) if c}
        fails.append((source or "", d, f))
    out = {}
    for part in {p for p, _, _ in fails}:
        mine = [(d, f) for p, d, f in fails if p == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                gone = [(d, f) for d, f in mine if x in f and not f & set(order[:k])]
                share[x] += len(gone)
                out[part, order, k + 1] = [sum(not f & set(order[: k + 1]) for _, f in mine), len(gone), sum(x in f and bool(f & set(order[:k])) for _, f in mine), sum(f == {x} for _, f in mine), sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(share[order[k - 1]])
    return out


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, "en", s, None) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def check(spark, rows, labels, more=lambda d: d, **options):
    docs, known = frames(spark, rows, labels)
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in A.audit(more(docs), known, **options).collect()}
    assert got == brute(rows, labels)


def corpus(n, seed=1):
    r = random.Random(seed)
    texts = []
    for _ in range(n // 3):
        words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(r.choice([3, 210, 260, 900]))]
        text = " ".join(words) + r.choice(["", " #", " X" * 40, ""])
        texts += [text, text[:-1] + "z", text[:300] + "é" + text[301:]]  # copies up to some block, and of one length
    return [(i, r.choice(texts), f"s{r.randint(0, 2)}") for i in range(n)], [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, n, 2)]


def test_against_brute_force(spark):
    check(spark, *corpus(240))


def test_hash_collisions_are_told_by_the_texts(spark):
    """With one bit of hash, classes hold different texts of one length; only their whole texts tell them apart."""
    rows, labels = corpus(60, seed=2)
    check(spark, rows, labels, refined=lambda cls, block: cls * 0 + F.pmod(block, F.lit(2)))
    check(spark, rows, labels, refined=lambda cls, block: cls * 0)


def test_odd_rows(spark, clash):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None, None), (3, "", ""), (3, "", "a"), (None, "", "a"), (None, "x", None), (7, long, "a"), (6, long, "a"), (6, long, "b"), (8, long[:-1] + "q", "b")]
    labels = [(6, 1, 0), (6, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    check(spark, rows, labels, more=clash)
    docs, known = frames(spark, rows, labels)
    assert A.audit(docs.limit(0), known).count() == 0
    assert A.audit(docs, known.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_refinement_drops_singletons(spark):
    rows = [("aaa",), ("aab",), ("aaa",), ("b" * 3000,), ("b" * 2999 + "c",), ("c" * 700,), ("c" * 700,), ("",), ("",)]
    t = spark.createDataFrame(rows, "text string").select(F.length("text").alias("n_chars"), A.blocks(F.col("text")).alias("blocks"))
    assert A.classes_left(t).count() == 3


def test_blocks_cover_the_text(spark):
    n = 20_000
    base = "é" * n
    texts = [base] + [base[:k] + "x" + base[k + 1 :] for k in (0, 255, 256, 2047, 2048, 16383, 16384, n - 1)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(A.blocks(F.col("text")).alias("b")).collect()
    assert len({tuple(r.b) for r in got}) == len(texts) and {len(r.b) for r in got} == {4}
