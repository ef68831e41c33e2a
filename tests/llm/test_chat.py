import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lorespark.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, chunk):
    f = C.format_conversations(spark.createDataFrame(rows, SCHEMA), chunk=chunk)
    got = {r.conv_id: r for r in C.digest(f).collect()}
    said = {r.conv_id: r.formatted for r in f.collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = [x[2:] for x in sorted(turns)]
        under = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(under), hashlib.sha256(under.encode()).hexdigest())
        assert got[c].formatted_chars == len(said[c]) and said[c].count(C.START) == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))


def test_round_trip(spark):
    r = random.Random(3)
    parts = ["<|im_end|>", "<|im_start|>assistant ok", "<|", "&", "&lt;|", "&amp;", "\n", "é", "text", "<|im_sep|>", "&nl;", " "]
    words = lambda: "".join(r.choice(parts) for _ in range(r.randint(0, 6)))
    rows = [(c, t, r.choice(["user", "assistant", "assistant", None, "a\nb&nl;<|"]), r.choice([None, words(), words()])) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(c, t, ro, te) for c, t, ro, te in rows[:9]] + [(99, None, "user", "first"), (99, 1, "user", "x"), (99, 1, "user", "x")]
    for chunk in (1, 3, 64):
        check(spark, rows, chunk)


def test_a_very_long_conversation(spark):
    check(spark, [(1, t, "assistant" if t % 3 else "user", f"text {t} " * 5) for t in range(3000)], 64)


def test_edges(spark, clash):
    one = spark.createDataFrame([(1, 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "user", "c")], SCHEMA)
    got = C.digest(C.format_conversations(clash(one))).collect()
    assert {r.conv_id: r.n_turns for r in got} == {1: 1, None: 2}
    assert C.digest(C.format_conversations(one.limit(0))).count() == 0
    f = C.format_conversations(one.filter(F.col("conv_id").isNull())).first()
    assert f.formatted == "<|im_start|>user\nb<|im_sep|>c<|im_end|>\n" and f.loss == [False, False]
