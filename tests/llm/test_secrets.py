import hashlib
import re

from lorespark.llm import secrets as S


def test_base_spans():
    t = 'é token = "abcdefgh12" password:short AKIAABCDEFGHIJKL99 ' + "0" * 32 + " Api_Key='zzzzzzzz'"
    got = [(k, t[s:e]) for k, s, e, _ in S.base_spans(t)]
    assert got == [("assign", 'token = "abcdefgh12'), ("access", "AKIAABCDEFGHIJKL99"), ("hex", "0" * 32), ("assign", "Api_Key='zzzzzzzz")]
    assert S.base_spans("AKIAABC " + "a1" * 15 + " ſecret=12345678 to\u212Aen=12345678") == []


def brute(text):
    """The same by plain patterns over the text, kind by kind."""
    out = []
    for kind, p, least, g in (("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2), ("access", r"AKIA[A-Z0-9]+", 16, 0), ("hex", r"[0-9a-f]+", 32, 0)):
        out += [(m.start(), S.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[g]) >= least]
    return ",".join(x for *_, x in sorted(out))


LIVE = "aB3dE5gH7jK9mN1pQ2rS"


def test_ownership(make, clash):
    rows = [
        (1, f"key {LIVE} here", "en", "s1"), (2, f"key {LIVE} here", "de", "s1"), (3, "key zX8cV6bN4mM2aS1dF3gQ", "en", "s1"), (4, "key zX8cV6bN4mM2aS1dF3gQ", "en", "s2"),
        (5, "token=abcdefgh1", "en", "s1"), (6, "token=abcdefgh1", "en", "s3"), (7, None, None, None), (8, "", "en", "s1"), (8, "", "en", "s1"), (None, "password = hunter2hunter2", None, None),
    ]
    d = clash(make(rows))
    got = {r.doc_id: r for r in S.scan(d).collect() if r.doc_id != 8}
    assert got[1].spans == got[2].spans == "live:4:24" and got[1].n_owned == 1  # one owner
    assert got[3].spans == got[4].spans == ""  # two owners: a copied example, not added
    assert got[5].spans == "assign:0:15" and (got[5].n_owned, got[5].n_copied) == (0, 1)  # base spans stay
    assert got[7].spans == "" and got[7].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].n_assign == 1 and got[None].found[0].kind == "assign"
    assert S.scan(d).count() == 10 and S.scan(d.limit(0)).count() == 0


def test_base_against_brute_force(spark, sf):
    from lorespark.llm.common import table

    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in S.scan(docs).collect():
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_placeholders_are_not_live():
    assert S.looks_live(LIVE) and not S.looks_live("EXAMPLEaB3dE5gH7jK9mN") and not S.looks_live("a" * 30) and not S.looks_live("aB3" * 9)
    assert S.candidate_spans("x" * 100_000, []) == []
