"""Extraction and chunking of code: odd and broken texts; the registered queries compare whole samples."""

import random

import pytest

from lorespark.operators import chunking, extract, lexer


def calls(path, text):
    return {r[4] for r in extract.findings(path, text) if r[2] == "calls"}


@pytest.mark.parametrize("suffix", [".ts", ".rs", ".go", ".astro", ".py"])
def test_any_text_is_read(suffix):
    r = random.Random(2)
    parts = ["(", ")", "{", "}", "[", "]", "<", ">", "'", '"', "`", "/", "/*", "*/", "//", "\n", " ", "name", "class", "fn", "func", "import", "type", "use", "impl", "for", "=", ":", "::", ".", "#", "!", "é", "1", "r#\"", "---", "<script", "</script>"]
    for text in [None, "", " ", "\x00", "(" * 3000, "}" * 3000, "{" * 3000 + "}" * 3000, *["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(400)]]:
        rows = list(extract.findings("a" + suffix, text))
        assert all(isinstance(x[5], int) and x[5] >= 1 for x in rows)
        chunks = chunking.chunk("a" + suffix, text)
        assert chunks and all(c.content in (text or "") or c.content.rstrip("\n") in (text or "") for c in chunks if suffix in (".ts", ".rs", ".go"))


def test_tokens_cover_the_code():
    for language, text in (("script", "a?.b /* c */ `d ${e}` // f\n/g[/]h/i.test(x) / 2"), ("rust", "/* a /* b */ c */ 'x 'y' r#\"z\"# b\"w\" 1..2"), ("go", "a := `b\nc` // d\n'\\n'")):
        t = lexer.tokens(text, language)
        assert all(text[x.start : x.end] == x.text and x.line == text.count("\n", 0, x.start) + 1 for x in t)
        assert not any(x.text in ("c", "f") and language == "script" for x in t)
    pairs = lexer.tokens("([)]{", "go")
    assert [x.partner for x in pairs] == [2, -1, 0, -1, -1]


def test_script_calls():
    assert calls("a.ts", "new Thing(1); function own(a) {} foo?.bar(2); x[0](3); import('m'); this.go(4); gen<T>(5); if (no) {}") == {"this.go", "gen"}
    assert calls("a.js", "class A { own(x) { inner() } get size() { return 1 } field = made(2) }\nconst o = { own(y) { deep() } }") == {"inner", "made", "deep"}


def test_rust_calls():
    text = "#[derive(Own(x))] fn own(f: impl Fn(i32)) { match v { Some(y) => used(y), Err(_) | None => {} } let Some(z) = opt() else { stop() }; mac!(hidden(1)); a::b(c.d(e)); }"
    assert calls("a.rs", text) == {"used", "opt", "stop", "a::b", "c.d"}


def test_go_calls():
    text = "type I interface { Own(a int) }\nfunc (t *T) Own(x []byte) (r error) { y := []byte(zed()); go run(1); t.do(func(q int) { in(q) }) ; map[string]int(nil) }"
    assert calls("a.go", text) == {"zed", "run", "t.do", "in"}


def test_c_lines(spark):
    text = "#include <a.h>\n#  include \"b/c.h\"\nenum class\nunion u{\nconst T* fun(int a);\nstatic inline int gun(int a) {\nunsigned long hun(void);\nreturn one(two (3));\nif(x) sizeof(y); 9zed(1)\nvoid open(\n"
    files = spark.createDataFrame([("x.c", text), ("y.h", None), ("z.C", "T ff()"), ("w.py", "int f()")], "file_path string, text string")
    got = {(r.file_path, r.kind, r.target, r.line) for r in extract.from_cpp(files).collect()}
    assert got == {
        ("x.c", "imports_module", "a.h", 1), ("x.c", "imports_module", "b/c.h", 2), ("x.c", "enum", "class", 3), ("x.c", "struct", "u", 4), ("x.c", "calls", "fun", 5), ("x.c", "function", "gun", 6),
        ("x.c", "calls", "gun", 6), ("x.c", "calls", "hun", 7), ("x.c", "calls", "one", 8), ("x.c", "calls", "two", 8), ("x.c", "calls", "open", 10), ("z.C", "function", "ff", 1), ("z.C", "calls", "ff", 1),
    }
    assert not any(r.file_path in ("y.h", "w.py") for r in extract.from_cpp(files).collect())


def test_many_keywords_join_by_grams(spark, monkeypatch):
    from lorespark.operators import classify

    q = spark.createDataFrame([("a", "Reindex the cache"), ("b", ""), ("c", None), ("d", "x")], "query_id string, query string")
    k = spark.createDataFrame([("A", 0, "index"), ("A", 0, "he c"), ("B", 1, "x"), ("B", 1, ""), ("C", 2, None), ("C", 2, "nothing")], "artifact_id string, ord int, keyword string")
    few = {tuple(r) for r in classify.keyword_hits(q, k).collect()}
    monkeypatch.setattr(classify, "FEW_KEYWORDS", 0)
    assert few == {tuple(r) for r in classify.keyword_hits(q, k).collect()} == {("a", "A", 0, "index"), ("a", "A", 0, "he c"), ("a", "B", 1, "x"), ("d", "B", 1, "x")}


def test_vectors_of_several_sizes(spark):
    """A query's result does not depend on the sizes of the others."""
    from lorespark.operators import retrieval

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [1.0, 1.0])], "node_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.node_id, r.score) for r in retrieval.vector_search(v, q, 2).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (5, 0.707107), (2, 1): (3, 1.0), (2, 2): (1, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0)}


def test_bm25_by_brute_force(spark, monkeypatch):
    import math
    import re

    from lorespark.operators import retrieval, text_index

    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["cache", "index", "graph", "the", "a1", "B"]) for _ in range(r.randint(0, 12)))) for i in range(40)] + [(90, None), (91, "")]
    asked = [(1, "cache the cache"), (2, "Graph, b!"), (3, "unknown"), (4, None), (5, "")]
    tok = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    n, mean = len(docs), sum(len(tok(t)) for _, t in docs) / len([1 for _, t in docs])
    df = lambda w: sum(w in tok(t) for _, t in docs)
    want = {}
    for q, text in asked:
        scored = []
        for i, t in docs:
            s = sum(math.log(1 + (n - df(w) + 0.5) / (df(w) + 0.5)) * tok(t).count(w) * 2.5 / (tok(t).count(w) + 1.5 * (0.25 + 0.75 * len(tok(t)) / mean)) for w in set(tok(text)) if w in tok(t))
            if s > 0:
                scored.append((-round(s, 6), i))
        want |= {(q, k): x for k, x in enumerate(sorted(scored)[:7], 1)}
    d, a = spark.createDataFrame(docs, "node_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    for pairs in (text_index.BLOCK_PAIRS, 1):
        monkeypatch.setattr(text_index, "BLOCK_PAIRS", pairs)
        got = {(x.query_id, x.rank): (-x.score, x.node_id) for x in retrieval.bm25(d, a, 7).collect()}
        assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)
    assert retrieval.bm25(d.limit(0), a, 3).count() == 0 and retrieval.bm25(d, a.limit(0), 3).count() == 0
