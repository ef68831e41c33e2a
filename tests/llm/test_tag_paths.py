import html
import math
import random
import re

from lorespark.llm import tag_paths as T
from lorespark.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var x = "</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies, really. Yes, we do.</div><!-- <p>no</p> -->
<main><article class=post><header><h1>Title &amp; more</h1></header><p>One,  two;\nthree. <b>Four</b> five<br>six.<p>Short.
<blockquote><p>Quoted, text. Long enough, too.</p></blockquote><ul><li>first<li>second &lt;x&gt;</ul><form><input>mail</form>
<div class="ad-box">Buy, now! Buy.</div><table><tr><td>cell</table><section id="comments"><p>Nice, thanks. Great, work.</p></section></article>
<aside><p>Other, things. More, things.</p></aside></main><footer>&copy; footer, text.</footer></body></html>"""


def test_article_of_a_page():
    assert T.extract(PAGE)[0].split("\n") == ["Title & more", "One, two; three. Four five six.", "Short.", "Quoted, text. Long enough, too.", "first", "second <x>", "cell"]


def test_pages_without_an_article_element():
    said = "A paragraph of the text, with words, and points. And another sentence."
    page = f"<div id=menu><a href=1>one</a><a href=2>two</a></div><div id=content><h2>Head</h2><p>{said}</p><p>{said} More.</p><p>End.</p></div><div id=footer>foot, note.</div>"
    assert T.extract(page)[0] == f"Head\n{said}\n{said} More.\nEnd."
    assert T.extract(f"<p>{said}</p><p>{said}</p>")[0] == f"{said}\n{said}"


def test_ratios_prefer_text_to_links():
    blocks, paths = T.read_blocks("<body><div><p>Long text, with points. And more, of it.</p></div><div><span><a>one</a></span></div></body>")
    r = T.path_ratios(blocks, paths)[0]
    assert paths.label == ["", "body", "div", "p"] and r[3] > 0 and r[2] == 0


def test_odd_markup():
    for page in (None, "", "   ", "<", "<>", "</p>", "<p", "<!--", "<script>", "<nav>only</nav>", "<p a='unclosed>x", "&", "<svg/><b>"):
        assert isinstance(T.extract(page)[0], str)
    assert T.extract(None) == ("", []) and T.extract("<nav>a, b.</nav>")[0] == ""
    assert T.extract("<article><p>x &amp y &#233;&nbsp;z</p>unclosed, text. Yes")[0] == "x & y é z\nunclosed, text. Yes"
    deep = "<div>" * 3000 + "text, text." + "</div>" * 3000
    assert T.extract(deep)[0] == "text, text."
    assert T.extract("<article>" + "<p>word, word.</p>" * 20_000 + "</article>")[0].count("\n") == 19_999


def test_generated_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r.page_id: r for r in T.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|$)", r.html)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        want = "\n".join(filter(None, blocks))
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_on_frames(spark, clash):
    d = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", ""), (None, "u", PAGE)], "page_id long, url string, html string")
    got = T.extract_pages(clash(d)).collect()
    assert sorted(r.n_chars for r in got)[:3] == [0, 0, 0] and len(got) == 4 and T.extract_pages(d.limit(0)).count() == 0


def test_unfinished_tags():
    assert T.extract("<article><p>text, here. And more</p><p")[0] == "text, here. And more"
    assert T.extract("<article><p>text, here. 1 < 2")[0] == "text, here. 1 < 2"
    assert T.read_blocks('<a "' * 50_000)[0] == [] and len(T.read_blocks('<p>x' * 9 + '<b "' * 20_000 + ">")[0]) == 9


def test_short_blocks_of_a_bare_page():
    said = "Words of the text, and points. " * 9
    for n, more in ((5, 1), (8, 2)):
        text = (said * more).strip()
        page = f"<nav><a href=/>Home</a></nav><h1>A title of some forty characters, or so.</h1>{f'<p>{text}</p>' * n}<ul><li>first<li>second</ul><div><a href=3>Three</a></div>"
        for form in ("<html><body>%s</body></html>", "<body>%s</body>"):
            got = T.extract(form % page)[0].split("\n")
            assert got == ["A title of some forty characters, or so.", *[text] * n, "first", "second"]


def test_links_of_an_article():
    said = "Words of the text, and points. And another sentence, too."
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=post>", "</div>")):
        page = f"<body>{open_}<p>{said}</p><p>{said}</p><ul><li><a href=1>Source one</a><li><a href=2>Source two</a></ul><p hidden>no</p>{close}<ul><li><a href=3>Home</a></ul></body>"
        assert T.extract(page)[0] == f"{said}\n{said}\nSource one\nSource two"


def test_titles_tails_and_suspect_blocks_stay():
    long = "Words of the text, and points. " * 8
    long = long.strip()
    for page, want in (
        (f"<div><h1>A head</h1><div class=b><p>{long}</p></div><p>tail</p></div>", ["A head", long, "tail"]),
        (f"<main><header><h1>Title</h1></header><p>{long}</p></main><header><p>Site</p></header>", ["Title", long]),
        (f"<article><p>{long}</p><div class=promo-story><p>{long}</p></div><div class=promo><p>Buy.</p></div></article>", [long, long]),
        (f"<article><p>{long}</p><p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", [long, "Where x=1 holds."]),
        (f"<article><p>{long}</p><ul class=share-links><li>Share this</li></ul><p>Yes.</p></article>", [long, "Yes."]),
    ):
        assert T.extract(page)[0].split("\n") == want
        assert T.extract(f"<html><body><nav><a href=1>Home</a></nav>{page}<footer>foot, note.</footer></body></html>")[0].split("\n") == want


def test_deep_nesting_takes_time_and_memory_in_proportion():
    import time
    import tracemalloc

    for n in (20_000, 50_000):
        for page in ("<div>text" * n, "<li><ul>x" * n, "<div><p>text, text." * n + "</div>" * n, "<ul><li>" + "<div>a" * n + "<li>b</li>" * 20):
            tracemalloc.start()
            begin = time.time()
            text, tree = T.extract(page)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert time.time() - begin < 15 and peak < 300e6 and text.count("\n") >= n - 1  # traced, some three times slower


def naive(page):
    """Paths as whole tuples, sums and smoothing by loops, the content node by common prefixes."""
    blocks, paths = T.read_blocks(page)
    full = lambda p: () if p <= 0 else (*full(paths.parent[p]), (paths.label[p], p))
    where = [full(b.path) for b in blocks]
    of = {}
    for i, w in enumerate(where):
        of.setdefault(w, []).append(i)
    noise = lambda w: bool(w) and paths.noise[w[-1][1]]
    size = [0 if noise(w) else len(b.text) for b, w in zip(blocks, where, strict=True)]
    dots = [0 if noise(w) else sum(c in ".,;:!?…。，、！？" for c in b.text) for b, w in zip(blocks, where, strict=True)]
    own = [max(0, 1 - b.linked / len(b.text)) for b in blocks]
    avg = lambda w, x: sum(x[i] for i in of[w]) / len(of[w])
    length, points = [avg(w, size) for w in where], [avg(w, dots) for w in where]
    g = [math.exp(-0.5 * k * k) for k in (-2, -1, 0, 1, 2)]
    smooth = lambda x: [sum(g[k + 2] / sum(g) * x[i + k] for k in (-2, -1, 0, 1, 2) if 0 <= i + k < len(x)) for i in range(len(x))]
    a, b = smooth(length), smooth(points)
    fused = lambda w, x, y: 0 if noise(w) else avg(w, [u * math.log(2 + v) for u, v in zip(x, y, strict=True)]) * avg(w, own)
    plain = {w: fused(w, length, points) for w in of}
    top = max(plain.values(), default=0)
    weak = lambda w: bool(w) and paths.suspect[w[-1][1]] and plain[w] < 0.5 * top
    ratio = {w: 0 if weak(w) else fused(w, a, b) for w in of}
    if not of or max(ratio.values()) <= 0:
        return ""
    best = max(of, key=lambda w: (round(sum(len(blocks[i].text) for i in of[w]) * ratio[w], 6), -(w[-1][1] if w else 0)))
    tag = lambda x: x[0].split(".")[0]
    ends = [[k for k, x in enumerate(best) if tag(x) == t and (t == "main" or not paths.own[x[1]])] for t in ("article", "main")]
    last = next((e[0] for e in ends if e), None)
    others = []
    if last is not None:
        node = best[: last + 1]
        if ends[0]:
            around = lambda w: next((w[: k + 1] for k, x in enumerate(w) if tag(x) == "article" and not paths.own[x[1]]), None)
            held = {}
            for w in of:
                if around(w) and ratio[w] > 0:
                    held[around(w)] = held.get(around(w), 0) + sum(len(blocks[i].text) for i in of[w])
            others = [a for a, n in held.items() if 2 * n >= held[node]]
    else:
        strong = [w for w in of if ratio[w] >= 0.1 * max(ratio.values())]
        node = strong[0]
        for w in strong:
            while w[: len(node)] != node:
                node = node[:-1]
        while node and tag(node[-1]) in T.LEAVES:
            node = node[:-1]
    bare = not node or tag(node[-1]) in ("html", "body")
    chars = {w: (sum(len(blocks[i].text) for i in i_), sum(blocks[i].linked for i in i_)) for w, i_ in of.items()}
    inside = lambda w: any(w[: len(x)] == x for x in [node, *others])
    title = lambda w: not bare and len(w) > 1 and tag(w[-1]) == "h1" and tag(w[-2]) == "header" and inside(w[:-1]) and not noise(w[:-2])
    head = {w[:-1] for w in of if title(w)}
    keep = [b.text for b, w in zip(blocks, where, strict=True) if inside(w) and (not noise(w) or title(w) or w in head) and not weak(w) and (not bare or 2 * chars[w][1] <= chars[w][0])]
    return "\n".join(keep)


def test_by_brute_force(spark, sf):
    r = random.Random(8)
    tags = ["div", "p", "ul", "li", "section", "article", "main", "h2", "td", "table", "tr", "aside", "nav", "div class=promo", "div class='x ad'", "div id=b", "header", "body"]

    def some(depth):
        out = ""
        for _ in range(r.randint(0, 4)):
            t = r.choice(tags)
            text = " ".join(r.choice(["word", "words, more", "end.", "x"]) for _ in range(r.choice([0, 1, 3, 20])))
            text = f"<a href=1>{text}</a>" if r.random() < 0.2 else text
            out += f"<{t}>{text}{some(depth - 1) if depth else ''}" + (f"</{t.split()[0]}>" if r.random() < 0.8 else "")
        return out

    pages = [PAGE, *[some(3) for _ in range(400)], *[x.html for x in table(spark, sf, "pages").collect()]]
    got = [T.extract(p)[0] for p in pages]
    assert got == [naive(p) for p in pages]
    assert sum(map(bool, got)) > 300


def test_names_are_a_prior_only():
    """Layout classes, wrapping forms, nested and several articles, titles in headers, comments by other names."""
    long = ("Words of the text, and points. " * 16).strip()
    two = f"<p>{long}</p><p>{long}</p>"
    both = [long, long]
    for page, want in (
        (f"<form id=aspnet>{two}</form>", both),
        (f"<form id=aspnet><div class=nav><a href=1>Home</a></div>{two}<input name=q><div class=footer>foot</div></form>", both),
        (f"<div class='page no-sidebar'>{two}</div>", both),
        (f"<div class='post ad-free'>{two}</div>", both),
        (f"<div class='has-sidebar'><div>{two}</div><div class=sidebar><p>{long}</p></div></div>", both),
        (f"<article><p>{long}</p><p class=share-of-market>{long}</p></article>", both),
        (f"<article><h1>Title</h1><p>Intro, here.</p><article class=quote>{two}</article><p>Tail.</p></article>", ["Title", "Intro, here.", *both, "Tail."]),
        (f"<main><article class=a>{two}</article><article class=b><p>{long}</p></article><article class=teaser><p>Short one.</p></article></main>", [*both, long]),
        (f"<div><header><h1>Title</h1></header>{two}</div>", ["Title", *both]),
        (f"<div id=all><header><h1>Site</h1></header><div class=text>{two}</div></div>", both),
        (f"<article>{two}</article><div class=discussion><p>{long}</p><p>{long}</p><p>{long}</p></div>", both),
        (f"<main>{two}<div class=user-responses><p>{long}</p></div></main>", both),
        (f"<article>{two}<section class=comments><article class=comment><p>{long}</p></article><article><p>{long}</p></article></section></article>", both),
    ):
        assert T.extract(f"<html><body><nav><a href=1>Home</a></nav>{page}<footer>foot, note.</footer></body></html>")[0].split("\n") == want, page[:80]
