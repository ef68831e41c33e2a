"""HTML extraction by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of block elements. For every path of the page, text
length, punctuation and link text are summed up over its blocks; the length and punctuation per block are smoothed over
the blocks' order with a small Gaussian window and fused with the share of text outside links into the path's ratio.
Paths of at least SHARE of the largest ratio are strong, and they select the content node: the least element path that
all strong paths lie in, or the outermost article, else main element around the path with the most text, if there is
one; other articles of half its text or more are taken with it. A content node is taken whole, however short its blocks are and also if they are links; only where it is the page's body, paths
whose text is mostly links stay out.

Elements that are never article text (navigation, page footers, sidebars, reader comments, scripts, ...) and those whose
class, id or role says so (NOISE) have the ratio nil and stay out. A name says so by its first or last word, and not
where another word turns it (`no-sidebar`, `ad-free`, `share-of-market`: LAYOUT). Names are a prior only: a form or a
name that holds half or more of the page's text outside links, and its title or article if it has any, is taken for the
page's layout and counts as any other element (STRICT ones, such as comments, never do). Words that say it of some elements only (SUSPECT, such as promo or
notice) leave the decision to the ratios: such a path stays out unless it is as strong, before smoothing, as half of the
strongest one. A header that holds the page's h1 inside the content node belongs to it.

Paths are nodes of a tree with parent numbers, made once for each different path, so that a page takes time and memory
in proportion to its length however deep its elements nest.

Defined results: a null or empty html gives an empty text; a page without text outside excluded elements, too; repeated
rows are read one by one; an empty table gives an empty result; other columns are ignored; a null url stays null; pages
are read whole; of paths with equally much text the first in the page counts; unclosed and stray tags are closed and
dropped as browsers do for block elements.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

# Fixed names of HTML elements by what they do to a page's text
INLINE = set([
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "rp", "rt", "ruby", "math", "mfrac", "mi", "mn", "mo",
    "mroot", "mrow", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "mover", "munder", "munderover", "semantics",
])
VOID = set(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = set([
    "script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "svg", "template", "select", "object", "annotation",
    "annotation-xml",
])
EXCLUDED = set(["nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset", "header"])
ENDS_P = set([
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
])
ENDS_LIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that hold text or parts of a list or table and are no content node by themselves
LEAVES = set([
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "table", "thead", "tbody", "tfoot", "tr", "td",
    "th", "caption",
])
# Fixed words of class, id and role values that mark what is not article text, or may mark it
NOISE = set(
    [
        "ad", "ads", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent",
        "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation",
        "discussion", "discussions", "pagination", "popup", "replies", "reply", "responses", "share", "sharing", "sidebar", "signup", "site-footer",
        "site-header", "toolbar", "topbar",
    ]
)
# Fixed words: those of NOISE that no amount of text overrides, and those that turn a name into one of the page's layout
STRICT = set([
    "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "discussion", "discussions", "disqus",
    "footer", "gdpr", "login", "masthead", "menubar", "navbar", "navigation", "pagination", "popup", "replies", "reply", "responses", "site-footer",
    "site-header",
])
LAYOUT = set(["for", "free", "has", "hide", "no", "non", "not", "of", "with", "without"])
SUSPECT = set([
    "banner", "header", "legal", "newsletter", "notice", "notices", "notification", "overlay", "promo", "promotion", "related", "respond", "search",
    "social", "sponsor", "sponsored", "subscribe", "subscription", "widget", "widgets",
])
#: A path of this share of the largest ratio is strong; one with a suspect name needs the second share, before smoothing
SHARE, SUSPECT_SHARE = 0.1, 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_NAMED = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


class Paths:
    """The page's different paths as a tree; a path's number is larger than its parent's. Number 0 is the page itself."""

    def __init__(self) -> None:
        self.parent, self.tag, self.label, self.noise, self.suspect = [-1], [""], [""], [False], [False]
        self.own, self.may = [False], [False]  # whether noise begins here, and whether the page's text may override that
        self.article, self.main = [-1], [-1]  # the outermost such path around, or the path itself
        self._known: dict[tuple[int, str, bool], int] = {}

    def child(self, parent: int, tag: str, attributes: str) -> int:
        names = [x for m in _NAMED.finditer(attributes) for x in (m[2] or m[3] or m[4] or "").lower().split()]
        hidden = bool(_HIDDEN.search(attributes))
        label = ".".join([tag, *sorted(names)])
        key = (parent, label, hidden)
        found = self._known.get(key)
        if found is None:
            inside = self.article[parent] >= 0 or self.main[parent] >= 0
            words, ends = _words(names) if names else (_NONE, _NONE)
            open_ = tag in ("html", "body", "main") or tag == "article" and not words & {"comment", "comments", "reply"}
            named = ends & NOISE if ends and not open_ else _NONE
            noise = hidden or tag in EXCLUDED and not (tag == "header" and inside) or bool(named)
            found = self._known[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.label.append(label)
            self.noise.append(noise or self.noise[parent])
            self.own.append(noise)
            self.may.append(noise and not hidden and not named & STRICT and (tag not in EXCLUDED or tag in ("form", "fieldset")))
            self.suspect.append(self.suspect[parent] or bool(words & SUSPECT) and not open_)
            self.article.append(self.article[parent] if self.article[parent] >= 0 or tag != "article" or noise else found)
            self.main.append(self.main[parent] if self.main[parent] >= 0 or tag != "main" else found)
        return found

    def weigh(self, blocks: list[Block]) -> None:
        """Takes names that hold half or more of the page's text outside links for layout.

        Such an element has the page's title, article or main in it; where these are nowhere, two blocks of text at least.
        """
        n = len(self.parent)
        size, times, head = [0] * n, [0] * n, [t in ("article", "main", "h1") for t in self.tag]
        for b in blocks:
            size[b.path] += max(0, len(b.text) - b.linked)
            times[b.path] += 1
        total = 0
        for k in range(n - 1, -1, -1):  # what a path has that no noise within holds
            p = self.parent[k]
            if not self.own[k] and k:
                size[p] += size[k]
                times[p] += times[k]
                head[p] = head[p] or head[k]
            elif not k or self.may[k]:
                total += size[k]
        for k in range(1, n):
            if self.may[k] and 2 * size[k] >= total > 0 and (head[k] or not head[0] and times[k] > 1):
                self.own[k] = False
            self.noise[k] = self.own[k] or self.noise[self.parent[k]]


_NONE: set[str] = set()


def _words(names: list[str]) -> tuple[set[str], set[str]]:
    """All words of the names and the names themselves, and those that can mark noise: first and last ones, without LAYOUT."""
    words, ends = set(names), set()
    for name in names:
        parts = re.split(r"[-_]+", name)
        words.update(parts)
        if not LAYOUT & set(parts):
            ends |= {name, parts[0], parts[-1]}
    return words, ends


class Block:
    __slots__ = ("path", "parts", "linked", "text")

    def __init__(self, path: int) -> None:
        self.path, self.parts, self.linked, self.text = path, [], 0, ""


class Open:
    """The open elements, with the places of each tag, so that closing looks nowhere else."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, path: int) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, path))

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def close(self, place: int) -> None:
        """Closes the element at a place and all that are open in it."""
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()

    def path(self) -> int:
        return self.stack[-1][1] if self.stack else 0


def read_blocks(page: str) -> tuple[list[Block], Paths]:
    """The page's blocks of text in order, those without text left out, and its paths."""
    open_, paths = Open(), Paths()
    blocks: list[Block] = []
    current: Block | None = None
    links, at, n = 0, 0, len(page)
    last = page.rfind(">")  # behind it there is no complete tag, so nothing is searched for in vain

    def add(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(open_.path())
            blocks.append(current)
        text = html_lib.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if links:
            current.linked += len(text)

    while at < n:
        if at > last:
            unfinished = re.compile(r"<[A-Za-z/!]").search(page, at)
            add(page[at : unfinished.start() if unfinished else n])
            break
        m = _TOKEN.search(page, at)
        add(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            links = max(0, links + (-1 if end else 1)) if tag == "a" else links
            continue
        if tag in RAW and not end:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag in VOID:
            if tag == "br" and current is not None:
                current.parts.append(" ")
            elif tag == "hr":
                current = None
            continue
        current, links = None, 0
        if end:
            place = open_.last((tag,))
            if place >= 0:
                open_.close(place)
            continue
        if tag in ENDS_P:
            place = open_.last(("p",))
            if place > open_.last(("td", "th", "table", "body", "article")):
                open_.close(place)
        if tag in ENDS_LIKE:
            same, stop = ENDS_LIKE[tag]
            place = open_.last(stop)
            while (k := open_.last(same)) > place:
                open_.close(k)
        if tag == "body":  # a second one is dropped; an unclosed head ends here
            if open_.last(("body",)) >= 0:
                continue
            open_.close(open_.last(("html",)) + 1)
        open_.push(tag, paths.child(open_.path(), tag, attributes))
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    blocks = [b for b in blocks if b.text]
    paths.weigh(blocks)
    return blocks, paths


def path_ratios(blocks: list[Block], paths: Paths, radius: int = 2, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The fused ratio of every path of the page, and the same without smoothing; both nil where there is no own text."""
    path, n = np.array([b.path for b in blocks]), len(paths.parent)
    noise = np.array(paths.noise)[path]
    size = np.where(noise, 0, [len(b.text) for b in blocks])
    dots = np.where(noise, 0, [len(_PUNCTUATION.findall(b.text)) for b in blocks])
    own = np.maximum(0.0, 1 - np.array([b.linked for b in blocks]) / np.array([len(b.text) for b in blocks]))
    times = np.maximum(1, np.bincount(path, minlength=n))
    mean = lambda x: np.bincount(path, x, minlength=n) / times
    window = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    window /= window.sum()
    length, points = mean(size)[path], mean(dots)[path]
    smooth = lambda x: np.convolve(x, window, mode="full")[radius : radius + len(x)]
    fuse = lambda x, y: np.where(paths.noise, 0.0, mean(x * np.log1p(1 + y)) * mean(own))
    return fuse(smooth(length), smooth(points)), fuse(length, points)


def content_node(strong: np.ndarray, paths: Paths) -> int:
    """The innermost path that all strong ones lie in, not itself a paragraph, a list or a part of a table."""
    below = strong.astype(np.int64)
    for k in range(len(below) - 1, 0, -1):
        below[paths.parent[k]] += below[k]
    node = int(np.flatnonzero(below == strong.sum())[-1])  # those that hold all are a chain, and numbers rise along it
    while paths.tag[node] in LEAVES:
        node = paths.parent[node]
    return node


def extract(page: str | None) -> tuple[str, list[dict]]:
    """The main text of a page, its blocks joined by line feeds, and the page's tree of paths with ratios."""
    blocks, paths = read_blocks(page or "")
    if not blocks:
        return "", []
    ratio, plain = path_ratios(blocks, paths)
    weak = np.array(paths.suspect) & (plain < SUSPECT_SHARE * plain.max())
    ratio = np.where(weak, 0.0, ratio)
    n, content = len(paths.parent), np.zeros(len(paths.parent), bool)
    if ratio.max() > 0:
        path = np.array([b.path for b in blocks])
        chars = np.bincount(path, [len(b.text) for b in blocks], minlength=n)
        best = int(np.argmax(chars * ratio))
        node = paths.article[best] if paths.article[best] >= 0 else paths.main[best]
        nodes = {node}
        if node < 0:
            nodes = {node := content_node(ratio >= SHARE * ratio.max(), paths)}
        elif paths.tag[node] == "article":
            own = np.bincount(np.maximum(np.array(paths.article), 0), np.where(ratio > 0, chars, 0), minlength=n)
            nodes |= {k for k in set(paths.article) if k >= 0 and 2 * own[k] >= own[node]}
        within, noise = np.zeros(n, bool), np.array(paths.noise)
        for k in range(n):
            within[k] = k in nodes or k > 0 and within[paths.parent[k]]
        if paths.tag[node] not in ("", "html", "body"):
            for k in [k for k in range(n) if paths.tag[k] == "h1" and within[k]]:  # a header with the title of what it stands in
                p = paths.parent[k]
                if paths.tag[p] == "header" and within[p] and not paths.noise[paths.parent[p]]:
                    noise[[p, k]] = False
        content = within & ~noise & ~weak
        if paths.tag[node] in ("", "html", "body"):
            content &= 2 * np.bincount(path, [b.linked for b in blocks], minlength=n) <= chars
    tree = [{"label": x, "parent": p, "ratio": float(r), "content": bool(c)} for x, p, r, c in zip(paths.label, paths.parent, ratio, content, strict=True)]
    return "\n".join(b.text for b in blocks if content[b.path]), tree


TREE = "array<struct<label: string, parent: int, ratio: double, content: boolean>>"


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the tree of paths of every page; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [extract(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], tree),
                ], names=["page_id", "url", "text", "n_chars", "paths"])

    tree = pa.list_(pa.struct([("label", pa.string()), ("parent", pa.int32()), ("ratio", pa.float64()), ("content", pa.bool_())]))
    p = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return p.mapInArrow(run, f"page_id long, url string, text string, n_chars long, paths {TREE}")
