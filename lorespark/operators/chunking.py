"""Chunkers: Python by its syntax tree, TypeScript, JavaScript, Rust and Go by their tokens, text by lines.

Each document is cut where it is read, without a shuffle. Defined results: a null text is an empty one; code without
functions and types, and Python that cannot be parsed, is one chunk; an item that never ends is no chunk.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame

from lorespark.operators.lexer import tokens

MAX_TOKENS, CHARS_PER_TOKEN, CLASS_HEAD_LINES = 1500, 4, 10
SYNTAX = {".ts": "script", ".tsx": "script", ".js": "script", ".jsx": "script", ".rs": "rust", ".go": "go"}
#: By language: words that open a function, those that open a type, and what may stand before them in their statement
OPENERS = {
    "script": ({"function"}, {"class", "interface", "enum"}, {"export", "default", "declare", "abstract", "async", "const"}),
    "rust": ({"fn"}, {"struct", "enum", "trait", "union", "impl"}, {"pub", "async", "const", "unsafe", "extern", "default"}),
    "go": ({"func"}, {"type"}, set()),
}
SCHEMA = "node_id long, pos int, content string, start_line int, end_line int, type string, name string"


@dataclass
class Chunk:
    content: str
    start_line: int
    end_line: int
    type: str
    name: str


def whole(text: str, name: str, kind: str) -> list[Chunk]:
    return [Chunk(text, 1, len(text.splitlines()), kind, name)]


def python_chunks(text: str, name: str) -> list[Chunk]:
    """Functions, class heads and methods; the whole module if there are none or it cannot be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return whole(text, name, "module")
    lines = text.splitlines(keepends=True)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def body(node: ast.AST, kind: str) -> Chunk:
        return Chunk("".join(lines[node.lineno - 1 : node.end_lineno]), node.lineno, node.end_lineno, kind, node.name)

    out: list[Chunk] = []
    for node in tree.body:
        if isinstance(node, functions):
            out.append(body(node, "function"))
        elif isinstance(node, ast.ClassDef):
            head = "".join(lines[node.lineno - 1 : node.lineno - 1 + CLASS_HEAD_LINES])
            out.append(Chunk(head, node.lineno, min(node.lineno + CLASS_HEAD_LINES, node.end_lineno), "class", node.name))
            out += [body(m, "method") for m in node.body if isinstance(m, functions)]
    return out or whole(text, name, "module")


def syntax_chunks(text: str, name: str, language: str) -> list[Chunk]:
    """Top functions, types and the methods of classes, traits and impls; the whole module if there are none.

    A type with methods is a chunk of its first lines, like a class of Python; one without is a chunk as a whole.
    """
    t, lines = tokens(text, language), text.split("\n")
    functions, types, before = OPENERS[language]
    said = lambda k: t[k].text if 0 <= k < len(t) else ""

    def end(k: int) -> int:
        """The place of the brace that closes the item at k, or of the semicolon before any brace; -1 if there is none."""
        begin = k
        while k < len(t):
            if t[k].text == "{" or t[k].text in "([" and t[k].partner > k:
                if t[k].text == "{":
                    return t[k].partner
                k = t[k].partner
            if t[k].text == ";":
                return k
            ended = t[k].kind != "mark" or t[k].text in (")", "]")  # where a line's end is a semicolon
            if language == "go" and k > begin and ended and (k + 1 == len(t) or t[k + 1].line > t[k].line):
                return k
            k += 1
        return -1

    def cut(first: int, last: int, kind: str, called: str, most: int = 0) -> Chunk:
        a, b = t[first].line, t[last].line
        b = min(b, a + most - 1) if most else b
        return Chunk("\n".join(lines[a - 1 : b]) + ("\n" if b < len(lines) else ""), a, b, kind, called)

    def methods(k: int, last: int) -> list[Chunk]:
        """The functions directly inside the braces from k to last."""
        out, i, first = [], k + 1, k + 1
        while i < last:
            if t[i].text in "([" and t[i].partner > i and i > first and t[i - 1].kind == "name" and said(t[i].partner + 1) != "=>":
                called = next((said(j + 1) for j in range(first, i) if said(j) == "fn"), said(i - 1))
                close = end(i)
                if -1 < close <= last and said(close) == "}":
                    out.append(cut(first, close, "method", called))
                i = first = max(close, i) + 1
                continue
            if t[i].text == "{" and t[i].partner > i:
                i = t[i].partner
                first = i + 1
            elif t[i].text in (";", ","):
                first = i + 1
            elif t[i].text == "=" and language == "script":  # a field's value, up to its semicolon or line
                line = t[i].line
                while i < last and said(i) != ";" and (t[i + 1].line == line or t[i].partner > i):
                    i = t[i].partner if t[i].partner > i else i + 1
                    line = t[i].line
                first = i + 1
            i += 1
        return out

    out: list[Chunk] = []
    k = 0
    while k < len(t):
        first = k
        while said(k) in before or said(k) == "(" and said(k - 1) == "pub" or t[k].kind == "string" and said(k - 1) == "extern":
            k = t[k].partner + 1 if said(k) == "(" and t[k].partner > k else k + 1
            if k >= len(t):
                return out or whole(text, name, "module")
        word = said(k)
        if word not in functions | types or t[k].kind != "name" or said(k - 1) in (".", "::"):
            k = t[k].partner + 1 if t[k].partner > k else k + 1
            continue
        last = end(k)
        if last < 0:
            k += 1
            continue
        at = k + 1
        if word == "func" and said(at) == "(" and t[at].partner > at:  # a receiver
            at = t[at].partner + 1
            out.append(cut(first, last, "method", said(at)))
        elif word in functions:
            out.append(cut(first, last, "function", said(at + (said(at) == "*"))))
        else:
            brace = t[last].partner if said(last) == "}" else -1
            inside = methods(brace, last) if word in ("class", "trait", "impl") and brace >= 0 else []
            if word != "impl":
                out.append(cut(first, last, "class", next((x.text for x in t[at : at + 2] if x.kind == "name"), name), CLASS_HEAD_LINES if inside else 0))
            out += inside
        k = last + 1
    return out or whole(text, name, "module")


def packed_lines(text: str, name: str, limit: int) -> list[Chunk]:
    """Lines in order, as many to a chunk as fit into the limit; a longer line is a chunk of its own."""
    if len(text) <= limit:
        return whole(text, name, "text")
    out: list[Chunk] = []
    held: list[str] = []
    size, start = 0, 1
    lines = text.splitlines(keepends=True)
    for at, line in enumerate(lines, 1):
        if held and size + len(line) > limit:
            out.append(Chunk("".join(held), start, at - 1, "text", f"{name}_part{len(out) + 1}"))
            held, size, start = [], 0, at
        held.append(line)
        size += len(line)
    if held:
        out.append(Chunk("".join(held), start, len(lines), "text", f"{name}_part{len(out) + 1}"))
    return out


def chunk(path: str, text: str | None, max_tokens: int = MAX_TOKENS) -> list[Chunk]:
    """The chunks of a document by its suffix."""
    p = PurePosixPath(path)
    if p.suffix.lower() == ".py":
        return python_chunks(text or "", p.stem)
    if p.suffix.lower() in SYNTAX:
        return syntax_chunks(text or "", p.stem, SYNTAX[p.suffix.lower()])
    return packed_lines(text or "", p.stem, max_tokens * CHARS_PER_TOKEN)


def chunked(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """All chunks of docs (node_id, file_path, text), numbered within their document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, i, *vars(c).values()) for n, p, t in zip(f["node_id"], f["file_path"], f["text"], strict=True) for i, c in enumerate(chunk(p, t, max_tokens))]
            yield pd.DataFrame(rows, columns=["node_id", "pos", "content", "start_line", "end_line", "type", "name"])

    return docs.select("node_id", "file_path", "text").mapInPandas(run, SCHEMA)
