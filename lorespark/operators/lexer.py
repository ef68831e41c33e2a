"""Tokens of brace languages: names, strings and marks, without comments, with each bracket's partner.

Comments and the insides of strings never give tokens, so what is read from tokens is code. Unfinished strings and
comments end with the text; brackets without a partner have none. Time is in proportion to the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_QUOTED = r'"(?:\\.|[^"\\\n])*"?'
_LINE = r"//[^\n]*"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*(?:\*/)?"
_NAME = r"[^\W\d]\w*"
_NUMBER = r"\d[\w.]*"
#: By language: what is left out, what is a string, what is a name, and the marks of more than one character
_PARTS = {
    "script": (rf"{_LINE}|{_BLOCK}", rf"{_QUOTED}|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", r"[#@]?[^\W\d][\w$]*|\$[\w$]*", r"=>|\?\.|\.\.\.|===|!==|==|!="),
    "rust": (_LINE, rf"b?r(?P<hash>#*)\".*?\"(?P=hash)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^\n]?[^'\n]*|[^'\\\n])'", _NAME, r"::|=>|->|==|!=|\.\.=|\.\.|'\w+"),
    "go": (rf"{_LINE}|{_BLOCK}", rf"{_QUOTED}|`[^`]*`?|'(?:\\.|[^'\\\n])*'?", _NAME, r":=|<-|\.\.\.|==|!="),
}
_READ = {
    language: re.compile(rf"(?P<out>\s+|{out})|(?P<string>{string})|(?P<name>{name})|(?P<number>{_NUMBER})|(?P<mark>{marks}|.)", re.S)
    for language, (out, string, name, marks) in _PARTS.items()
}
_PARTNER = {")": "(", "]": "[", "}": "{"}
#: A slash behind one of these, or at the beginning, opens a regular expression
_BEFORE_PATTERN = set("( , = : [ ! & | ? { } ; + - * % < > ~ ^ => == === != !== return typeof case in of do else void delete throw new".split())
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    line: int
    partner: int = -1  # the place of the other bracket of a pair

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def _nested(text: str, at: int) -> int:
    """The end of a block comment that may hold others, as in Rust."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def tokens(text: str, language: str) -> list[Token]:
    """The tokens of a text in order."""
    read, out, open_ = _READ[language], [], []
    at, line = 0, 1
    while at < len(text):
        if language == "rust" and text.startswith("/*", at):
            end = _nested(text, at)
            line += text.count("\n", at, end)
            at = end
            continue
        m = None
        if language == "script" and text[at] == "/" and (not out or out[-1].text in _BEFORE_PATTERN):
            m = _PATTERN.match(text, at)
        kind = "string" if m else ""
        if not m:
            m = read.match(text, at)
            kind = m.lastgroup if m.lastgroup != "hash" else "string"
        if kind != "out":
            t = Token(kind, m[0], at, line)
            if kind == "mark":
                if t.text in "([{":
                    open_.append(len(out))
                elif t.text in ")]}":
                    _close(out, open_, t)
            out.append(t)
        line += m[0].count("\n")
        at = m.end()
    return out


def _close(out: list[Token], open_: list[int], t: Token) -> None:
    """Joins a closing bracket with the last open one of its kind; those that are open inside stay without a partner."""
    k = len(open_) - 1
    while k >= 0 and out[open_[k]].text != _PARTNER[t.text]:
        k -= 1
        if len(open_) - k > 64:  # so many wrong brackets are no code
            return
    if k >= 0:
        t.partner = open_[k]
        out[open_[k]].partner = len(out)
        del open_[k:]


def text_of(text: str, first: Token, last: Token) -> str:
    """The source between two tokens, both included."""
    return text[first.start : last.end]
