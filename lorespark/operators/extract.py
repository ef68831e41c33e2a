"""Extraction of relations and entities from source files.

Python files are read by their syntax tree; TypeScript, JavaScript, Rust and Go by their tokens, with brackets matched,
so that comments, strings, definitions and macros give no calls; C and C++ by Spark expressions over lines; Astro by its
sections. One row for each finding: what (`relation` or `entity`), kind, name, and the line it is on.

Defined results: a null or empty text and a suffix of another language give no rows; text that is no code gives what
its tokens say; repeated files are read one by one; a name counts once in a file and kind, at its first line.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark import constants as K
from lorespark.operators.lexer import text_of, tokens

SCHEMA = "file_path string, what string, kind string, source string, target string, line int, owner string"
_NAME = re.compile(r"^[a-zA-Z_$][a-zA-Z0-9_$.:]*$")
_PYTHON = frozenset(keyword.kwlist) | {"self", "cls"}
FAMILY = {".ts": "script", ".tsx": "script", ".js": "script", ".jsx": "script", ".mjs": "script", ".cjs": "script", ".rs": "rust", ".go": "go"}
Row = tuple[str, str, str, str, str, int, str | None]


def is_name(text: str, words: frozenset) -> bool:
    return 2 <= len(text) <= 128 and bool(_NAME.match(text)) and text not in words


def _dotted(node: ast.AST) -> str:
    """The dotted name of an expression as far as it is one."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def from_python(path: str, text: str) -> Iterator[Row]:
    """Imports, classes with bases and methods, calls (top name and dotted chain, once a file each)."""
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    rel = lambda kind, target, node, owner=None, source=path: (path, "relation", kind, source, target, node.lineno, owner)
    seen: set[str] = set()
    for n in nodes:
        if isinstance(n, ast.Import):
            yield from (rel("imports_module", a.name, n) for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            yield from (rel("imports_from", f"{n.module}.{a.name}" if n.module else a.name, n) for a in n.names)
        elif isinstance(n, ast.ClassDef):
            yield (path, "entity", "class", f"{path}::{n.name}", n.name, n.lineno, None)
            for base in filter(None, map(_dotted, n.bases)):
                if is_name(base.rpartition(".")[2], _PYTHON):
                    yield rel("inherits_from", base, n, n.name)
            for m in n.body:
                if isinstance(m, ast.FunctionDef):  # async methods are not listed
                    key = f"{path}::{n.name}.{m.name}"
                    yield (path, "entity", "method", key, m.name, m.lineno, n.name)
                    yield rel("has_method", key, m, n.name, f"{path}::{n.name}")
        elif isinstance(n, ast.Call) and (name := _dotted(n.func)):
            top = name.partition(".")[0]
            for target in dict.fromkeys((top, name)):
                if target not in seen and (target != top or is_name(top, _PYTHON)):
                    seen.add(target)
                    yield rel("calls", target, n)


class _Reader:
    """The tokens of one file and what its language reads from them; the places of tokens are numbers."""

    def __init__(self, path: str, text: str, family: str) -> None:
        self.path, self.text, self.words, self.t = path, text, K.CODE_WORDS[family], tokens(text, family)
        self.joints = {"script": (".",), "rust": (".", "::"), "go": (".",)}[family]
        self.seen: set[tuple[str, str]] = set()

    def at(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def named(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "name"

    def past(self, k: int) -> int:
        """Behind the bracket at k and its partner; behind k alone if it has none."""
        return (self.t[k].partner if self.t[k].partner > k else k) + 1

    def angles(self, k: int) -> int:
        """Behind the type parameters that open at k, or k if there are none."""
        if self.at(k) != "<":
            return k
        depth, i = 0, k
        while i < len(self.t) and self.at(i) not in (";", "{", "}"):
            depth += (self.at(i) == "<") - (self.at(i) == ">")
            i = self.past(i) if self.at(i) in ("(", "[") else i + 1
            if not depth:
                return i
        return k

    def chain(self, k: int) -> int:
        """Behind the names joined by dots (or colons) that begin at k."""
        i = k + 1
        while self.at(i) in self.joints and self.named(i + 1):
            i += 2
        return i

    def source(self, first: int, behind: int) -> str:
        return text_of(self.text, self.t[first], self.t[behind - 1])

    def once(self, kind: str, name: str) -> bool:
        if (kind, name) in self.seen:
            return False
        self.seen.add((kind, name))
        return True

    def relation(self, kind: str, target: str, k: int, owner: str | None = None) -> Row:
        return (self.path, "relation", kind, self.path, target, self.t[k].line, owner)

    def entity(self, kind: str, name: str, k: int) -> Row:
        return (self.path, "entity", kind, f"{self.path}::{name}", name, self.t[k].line, None)

    def call(self, k: int, behind: int) -> Iterator[Row]:
        name = self.source(k, behind)
        if is_name(name, self.words) and self.once("calls", name):
            yield self.relation("calls", name, k)


#: What may stand before the name of a method that a class or an object defines
_BEFORE_METHOD = {"", "{", "}", ";", ",", "*", "async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract"}


def _script(r: _Reader) -> Iterator[Row]:
    """Imports, classes with their base, calls."""
    k = 0
    while k < len(r.t):
        here, before, then = r.at(k), r.at(k - 1), r.at(k + 1)
        if not r.named(k) or before in (".", "?."):
            k += 1
        elif here == "import" and then not in ("(", ".", ":"):
            i = k + 1
            while i < len(r.t) and r.t[i].kind != "string" and r.at(i) not in (";", "import"):
                i += 1
            target = r.at(i).strip("'\"`") if i < len(r.t) and r.t[i].kind == "string" else ""
            if target and r.once("imports", target):
                yield r.relation("imports_module", target, k)
            k = i if r.at(i) == "import" else i + 1
        elif here == "class" and r.named(k + 1) and then not in ("extends", "implements"):
            yield r.entity("class", then, k)
            i = r.angles(k + 2)
            if r.at(i) == "extends" and r.named(i + 1):
                base = r.source(i + 1, r.chain(i + 1))
                if is_name(base.rpartition(".")[2], r.words):
                    yield r.relation("inherits_from", base, k, then)
            k += 2
        else:
            end = r.chain(k)
            opens = r.angles(end)
            if r.at(opens) == "(" and before not in ("new", "function", "@"):
                after = r.past(opens)
                defined = end == k + 1 and before in _BEFORE_METHOD and (r.at(after) == "{" or r.at(after) == ":" and before != "")
                if not defined and not (before == "*" and r.at(k - 2) == "function"):
                    yield from r.call(k, end)
            k = end


def _rust(r: _Reader) -> Iterator[Row]:
    """Used modules, structs, enums and traits, implemented traits, calls outside of macros and patterns."""
    k = 0
    while k < len(r.t):
        here, before, then = r.at(k), r.at(k - 1), r.at(k + 1)
        if here == "#" and then in ("[", "!"):  # an attribute
            k = r.past(k + 1 if then == "[" else k + 2) if r.at(k + (1 if then == "[" else 2)) == "[" else k + 1
        elif not r.named(k):
            k += 1
        elif here == "use" and r.named(k + 1):
            i = k + 1
            while i < len(r.t) and r.at(i) not in (";", "as") and not (r.at(i) == "::" and r.at(i + 1) == "*"):
                i = r.past(i) if r.at(i) == "{" else i + 1
            target = r.source(k + 1, i).strip("{}")
            top = target.split("::")[0].strip()
            if is_name(top, r.words) and r.once("imports", top):
                yield r.relation("imports_module", target, k)
            while i < len(r.t) and r.at(i) != ";":
                i += 1
            k = i + 1
        elif here in ("struct", "enum", "trait") and r.named(k + 1):
            yield r.entity(here, then, k)
            i = r.angles(k + 2)
            if here == "enum" or r.at(i) == "(":  # variants and fields of a tuple are no calls
                while i < len(r.t) and r.at(i) not in ("{", "(", ";"):
                    i += 1
                i = r.past(i) if i < len(r.t) else i
            k = i
        elif here == "impl" and before not in ("->", ":", "(", ",", "<", "&", "="):
            i = r.angles(k + 1)
            i += r.at(i) == "!"
            j, split = i, -1
            while j < len(r.t) and r.at(j) not in ("{", ";", "where"):
                split = j if r.at(j) == "for" and split < 0 and r.at(j + 1) != "<" else split
                j += 1
            if split > i and j > split + 1:
                trait = r.source(i, split)
                if is_name(trait.split("<")[0].strip(), r.words):
                    yield r.relation("inherits_from", trait, k, r.source(split + 1, j))
            k = j
        elif then == "!" and r.at(k + 2) in ("(", "[", "{"):  # a macro's insides are no expressions yet
            k = r.past(k + 2)
        elif here == "macro_rules":
            while k < len(r.t) and r.at(k) not in ("{", "("):
                k += 1
            k = r.past(k) if k < len(r.t) else k
        else:
            end = r.chain(k)
            if r.at(end) == "(" and before not in ("fn", ".", "?", "::", "dyn", "struct", "let") and here not in ("Fn", "FnMut", "FnOnce"):
                pattern = r.at(r.past(end)) in ("=>", "=", "|") or before == "let"
                if not pattern:
                    yield from r.call(k, end)
            k = end


def _go(r: _Reader) -> Iterator[Row]:
    """Imports, types, calls; what an interface lists and what a func defines are no calls."""

    def specs(k: int) -> tuple[range, int]:
        """The tokens of a declaration, grouped by brackets or not, and the place behind it."""
        if r.at(k + 1) == "(":
            behind = r.past(k + 1)
            return range(k + 2, behind - 1), behind
        line = r.t[k].line
        i = k + 1
        while i < len(r.t) and r.t[i].line == line:
            i += 1
        return range(k + 1, i), k + 1

    k, listed = 0, -1
    while k < len(r.t):
        here, before = r.at(k), r.at(k - 1)
        if here == "{" and before == "interface":
            listed = max(listed, r.t[k].partner)
        if not r.named(k) or before == ".":
            k += 1
        elif here == "import":
            inside, behind = specs(k)
            for i in inside:
                if r.t[i].kind == "string" and r.at(i)[0] == '"':
                    target = r.at(i).strip('"')
                    if target.split("/")[-1] and r.once("imports", target.split("/")[-1]):
                        yield r.relation("imports_module", target, i)
            k = max(behind, inside.stop)
        elif here == "type" and (r.named(k + 1) or r.at(k + 1) == "("):
            inside, behind = specs(k)
            i = inside.start
            while i < inside.stop:
                if r.at(i) in ("{", "(", "["):
                    i = r.past(i)
                    continue
                if r.named(i) and (i == inside.start or r.at(i - 1) == ";" or r.t[i].line > r.t[i - 1].line):
                    j = i + 1
                    if r.at(j) == "[" and r.past(j) > j + 3:  # type parameters; an array's length is one token
                        j = r.past(j)
                    if j < len(r.t) and r.at(j) != "=":
                        yield r.entity("interface" if r.at(j) == "interface" else "struct", r.at(i), i)
                i += 1
            k += 2
        elif here == "func":
            k += 1
            if r.at(k) == "(" and r.named(r.past(k)) and r.at(r.past(k) + 1) in ("(", "["):  # a receiver, and the method's name
                k = r.past(k)
            k += r.named(k)
        else:
            end = r.chain(k)
            if r.at(end) == "(" and k > listed and before != "]":  # behind a bracket it is a type, as in []byte(x)
                yield from r.call(k, end)
            k = end


def from_tokens(path: str, text: str, family: str) -> Iterator[Row]:
    """Findings of a brace language."""
    yield from {"script": _script, "rust": _rust, "go": _go}[family](_Reader(path, text, family))


def _astro_sections(text: str) -> tuple[str, str]:
    """Script and markup of an Astro file, each with the other's lines empty, so that lines keep their numbers."""
    script, markup, fenced, scripted = [], [], False, False
    for raw in text.splitlines():
        said = raw.strip()
        if said == "---":
            fenced = not fenced
            turn = True
        elif said.startswith("<script"):
            scripted = turn = True
        elif said == "</script>":
            scripted, turn = False, True
        else:
            turn = False
        inside = (fenced or scripted) and not turn
        script.append(raw if inside else "")
        markup.append("" if inside or turn else raw)
    return "\n".join(script), "\n".join(markup)


def from_astro(path: str, text: str) -> Iterator[Row]:
    """Imports and exports of the fenced scripts, components (capitalised elements) of the markup."""
    script, markup = _astro_sections(text)
    r = _Reader(path, script, "script")
    for k, t in enumerate(r.t):
        first = k == 0 or r.t[k - 1].line < t.line  # of its line
        if t.text == "import" and first and r.at(k + 1) not in ("(", "."):
            i = k + 1
            while i < len(r.t) and r.t[i].kind != "string" and r.t[i].line == t.line:
                i += 1
            if i == len(r.t) or r.t[i].kind != "string" or r.t[i].line != t.line:
                continue
            target = r.at(i).strip("'\"`")
            inside = text_of(script, r.t[k + 1], r.t[i - 2]) if i > k + 2 and r.at(i - 1) == "from" else ""
            names = [n.strip().removeprefix("* as ").strip(" *{}") for n in inside.split(",")]
            yield from (r.relation("imports_from", f"{target}.{n}", k) for n in filter(None, names))
            if not any(names):
                yield r.relation("imports_module", target, k)
        elif t.text == "export" and first:
            i = k + 1 + (r.at(k + 1) == "default")
            if r.at(i) in ("const", "let", "var", "function", "class", "enum") and r.named(i + 1) and r.t[i + 1].line == t.line:
                yield r.entity("function", r.at(i + 1), k)
    for line, raw in enumerate(markup.split("\n"), 1):
        for part in raw.split("<")[1:]:
            head, closed, _ = part.partition(">")
            words = head.replace("/", " ").split(None, 1)
            name = words[0] if words and head.startswith(words[0]) else ""
            if closed and name[:1].isupper() and name.isascii() and name.isidentifier() and is_name(name, K.CODE_WORDS["script"]) and r.once("tags", name):
                yield (path, "relation", "calls", path, name, line, None)


def findings(path: str, text: str | None) -> Iterator[Row]:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".py":
        yield from from_python(path, text or "")
    elif suffix in FAMILY:
        yield from from_tokens(path, text or "", FAMILY[suffix])
    elif suffix == ".astro":
        yield from from_astro(path, text or "")


def extracted(files: DataFrame) -> DataFrame:
    """All findings of files (file_path, text), C and C++ included."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for p, t in zip(f["file_path"], f["text"], strict=True) for r in findings(p, t)]
            yield pd.DataFrame(rows, columns=["file_path", "what", "kind", "source", "target", "line", "owner"])

    return files.select("file_path", "text").mapInPandas(run, SCHEMA).unionByName(from_cpp(files))


# Fixed words: types that are entities, and what may stand before a function's type
TYPES = ["struct", "class", "enum", "typedef", "union"]
MODIFIERS = ["inline", "virtual", "explicit", "constexpr", "const"]
#: Words that stand before a call, not before a function's name
STATEMENTS = ["return", "else", "throw", "new", "delete", "goto", "case"]


def from_cpp(files: DataFrame) -> DataFrame:
    """Includes, struct-like types, functions and calls of .c, .cpp and .h files, as expressions over their lines.

    A line is an include, a type or a function, in this order: its first words say which. A function is a type and a
    name, behind `static` and one modifier at most, before a bracket that closes on the line. A call is a name before
    a bracket; calls are taken from all lines, once a file.
    """
    c = files.filter(F.lower(F.regexp_extract("file_path", r"(\.[^./]*)$", 1)).isin(".cpp", ".c", ".h"))
    lines = c.select("file_path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("at", "said")).withColumn("line", F.col("at") + 1)
    head = F.split(F.trim(F.regexp_replace(F.split_part("said", F.lit("("), F.lit(1)), r"\s+", " ")), " ")
    marked = F.split(F.regexp_replace("said", "[<>]", '"'), '"')  # before, inside and behind the marks of an include
    parts = F.struct(head.alias("w"), marked.alias("m"), F.split_part("said", F.lit("("), F.lit(2)).contains(")").alias("closed"))
    # a lambda's variable is worked out once, where a column would be put into every expression that names it
    own = lines.select("file_path", F.transform(F.array(parts), _read_line)[0].alias("x"), "line").select("file_path", "x.kind", "x.name", "line").filter("kind is not null")
    pieces = F.split("said", r"\(")
    before = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.regexp_extract(x, r"(\w+)\s*$", 1))
    calls = lines.select("file_path", F.explode(before).alias("name"), "line").filter(_named(F.col("name")) & ~F.col("name").isin(*K.NOT_CALLS))
    once = calls.groupBy("file_path", "name").agg(F.min("line").alias("line")).select("file_path", F.lit("calls").alias("kind"), "name", "line")
    relation = F.col("kind").isin("imports_module", "calls")
    return own.unionByName(once).select(
        "file_path", F.when(relation, "relation").otherwise("entity").alias("what"), "kind",
        F.when(relation, F.col("file_path")).otherwise(F.concat("file_path", F.lit("::"), "name")).alias("source"), F.col("name").alias("target"), F.col("line").cast("int").alias("line"), F.lit(None).cast("string").alias("owner"),
    )


def _read_line(x: Column) -> Column:
    """(kind, name) of a line's words w and marked parts m."""
    static = x["w"][0] == "static"
    skip = F.when(static, 1).otherwise(0)
    skip = skip + F.when((F.size(x["w"]) == skip + 3) & F.get(x["w"], skip).isin(MODIFIERS), 1).otherwise(0)
    word = lambda k: F.coalesce(F.get(x["w"], k), F.lit(""))
    include = F.when((F.regexp_replace(x["m"][0], r"\s", "") == "#include") & (F.size(x["m"]) > 2), x["m"][1])
    struct = F.when(word(F.lit(0)).isin(TYPES), F.regexp_extract(word(F.lit(1)), r"^\w+", 0))
    shaped = (F.size(x["w"]) == skip + 2) & word(skip).rlike(r"^[\w:<>]+$") & ~word(skip).isin(STATEMENTS) & word(skip + 1).rlike(r"^[\w~]+$") & x["closed"]
    function = F.when(shaped & _named(word(skip + 1)), word(skip + 1))
    kind = F.when(include != "", "imports_module").when(struct != "", F.when(word(F.lit(0)) == "union", "struct").otherwise(word(F.lit(0)))).when(function != "", "function")
    return F.struct(kind.alias("kind"), F.when(include != "", include).when(struct != "", struct).otherwise(function).alias("name"))


def _named(c):
    return F.length(c).between(2, 128) & c.rlike(_NAME.pattern) & ~c.isin(*sorted(K.CODE_WORDS["cpp"]))


def deduplicated(found: DataFrame) -> DataFrame:
    """Each entity once, by its key; the last one read wins."""
    w = Window.partitionBy("source").orderBy(F.desc("line"), F.desc("kind"))
    return found.filter("what = 'entity'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
