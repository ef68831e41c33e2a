"""Path functions and predicates as column expressions."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark import constants as K


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def stem(p: Column) -> Column:
    """The file name without its last extension; names that begin with their only dot have none."""
    return F.regexp_replace(basename(p), r"(?<=.)\.[^.]*$", "")


def extension(p: Column) -> Column:
    """The last extension without its dot, '' if there is none."""
    return F.regexp_extract(basename(p), r"^.+\.([^.]*)$", 1)


def language(p: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in K.EXTENSION_LANGUAGE.items() for x in kv])
    return names[F.concat(F.lit("."), F.lower(extension(p)))]


def is_code(name: Column) -> Column:
    return F.when(extension(name).isin(*K.CODE_EXTENSIONS), "code").otherwise("document")


def _glob(patterns: list[str]) -> str:
    """One regular expression for shell patterns that must fit the whole text."""
    return "^(?:" + "|".join(fnmatch.translate(p).replace(r"\Z", r"\z") for p in patterns) + ")"


def glob_match(t: Column, *patterns: str) -> Column:
    """Whether one of the shell patterns fits the whole of t."""
    return t.rlike(_glob(list(patterns)))


def contains_any(t: Column, parts: list[str]) -> Column:
    return t.rlike("|".join(map(re.escape, parts)))


def excluded(p: Column, patterns: list[str] = K.EXCLUDE_PATTERNS) -> Column:
    """Whether a path is not indexed: a plain pattern is part of it, or one with * fits its file name."""
    plain, ends = [x for x in patterns if "*" not in x], [x for x in patterns if "*" in x]
    tests = ([contains_any(p, plain)] if plain else []) + ([glob_match(basename(p), *ends)] if ends else [])
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def has_part(p: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, names)))


def graph_excluded(p: Column) -> Column:
    return has_part(p, K.GRAPH_EXCLUDE_DIRS) | excluded(p)


def watch_excluded(p: Column) -> Column:
    """The watcher's rule: a named part, a pattern that fits the file name, or any pattern as plain text within the path."""
    return has_part(p, K.WATCH_EXCLUDE_DIRS) | contains_any(p, K.EXCLUDE_PATTERNS) | glob_match(basename(p), *K.EXCLUDE_PATTERNS)


def agent_excluded(p: Column, patterns: list[str]) -> Column:
    """Whether a pattern fits the whole path or one of its parts."""
    return glob_match(p, *patterns) | F.exists(F.split(p, "/"), lambda part: glob_match(part, *patterns))


def blocked(p: Column) -> Column:
    name = F.lower(basename(p))
    return name.isin(*K.BLOCKED_NAMES) | F.endswith(name, F.lit(".pem"))


def valid_identifier(name: Column, keywords: list[str]) -> Column:
    return F.length(name).between(2, 128) & name.rlike(r"^[a-zA-Z_$][a-zA-Z0-9_$.:]*$") & ~name.isin(*keywords)


def suffixes(p: Column) -> Column:
    """All suffixes of a path at its slashes, the longest first."""
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))


def lookup_candidates(target: Column) -> Column:
    """The names under which a relation's end is looked up, in order."""
    base, s, e = basename(target), stem(target), extension(target)
    py = (e == "py") | (e == "")
    rs = (e == "rs") | (e == "")
    dotted = F.replace(target, F.lit("."), F.lit("/"))
    ends = lambda c, x: F.concat(c, F.lit(x))
    return F.concat(
        F.array(target, base, s),
        F.when(py, F.array(ends(target, ".py"), ends(dotted, ".py"), ends(s, ".py"))).otherwise(F.array().cast("array<string>")),
        F.when(rs, F.array(ends(target, ".rs"), ends(s, ".rs"))).otherwise(F.array().cast("array<string>")),
    )
