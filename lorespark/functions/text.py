"""Text functions as column expressions: normalisation, redaction, keys, estimates, rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark import constants as K


def normalize_query(q: Column) -> Column:
    """A question without case, filler phrases, doubled white space and outer punctuation."""
    q = F.btrim(F.lower(q), F.lit(" \t\n\r\f\v"))
    q = F.regexp_replace(q, K.FILLER, " ")
    q = F.regexp_replace(q, r"\s+", " ")
    q = F.regexp_replace(q, r"\s*([.,;:!?])\s*", "$1")
    return F.btrim(q, F.lit(K.TRIM_CHARS))


def is_sensitive(t: Column) -> Column:
    return t.rlike("|".join(f"(?:{p})" for p in K.SENSITIVE))


def redact(t: Column) -> Column:
    for p in K.SENSITIVE:
        t = F.regexp_replace(t, p, "[REDACTED]")
    return t


def snippet(t: Column, n: int = 500) -> Column:
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("..."))).otherwise(t)


def context_chars(max_tokens: int, k: int) -> int:
    """Characters that each of k context chunks may take."""
    return max_tokens * 4 // k // 2


def freshness(age_hours: Column, decay_hours: float = 168.0) -> Column:
    """Linear decay from 1 to 0; an unknown age counts as one half."""
    return F.when(age_hours.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - age_hours / decay_hours)))


def freshness_tag(f: Column) -> Column:
    return F.when(f > 0.7, "fresh").when(f > 0.3, "recent").otherwise("stale")


def prompt_chunk(source: Column, score: Column, fresh: Column, text: Column) -> Column:
    return F.concat(F.lit("["), source, F.lit(" ("), freshness_tag(fresh), F.lit(", score="), F.format_string("%.2f", score), F.lit(")]\n"), text)


def cache_key(query_type: Column, query: Column, k: Column) -> Column:
    """The key of a cached result: a digest over type, question and arguments in JSON."""
    args = F.concat(F.lit('{"top_k": '), k.cast("string"), F.lit("}"))
    return F.substring(F.sha2(F.concat_ws(":", query_type, query, args), 256), 1, 16)


def exact_key(query: Column, k: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", query, k.cast("string")), 256), 1, 16)


def keyword_hits(t: Column, keywords: list[str]) -> Column:
    """How many of the keywords are part of t, as substrings; t is in lower case."""
    return F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(t, k)))


def any_of(t: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases is part of t: one pattern, so that the generated code stays small."""
    return t.rlike("|".join(map(re.escape, phrases)))


def pair(q: Column, which: int) -> Column:
    """The first or second end of the path that a question asks for; null if it asks for none."""
    low = F.lower(q)
    return F.coalesce(*[F.when(low.rlike(p), F.regexp_extract(low, p, which)) for p in K.PAIR_PATTERNS])


def topic(q: Column) -> Column:
    low = F.lower(q)
    return F.when(low.rlike(K.TOPIC_PATTERN), F.regexp_extract(low, K.TOPIC_PATTERN, 1))


def slug(t: Column, n: int | None = None) -> Column:
    out = F.translate(F.lower(t), "/ ", "--") if n is None else F.left(F.translate(F.lower(t), " ", "-"), F.lit(n))
    return out


def source_tag(source: Column) -> Column:
    """How a result's index is shown."""
    shared = F.concat(F.lit("["), F.upper(F.replace(source, F.lit("shared:"), F.lit(""))), F.lit(" SDK]"))
    return F.when(source == "local", "[YOUR CODE]").when(F.startswith(source, F.lit("shared:")), shared).otherwise(F.concat(F.lit("["), F.upper(source), F.lit("]")))


def mask(secret: Column) -> Column:
    return F.when(F.length(secret) > 0, F.concat(F.lit("***"), F.right(secret, F.lit(4)))).otherwise(F.lit("(none)"))


def error_class(message: Column) -> Column:
    """What a failure is about, by words of its message."""
    m = F.lower(message)
    return (
        F.when(F.contains(m, F.lit("api key")) | F.contains(m, F.lit("auth")) | F.contains(m, F.lit("401")), "auth")
        .when(F.contains(m, F.lit("rate limit")) | F.contains(m, F.lit("429")), "rate_limit")
        .when(F.contains(m, F.lit("timeout")) | F.contains(m, F.lit("timed out")), "timeout")
        .otherwise("unknown")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of doubles; 0 for different sizes or a norm below 1e-10."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (na < 1e-10) | (nb < 1e-10), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
