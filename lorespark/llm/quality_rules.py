"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Every document gets integer statistics and, from them, integer measures (permille of symbols, of repeated words, ...).
A sketch of a measure is a histogram over its integer values up to TOP = 1000: at most TOP + 1 counters, merged by adding
counters, with quantiles exact to one unit. Shares are permille, so TOP is all of the text; the mean word length counts
tenths of a character, so that means of over 100 characters are as far out as those of 100. Sketches are built per (language, source), merged into languages and into
the whole corpus, and each (language, source) takes the thresholds of its own sketch, or of the next wider one while
it holds fewer than `min_group` documents. A document is kept if it passes the fixed base rules and no measure lies
outside its group's fence: third quartile plus `fence` times the larger of the interquartile range and the measure's
least spread (and, for the mean word length, the mirrored bound below the first quartile).

Defined results: a null text has no words and fails the base rules; null language or source count as ''; an empty table
gives an empty result; repeated rows are judged one by one; other columns are ignored (`judge`) or passed on
(`keep_good`); very long texts are counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, numbered, pick, text_bytes

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
TOP = 1000
#: Measure: its least spread, in the measure's own units.
SPREAD = {"m_symbols": 10, "m_repeat": 100, "m_dup_lines": 120, "m_upper": 40, "m_word_len": 8}
TWO_SIDED = ("m_word_len",)
#: Thresholds are broadcast up to so many (language, source) pairs, some 10 MB; beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000
_MANY = 20_000


def _repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n > _MANY:  # the same in arrays, so that long texts need little memory
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
        pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, at, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[at] > 1)
        hit = np.zeros(len(words), bool)
        for k in range(3):
            hit[again + k] = True
        return int(hit.sum())
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == n:
        return 0
    times = Counter(grams)
    total, covered = 0, 0  # covered: words before this index are counted already
    for i, g in enumerate(grams):
        if times[g] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one whole text."""
    raw = text_bytes(text)
    words = raw.split()
    if not words:
        return (0,) * len(STATS)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), chars, symbols, dup, _repeated(words), lines, upper


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and those of STATS, named `_s_...`; one pass without a shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"_s_{n}", T.LongType()) for n in STATS])
    at, kept, names = docs.columns.index("text"), [docs.columns.index(c) for c in keep], schema.names

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(t.as_py()) for t in b.column(at)]
            new = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *new], names=names)

    return docs.mapInArrow(add, schema)


def _measures(df: DataFrame) -> DataFrame:
    s = {n: F.col(f"_s_{n}") for n in STATS}
    share = lambda a, b: F.least(F.lit(TOP), F.floor(1000 * a / F.greatest(b, F.lit(1)))).cast("int")
    return df.withColumns({
        "m_symbols": share(s["n_symbols"], s["word_chars"]),
        "m_repeat": share(s["n_repeat_words"], s["n_words"]),
        "m_dup_lines": share(s["n_dup_lines"], s["n_lines"]),
        "m_upper": share(s["n_upper"], s["word_chars"]),
        "m_word_len": F.least(F.lit(TOP), F.floor(10 * s["word_chars"] / F.greatest(s["n_words"], F.lit(1)))).cast("int"),
        "_lang": F.coalesce(F.col("lang"), F.lit("")),
        "_source": F.coalesce(F.col("source"), F.lit("")),
        "_base_failed": (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"]),
    })


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): the mergeable sketches of the documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in SPREAD]))
    return (
        measured.filter(~F.col("_base_failed"))
        .select("_lang", "_source", each.alias("x"))
        .groupBy("_lang", "_source", F.col("x.measure").alias("measure"), F.col("x.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def _fences(hist: DataFrame, keys: list[str], fence: int) -> DataFrame:
    """One row for each key: documents, low and high bound of every measure. A window spans TOP + 1 rows at most."""
    merged = hist.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"cum": F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(w)})
    quart = ranked.groupBy(*keys, "measure").agg(
        F.min(F.when(4 * F.col("cum") >= F.col("all"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("cum") >= 3 * F.col("all"), F.col("value"))).alias("q3"),
        F.max("all").alias("docs"),
    )
    is_ = lambda m: F.col("measure") == m
    out = [F.max("docs").alias("docs")]
    for m, least in SPREAD.items():
        reach = fence * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        out.append(F.max(F.when(is_(m), F.col("q3") + reach)).alias(f"hi_{m}"))
        if m in TWO_SIDED:
            out.append(F.max(F.when(is_(m), F.col("q1") - reach)).alias(f"lo_{m}"))
    return quart.groupBy(*keys).agg(*out)


def thresholds(hist: DataFrame, min_group: int, fence: int) -> DataFrame:
    """The bounds of every (language, source): its own sketch's, or the merged ones of its language or of all."""
    bounds = [f"hi_{m}" for m in SPREAD] + [f"lo_{m}" for m in TWO_SIDED]
    as_ = lambda df, tag: df.select(*[c for c in df.columns if c.startswith("_")], F.struct("docs", *bounds).alias(tag))
    own = as_(_fences(hist, ["_lang", "_source"], fence), "own")
    lang = as_(_fences(hist, ["_lang"], fence), "by_lang")
    every = as_(_fences(hist.withColumn("_all", F.lit(1)), ["_all"], fence), "by_all")
    joined = own.join(lang, "_lang").withColumn("_all", F.lit(1)).join(F.broadcast(every), "_all")  # `every` is one row
    big = lambda c: F.when(F.col(f"{c}.docs") >= min_group, F.col(c))
    best = F.coalesce(big("own"), big("by_lang"), big("by_all"))
    return joined.select("_lang", "_source", best.alias("t")).select("_lang", "_source", *[F.col(f"t.{b}").alias(b) for b in bounds])


def judged(docs: DataFrame, keep: list[str], min_group: int, fence: int) -> DataFrame:
    """The columns `keep` (with lang and source) of docs with `_s_...`, the measures, `_base_failed` and `_kept`.

    The statistics are written to the shared folder once; sketches and verdicts read them from there. The verdict joins
    thresholds by (language, source): broadcast while they are few, else by a shuffle that adaptive execution splits
    where one source is large.
    """
    measured = _measures(cut(with_stats(docs, keep), "stats"))
    hist = cut(sketches(measured), "sketch")
    limits = cut(thresholds(hist, min_group, fence), "limits")
    if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    out = F.lit(False)
    for m in SPREAD:
        out = out | F.coalesce(F.col(m) > F.col(f"hi_{m}"), F.lit(False))
    for m in TWO_SIDED:
        out = out | F.coalesce(F.col(m) < F.col(f"lo_{m}"), F.lit(False))
    return measured.join(limits, ["_lang", "_source"], "left").withColumn("_kept", ~F.col("_base_failed") & ~out)


def judge(docs: DataFrame, min_group: int = 50, fence: int = 3) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the measures, for every document."""
    j = judged(pick(docs, "doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"], min_group, fence)
    return j.select("doc_id", *[F.col(f"_s_{n}").alias(n) for n in STATS[:5]], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), *SPREAD)


def keep_good(docs: DataFrame, min_group: int = 50, fence: int = 3) -> DataFrame:
    """The documents that are kept, with all columns they came with."""
    d = numbered(docs, "text", "lang", "source")
    return judged(d, d.columns, min_group, fence).filter("_kept").select(*d.columns).toDF(*docs.columns)
