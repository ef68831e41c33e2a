"""Secret scan with corpus-wide ownership frequency.

One pass over the texts finds base matches (assignments, access keys, long hex strings) and further candidates: long
mixed tokens that look live. The hash of every candidate's value is aggregated over the corpus by distinct owners and
distinct repositories. A value of more than `max_owners` owners or `max_repos` repositories is a widely copied example;
any other one is owner-specific. Owner-specific live-looking tokens become spans of kind `live`; base spans stay and
are told apart in the counts n_owned and n_copied.

Only hashes, positions and names are shuffled, never texts. (hash, owner, repository) is made distinct before it is
counted, so a value in a third of all rows arrives as a few rows; the verdicts go back to the candidates by a plain
join, whose large partitions adaptive execution splits.

Defined results: a null text is empty; an empty text has no spans (the digest of nothing); null owners and repositories
count as ''; repeated rows are scanned one by one; an empty table gives an empty result; other columns are ignored;
texts are scanned whole, with positions in code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

KINDS = ("assign", "access", "hex", "live")
# Fixed patterns of the base; the flags make letters match in either case, ASCII only
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")


def looks_live(value: str) -> bool:
    """A mixed token: upper and lower case letters and digits, many different characters, no placeholder words."""
    return (
        any(c.isdigit() for c in value)
        and any("A" <= c <= "Z" for c in value)
        and any("a" <= c <= "z" for c in value)
        and len(set(value)) >= 12
        and not re.search(r"(?i)example|sample|placeholder|changeme|your|xxxx|1234567|abcdef", value)
    )


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base matches, by start, then kind."""
    out = [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX_LONG.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidate_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Live-looking tokens that overlap no base span; base is by start."""
    starts, ends = [s for _, s, _, _ in base], []
    for _, _, e, _ in base:
        ends.append(max(e, ends[-1]) if ends else e)  # the furthest end of the spans up to each
    out = []
    for m in _TOKEN.finditer(text):
        k = bisect.bisect_left(starts, m.end())  # spans before k start before the token ends
        if looks_live(m[0]) and not (k and ends[k - 1] > m.start()):
            out.append(("live", m.start(), m.end(), m[0]))
    return out


def spell(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


_SCAN = "row long, doc_id long, owner string, repo string, base_sha256 string, spans array<struct<kind: string, start: int, end: int, hash: binary>>"


def candidates(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """One row for each document, numbered, with all its base and candidate spans and the hashes of their values."""
    d = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(owner.cast("string"), F.lit("")), F.coalesce(repo.cast("string"), F.lit("")))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            shas, spans = [], []
            for t in b.column(1).to_pylist():
                base = base_spans(t or "")
                shas.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).digest()} for k, s, e, v in base + candidate_spans(t or "", base)])
            rows = pa.array(range(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column(0), b.column(2), b.column(3), pa.array(shas, pa.string()), pa.array(spans, span)], names=["row", "doc_id", "owner", "repo", "base_sha256", "spans"])

    return d.mapInArrow(run, _SCAN)


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, owners, repos): distinct owners and repositories of every candidate value."""
    each = scanned.select("owner", "repo", F.explode("spans.hash").alias("hash")).distinct()
    return each.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, owner: Column | None = None, repo: Column | None = None, max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied and found (the spans as structs).

    By default the source of a document is its owner, and source with language its repository.
    """
    if owner is None or repo is None:
        docs = pick(docs, "doc_id", "text", "source", "lang")
        owner, repo = F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    scanned = cut(candidates(docs, owner, repo), "secrets")
    copied = cut(ownership(scanned).filter((F.col("owners") > max_owners) | (F.col("repos") > max_repos)).select("hash", F.lit(True).alias("copied")), "copied")
    each = scanned.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.kind", "s.start", "s.end", "s.hash")
    judged = each.join(copied, "hash", "left").select("row", "kind", "start", "end", F.coalesce("copied", F.lit(False)).alias("copied"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    found = (
        judged.filter((F.col("kind") != "live") | ~F.col("copied"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", order.alias("at"), "kind", "end", "copied"))).alias("found"))
    )
    with_spans = scanned.filter(F.size("spans") > 0).select("row", "doc_id", "base_sha256").join(found, "row", "left").drop("row")
    none = F.expr("cast(array() as array<struct<start: int, at: int, kind: string, end: int, copied: boolean>>)")
    plain = scanned.filter(F.size("spans") == 0).select("doc_id", "base_sha256", none.alias("found"))
    out = with_spans.withColumn("found", F.coalesce("found", none)).unionByName(plain)
    n = lambda test: F.size(F.filter("found", test)).cast("long")
    of = lambda k: n(lambda s: s["kind"] == k)
    return out.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS[:3]],
        "base_sha256",
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans"),
        n(lambda s: ~s["copied"]).alias("n_owned"),
        n(lambda s: s["copied"]).alias("n_copied"),
        F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["copied"].alias("copied"))).alias("found"),
    )
