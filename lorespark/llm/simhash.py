"""Near-duplicates by SimHash: segment-popcount embedding, grid join under the Manhattan distance, exact check.

A 64-bit fingerprint is embedded as the bit counts of SEGMENTS segments. The Manhattan distance of two embeddings is a
lower bound of the fingerprints' Hamming distance, so fingerprints that link at 2 or fewer bits have embeddings at most
2 apart, and those meet in a grid point that is at most 1 from each. The grid join therefore puts every fingerprint at
its own grid point and the neighbours of it (2 * SEGMENTS + 1 at most) and keeps the points where two or more meet.

The exact check does for the bits what the grid did for the counts: only in the kept grid points, a fingerprint emits
those fingerprints within 1 bit of itself that embed there. Two fingerprints share such a point exactly if they differ
in 2 bits or fewer, and no more than 65 fingerprints share one, so groups of copies of any size yield links in
proportion to their members, never all pairs. Components come from alternating large-star and small-star rounds.

Defined results: a null or empty text has the fingerprint zero, which links like any other; a text of one or two words
is one shingle; repeated rows share a component; an empty table gives an empty result; a document without an id
links like any other, and its component_id is null only if no document of the component has an id; other columns are
ignored; long texts are hashed whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, text_bytes

SEGMENTS = 16
WIDTH = 64 // SEGMENTS
_PIECE = 1 << 16
_BITS = 1 << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """The SimHash of a whole text as an unsigned number: A-Z lower-cased, words between ASCII white space, repeats counted."""
    words = text_bytes(text).lower().split()
    if not words:
        return 0
    digest, k = xxhash.xxh64_intdigest, words_per_shingle
    n = max(1, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        h = np.fromiter((digest(b" ".join(words[i : i + k]), 42) for i in range(at, min(at + _PIECE, n))), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BITS[2 * ones > n].sum())


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words_per_shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, "doc_id long, fp long")


def _segment(k: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links between different fingerprints of fps (fp, rep), as rep numbers; u > v, each star to its least rep."""
    counts = [F.bit_count(_segment(k)) for k in range(SEGMENTS)]
    # 3 bits a segment: 48 bits in all, so that the packed point is a plain positive number
    point = sum((c.cast("long") * F.lit(1 << (3 * k)) for k, c in enumerate(counts)), F.lit(0).cast("long"))
    up = [F.when(c < WIDTH, F.lit(1 << (3 * k))) for k, c in enumerate(counts)]
    down = [F.when(c > 0, F.lit(-(1 << (3 * k)))) for k, c in enumerate(counts)]
    moves = F.array(F.lit(0).cast("long"), *[m.cast("long") for m in up + down])
    grid = fps.select("fp", "rep", point.alias("own"), F.explode(F.array_compact(moves)).alias("move")).withColumn("cell", F.col("own") + F.col("move"))
    shared = grid.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    met = grid.join(shared, "cell", "left_semi")
    near = met.select("fp", "rep", F.explode(_near(F.col("fp"), F.col("move"))).alias("point"))
    stars = near.groupBy("point").agg(F.collect_set("rep").alias("reps")).filter(F.size("reps") > 1)  # 65 at most
    least = F.array_min("reps")
    return stars.select(F.explode("reps").alias("u"), least.alias("v")).filter("u > v").distinct()


def _near(fp: Column, move: Column) -> Column:
    """The fingerprints that are fp itself (move 0), or fp with one bit changed that moves its embedding by `move`."""
    own = F.when(move == 0, F.array(fp))
    for k in range(SEGMENTS):
        flips = [F.lit(_signed(1 << (k * WIDTH + i))) for i in range(WIDTH)]
        rise = F.array_compact(F.array(*[F.when(fp.bitwiseAND(f) == 0, fp.bitwiseXOR(f)) for f in flips]))
        fall = F.array_compact(F.array(*[F.when(fp.bitwiseAND(f) != 0, fp.bitwiseXOR(f)) for f in flips]))
        own = own.when(move == (1 << (3 * k)), rise).when(move == -(1 << (3 * k)), fall)
    return own


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of edges (u, v) with the least node of its component.

    Large-star and small-star in turn until the set of edges stays the same; each round is a written table, and every
    join has a plain exchange on both sides, so adaptive execution can split a node with very many neighbours.
    """
    e, before = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges"), None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        e = cut(large, "large")
        least = cut(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    else:
        raise RuntimeError(f"components: no fixpoint in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every document; component_id is the least doc_id reachable over links."""
    each = cut(fingerprints(docs, words_per_shingle).withColumn("row", F.monotonically_increasing_id()), "fp")
    # a fingerprint's number is that of one of its rows, so that it may link others even if none of its rows has an id
    fps = cut(each.groupBy("fp").agg(F.min("row").alias("rep"), F.min("doc_id").alias("id")), "fps")
    roots = components(links(fps.select("fp", "rep")))
    rooted = cut(fps.join(roots, fps.rep == roots.node, "left").select("fp", "id", F.coalesce("root", "rep").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    whole = cut(rooted.join(ids, "root").select("fp", "component_id"), "whole")
    return each.select("doc_id", "fp").join(whole, "fp", "left").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
