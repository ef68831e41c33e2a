"""An index of vectors by cells and product-quantised residuals, searched in part and ranked exactly.

`train` learns coarse cells by k-means and, for each of SUBS parts of a vector's residual to its cell, a book of codes,
from a bounded sample: at most SAMPLE unit vectors, those of the least hash of their id. `add` encodes every row given to
it, the first ones and later ones alike, without training again, and writes two tables partitioned by cell: codes of SUBS
bytes, and the unit vectors. `search` looks at the `probes` cells nearest to a question alone: it ranks their codes by
approximate similarity, keeps `refine` candidates of each question, and ranks these by the exact cosine of their vectors.

The questions are the small side; they go out in blocks of bounded size with the cells that they look at, one after the
other. A task keeps `refine` candidates of each batch for a question before anything is shuffled, so a hot cell is read by
as many tasks as its files and is never held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.operators.tables import in_turn, shipped

SAMPLE, ITERATIONS, SEED = 20_000, 15, 5
CELLS, SUBS, CODES = 64, 16, 256
QUESTIONS = 2048
_CANDIDATES = "query_id long, cell int, node_id long, near double"


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(norm < 1e-10, 0.0, m / np.maximum(norm, 1e-300))


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centers.T - 0.5 * (centers**2).sum(1), axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centers; one that loses all its points stays where it is."""
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ITERATIONS):
        at = _nearest(x, centers)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


@dataclass
class Quantiser:
    """Cells and books: some CELLS * dimensions + CODES * dimensions numbers, whatever the size of the corpus."""

    centers: np.ndarray  # cells x dimensions
    books: list[np.ndarray]  # for each part, codes x its dimensions

    @property
    def size(self) -> int:
        return self.centers.shape[1]

    def parts(self) -> list[slice]:
        ends = np.cumsum([0] + [b.shape[1] for b in self.books])
        return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector and the codes of its residual."""
        cell = _nearest(x, self.centers)
        rest = x - self.centers[cell]
        return cell, np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts(), self.books, strict=True)], 1).astype(np.uint8)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The cells nearest to each question, nearest first, ties by number."""
        far = -(q @ self.centers.T) + 0.5 * (self.centers**2).sum(1)
        return np.argsort(far, axis=1, kind="stable")[:, :probes]

    def near(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """The approximate cosines of questions and coded vectors of a cell."""
        out = (q @ self.centers[cell])[:, None].repeat(len(codes), 1)
        for j, (p, b) in enumerate(zip(self.parts(), self.books, strict=True)):
            out += (q[:, p] @ b.T)[:, codes[:, j]]
        return out


def train(vectors: DataFrame, cells: int = CELLS, subs: int = SUBS, sample: int = SAMPLE) -> Quantiser | None:
    """Learns from at most `sample` of the vectors (node_id, embedding); None if there is no vector."""
    v = vectors.filter("node_id is not null and size(embedding) > 0")
    rows = v.orderBy(F.xxhash64("node_id"), "node_id").limit(sample).select(F.col("embedding").cast("array<double>").alias("e")).collect()
    if not rows:
        return None
    size = max(len(r.e) for r in rows)
    x = unit(np.array([[y or 0.0 for y in r.e] for r in rows if len(r.e) == size]))
    rng = np.random.default_rng(SEED)
    centers = _k_means(x, cells, rng)
    rest = x - centers[_nearest(x, centers)]
    return Quantiser(centers, [_k_means(rest[:, p], CODES, rng) for p in np.array_split(np.arange(size), min(subs, size))])


def add(vectors: DataFrame, q: Quantiser, folder: str) -> None:
    """Adds vectors (node_id, embedding) to the index in a folder; those of another size are no part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(np.array([[0.0 if y is None else y for y in e] for e in b.column(1).to_pylist()]).reshape(-1, q.size))
            cell, codes = q.encode(x)
            flat = pa.array(np.arange(0, x.size + 1, q.size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(flat, pa.array(x.astype(np.float32).ravel()))], names=["node_id", "cell", "codes", "vector"])

    v = vectors.filter(F.col("node_id").isNotNull() & (F.size("embedding") == q.size)).select(F.col("node_id").cast("long").alias("node_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    coded = v.mapInArrow(run, "node_id long, cell int, codes binary, vector array<float>").repartition("cell", F.pmod(F.xxhash64("node_id"), F.lit(4)))
    coded.select("cell", "node_id", "codes").write.mode("append").partitionBy("cell").parquet(f"{folder}/codes")
    coded.select("cell", "node_id", "vector").write.mode("append").partitionBy("cell").parquet(f"{folder}/vectors")


def _blocks(queries: DataFrame, q: Quantiser, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, list[int]]]]:
    """Ids and unit vectors of questions, and for each cell the places of those that look at it."""
    ids: list[int] = []
    rows: list[list[float]] = []

    def block() -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        x, at = unit(np.array(rows, float)), {}
        for i, cells in enumerate(q.probed(x, probes)):
            for c in cells.tolist():
                at.setdefault(c, []).append(i)
        return np.array(ids, np.int64), x, at

    for r in queries.filter(F.col("query_id").isNotNull() & (F.size("embedding") == q.size)).select("query_id", "embedding").toLocalIterator():
        ids.append(r[0])
        rows.append([0.0 if y is None else y for y in r[1]])
        if len(ids) == QUESTIONS:
            yield block()
            ids, rows = [], []
    if ids:
        yield block()


def _kept(ids: np.ndarray, cell: int, nodes: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of a batch the `most` best of each question."""
    if near.shape[1] > most:
        at = np.argpartition(-near, most - 1, axis=1)[:, :most]
    else:
        at = np.tile(np.arange(near.shape[1]), (len(ids), 1))
    row = np.repeat(np.arange(len(ids)), at.shape[1])
    at = at.ravel()
    return ids[row], np.full(len(row), cell, np.int32), nodes[at], near[row, at]


def search(spark: SparkSession, folder: str, q: Quantiser, queries: DataFrame, k: int = 10, probes: int = 16, refine: int = 100) -> DataFrame:
    """(query_id, node_id, score, rank): about the k most similar vectors of each question (query_id, embedding), exactly ranked.

    Scores are cosines to six decimals, ties go to the lesser node. With all cells probed and `refine` as large as the
    corpus the result is exact.
    """
    held = shipped(spark, _blocks(queries, q, probes))
    if not held:
        return spark.createDataFrame([], "query_id long, node_id long, score double, rank int")
    looked = sorted({c for h in held for c in h.value[2]})  # cells at most
    codes = spark.read.parquet(f"{folder}/codes").filter(F.col("cell").isin(looked)).select("cell", "node_id", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, nodes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            coded = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(nodes), -1)
            for ids, x, at in in_turn(held) if len(nodes) else ():
                for c in np.unique(cell).tolist():
                    if c in at:
                        mine = cell == c
                        found = _kept(ids[at[c]], c, nodes[mine], q.near(x[at[c]], c, coded[mine]), refine)
                        yield pa.RecordBatch.from_arrays([pa.array(y) for y in found], names=["query_id", "cell", "node_id", "near"])

    near = codes.mapInArrow(run, _CANDIDATES)
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "node_id")
    candidates = near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= refine).select("query_id", "cell", "node_id").distinct()
    vectors = spark.read.parquet(f"{folder}/vectors").filter(F.col("cell").isin(looked))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    both = candidates.join(vectors, ["cell", "node_id"]).join(asked, "query_id")
    dot = F.aggregate(F.zip_with("vector", "embedding", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    scored = both.select("query_id", "node_id", F.round(F.when(size < 1e-10, 0.0).otherwise(dot / size), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
