"""An inverted index of texts as a table, and BM25 over it by blocks whose scores are bounded.

`blocks` reads each text once: a task deals its documents to chunks of at most CHUNK_DOCS and writes, for a chunk, one row
of its documents and one row, a block, for each of its terms: where in the chunk the term is and how often, the most
occurrences and the shortest document, which bound what any document of the block can score. Nothing is shuffled.

`save` keeps blocks in a folder, partitioned by bucket of the term, so a search reads its terms' buckets alone. `update`
adds the blocks of changed documents as a new generation, and what it replaces or removes as a list of dead places; no
other file is written. `load` reads the live blocks of some terms.

`search` brings a chunk's blocks of the asked terms together, one chunk of a task after the other, and keeps the k best of
each question. A chunk whose blocks' bounds together cannot reach a question's k-th score so far is skipped for it.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark.operators.tables import in_turn, shipped, written

CHUNK_DOCS, CHUNK_BYTES, BUCKETS = 4096, 32 << 20, 64
#: (question, term) pairs that a task holds at once
BLOCK_PAIRS = 500_000
#: So many asked terms go out to the tasks; beyond it the index of all terms is made and joined with them
FEW_TERMS = 200_000
K1, B = 1.5, 0.75
_TOKEN = re.compile(rb"[0-9a-z]+")
SCHEMA = "chunk long, term string, n long, tokens long, most int, least int, p array<struct<at: int, tf: int>>, nodes array<long>, sizes array<int>"
_P = pa.list_(pa.struct([("at", pa.int32()), ("tf", pa.int32())]))
_ARROW = pa.schema([("chunk", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("tokens", pa.int64()), ("most", pa.int32()), ("least", pa.int32()), ("p", _P), ("nodes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


class _Chunk:
    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.term, self.tf, self.held, self.nodes, self.sizes, self.bytes = array("q"), array("i"), array("q"), [], array("i"), 0

    def add(self, node: int | None, raw: bytes, only: frozenset[bytes] | None) -> None:
        said = _TOKEN.findall(raw)
        found = Counter(said if only is None else [t for t in said if t in only])
        terms = self.terms
        self.term.extend([terms.setdefault(t, len(terms)) for t in found])
        self.tf.extend(found.values())
        self.held.append(len(found))
        self.nodes.append(node)
        self.sizes.append(len(said))
        self.bytes += len(raw)

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        sizes = np.array(self.sizes, np.int32)
        yield pa.RecordBatch.from_pylist([{"chunk": chunk, "n": len(sizes), "tokens": int(sizes.sum()), "nodes": self.nodes, "sizes": sizes.tolist()}], _ARROW)
        names = sorted(self.terms)
        if not names:
            return
        rank = np.empty(len(names), np.int64)
        rank[[self.terms[t] for t in names]] = np.arange(len(names))
        term, at, tf = rank[np.array(self.term)], np.repeat(np.arange(len(sizes), dtype=np.int32), self.held), np.array(self.tf, np.int32)
        order = np.argsort(term, kind="stable")
        term, at, tf = term[order], at[order], tf[order]
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        offsets = np.append(begin, len(term)).astype(np.int32)
        p = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(at), pa.array(tf)], ["at", "tf"]))
        m = len(names)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(m, chunk)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.diff(offsets).astype(np.int64)), pa.array(np.add.reduceat(tf, begin).astype(np.int64)),
            pa.array(np.maximum.reduceat(tf, begin)), pa.array(np.minimum.reduceat(sizes[at], begin)), p, pa.nulls(m, _ARROW.field("nodes").type), pa.nulls(m, _ARROW.field("sizes").type),
        ], schema=_ARROW)


def blocks(docs: DataFrame, generation: int = 0, chunk_docs: int = CHUNK_DOCS, only: Broadcast | None = None) -> DataFrame:
    """The index rows of documents (node_id, text), those of some terms only if these are given, as bytes.

    A null text is an empty one, and rows without a node_id are counted only. Chunks are numbered by task, so the rows have
    to be written before they are read more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = only.value if only is not None else None
        task, n, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        number = lambda: (generation << 48) + (task << 24) + n
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for node, raw in zip(b.column(0).to_pylist(), texts, strict=True):
                chunk.add(node, raw, known)
                if len(chunk.nodes) >= chunk_docs or chunk.bytes >= CHUNK_BYTES:
                    yield from chunk.rows(number())
                    n, chunk = n + 1, _Chunk()
        if chunk.nodes:
            yield from chunk.rows(number())

    return docs.select(F.col("node_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, SCHEMA)


def _bucket(term: Column, buckets: int) -> Column:
    """The bucket of a term; that of the chunks' own rows is -1."""
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int"))


def save(index: DataFrame, folder: str, generation: int = 0, buckets: int = BUCKETS) -> None:
    """Adds a generation of blocks; a bucket's blocks are dealt over some tasks and stand in order of terms."""
    b = index.withColumn("bucket", _bucket(F.col("term"), buckets))
    b.repartition("bucket", F.pmod("chunk", F.lit(4))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings/gen={generation}")


def update(spark: SparkSession, folder: str, changed: DataFrame, removed: DataFrame, generation: int, buckets: int = BUCKETS) -> None:
    """Replaces or adds the documents `changed` (node_id, text) and removes those of `removed` (node_id).

    What is written are the blocks of the changed documents and the places of those that are dead from now on.
    """
    gone = removed.select("node_id").unionByName(changed.select("node_id")).distinct()
    places = load(spark, folder, [], buckets).select("chunk", F.posexplode("nodes").alias("at", "node_id"))
    dead = written(places.join(gone, "node_id", "left_semi").select("chunk", "at"), "dead")
    save(blocks(changed, generation), folder, generation, buckets)
    dead.write.parquet(f"{folder}/dead/gen={generation}")


def load(spark: SparkSession, folder: str, terms: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The live blocks of the folder: all, or the chunks' own rows and the buckets of some terms."""
    found = spark.read.option("basePath", f"{folder}/postings").schema(f"{SCHEMA}, gen int, bucket int").parquet(f"{folder}/postings/*")
    if terms is not None:
        own = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), buckets)).distinct().collect()]
        found = found.filter(F.col("bucket").isin([-1, *own]) & (F.col("term").isNull() | F.col("term").isin(terms)))
    names = [c.split()[0] for c in SCHEMA.split(", ")[:6]] + ["p", "nodes", "sizes"]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/dead")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return found.select(*names)
    dead = spark.read.schema("chunk long, at int, gen int").parquet(f"{folder}/dead").groupBy("chunk").agg(F.collect_set("at").alias("dead"))  # of a chunk: CHUNK_DOCS at most
    j = found.join(dead, "chunk", "left")
    none, own = F.col("dead").isNull(), F.col("term").isNull()
    alive = F.filter("p", lambda x: ~F.array_contains("dead", x["at"]))
    lost = F.aggregate("dead", F.lit(0).cast("long"), lambda a, at: a + F.col("sizes")[at])
    j = j.withColumn("p", F.when(none | own, F.col("p")).otherwise(alive))
    # a dead document's place stays, so that the others keep theirs, but its node is no more
    j = j.withColumn("tokens", F.when(own & ~none, F.col("tokens") - lost).otherwise(F.col("tokens"))).withColumn("n", F.when(none, F.col("n")).when(own, F.col("n") - F.size("dead")).otherwise(F.size("p")))
    j = j.withColumn("nodes", F.when(own & ~none, F.transform("nodes", lambda x, i: F.when(F.array_contains("dead", i), F.lit(None)).otherwise(x))).otherwise(F.col("nodes")))
    return j.filter(own | (F.col("n") > 0)).select(*names)


def _questions(pairs: DataFrame) -> Iterator[dict[int, list[tuple[str, float]]]]:
    """The questions' terms and weights, in blocks of about BLOCK_PAIRS pairs; they pass through the driver one partition at a time."""
    held: dict[int, list[tuple[str, float]]] = {}
    n = 0
    for r in pairs.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("x")).toLocalIterator():
        held[r.query_id] = [(x.term, x.idf) for x in r.x]
        n += len(r.x)
        if n >= BLOCK_PAIRS:
            yield held
            held, n = {}, 0
    if held:
        yield held


class _Best:
    """The k best of each question among the chunks that a task has read so far."""

    def __init__(self, k: int) -> None:
        self.k, self.of, self.skipped = k, {}, 0

    def least(self, query: int) -> float:
        found = self.of.get(query)
        return found[0][-1] if found is not None and len(found[0]) == self.k else 0.0

    def add(self, query: int, score: np.ndarray, nodes: np.ndarray) -> None:
        if query in self.of:
            score, nodes = np.concatenate([self.of[query][0], score]), np.concatenate([self.of[query][1], nodes])
        order = np.lexsort((nodes, -score))[: self.k]
        self.of[query] = score[order], nodes[order]

    def batch(self) -> pa.RecordBatch:
        queries = np.repeat(np.array(list(self.of), np.int64), [len(s) for s, _ in self.of.values()])
        parts = list(zip(*self.of.values(), strict=True)) or [[np.zeros(0)], [np.zeros(0, np.int64)]]
        return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(np.concatenate(parts[1])), pa.array(np.concatenate(parts[0]))], names=["query_id", "node_id", "score"])


def _gain(tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _score_chunk(rows: list[dict], questions: Iterable[dict[int, list[tuple[str, float]]]], best: _Best, mean: float) -> None:
    own = next(r for r in rows if r["term"] is None)
    held = {r["term"]: r for r in rows if r["term"] is not None}
    if not held:
        return
    sizes = np.array(own["sizes"], float)
    alive = np.array([x is not None for x in own["nodes"]])
    nodes = np.array([x or 0 for x in own["nodes"]], np.int64)
    bound = {t: float(_gain(np.float64(r["most"]), np.float64(r["least"]), mean)) for t, r in held.items()}
    read: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for block in questions:
        for query, weighted in block.items():
            mine = [(t, w) for t, w in weighted if t in held]
            if not mine or sum(w * bound[t] for t, w in mine) < best.least(query) - 1e-5:
                best.skipped += bool(mine)
                continue
            score = np.zeros(len(sizes))
            for t, w in mine:
                if t not in read:
                    at, tf = held[t]["p"]
                    read[t] = at, _gain(tf.astype(float), sizes[at], mean)
                score[read[t][0]] += w * read[t][1]
            score = np.round(score, 6)
            good = np.flatnonzero((score > 0) & (score >= best.least(query)) & alive)
            if len(good):
                best.add(query, score[good], nodes[good])


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, score, rank): the k best documents of every question (query_id, text) by BM25, ties by the lesser node.

    index is a written table with the chunks' own rows and at least the blocks of the questions' terms. Scores are rounded to six decimals;
    documents without a term of the question are no result, and a question without a token has none.
    """
    spark = index.sparkSession
    asked = written(asked_terms(queries), "asked")
    d = index.join(asked.select("term").distinct(), "term", "left_semi").unionByName(index.filter("term is null"))
    size = index.filter("term is null").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
    n, mean = size.n or 0, (size.tokens or 0) / size.n if size.n else 0.0
    counted = d.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    held = shipped(spark, _questions(asked.join(counted.select("term", idf.alias("idf")), "term")))
    if not held:
        return spark.createDataFrame([], "query_id long, node_id long, score double, rank int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = _Best(k), []
        for b in batches:
            p = b.column(4)
            for i, row in enumerate(b.select(["chunk", "term", "most", "least"]).to_pylist()):
                if rows and row["chunk"] != rows[0]["chunk"]:
                    _score_chunk(rows, in_turn(held), best, mean)
                    rows = []
                if row["term"] is None:
                    row |= {"nodes": b.column(5)[i].as_py(), "sizes": b.column(6)[i].as_py()}
                else:
                    both = p[i].values
                    row["p"] = both.field("at").to_numpy(), both.field("tf").to_numpy()
                rows.append(row)
        if rows:
            _score_chunk(rows, in_turn(held), best, mean)
        yield best.batch()

    together = d.select("chunk", "term", "most", "least", "p", "nodes", "sizes").repartition("chunk").sortWithinPartitions("chunk")
    found = together.mapInArrow(run, "query_id long, node_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tokens(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda x: x != "")


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id and term, each pair once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).filter("query_id is not null").distinct()


def bm25(docs: DataFrame, queries: DataFrame, k: int, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """The search over an index of the questions' terms made for it: documents (node_id, text) are read once."""
    spark = docs.sparkSession
    wanted = written(asked_terms(queries).select("term").distinct(), "terms")
    if wanted.count() <= FEW_TERMS:
        only = spark.sparkContext.broadcast(frozenset(r[0].encode() for r in wanted.collect()))  # FEW_TERMS words at most
        made = blocks(docs, chunk_docs=chunk_docs, only=only)
    else:
        made, wanted = blocks(docs, chunk_docs=chunk_docs), wanted.unionByName(spark.createDataFrame([(None,)], "term string"))
        made = made.join(wanted, made.term.eqNullSafe(wanted.term), "left_semi")
    return search(written(made, "blocks"), queries, k)
