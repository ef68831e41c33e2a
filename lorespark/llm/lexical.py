"""Ranked lexical search: compressed postings in shards, document-at-a-time merge with bounded heaps, global merge.

`build_index` reads each text once. A task deals its rows to shards of about SHARD_BYTES of text, sorts a shard's
documents by doc_id and writes one row for the shard's documents (ids and numbers of terms) and one for each term: how
many documents hold it, and its postings as variable-length bytes of (gap to the previous document, occurrences). The
index is a table in the shared folder; rows of a shard come in order of terms.

`search` sums up the collection's counts and the query terms' document frequencies from the index, gives the terms their
weights, and brings the query terms' postings of a shard together. There each query is a k-way heap merge over doc_id
order of its terms' postings, with a result heap of k entries keyed by score, then doc_id. A list's largest possible
contribution in the shard is known exactly, so the lists that together cannot lift a document over the heap's least entry
leave the merge and are only looked up, from the strongest down, while the document can still get in: no result is lost,
since documents come in ascending order and an equal score does not displace. Each task's best k for a query, and then
all tasks', are ranked by score, then doc_id.

Queries are dealt to blocks of about `block_terms` (query, term) pairs; a block is collected and broadcast, one after
the other, so neither the driver nor a task holds more, however many queries there are.

A document's score for a query sums w * ((10^9 * tf) div (1000 * tf + 8 * m)) over the query's distinct terms, with
w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 10 + (90 * n * N) div L, all else in integers.

Defined results: null or empty texts have no terms, are in no count and in no result; a query without terms has no rows;
rows of one doc_id are ranked as so many documents; null doc_ids come after all others of the same score; each row of
the queries is one of its own, also with a null or repeated id; empty tables give no rows; other columns are ignored;
texts are indexed whole.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, cut, pick

SHARD_BYTES = 32 << 20
BLOCK_TERMS = 500_000
#: Letters, digits and everything beyond ASCII, in bytes and in code points
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "shard long, term string, n long, total long, postings binary, ids array<long>, sizes array<long>"
_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("postings", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
_ROWS = 20_000


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values as bytes of seven bits, the last of each below 128, and where each value ends."""
    n = np.ones(len(values), np.int64)
    for k in range(1, 9):
        n += values >= (1 << 7 * k)
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(n.max(initial=1))):
        has = n > k
        out[ends[has] - n[has] + k] = (values[has] >> 7 * k & 127) | np.where(n[has] > k + 1, 128, 0)
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, starts)


class _Shard:
    """The documents of one shard while they are gathered."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.term, self.times, self.sizes = array("q"), array("q"), array("q")
        self.held, self.ids, self.bytes = array("q"), [], 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        found = Counter(_TERM.findall(raw.lower()))  # bytes: A-Z alone are lower-cased
        if not found:
            return
        terms = self.terms
        self.term.extend([terms.setdefault(t, len(terms)) for t in found])
        self.times.extend(found.values())
        self.held.append(len(found))
        self.sizes.append(sum(found.values()))
        self.ids.append(doc_id)
        self.bytes += len(raw)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = [self.sizes[i] for i in order]
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n": len(order), "total": sum(sizes), "ids": [self.ids[i] for i in order], "sizes": sizes}], _SCHEMA)
        names = sorted(self.terms)
        rank = np.empty(len(names), np.int64)
        rank[[self.terms[t] for t in names]] = np.arange(len(names))
        term, doc, times = rank[np.array(self.term)], np.repeat(place, self.held), np.array(self.times)
        at = np.lexsort((doc, term))
        term, doc, times = term[at], doc[at], times[at]
        begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        gap = np.diff(doc, prepend=0)
        gap[begin] = doc[begin]
        data, ends = packed(np.stack([gap, times], 1).ravel())
        df = np.diff(begin, append=len(term))
        stop = ends[2 * (begin + df) - 1]
        start = np.concatenate([[0], stop[:-1]])
        total = np.add.reduceat(times, begin)
        for k in range(0, len(names), _ROWS):
            part = slice(k, k + _ROWS)
            m = len(names[part])
            offsets = np.concatenate([start[part][:1], stop[part]]) - start[k]
            body = data[start[k] : stop[part][-1]]
            postings = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body.tobytes())])
            nothing = pa.nulls(m, _SCHEMA.field("ids").type)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard)), pa.array(names[part], pa.binary()).cast(pa.string()), pa.array(df[part]), pa.array(total[part]), postings, nothing, nothing], schema=_SCHEMA)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents, a written table; `search` takes it any number of times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, shard = TaskContext.get().partitionId(), 0, _Shard()
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for i in range(b.num_rows):
                if (raw := texts[i].as_py()) is not None:
                    shard.add(b.column(0)[i].as_py(), raw)
                if shard.bytes >= shard_bytes:
                    yield from shard.rows((task << 24) + n)
                    n, shard = n + 1, _Shard()
        if shard.ids:
            yield from shard.rows((task << 24) + n)

    return cut(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), "postings")


def terms(text: Column) -> Column:
    """The distinct terms of a text, none for a null."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(PATTERN), F.lit(0)))


def best(lists: list[tuple[int, array, array]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) of one query, highest first: lists of (largest contribution, documents, contributions).

    Documents are numbers in doc_id order; only scores above 0 count.
    """
    lists = sorted(lists, key=lambda x: x[0])
    tops, total = [], 0  # tops[i]: what lists 0 to i can give together
    for top, _, _ in lists:
        total += top
        tops.append(total)
    results: list[tuple[int, int]] = []  # (score, -document), the least first
    least, merged = 0, 0  # lists from `merged` on are merged, those before are looked up
    cursors = [(docs[0], i, 0) for i, (_, docs, _) in enumerate(lists)]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            _, i, at = cursors[0]
            _, docs, gives = lists[i]
            score += gives[at]
            if (at := at + 1) < len(docs):
                heapq.heapreplace(cursors, (docs[at], i, at))
            else:
                heapq.heappop(cursors)
        for i in range(merged - 1, -1, -1):
            if score + tops[i] <= least:
                break
            _, docs, gives = lists[i]
            at = bisect_left(docs, doc)
            if at < len(docs) and docs[at] == doc:
                score += gives[at]
        if score > least:
            heapq.heappush(results, (score, -doc))
            if len(results) > k:
                heapq.heappop(results)
            if len(results) == k and results[0][0] > least:
                least = results[0][0]
                if merged < len(lists) and tops[merged] <= least:
                    while merged < len(lists) and tops[merged] <= least:
                        merged += 1
                    cursors = [c for c in cursors if c[1] >= merged]
                    heapq.heapify(cursors)
    return [(s, -d) for s, d in sorted(results, reverse=True)]


_FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search_shard(rows: pa.Table, queries: dict[int, list[tuple[str, int]]], k: int, n_docs: int, n_terms: int) -> pa.Table:
    by_term, ids, m = {}, None, None
    for name, data, of, sizes in zip(rows["term"].to_pylist(), rows["postings"].to_pylist(), rows["ids"], rows["sizes"], strict=True):
        if name is None:
            ids, m = of.as_py(), np.array([10 + 90 * n * n_docs // n_terms for n in sizes.as_py()], np.int64)
        else:
            by_term[name] = data
    read: dict[str, tuple[array, np.ndarray]] = {}
    out: tuple[list, list, list] = ([], [], [])
    for query, weighted in queries.items():
        lists = []
        for term, w in weighted:
            if term not in by_term:
                continue
            if term not in read:
                gap, tf = unpacked(by_term[term]).reshape(-1, 2).T
                at = np.cumsum(gap)
                gives = w * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
                read[term] = (int(gives.max()), array("q", at.tobytes()), array("q", gives.tobytes()))
            if read[term][0] > 0:
                lists.append(read[term])
        for score, at in best(lists, k):
            out[0].append(query)
            out[1].append(ids[at])
            out[2].append(score)
    return pa.table([pa.array(x, pa.int64()) for x in out], schema=_FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank from 1, doc_id and score of the k best documents for every item (item_id, text)."""
    spark = index.sparkSession
    asked = cut(pick(items, "item_id", "text").select(F.monotonically_increasing_id().alias("query"), "item_id", terms(F.col("text")).alias("terms")), "queries")
    pairs = asked.select("query", F.explode("terms").alias("term"))
    n_docs, n_terms = index.filter("term is null").agg(F.sum("n"), F.sum("total")).first()
    if not n_docs:
        return asked.join(spark.createDataFrame([], "query long, rank int, doc_id long, score long"), "query").select("item_id", "rank", "doc_id", "score")
    held = index.join(pairs.select("term").distinct(), "term", "leftsemi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = cut(pairs.join(held.select("term", weight.alias("w")), "term"), "weights")
    blocks = -(-weighted.count() // block_terms)
    found = spark.createDataFrame([], "query long, doc_id long, score long")
    for b in range(blocks):
        block = weighted.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        queries: dict[int, list[tuple[str, int]]] = {}
        for r in block.sort("query", "term").toLocalIterator():  # about block_terms rows
            queries.setdefault(r.query, []).append((r.term, r.w))
        sent = spark.sparkContext.broadcast(queries)
        wanted = index.join(block.select("term").distinct(), "term", "leftsemi").unionByName(index.filter("term is null"))
        shards = wanted.select("shard", "term", "postings", "ids", "sizes").groupBy("shard")
        part = _ranked(shards.applyInArrow(_searcher(sent, k, n_docs, n_terms), "query long, doc_id long, score long"), k).drop("rank")
        if blocks > 1:
            part = cut(part, "found")
            sent.destroy()
        found = found.unionByName(part)
    return _ranked(found, k).join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _searcher(sent, k: int, n_docs: int, n_terms: int):
    return lambda rows: _search_shard(rows, sent.value, k, n_docs, n_terms)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The k best documents for every item, over an index made for this search."""
    return search(build_index(docs, shard_bytes), items, k)
