"""Cached results and prepared answers as tables: time to live, eviction, invalidation, staleness, lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark import constants as K


def ttl(query_type: Column, scale: int = 1) -> Column:
    """Seconds that results of a type live; scale stretches all of them."""
    names = F.create_map(*[F.lit(x) for kv in K.CACHE_TTL.items() for x in kv])
    return F.coalesce(F.try_element_at(names, query_type), F.lit(K.CACHE_TTL_DEFAULT)) * scale


def fresh(rows: DataFrame, as_of: int, scale: int = 1) -> DataFrame:
    """Rows (query_type, stored_at) that are not older than their type lives."""
    return rows.filter(F.lit(as_of) - F.col("stored_at") <= ttl(F.col("query_type"), scale))


def expired(rows: DataFrame, as_of: int, scale: int = 1) -> DataFrame:
    return rows.filter(F.lit(as_of) - F.col("stored_at") > ttl(F.col("query_type"), scale))


def without_type(rows: DataFrame, query_type: str | None) -> DataFrame:
    """What is left after invalidation: other types, or nothing."""
    return rows.limit(0) if query_type is None else rows.filter(~F.col("query_type").eqNullSafe(query_type))


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("query_type", F.lit("unknown")).alias("query_type")).agg(F.count("*").alias("n"))


def newest(rows: DataFrame, capacity: int) -> DataFrame:
    """First in, first out: the newest rows up to a capacity."""
    return rows.orderBy(F.desc("stored_at"), F.desc("event_id")).limit(capacity)


def lookup(queries: DataFrame, rows: DataFrame, as_of: int, scale: int = 1) -> DataFrame:
    """queries (query, query_type, answer) with `result`: the newest fresh cached one, marked, or the answer."""
    best = fresh(rows, as_of, scale).groupBy("query", "query_type").agg(F.max_by("result", F.struct("stored_at", "event_id")).alias("cached"))
    hit = F.concat("cached", F.lit("\n[Cache Hit]"))
    return queries.join(best, ["query", "query_type"], "left").select("query", "query_type", F.coalesce(hit, "answer").alias("result"), F.col("cached").isNotNull().alias("hit"))


def replayed(calls: DataFrame, seconds: int) -> DataFrame:
    """calls (query, event_id, stored_at) with `hit`, as a cache with a time to live would answer them in turn.

    A miss stores, a hit does not renew. A call that comes more than the time to live after the one before it is a miss
    whatever came earlier, so a question's history falls into stretches that do not depend on each other. Stretches are
    dealt over tasks and read in order with one stored time at hand, never held as a whole.
    """
    w = Window.partitionBy("query").orderBy("stored_at", "event_id")
    apart = F.coalesce(F.col("stored_at") - F.lag("stored_at").over(w) > seconds, F.lit(True)).cast("int")
    c = calls.select("query", "event_id", "stored_at").withColumn("apart", apart).withColumn("stretch", F.sum("apart").over(w))
    dealt = c.repartition("query", "stretch").sortWithinPartitions("query", "stretch", "stored_at", "event_id").select("query", "event_id", "stored_at", "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stored = None, None
        for b in batches:
            hits = []
            for key, t in zip(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True):
                if key != at:
                    at, stored = key, None
                hits.append(stored is not None and t - stored <= seconds)
                stored = stored if hits[-1] else t
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), pa.array(hits, pa.bool_())], names=["query", "event_id", "hit"])

    return dealt.mapInArrow(run, "query string, event_id long, hit boolean")


def sdk_get(wanted: DataFrame, docs: DataFrame, as_of: int) -> DataFrame:
    """(library, topic, doc, how): the fresh topic, the fresh general page, the stale topic, the stale general page, or null.

    docs has library, topic, doc, fetched_at (seconds) and ttl_days.
    """
    is_fresh = (F.lit(as_of) - F.col("fetched_at")) < F.col("ttl_days") * 86400
    d = docs.select("library", F.col("topic").alias("of"), "doc", is_fresh.alias("fresh"))
    own = d.select("library", F.col("of").alias("topic"), F.col("doc").alias("t_doc"), F.col("fresh").alias("t_fresh"))
    general = d.filter("of = 'general'").select("library", F.col("doc").alias("g_doc"), F.col("fresh").alias("g_fresh"))
    j = wanted.join(own, ["library", "topic"], "left").join(general, "library", "left")
    pick = lambda name, doc, test: F.when(test & F.col(doc).isNotNull(), F.struct(F.col(doc).alias("doc"), F.lit(name).alias("how")))
    best = F.coalesce(pick("topic", "t_doc", F.col("t_fresh")), pick("general", "g_doc", F.col("g_fresh")), pick("stale topic", "t_doc", F.lit(True)), pick("stale general", "g_doc", F.lit(True)))
    return j.select("library", "topic", best["doc"].alias("doc"), best["how"].alias("how"))


def stale_artifacts(deps: DataFrame, current: DataFrame, age: DataFrame | None = None, ttl_seconds: int = 3600) -> DataFrame:
    """(artifact_id, stale): a source file changed or is gone, or the answer is too old.

    deps has artifact_id, path and expected; current has path and sha256; age has artifact_id and age_seconds.
    """
    j = deps.join(current.select("path", F.col("sha256").alias("actual")), "path", "left")
    bad = j.groupBy("artifact_id").agg(F.max(F.col("actual").isNull() | (F.col("actual") != F.col("expected"))).alias("stale"))
    if age is None:
        return bad
    return bad.join(age, "artifact_id", "left").select("artifact_id", (F.col("stale") | (F.coalesce("age_seconds", F.lit(0)) > ttl_seconds)).alias("stale"))


def invalidated(deps: DataFrame, changed: DataFrame, stale: DataFrame) -> DataFrame:
    """(artifact_id, path): answers that a changed file makes stale, each for its least path, unless they were stale before."""
    hit = deps.join(changed.select("path"), "path").join(stale.select("artifact_id"), "artifact_id", "left_anti")
    return hit.groupBy("artifact_id").agg(F.min("path").alias("path"))


def rebuilt(deps: DataFrame, current: DataFrame) -> DataFrame:
    """The dependencies with the files' present hashes; files that are gone are dropped."""
    return deps.join(current, "path").select("artifact_id", "path", F.col("sha256").alias("expected"))
