"""Queries that run as streams over the event table, with the oracles of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark import constants as K
from lorespark.plans.registry import ORACLES, query
from lorespark.plans import retrieval_queries  # noqa: F401  the batch twins
from lorespark.streaming import file_events, state
from lorespark.streaming.run import closing, finished, table_stream


def event_stream(spark, sf):
    return table_stream(spark, sf, "events")


@query("i01_daily_stream", ORACLES["i01_daily_kind_counts"])
def i01(spark, sf):
    kind = F.create_map(*map(F.lit, ["view", "created", "click", "modified", "error", "deleted", "purchase", "moved", "signup", "modified"]))
    e = event_stream(spark, sf).select("event_id", "ts", kind[F.col("event_type")].alias("kind"))
    d = finished(file_events.daily_counts(e), "daily", "complete")
    return d.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("i14_usage_stream", "SELECT user_id AS session, CAST(sum(100 + k * 10) AS BIGINT) AS prompt_tokens, CAST(sum(k * 3) AS BIGINT) AS completion_tokens, count(*) AS calls FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def i14(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return finished(state.usage_stream(event_stream(spark, sf).select(F.col("user_id").alias("session"), (100 + k * 10).alias("tokens_in"), (k * 3).alias("tokens_out"))), "usage", "complete")


@query("i11_cache_stream", ORACLES["i11_cache_replay"])
def i11(spark, sf):
    """Each question has a cache of its own, without vectors: what the batch replay gives."""
    e, folder = closing(event_stream(spark, sf))
    q = F.concat(F.lit("q"), (F.col("user_id") % 50).cast("string"))
    calls = e.select(q.alias("key"), F.col("event_id").alias("id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), q.alias("query"), F.lit(None).cast("array<double>").alias("vector"))
    return finished(state.cache_stream(calls, 3600), "cache", close=(folder, event_stream(spark, sf))).select(F.col("key").alias("query"), F.col("id").alias("event_id"), "hit")


def semantic_calls(events, vectors):
    """Questions of 20 sessions: an event's words are its type and user, its vector that of its number."""
    words = F.concat("event_type", F.lit(" of "), (F.col("user_id") % 300).cast("string"))
    e = events.select((F.col("user_id") % 20).alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), words.alias("query"), (F.col("event_id") % 700).alias("vec_id"))
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return e.join(v, "vec_id", "left").select("key", "id", "ts", "query", "vector")


@query("i11_semantic_cache_stream")
def i11_semantic(spark, sf):
    """Caches of 128 entries, a day to live, for 20 sessions: the same words, or a cosine of 0.3 or more."""
    e, folder = closing(event_stream(spark, sf))
    calls = semantic_calls(e, spark.read.parquet(f"{sf}/embeddings.parquet"))
    return finished(state.cache_stream(calls, 86400, least=0.3), "semantic", close=(folder, event_stream(spark, sf)))


@query("i02_debounced_stream")
def i02(spark, sf):
    """Bursts that the watermark has closed; the open ones wait for later events."""
    e = event_stream(spark, sf).select("event_id", "ts", F.concat(F.lit("/f/"), F.col("user_id").cast("string")).alias("path"))
    return finished(file_events.debounced(e, "6 hours", "1 day"), "bursts")


_BREAKER = (
    "WITH RECURSIVE c AS (SELECT user_id AS key, event_id AS call_id, epoch_us(ts) AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "s AS (SELECT key, CAST(0 AS BIGINT) AS call_id, CAST(0 AS BIGINT) AS n, 0 AS count, CAST(0 AS BIGINT) AS last, false AS open, false AS blocked FROM c WHERE n = 1 UNION ALL "
    "SELECT key, call_id, n, CASE WHEN stop THEN count WHEN failed THEN base + 1 ELSE 0 END, CASE WHEN stop OR NOT failed THEN last ELSE t END, CASE WHEN stop THEN true WHEN failed THEN base + 1 >= 2 ELSE false END, stop FROM "
    f"(SELECT s.key, c.call_id, c.n, s.count, s.last, c.t, c.failed, s.open AND c.t - s.last <= {K.BREAKER_COOLDOWN * 1_000_000} AS stop, CASE WHEN s.open THEN 0 ELSE s.count END AS base FROM s JOIN c ON c.key = s.key AND c.n = s.n + 1)) "
    "SELECT key, call_id, blocked, open FROM s WHERE n > 0"
)


@query("i10_breaker_stream", _BREAKER)
def i10(spark, sf):
    e, folder = closing(event_stream(spark, sf))
    calls = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    return finished(state.breaker_stream(calls, 2, K.BREAKER_COOLDOWN), "breaker", close=(folder, event_stream(spark, sf))).withColumnRenamed("id", "call_id")
