"""Custom keyed state: the circuit breaker, the result cache and token usage. Each has a batch twin with the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorespark import constants as K
from lorespark.streaming import ordered

#: How late a call may come and still be read in its place
LATE = "1 day"


def breaker_states(calls: DataFrame, threshold: int = K.BREAKER_THRESHOLD) -> DataFrame:
    """calls (key, call_id, ts, failed) with `failures`, those in a row up to the call, and `open`: the breaker after it.

    Gaps and islands: a success starts a new island, failures are numbered within it.
    """
    w = Window.partitionBy("key").orderBy("ts", "call_id")
    island = F.sum((~F.col("failed")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum(F.col("failed").cast("int")).over(Window.partitionBy("key", "island").orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("island", island).withColumn("failures", n).select("key", "call_id", "failures", (F.col("failures") >= threshold).alias("open"))


def breaker_step(state: tuple[int, float, bool], at: float, failed: bool, threshold: int, cooldown: float) -> tuple[tuple[int, float, bool], bool]:
    """The state after a call, and whether the call was blocked. A blocked call changes nothing."""
    count, last, is_open = state
    if is_open:
        if at - last <= cooldown:
            return state, True
        count, is_open = 0, False
    if failed:
        count, last = count + 1, at
        return (count, last, is_open or count >= threshold), False
    return (0, last, False), False


def _breaker(threshold: int, cooldown: float) -> ordered.Step:
    """The breaker as a fold. Its state matters until the cooldown has passed; counted failures matter for ever."""

    pause = round(cooldown * 1e6)

    def step(state: list | None, at: int, i: int, said: dict) -> tuple[list | None, tuple, int | None]:
        (count, last, is_open), blocked = breaker_step(tuple(state or (0, 0, False)), at, bool(said.get("failed")), threshold, pause)
        if not count and not is_open:
            return None, (blocked, False), None
        return [count, last, is_open], (blocked, is_open), last + pause + 1 if is_open else None

    return step


_BREAKER = "blocked boolean, open boolean"


def breaker_stream(calls: DataFrame, threshold: int = K.BREAKER_THRESHOLD, cooldown: float = K.BREAKER_COOLDOWN, late: str = LATE) -> DataFrame:
    """A stream of calls (key, id, ts, failed) with `blocked` and `open`, in order of time for each key."""
    return ordered.folded_stream(calls.select("key", "id", "ts", "failed"), _breaker(threshold, cooldown), _BREAKER, late)


def breaker_calls(calls: DataFrame, threshold: int = K.BREAKER_THRESHOLD, cooldown: float = K.BREAKER_COOLDOWN) -> DataFrame:
    """The batch twin of breaker_stream."""
    return ordered.folded(calls.select("key", "id", "ts", "failed"), _breaker(threshold, cooldown), _BREAKER)


class Near:
    """The vectors of a cache's entries as one array, kept from call to call."""

    def __init__(self) -> None:
        self.size, self.of, self.rows = 0, [], {}

    def among(self, entries: list, own: np.ndarray) -> tuple[list, np.ndarray]:
        """The entries with a vector of own's size and their cosines, which may differ in the last digits from single ones."""
        same = [e for e in entries if e[3] and len(e[3]) == len(own)]
        if self.size != len(own) or len(same) != len(self.of) or any(a is not b for a, b in zip(same, self.of, strict=True)):
            rows = {id(e): self.rows[id(e)] if self.size == len(own) and id(e) in self.rows else np.array(e[3], float) for e in same}
            self.size, self.of, self.rows = len(own), same, rows  # entries are held, so their ids are their own
            self.table = np.stack(list(rows.values())) if rows else np.zeros((0, len(own)))
            self.norms = np.sqrt((self.table**2).sum(1))
        return same, (self.table @ own) / np.maximum(self.norms * np.linalg.norm(own), 1e-300)


def cache_step(entries: list, at: int, i: int, query: str | None, vector: list | None, seconds: int, capacity: int, least: float, held: Near | None = None) -> tuple[list, tuple[bool, int | None, float | None]]:
    """The entries [stored, id, query, vector] after a call, and (hit, the entry's id, similarity).

    First the oldest entry of the same words, which is dropped if it is too old; then, of those not too old with a vector
    of the same size, the most similar one, at least `least`, the oldest of equal ones. A miss stores the call, and the
    entry that came first goes when there are `capacity`. A hit does not renew.
    """
    kept, found = [], None
    for e in entries:
        if found is None and query is not None and e[2] == query:
            if at - e[0] > seconds * 1_000_000:
                continue
            found = e
        kept.append(e)
    if found is not None:
        return kept, (True, found[1], 1.0)
    best, near = None, 0.0
    if vector:
        own = np.array(vector)
        size = np.linalg.norm(own)
        same, rough = (held or Near()).among(kept, own) if size >= 1e-10 else ([], np.zeros(0))
        fresh = np.array([at - e[0] <= seconds * 1_000_000 for e in same], bool)
        if fresh.any():
            top = max(rough[fresh].max(), least) - 1e-9  # those that may be the most similar are held against it one by one
            for k in np.flatnonzero(fresh & ~(rough < top)):
                e = same[k]
                other = np.array(e[3])
                norm = np.linalg.norm(other)
                sim = float(own @ other / (size * norm)) if norm >= 1e-10 else 0.0
                if sim > near and sim >= least:
                    best, near = e, sim
    if best is not None:
        return kept, (True, best[1], round(near, 6))
    return [*(kept[1:] if len(kept) >= capacity else kept), [at, i, query, vector]], (False, None, None)


def _cache(seconds: int, capacity: int, least: float) -> ordered.Step:
    """The cache as a fold. Its state matters until its newest entry is too old."""

    held = Near()

    def step(state: list | None, at: int, i: int, said: dict) -> tuple[list | None, tuple, int | None]:
        entries, row = cache_step(state or [], at, i, said.get("query"), said.get("vector"), seconds, capacity, least, held)
        return entries, row, max((e[0] for e in entries), default=at) + seconds * 1_000_000

    return step


_CACHE = "hit boolean, of long, similarity double"


def cache_stream(calls: DataFrame, seconds: int = K.CACHE_TTL_DEFAULT, capacity: int = K.CACHE_CAPACITY, least: float = K.CACHE_SIMILARITY, late: str = LATE) -> DataFrame:
    """A stream of calls (key, id, ts, query, vector) with `hit`, the stored call it is answered `of`, and `similarity`.

    Each key has a cache of its own, of the calls that missed.
    """
    return ordered.folded_stream(calls.select("key", "id", "ts", "query", "vector"), _cache(seconds, capacity, least), _CACHE, late)


def cache_calls(calls: DataFrame, seconds: int = K.CACHE_TTL_DEFAULT, capacity: int = K.CACHE_CAPACITY, least: float = K.CACHE_SIMILARITY) -> DataFrame:
    """The batch twin of cache_stream."""
    return ordered.folded(calls.select("key", "id", "ts", "query", "vector"), _cache(seconds, capacity, least), _CACHE)


def usage_stream(calls: DataFrame) -> DataFrame:
    """A stream of calls (session, tokens_in, tokens_out) summed up for each session."""
    return calls.groupBy("session").agg(F.sum("tokens_in").alias("prompt_tokens"), F.sum("tokens_out").alias("completion_tokens"), F.count("*").alias("calls"))
