"""The facade: one engine for a project, with the actions that clients call by name."""

from __future__ import annotations

import time
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespark import config as C
from lorespark import workflows
from lorespark.functions import text
from lorespark.operators import cache, changes, chunking, classify, extract, graph, graph_search, report, retrieval
from lorespark.operators.tables import written
from lorespark.sources import files, projects
from lorespark.sources.log_table import LogTable
from lorespark.streaming import file_events

INDEX = "node_id long, doc_id string, file_path string, file_name string, text string, sha256 string"
RELATIONS = "file_path string, source string, target string, edge_type string"
VECTORS = "node_id long, file_path string, embedding array<double>"
CHUNKS = "file_path string, " + chunking.SCHEMA
CACHE = "event_id long, query string, query_type string, result string, stored_at long"
BY_FILE = {"index": INDEX, "relations": RELATIONS, "chunks": CHUNKS, "vectors": VECTORS}
SDK = "library string, topic string, doc string, fetched_at long, ttl_days int"


class Engine:
    """Tables of a project (index, relations, cache, library pages) and the actions over them.

    Tables are versioned below the knowledge folder; every action reads the current version. The index and what is derived
    from it (relations, chunks, vectors) are merge-on-read tables by file: a change derives and writes only the changed
    files' rows, and a search reads the stored vectors. `execute` takes a request
    {"action": ..., "params": {...}} and returns {"status": ..., ...}, an error as a status, never as an exception.
    """

    def __init__(self, spark: SparkSession, project_root: str | Path, generate: workflows.Generate = workflows.extractive) -> None:
        self.spark, self.root, self.generate = spark, Path(project_root), generate
        self.config = C.load(project_root)
        self.home = self.root / self.config.knowledge_dir
        self.watch: StreamingQuery | None = None
        self.actions = {
            n: getattr(self, n)
            for n in "init search enrich_task query rag_workflow knowledge_agent reindex incremental_reindex add_directory remove_file post_commit watch_start watch_stop watch_status stats task_health sdk_cache_get sdk_cache_list cache_stats cache_clear cache_cleanup graph_path graph_neighbors metrics".split()
        }

    def execute(self, request: dict[str, Any]) -> dict[str, Any]:
        began = time.monotonic()
        action = request.get("action")
        try:
            if action not in self.actions:
                out = {"status": "error", "error": f"unknown action {action!r}", "known": sorted(self.actions)}
            else:
                out = self.actions[action](**request.get("params", {}))
        except (TypeError, ValueError, OSError) as e:
            out = {"status": "error", "error": str(e)}
        return out | {"_meta": {"action": action, "elapsed_ms": round((time.monotonic() - began) * 1000)}}

    # ---- tables ------------------------------------------------------------------------------------------------------

    def log(self, name: str) -> LogTable:
        return LogTable(self.spark, str(self.home / f"{name}_log"), "file_path")

    def table(self, name: str, schema: str) -> DataFrame:
        if name in BY_FILE and (log := self.log(name)).versions():
            return log.read()
        found = files.load_version(self.spark, str(self.home / name))
        return self.spark.createDataFrame([], schema) if found is None else found

    def indexed(self) -> bool:
        return bool(self.log("index").versions()) or (self.home / "index").exists()

    def save(self, name: str, df: DataFrame) -> None:
        files.save_version(df, str(self.home / name))

    def scanned(self, folders: list[str]) -> DataFrame:
        """The text files of folders that exist, numbered by a hash of their path."""
        out = None
        for d in folders:
            if Path(d).exists():
                part = files.scan(self.spark, d).filter("text is not null")
                out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], INDEX)
        return out.dropDuplicates(["file_path"]).select(F.xxhash64("file_path").alias("node_id"), "doc_id", "file_path", "file_name", "text", "sha256")

    def folders(self) -> list[str]:
        return [str(self.root / d) for d in (self.config.docs_dir, *self.config.code_dirs)]

    def vectors(self, docs: DataFrame) -> DataFrame:
        return retrieval.hashing_embedder(docs)

    def asked(self, question: str) -> DataFrame:
        q = self.spark.createDataFrame([(0, question)], "node_id long, text string")
        v = self.vectors(q).select(F.col("node_id").alias("query_id"), "embedding")
        return q.select(F.col("node_id").alias("query_id"), "text").join(v, "query_id", "left")

    # ---- actions -----------------------------------------------------------------------------------------------------

    def init(self) -> dict[str, Any]:
        self.home.mkdir(parents=True, exist_ok=True)
        return {"status": "ok", "config": self.config.shown(), "problems": self.config.problems()}

    def _derived(self, docs: DataFrame) -> dict[str, DataFrame]:
        """Relations, chunks and vectors of documents, each with its file."""
        found = extract.extracted(docs).filter("what = 'relation'")
        number = docs.select("node_id", "file_path")
        return {
            "relations": found.select("file_path", "source", "target", F.col("kind").alias("edge_type")),
            "chunks": chunking.chunked(docs).join(number, "node_id").select("file_path", *[c.split()[0] for c in chunking.SCHEMA.split(", ")]),
            "vectors": self.vectors(docs).join(number, "node_id").select("node_id", "file_path", "embedding"),
        }

    def _apply(self, fresh: DataFrame, changed: DataFrame | None) -> dict[str, Any]:
        """Puts the rows of fresh, index rows, in place of those of changed (file_path), or of the whole index.

        Of the derived tables, too, only the rows of these files are made and written.
        """
        fresh = fresh.select(*[c.split()[0] for c in INDEX.split(", ")])
        if changed is not None:
            changed = written(changed.select("file_path").distinct(), "changed")
            fresh = written(fresh.join(changed, "file_path", "left_semi").select(*fresh.columns), "fresh")
            self._put("index", fresh, changed)
        else:
            self._put("index", fresh, None)
            fresh = self.table("index", INDEX)
        for name, rows in self._derived(fresh).items():
            self._put(name, rows, changed)
        return {"status": "ok", "documents": self.table("index", INDEX).count(), "relations": self.table("relations", RELATIONS).count()}

    def _put(self, name: str, fresh: DataFrame, changed: DataFrame | None) -> None:
        log = self.log(name)
        if changed is None:
            log.replace(fresh)
            return
        if not log.versions():
            log.replace(self.table(name, BY_FILE[name]))
        log.merge(fresh, changed)

    def reindex(self, force: bool = True) -> dict[str, Any]:
        return self._apply(self.scanned(self.folders()), None) if force else self.incremental_reindex()

    def incremental_reindex(self) -> dict[str, Any]:
        """Applies what changed since the last index: added, modified and deleted files."""
        old, new = self.table("index", INDEX), self.scanned(self.folders())
        as_snapshot = lambda df: df.select(F.col("file_path").alias("path"), "sha256")
        delta = written(changes.diff(as_snapshot(old), as_snapshot(new)), "delta")
        counts = {r["change"]: r["n"] for r in delta.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if counts:
            self._apply(new, delta.select(F.col("path").alias("file_path")))
        return {"status": "ok", "changes": counts}

    def add_directory(self, path: str) -> dict[str, Any]:
        new = self.scanned([path])
        return self._apply(new, new)

    def remove_file(self, path: str) -> dict[str, Any]:
        old = self.table("index", INDEX)
        left = changes.remove(old, path, "doc_id")
        return self._apply(left, old.join(left.select("file_path", "doc_id"), ["file_path", "doc_id"], "left_anti"))

    def post_commit(self, changed: list[str]) -> dict[str, Any]:
        """What a commit hook calls with the commit's files: a new index if documents are among them."""
        due = projects.docs_changed(changed, self.config.docs_dir)
        return {"status": "ok", "reindexed": due} | ({"changes": self.incremental_reindex()["changes"]} if due else {})

    def watch_start(self, events: str | None = None, every: str = "2 seconds") -> dict[str, Any]:
        """Follows a folder of file events as a stream; a batch with one that is not excluded brings the index up to date."""
        if self.watch is not None and self.watch.isActive:
            return {"status": "ok", "running": True, "started": False}
        folder = Path(events or self.home / "events")
        folder.mkdir(parents=True, exist_ok=True)

        def apply(batch: DataFrame, _: int) -> None:
            if not file_events.relevant(batch).isEmpty():
                self.incremental_reindex()

        stream = file_events.read_stream(self.spark, str(folder)).writeStream.option("checkpointLocation", str(self.home / "watch_progress"))
        self.watch = stream.trigger(processingTime=every).foreachBatch(apply).start()
        return {"status": "ok", "running": True, "started": True}

    def watch_stop(self) -> dict[str, Any]:
        """Ends the watch after the events that have come so far."""
        running = self.watch is not None and self.watch.isActive
        if running:
            self.watch.processAllAvailable()
            self.watch.stop()
        return {"status": "ok", "running": False, "stopped": running}

    def watch_status(self) -> dict[str, Any]:
        running = self.watch is not None and self.watch.isActive
        failure = self.watch.exception() if self.watch is not None else None
        return {"status": "ok", "running": running, "events": sum(p.numInputRows for p in self.watch.recentProgress) if self.watch is not None else 0, "error": str(failure) if failure else None}

    def search(self, query: str, top_k: int | None = None) -> dict[str, Any]:
        k = top_k or self.config.top_k
        docs = self.table("index", INDEX)
        hits = retrieval.hybrid_search(docs, self.table("vectors", VECTORS), self.asked(query), k)
        rows = hits.join(docs, "node_id").select("rank", "score", "origin", "file_name", text.snippet(F.col("text")).alias("text")).orderBy("rank").collect()
        return {"status": "ok" if rows else "no_results", "results": [r.asDict() for r in rows]}

    def context(self, question: str, k: int) -> str:
        docs = self.table("index", INDEX)
        row = retrieval.context(retrieval.hybrid_search(docs, self.table("vectors", VECTORS), self.asked(question), k), docs, k, self.config.max_context_tokens).first()
        return row.context if row else ""

    def enrich_task(self, task: str, top_k: int | None = None) -> dict[str, Any]:
        """Routes a task to a prepared answer, the graph, hybrid or vector search, and returns the context found there."""
        q = self.spark.createDataFrame([("t", task)], "query_id string, query string")
        r = classify.route(q, classify.train_mlp()).first()
        k = top_k or self.config.top_k
        lines = self._path_lines(task) if r.routed_to in ("graph", "hybrid") else ""
        found = lines if r.routed_to == "graph" and lines else "\n\n".join(filter(None, [lines, self.context(task, k)]))
        routed = r.routed_to if r.routed_to != "graph" or lines else "vector"
        return {"status": "ok" if found or r.artifact_id else "no_results", "routed_to": routed, "query_type": r.label, "confidence": r.confidence, "artifact_id": r.artifact_id, "context": found}

    def _path_lines(self, task: str) -> str:
        q = self.spark.createDataFrame([(task,)], "q string").select(text.pair(F.col("q"), 1).alias("a"), text.pair(F.col("q"), 2).alias("b")).first()
        if not q.a or not q.b:
            return ""
        steps = self.graph_path(q.a, q.b)["steps"]
        return "\n".join(["[Graph Path]"] + [f"  {i}. {x['node']} --{x['edge_type']}--> {y['node']}" for i, (x, y) in enumerate(zip(steps, steps[1:]), 1)]) if len(steps) > 1 else ""

    def graph_path(self, source: str, target: str) -> dict[str, Any]:
        steps = [r.asDict() for r in graph_search.shortest_path(self.table("relations", RELATIONS), source, target).orderBy("step").collect()]
        return {"status": "ok", "found": bool(steps), "total_cost": steps[0]["total_cost"] if steps else 0.0, "hops": max(0, len(steps) - 1), "steps": steps}

    def graph_neighbors(self, node_id: str, depth: int = 1, relation: str | None = None) -> dict[str, Any]:
        rows = graph_search.neighbours(self.table("relations", RELATIONS), node_id, depth, relation).orderBy("level", "node").collect()
        return {"status": "ok", "center": node_id, "depth": depth, "neighbors": [r.asDict() for r in rows]}

    def query(self, query: str, top_k: int | None = None) -> dict[str, Any]:
        said = workflows.rag(query, self.context, self.generate, top_k or self.config.top_k)
        return {"status": "ok", "answer": said["answer"]}

    def rag_workflow(self, question: str, response_shape: str | None = None) -> dict[str, Any]:
        return {"status": "ok"} | workflows.rag(question, self.context, self.generate, 5, response_shape)

    def knowledge_agent(self, task: str) -> dict[str, Any]:
        """Searches once, unless the task needs no code knowledge."""
        gate = self.spark.createDataFrame([(task,)], "t string").select(classify.activation(F.col("t")).alias("g")).first().g
        tools = {"search": lambda q: self.context(q, self.config.top_k)}
        decide = lambda t, said: ("search", t) if gate.should_use and not said else None
        return {"status": "ok", "should_use": gate.should_use} | workflows.knowledge_agent(task, tools, decide, self.generate)

    def stats(self) -> dict[str, Any]:
        docs, rel = self.table("index", INDEX), self.table("relations", RELATIONS)
        kinds = {r.edge_type: r.n for r in graph.by_relation(rel).collect()}
        return {"status": "ok", "stats": {"project_root": str(self.root), "has_index": self.indexed(), "document_count": docs.count(), "relations": kinds}}

    def task_health(self) -> dict[str, Any]:
        c = self.config
        return {"status": "ok", "health": {"enabled": c.enabled, "has_index": self.indexed(), "top_k": c.top_k, "cache_maxsize": c.cache_maxsize, "cache_similarity_threshold": c.similarity_threshold, "circuit_breaker_threshold": c.circuit_breaker_threshold}}

    def sdk_cache_get(self, library: str, topic: str = "general", as_of: int | None = None) -> dict[str, Any]:
        wanted = self.spark.createDataFrame([(library, topic)], "library string, topic string")
        row = cache.sdk_get(wanted, self.table("sdk", SDK), int(time.time()) if as_of is None else as_of).first()
        return {"status": "ok" if row.doc else "miss", "doc": row.doc, "how": row.how}

    def sdk_cache_put(self, library: str, topic: str, doc: str, fetched_at: int) -> dict[str, Any]:
        new = self.spark.createDataFrame([(library, topic, doc, fetched_at, self.config.sdk_cache_ttl_days)], SDK)
        self.save("sdk", self.table("sdk", SDK).join(new.select("library", "topic"), ["library", "topic"], "left_anti").select(*new.columns).unionByName(new))
        return {"status": "ok"}

    def sdk_cache_list(self, as_of: int | None = None) -> dict[str, Any]:
        rows = report.library_listing(self.table("sdk", SDK), int(time.time()) if as_of is None else as_of).orderBy("library").collect()
        return {"status": "ok", "libraries": [r.asDict() for r in rows]}

    def cache_stats(self) -> dict[str, Any]:
        n = {r.query_type: r.n for r in cache.counts(self.table("cache", CACHE)).collect()}
        return {"status": "ok", "total": sum(n.values()), "by_type": n}

    def cache_clear(self, query_type: str | None = None) -> dict[str, Any]:
        old = self.table("cache", CACHE)
        kept = cache.without_type(old, query_type)
        before = old.count()
        self.save("cache", kept)
        return {"status": "ok", "cleared": before - self.table("cache", CACHE).count()}

    def cache_cleanup(self, as_of: int | None = None) -> dict[str, Any]:
        old = self.table("cache", CACHE)
        before = old.count()
        self.save("cache", cache.fresh(old, int(time.time()) if as_of is None else as_of))
        return {"status": "ok", "removed": before - self.table("cache", CACHE).count()}

    def metrics(self, path: str | None = None, since: str | None = None) -> dict[str, Any]:
        """The summary and the breakdown by type of the cost log."""
        from lorespark.operators import metrics as M

        log = files.read_metrics(self.spark, path or str(self.home / "metrics.jsonl"), since)
        return {"status": "ok", "summary": M.summary(log).first().asDict(), "by_type": [r.asDict() for r in M.by_type(log).orderBy("query_type").collect()]}
