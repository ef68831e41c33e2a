"""File sources and sinks, settings, the facade and workflows."""

import json
import time

from pyspark.sql import functions as F

from lorespark import config, workflows
from lorespark.api import Engine
from lorespark.sources import files


def test_scan(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("hé")
    (tmp_path / "docs/b.png").write_bytes(b"x")
    (tmp_path / "docs/c.md").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/d.md").write_text("d")
    got = {r.file_name: r.text for r in files.scan(spark, str(tmp_path), ["node_modules", "*.png"]).collect()}
    assert got == {"a.md": "hé", "c.md": None}
    assert files.read_file(spark, str(tmp_path / "docs/a.md")).first().text == "hé"


def test_metrics_log(spark, tmp_path):
    log = tmp_path / "m.jsonl"
    log.write_text('{"timestamp": "2024-01-02T00:00:00", "query_type": "rag", "cost": 0.5, "odd": 1}\n\nnot json\n{"timestamp": "2023-01-02T00:00:00", "query_type": "rag", "cost": 0.25}\n')
    assert files.read_metrics(spark, str(log)).agg(F.sum("cost")).first()[0] == 0.75
    assert files.read_metrics(spark, str(log), "2024-01-01T00:00:00").count() == 1
    assert files.read_metrics(spark, str(tmp_path / "none")).count() == 0
    out = str(tmp_path / "out")
    files.append_metrics(files.read_metrics(spark, str(log)), out)
    files.append_metrics(files.read_metrics(spark, str(log)), out)
    assert files.read_metrics(spark, out).count() == 4


def test_docstore_and_relations(spark, tmp_path):
    node = {"__data__": {"id_": "1", "metadata": {"file_path": "/a", "file_size": 3}}}
    (tmp_path / "d.json").write_text(json.dumps({"docstore/data": {}, "docstore/docs": {"k": node}}))
    assert [(r.id_, r.file_path) for r in files.read_docstore(spark, str(tmp_path / "d.json")).collect()] == [("1", "/a")]
    (tmp_path / "r.json").write_text(json.dumps({"relationships": [{"source": "a", "target": "b", "relation_type": "calls", "metadata": {}}], "entities": {"a::X": {"name": "X", "entity_type": "class"}}}))
    rel, ent = files.read_relations(spark, str(tmp_path / "r.json"))
    assert rel.count() == ent.count() == 1
    assert files.read_relations(spark, str(tmp_path / "none.json"))[0].count() == 0


def test_cache_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"query": f"q{i}", "query_type": "rag", "kwargs": {"k": "1"}, "result": "r", "timestamp": 1.5}))
    assert files.read_cache(spark, str(tmp_path)).count() == 2


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert files.load_version(spark, folder) is None
    for i in range(5):
        files.save_version(spark.range(i + 1), folder)
    assert files.load_version(spark, folder).count() == 5 and files.load_version(spark, folder, back=1).count() == 4
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 3


def test_state(tmp_path):
    p = str(tmp_path / "s/state.json")
    assert files.load_state(p, {"a": 1}) == {"a": 1}
    files.save_state(p, {"a": 2})
    assert files.load_state(p, {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    (tmp_path / "s/state.json").write_text("{broken")
    assert files.load_state(p, {"a": 1}) == {"a": 1}


def test_precedence(tmp_path):
    (tmp_path / ".lore").mkdir()
    (tmp_path / ".lore/config.json").write_text(json.dumps({"docs_dir": "f", "llm_model": "file", "code_dirs": ["x"], "bridge": {"top_k": 7}}))
    c = config.load(tmp_path, {"LORE_DOCS_DIR": "e", "LORE_LLM_MODEL": "env", "LORE_CODE_DIRS": "y,z", "LORE_API_KEY": "abcd1234", "LORE_CACHE_MAXSIZE": "many"})
    assert (c.docs_dir, c.llm_model, c.code_dirs, c.top_k, c.cache_maxsize) == ("e", "file", ("x",), 7, 128)
    assert c.shown()["api_key"] == "***1234"
    assert config.load(tmp_path / "none", {}).docs_dir == "docs"


def test_workflows():
    said = workflows.knowledge_agent("t", {"search": lambda q: f"found {q}"}, lambda t, s: ("search", t) if len(s) < 9 else None, lambda p: p)
    assert said["rounds"] == 3 and said["answer"].count("found t") == 3
    assert workflows.session_diff({"a": 1}, {"a": 3, "b": 1})["changes"] == {"a": 2, "b": 1}
    done = workflows.evaluate([{"id": "1", "question": "x", "expected": "X"}, {"id": "2", "question": "y", "expected": "z"}], lambda q: q.upper())
    assert (done["total"], done["passed"], done["percent"]) == (2, 1, 50.0)
    assert workflows.evaluate([], str)["percent"] == 0.0


def test_engine(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/one.md").write_text("Caching keeps answers.")
    (tmp_path / "docs/two.py").write_text("import os\nclass Abc(Base):\n    def f(self):\n        return go()\n")
    e = Engine(spark, tmp_path)
    run = lambda action, **params: e.execute({"action": action, "params": params})
    assert run("init")["status"] == "ok" and run("nothing")["status"] == "error" and run("search")["status"] == "error"
    assert run("stats")["stats"]["document_count"] == 0
    made = run("reindex")
    assert made["documents"] == 2 and made["relations"] >= 4
    assert run("search", query="caching answers", top_k=1)["results"][0]["file_name"] == "one.md"
    assert run("enrich_task", task="what keeps answers")["routed_to"] in ("vector", "hybrid", "graph", "artifact")
    assert "Caching" in run("rag_workflow", question="caching answers")["context"]
    assert run("query", query="caching")["status"] == "ok" and run("knowledge_agent", task="fix the cache")["rounds"] == 1
    (tmp_path / "docs/one.md").write_text("Changed.")
    (tmp_path / "docs/three.md").write_text("New.")
    assert run("incremental_reindex")["changes"] == {"modified": 1, "added": 1}
    assert run("remove_file", path=str(tmp_path / "docs/three.md"))["documents"] == 2
    assert run("graph_path", source=f"{tmp_path}/docs/two.py", target="os")["hops"] == 1
    assert len(run("graph_neighbors", node_id="os")["neighbors"]) == 1
    assert run("task_health")["health"]["has_index"] is True
    e.sdk_cache_put("Lib", "general", "text", int(time.time()))
    assert run("sdk_cache_get", library="Lib")["doc"] == "text" and run("sdk_cache_list")["libraries"][0]["fresh"]
    assert run("cache_stats")["total"] == 0 and run("cache_clear")["cleared"] == 0 and run("cache_cleanup")["removed"] == 0
    assert run("metrics")["summary"]["total_queries"] == 0


def test_only_changed_files_are_derived_anew(spark, tmp_path, monkeypatch):
    """A change reads, chunks and embeds the changed files alone, and gives the tables that a whole index gives."""
    from lorespark.operators import chunking, extract

    (tmp_path / "docs").mkdir()
    for i in range(4):
        (tmp_path / f"docs/f{i}.py").write_text(f"import m{i}\ndef f{i}():\n    return g{i}()\n")
    e = Engine(spark, tmp_path)
    e.execute({"action": "reindex"})
    seen = []
    for module, name in ((extract, "extracted"), (chunking, "chunked")):
        monkeypatch.setattr(module, name, lambda docs, f=getattr(module, name): (seen.append({r.file_name for r in docs.select("file_name").collect()}), f(docs))[1])
    (tmp_path / "docs/f1.py").write_text("import other\n")
    (tmp_path / "docs/f2.py").unlink()
    assert e.execute({"action": "incremental_reindex"})["changes"] == {"modified": 1, "deleted": 1}
    assert seen == [{"f1.py"}, {"f1.py"}]
    rows = lambda: [sorted(map(str, e.table(n, "x int").collect())) for n in ("index", "relations", "chunks", "vectors")]
    after = rows()
    e.execute({"action": "reindex"})
    assert after == rows() and any("other" in r for r in after[1])
    assert e.execute({"action": "post_commit", "params": {"changed": ["src/a.py"]}}) | {"_meta": 0} == {"status": "ok", "reindexed": False, "_meta": 0}
    (tmp_path / "docs/f3.py").unlink()
    assert e.execute({"action": "post_commit", "params": {"changed": ["docs/f3.py"]}})["changes"] == {"deleted": 1}


def test_watch(spark, tmp_path):
    import json

    (tmp_path / "docs").mkdir()
    e = Engine(spark, tmp_path)
    run = lambda action: e.execute({"action": action})
    run("reindex")
    assert run("watch_status")["running"] is False and run("watch_stop")["stopped"] is False
    assert run("watch_start")["started"] and run("watch_start")["started"] is False
    (tmp_path / "docs/a.md").write_text("New text.")
    event = {"event_id": 1, "ts": "2024-01-01T00:00:00Z", "kind": "created", "path": f"{tmp_path}/docs/a.md"}
    (e.home / "events/one.json").write_text(json.dumps(event))
    assert run("watch_stop")["stopped"] and run("watch_status")["error"] is None
    assert run("stats")["stats"]["document_count"] == 1 and run("watch_status")["running"] is False
