import io
import json

import pytest

from lorespark import cli
from lorespark.sources import http_docs, projects


def test_projects(tmp_path):
    for n in ("a", "b/c"):
        (tmp_path / n / ".lore").mkdir(parents=True)
        (tmp_path / n / ".lore/config.json").write_text("{}")
    assert projects.discover(tmp_path) == [str(tmp_path / "a"), str(tmp_path / "b/c")]
    assert projects.flags(tmp_path / "a") == {"exists": True, "has_index": False, "has_config": True}
    r = projects.Registry(str(tmp_path / "reg.json"))
    r.add("one", str(tmp_path / "a"))
    r.add("two", str(tmp_path / "zz"))
    again = projects.Registry(str(tmp_path / "reg.json"))
    assert [(p["name"], p["exists"]) for p in again.listed()] == [("one", True), ("two", False)]
    assert again.remove("two") and not again.remove("two")


def test_confined(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("text")
    (tmp_path / "inside").mkdir()
    (tmp_path / "inside/b.txt").write_text("secret")
    assert projects.read_confined(tmp_path / "in", "a.txt") == "text"
    for bad in ("../inside/b.txt", "/etc/hostname"):
        with pytest.raises(ValueError):
            projects.read_confined(tmp_path / "in", bad)


def test_fingerprint(tmp_path):
    f = tmp_path / "f"
    a = projects.fingerprint([str(f)])
    f.write_text("x")
    assert projects.fingerprint([str(f)]) != a
    assert projects.docs_changed(["src/x", "docs/a.md"]) and not projects.docs_changed(["docsx/a"])


def test_http_docs(spark):
    pages = {"b/search?query=lib": b'{"results": [{"id": "/x/y"}]}', "b/x/y?topic=t": "pagé".encode(), "b/search?query=none": b'{"results": []}', "b/search?query=bad": b"<html>"}

    def fetch(url):
        if url not in pages:
            raise OSError(url)
        return pages[url]

    got = [http_docs.fetch_doc("b", lib, "t", fetch) for lib in ("lib", "none", "bad", "away")]
    assert got == ["pagé", None, None, None]
    spark.dataSource.register(http_docs.HttpDocs)
    rows = spark.read.format("http_docs").option("base", "http://127.0.0.1:9").option("topics", "lib:t,other").load().collect()
    assert {(r.library, r.topic, r.doc) for r in rows} == {("lib", "t", None), ("other", "general", None)}


def test_requests(spark, tmp_path):
    args = lambda **k: type("A", (), {"reindex": False, "add": None, "remove_file": None, "list": False, **k})()
    assert cli.request_of(args(add="d"), io.StringIO())["params"] == {"path": "d"}
    assert cli.request_of(args(), io.StringIO("{broken"))["action"] is None
    out = io.StringIO()
    assert cli.main(["--project", str(tmp_path)], io.StringIO('{"action": "task_health"}'), out) == 0
    assert json.loads(out.getvalue())["status"] == "ok"
    assert cli.main(["--project", str(tmp_path)], io.StringIO("[]"), io.StringIO()) == 1
