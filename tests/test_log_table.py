import json
import random
from collections import Counter
from pathlib import Path

import pytest

from lorespark.sources import log_table
from lorespark.sources.log_table import LogTable

SCHEMA = "file_path string, line int, text string"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "t")


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_any_sequence_of_changes_equals_a_plain_table(spark, folder, monkeypatch):
    """Merges, folds and compactions against a dictionary of rows by key; null keys, repeated rows and empty changes."""
    monkeypatch.setattr(log_table, "MAX_DELTAS", 3)
    r = random.Random(4)
    keys = [None, *[f"/f/{i}.py" for i in range(12)]]
    some = lambda: [(k, r.randint(1, 3), r.choice("ab")) for k in r.sample(keys, r.randint(0, 3)) for _ in range(r.randint(1, 3))]
    first = [(k, 0, "x" * 400) for k in keys for _ in range(2)]
    plain, t, seen = Counter(first), LogTable(spark, folder, "file_path"), []
    assert t.version() is None and t.versions() == []
    t.replace(spark.createDataFrame(first, SCHEMA))
    for step in range(9):
        fresh, gone = some(), [(k,) for k in r.sample(keys, r.randint(0, 2))]
        number = t.merge(spark.createDataFrame(fresh, SCHEMA), spark.createDataFrame(gone, "file_path string"), tidy=False)
        dead = {k for k, _, _ in fresh} | {k for k, in gone}
        plain = Counter({x: n for x, n in plain.items() if x[0] not in dead}) + Counter(fresh)
        seen.append((number, Counter(plain)))
        assert rows_of(t.read()) == plain
        if step == 5:
            assert t.compact() and not t.version()["deltas"] and rows_of(t.read()) == plain
        elif len(t.version()["deltas"]) > 3:
            before = t.version()["base"]
            assert t.fold() and len(t.version()["deltas"]) == 1 and t.version()["base"] == before and rows_of(t.read()) == plain
    for number, was in seen[::4]:
        assert rows_of(t.read(number)) == was
    monkeypatch.setattr(log_table, "BROADCAST_KEYS", 0)
    assert rows_of(t.read()) == plain


def test_a_change_writes_in_proportion_to_it(spark, folder):
    t = LogTable(spark, folder, "file_path")
    wide = spark.range(40_000).selectExpr("concat('/f/', id % 4000) as file_path", "cast(id as int) as line", "sha2(cast(id as string), 256) as text")
    t.replace(wide)
    base = size(folder)
    t.merge(wide.filter("file_path = '/f/7'"))
    assert size(folder) - base < base / 50 and t.read().count() == 40_000
    plan = t.read().filter("file_path = '/f/9'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(file_path,/f/9)") >= 2  # the filter is in both scans
    for k in range(3):
        t.merge(wide.filter(f"line % 4 = {k}"))
    assert len(t.version()["deltas"]) <= 1  # large deltas went into a new base


def test_readers_and_writers_beside_each_other(spark, folder):
    """A reader keeps its version; a taken number sends a change on top of it, and stops a compaction."""
    t, other = LogTable(spark, folder, "file_path"), LogTable(spark, folder, "file_path")
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    with pytest.raises(ValueError):
        t.merge(make(("a", 1, "x")))
    t.replace(make(("a", 1, "old"), ("b", 1, "old")))
    reader, stale = t.read(), t.version()
    other.merge(make(("a", 2, "new")))
    assert rows_of(reader) == Counter([("a", 1, "old"), ("b", 1, "old")])
    assert not t.compact(stale) and rows_of(t.read()) == Counter([("a", 2, "new"), ("b", 1, "old")])
    t.version = lambda number=None, v=iter([stale]): next(v, None) or LogTable.version(t, number)  # it has read the log before the other wrote
    t.merge(make(("c", 3, "mine")), tidy=False)
    assert rows_of(other.read()) == Counter([("a", 2, "new"), ("b", 1, "old"), ("c", 3, "mine")])
    assert [p.name for p in Path(folder, "_log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")] == []
    with pytest.raises(ValueError):
        t.replace(spark.createDataFrame([(1, 2)], "file_path int, _layer int"))


def test_vacuum_keeps_what_versions_name_and_what_is_young(spark, folder):
    t = LogTable(spark, folder, "file_path")
    for k in range(4):
        t.replace(spark.createDataFrame([("a", k, "x")], SCHEMA))
    assert t.vacuum(keep=2) == []
    removed = t.vacuum(keep=2, older_than_s=-60)
    assert len([x for x in removed if x.startswith("base-")]) == 2 and t.versions() == [3, 4]
    assert [r.line for r in t.read(3).collect()] == [2] and [r.line for r in t.read().collect()] == [3]
    assert json.loads(t.version()["schema"])["fields"][0]["name"] == "file_path"
