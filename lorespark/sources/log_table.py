"""Merge-on-read tables: a base, small deltas with the keys they replace, and a log of versions.

A table is a folder. Each version is one small file of `_log`, which names a base (Parquet, sorted by key) and the deltas
above it; a delta has fresh rows and the keys whose earlier rows are dead. A change writes a delta and a version, so its
bytes are in proportion to it, whatever the table's size. A reader takes the newest version once, and its files never
change; so beside a writer it sees one version. A version's file is put in place by a rename that fails if its number is
taken: a change then goes on top of the other writer's version, and a compaction, whose input is out of date, is given up.

Reading joins rows with the newest delta that names their key: broadcast while the keys are at most BROADCAST_KEYS, which
the log counts, else by a shuffle. Filters on columns reach the scans. More than MAX_DELTAS deltas are folded into one,
and deltas of over a quarter of the base's bytes are merged into a new base, so that rewriting costs a constant factor.

Defined results: a key may have any number of rows, which are replaced together; null is a key like others; of a key in
both fresh rows and `gone` the fresh rows stay; equal rows are kept; a change without rows and keys makes a version all the
same; files that no kept version names are removed by `vacuum` only, and only when they are old.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DELTAS, BASE_SHARE, BROADCAST_KEYS, TRIES = 16, 0.25, 1_000_000, 20
_OWN = ("_layer", "_at", "_key")


class LogTable:
    """The table of a folder, with the column whose values are replaced together."""

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    # ---- versions ----------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        log = self._path("_log")
        if not self._fs.exists(log):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(log))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> dict[str, Any] | None:
        """What a version (the newest one) names; None if there is none."""
        known = self.versions()
        if not known or number is not None and number not in known:
            return None
        number = known[-1] if number is None else number
        stream = self._fs.open(self._path(f"_log/{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"number": number}

    def _commit(self, number: int, base: dict, deltas: list[dict], schema: str) -> bool:
        """Puts a version in place; False if its number is taken."""
        new, place = self._path(f"_log/.{uuid.uuid4().hex}"), self._path(f"_log/{number:012d}.json")
        self._fs.mkdirs(self._path("_log"))
        stream = self._fs.create(new, False)
        stream.write(json.dumps({"base": base, "deltas": deltas, "schema": schema}).encode())
        stream.close()
        try:
            options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            place_fs = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else self._fs.getUri(), self._conf)
            place_fs.rename(self._fs.makeQualified(new), self._fs.makeQualified(place), options)
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    # ---- writing -----------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str) -> dict[str, Any]:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return {"name": name, "bytes": self._fs.getContentSummary(self._path(name)).getLength()}

    def replace(self, df: DataFrame) -> int:
        """A new base in place of everything; the version's number."""
        if any(c in _OWN for c in df.columns):
            raise ValueError(f"columns {_OWN} are the table's own")
        base = self._write(df.sortWithinPartitions(self.key), "base")
        for _ in range(TRIES):
            number = max(self.versions(), default=0) + 1
            if self._commit(number, base, [], df.schema.json()):
                return number
        raise RuntimeError("other writers took every version's number")

    def merge(self, fresh: DataFrame | None = None, gone: DataFrame | None = None, tidy: bool = True) -> int:
        """Replaces the rows of fresh's keys by fresh's, and removes those of gone's keys; the version's number."""
        now = self.version()
        if now is None:
            raise ValueError("the table has no version yet")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        fresh = self.spark.createDataFrame([], schema) if fresh is None else fresh.select(*schema.names)
        rows = self._write(fresh.sortWithinPartitions(self.key), "rows")
        dead = self.spark.read.schema(schema).parquet(f"{self.folder}/{rows['name']}").select(self.key)
        if gone is not None:
            dead = dead.unionByName(gone.select(F.col(self.key).cast(schema[self.key].dataType)))
        keys = self._write(dead.distinct(), "keys")
        n = self.spark.read.schema(dead.schema).parquet(f"{self.folder}/{keys['name']}").count()
        delta = {"rows": rows["name"], "keys": keys["name"], "n_keys": n, "bytes": rows["bytes"] + keys["bytes"]}
        for _ in range(TRIES):
            if self._commit(now["number"] + 1, now["base"], [*now["deltas"], delta], now["schema"]):
                if tidy:
                    self.tidy()
                return now["number"] + 1
            now = self.version()
        raise RuntimeError("other writers took every version's number")

    # ---- reading -----------------------------------------------------------------------------------------------------

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest one by default."""
        now = self.version(number)
        if now is None:
            raise ValueError("the table has no such version")
        return self._live(now, [now["base"]["name"]])

    def _live(self, now: dict[str, Any], base: list[str]) -> DataFrame:
        """The live rows of the named base tables and of all deltas."""
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        read = lambda name, s=schema: self.spark.read.schema(s).parquet(f"{self.folder}/{name}")
        if not now["deltas"]:
            return read(base[0])
        parts = [read(b).withColumn("_layer", F.lit(-1)) for b in base] + [read(d["rows"]).withColumn("_layer", F.lit(i)) for i, d in enumerate(now["deltas"])]
        dead = self._dead(now).withColumnRenamed(self.key, "_key")
        if sum(d["n_keys"] for d in now["deltas"]) <= BROADCAST_KEYS:
            dead = F.broadcast(dead)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.join(dead, F.col(self.key).eqNullSafe(F.col("_key")), "left").filter("_at is null or _layer >= _at").select(*schema.names)

    def _dead(self, now: dict[str, Any]) -> DataFrame:
        """Each key that deltas name, with the last of them."""
        schema = T.StructType([T.StructType.fromJson(json.loads(now["schema"]))[self.key]])
        out = None
        for i, d in enumerate(now["deltas"]):
            part = self.spark.read.schema(schema).parquet(f"{self.folder}/{d['keys']}").withColumn("_at", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out.groupBy(self.key).agg(F.max("_at").alias("_at"))

    # ---- upkeep ------------------------------------------------------------------------------------------------------

    def tidy(self) -> str | None:
        """Compacts or folds where the deltas are large or many; what was done."""
        now = self.version()
        if sum(d["bytes"] for d in now["deltas"]) > BASE_SHARE * now["base"]["bytes"] and len(now["deltas"]) > 1:
            return "compacted" if self.compact(now) else None
        if len(now["deltas"]) > MAX_DELTAS:
            return "folded" if self.fold(now) else None
        return None

    def compact(self, now: dict[str, Any] | None = None) -> bool:
        """Base and deltas as one new base; False if another writer was faster."""
        now = now or self.version()
        base = self._write(self._live(now, [now["base"]["name"]]).sortWithinPartitions(self.key), "base")
        return self._commit(now["number"] + 1, base, [], now["schema"])

    def fold(self, now: dict[str, Any] | None = None) -> bool:
        """All deltas as one, without reading the base; False if another writer was faster."""
        now = now or self.version()
        rows = self._write(self._live(now, []).sortWithinPartitions(self.key), "rows")
        dead = self._dead(now).select(self.key)
        keys = self._write(dead, "keys")
        n = self.spark.read.schema(dead.schema).parquet(f"{self.folder}/{keys['name']}").count()
        return self._commit(now["number"] + 1, now["base"], [{"rows": rows["name"], "keys": keys["name"], "n_keys": n, "bytes": rows["bytes"] + keys["bytes"]}], now["schema"])

    def vacuum(self, keep: int = 3, older_than_s: float = 86_400.0) -> list[str]:
        """Removes all but the newest versions and the files that only those named; never what is younger, which a writer may need yet."""
        known = self.versions()
        named, limit, removed = set(), (time.time() - older_than_s) * 1000, []
        for number in known[-keep:]:
            v = self.version(number)
            named |= {v["base"]["name"], *(d[c] for d in v["deltas"] for c in ("rows", "keys"))}
        old = {f"_log/{number:012d}.json" for number in known[:-keep]}
        for s in [*self._fs.listStatus(self._path("_log")), *self._fs.listStatus(self._path(""))]:
            name = s.getPath().getName()
            name = f"_log/{name}" if s.getPath().getParent().getName() == "_log" else name
            if (name in old or name.split("-")[0] in ("base", "rows", "keys") and name not in named) and s.getModificationTime() <= limit:
                self._fs.delete(s.getPath(), True)
                removed.append(name)
        return sorted(removed)
