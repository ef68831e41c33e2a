"""Readers and writers of files: documents, JSON logs and stores, snapshots, versioned tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark import constants as K
from lorespark.functions import paths

METRICS = T.StructType([
    T.StructField(n, t) for n, t in (
        ("timestamp", T.StringType()), ("query_type", T.StringType()), ("query_text", T.StringType()), ("model", T.StringType()), ("tokens_in", T.LongType()), ("tokens_out", T.LongType()),
        ("cost", T.DoubleType()), ("docs_retrieved", T.LongType()), ("duration_ms", T.LongType()), ("project_root", T.StringType()),
        ("embedding_cost", T.DoubleType()), ("llm_input_cost", T.DoubleType()), ("llm_output_cost", T.DoubleType()),
    )
])
NODE = "struct<id_: string, metadata: struct<file_path: string, file_name: string, file_type: string, file_size: bigint, creation_date: string, last_modified_date: string>>"
STORE = f"`docstore/data` map<string, struct<__data__: {NODE}>>, `docstore/docs` map<string, struct<__data__: {NODE}>>"
RELATIONS = "relationships array<struct<source: string, target: string, relation_type: string, metadata: map<string, string>>>, entities map<string, struct<name: string, entity_type: string, file_path: string, line_number: int, metadata: map<string, string>>>"


def scan(spark: SparkSession, folder: str, exclude: list[str] = K.EXCLUDE_PATTERNS, contents: bool = True) -> DataFrame:
    """(doc_id, file_path, file_name, file_size, modified, text, sha256) of the files below a folder.

    Paths are filtered before contents are read; files over 50 MB and those that are not UTF-8 have no text.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    f = f.withColumn("file_path", path).filter(~paths.excluded(F.col("file_path"), exclude))
    cols = [F.concat(F.lit("file://"), "file_path").alias("doc_id"), "file_path", paths.basename(F.col("file_path")).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")]
    if contents:
        fit = F.col("length") <= K.MAX_FILE_BYTES
        cols += [F.when(fit & F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("text"), F.when(fit, F.sha2("content", 256)).alias("sha256")]
    return f.select(*cols)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as scan() gives it, if it is text."""
    return scan(spark, path, []).filter("text is not null")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def read_docstore(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store file: its `data` map, or else its `docs` map."""
    raw = spark.read.schema(STORE).option("multiLine", "true").json(path)
    full = F.when(F.size("docstore/data") > 0, F.col("docstore/data")).otherwise(F.col("docstore/docs"))
    return raw.select(F.explode(full).alias("key", "node")).select("key", "node.__data__.id_", "node.__data__.metadata.*")


def read_relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Relations and entities of a file; both are empty if it is missing or invalid."""
    raw = spark.read.schema(RELATIONS).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path) if exists(spark, path) else spark.createDataFrame([], RELATIONS)
    rel = raw.select(F.explode("relationships").alias("r")).select("r.source", "r.target", F.col("r.relation_type").alias("edge_type"), "r.metadata")
    ent = raw.select(F.explode("entities").alias("entity_key", "e")).select("entity_key", "e.*")
    return rel, ent


def read_metrics(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The cost log: unknown fields are dropped, malformed lines skipped, rows before `since` (ISO time) left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], METRICS)
    m = spark.read.schema(METRICS).option("mode", "DROPMALFORMED").json(path).filter("timestamp is not null")
    return m if since is None else m.filter(F.substring("timestamp", 1, 19) >= since[:19])


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cached results of a folder of JSON files."""
    return spark.read.schema("query string, query_type string, kwargs map<string, string>, result string, timestamp double").option("multiLine", "true").json(f"{folder}/*.json")


def save_version(df: DataFrame, folder: str, keep: int = 3) -> str:
    """Writes df as a new version below a folder and moves the pointer to it; keeps the newest versions.

    Readers follow the pointer, a small file that is replaced in one step, so they never see half a table.
    """
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    n = 1 + max((int(p.name[1:]) for p in root.glob("v*") if p.name[1:].isdigit()), default=0)
    name = f"v{n:06d}"
    df.write.parquet(str(root / name))
    new = root / "CURRENT.new"
    new.write_text(name)
    new.replace(root / "CURRENT")
    old = sorted(p for p in root.glob("v*") if p.is_dir())[:-keep]
    for p in old:
        for f in sorted(p.rglob("*"), reverse=True):
            f.unlink()
        p.rmdir()
    return name


def load_version(spark: SparkSession, folder: str, back: int = 0) -> DataFrame | None:
    """The current version of a table, or one further back; None if there is none."""
    root = Path(folder)
    names = sorted(p.name for p in root.glob("v*") if p.is_dir())
    if not (root / "CURRENT").exists() or back >= len(names):
        return None
    current = (root / "CURRENT").read_text().strip()
    return spark.read.parquet(str(root / (current if not back else names[-1 - back])))


def load_state(path: str, default: dict) -> dict:
    """A small state file; the default if it is missing or invalid, and for keys it lacks."""
    try:
        return default | json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return dict(default)


def save_state(path: str, state: dict) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    new = p.with_suffix(".new")
    new.write_text(json.dumps(state, indent=2, sort_keys=True))
    new.replace(p)
