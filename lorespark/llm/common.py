"""What the training-data operators share: column picking, tables that cut lineage, small helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched by exact case, also where other columns differ from them in case only."""
    columns = df.columns
    if len({c.lower() for c in columns}) < len(columns):
        df = df.toDF(*[f"_{i}" for i in range(len(columns))])
        return df.select(*[F.col(f"_{columns.index(n)}").alias(n) for n in names])
    return df.select(*[F.col(f"`{n}`") for n in names])


def numbered(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with all columns but `keep` under numbers, so that no name can clash with an operator's own ones.

    toDF(*docs.columns) gives the names back.
    """
    return docs.toDF(*[c if c in keep else f"_c{i}" for i, c in enumerate(docs.columns)])


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a local master gets a temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lorespark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: later reads neither recompute it nor depend on one executor.

    The file's columns are numbered, so that names may clash or have any characters.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lore-{name}-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def _remove(spark: SparkSession, path: str) -> None:
    """At the end of the driver's process, when no result can need the table any more."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        return


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def give_back() -> None:
    """Returns a worker's free memory to the system at the end of a task; the worker lives on beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        return
