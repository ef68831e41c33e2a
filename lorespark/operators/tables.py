"""Intermediate tables in the cluster's shared folder: iterative operators cut their lineage with them."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local master (as in tests) gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lorespark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: reliable if executors are lost, and no longer than one round in lineage."""
    spark = df.sparkSession
    path = removed_at_exit(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """The path of an intermediate table, which goes when the driver's process ends."""
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        return


def shipped(spark: SparkSession, blocks: Iterable) -> list[Broadcast]:
    """A broadcast for each block, made as the blocks come, so that the driver holds one of them at a time.

    Each is as large as its block, which the caller bounds; there may be any number of them.
    """
    return [spark.sparkContext.broadcast(b) for b in blocks]


def in_turn(held: list[Broadcast]) -> Iterator:
    """The blocks in a task, one at a time: with several, each is read again from the broadcast's file when its turn comes."""
    for b in held:
        yield b.value
        if len(held) > 1:
            b.__dict__.pop("_value", None)
