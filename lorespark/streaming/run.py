"""Runs a stream over all input that there is and gives its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.operators.tables import shared_folder


#: Keyed state with lists and timers needs this store; its files are part of the stream's progress in the shared folder
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def closing(stream: DataFrame) -> tuple[DataFrame, str]:
    """The stream united with that of a folder, empty at first, and the folder's path.

    `finished` puts a row there once all input is read: its `ts`, later than any, lets the watermark pass all rows.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(folder)
    more = spark.readStream.schema(stream.schema).parquet(folder)
    return stream.unionByName(more), folder


def _close(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    row = spark.range(1).select(*[(F.lit("9999-01-01") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    row.write.mode("append").parquet(folder)


def finished(stream: DataFrame, name: str, mode: str = "append", close: tuple[str, DataFrame] | None = None) -> DataFrame:
    """The rows of a stream after all available input, from a table in the shared folder, where its progress is kept, too.

    In append mode every batch adds its rows once; in complete mode each batch replaces the table by the whole result.
    close: the folder of `closing` and the stream that it was united with. The stream stops after its input, and starts
    once more from its progress with the row that closes it.
    """
    spark = stream.sparkSession
    home = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{home}/progress").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", f"{home}/rows")
    else:
        w = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{home}/rows"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    w.start().awaitTermination()
    if close:
        _close(spark, close[0], close[1].schema)
        w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")
