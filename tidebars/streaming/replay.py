"""Starting streams from files and draining them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidebars.functions.records import from_record
from tidebars.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_records(spark: SparkSession, path: str, kind: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of the ``kind`` table from JSON lines; records that lack a required field are left out."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.text(path).select(from_record(kind, "value").alias("r"))
    return rows.filter("r IS NOT NULL").select("r.*")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there into Parquet files, and return what was written."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, handler, progress: str) -> None:
    """Run a stream over everything that is there through a batch handler."""
    query = (
        stream.writeStream.foreachBatch(handler).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
