"""Topics: publishing rows as records and handing records to subscribers."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.records import to_record, topic
from tidebars.sources.tables import newest_per_key

log = logging.getLogger(__name__)

Handler = Callable[[DataFrame, int], None]


def as_records(rows: DataFrame, kind: str) -> DataFrame:
    """(topic, value, event_time) of table rows."""
    return rows.select(topic(kind).alias("topic"), to_record(kind).alias("value"), F.col("ts").alias("event_time"))


def matching(records: DataFrame, prefix: str) -> DataFrame:
    return records.filter(F.col("topic").startswith(prefix))


def fan_out(subscriptions: Mapping[str, Sequence[Handler]]) -> Handler:
    """A batch handler that gives each subscriber the records of its prefix.

    A handler that fails is logged; the others still run and the stream goes on.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for prefix, handlers in subscriptions.items():
                for handler in handlers:
                    try:
                        handler(matching(batch, prefix), number)
                    except Exception:
                        log.exception("subscriber of %r failed on batch %d", prefix, number)
        finally:
            batch.unpersist()

    return handle


def append_to(path: str) -> Handler:
    """A handler that stores records below ``path``; each batch has its own folder, so a retry replaces it."""

    def handle(records: DataFrame, number: int) -> None:
        records.write.mode("overwrite").json(f"{path}/batch={number:09d}")

    return handle


def upsert_latest(path: str, keys: Sequence[str] = ("symbol", "timeframe")) -> Handler:
    """A handler that keeps the newest row of every series in a table partitioned by series."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = newest_per_key(batch, "ts", keys).withColumn("updated_at", F.current_timestamp())
        try:
            old = spark.read.schema(new.schema).parquet(path)
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
        else:
            touched = new.select(*keys)
            new = newest_per_key(old.join(touched, list(keys), "left_semi").unionByName(new), "ts", keys)
        new.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *keys).parquet(path)

    return handle
