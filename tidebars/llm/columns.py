"""Column expressions and helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.session import checkpoint_dir, materialize, prepare

__all__ = ["ascii_lower", "discard", "drop_ids", "materialize", "new_folder", "prepare", "set_for", "table", "text_or_empty"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared checkpoint folder; nothing is created yet."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    files = written.inputFiles()
    if files:
        jvm, spark = written.sparkSession._jvm, written.sparkSession
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def set_for(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold for the queries that are run within."""
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character, accented ones too, stays."""
    return F.translate(text, UPPER, LOWER)


def drop_ids(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``; all columns stay, rows without a key stay."""
    name = f"_gone_{uuid.uuid4().hex[:8]}"
    return docs.join(gone.select(F.col(key).alias(name)).distinct(), F.col(name) == docs[key], "left_anti")
