"""Session helpers: the settings every job of this package relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", app: str = "tidebars", **conf: str) -> SparkSession:
    """A session for tests and local runs; on a cluster use the one you are given."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        **RUNTIME_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session we did not build ready: UTC, and this package where Python tasks run."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application."""
    ctx = spark.sparkContext
    if ctx.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "tidebars.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    ctx.addPyFile(str(archive))
    _SHIPPED.add(ctx.applicationId)


_SHIPPED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh one only where none is set (tests)."""
    ctx = spark.sparkContext
    current = ctx.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not ctx.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    ctx.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    For results that a job uses several times: what follows scans only the columns it needs, has sizes
    to plan with, and after a lost executor reads the files instead of computing everything again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over all shuffle partitions, for steps that cost time and not bytes.

    Adaptive execution merges partitions by size, which would leave small but slow inputs (model fits,
    segmentations) to one task; it does not merge partitions whose number was asked for.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
