"""As-of join: the newest earlier row of another table, without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.blocks import carry_last


def asof_pointer(
    left: DataFrame, right: DataFrame, keys: Sequence[str], step: int,
    left_ts: str = "ts", right_ts: str = "ts", available: Column | None = None, name: str = "asof_ts",
) -> DataFrame:
    """``left`` plus the time of the newest ``right`` row with ``available`` (default its time) <= left time.

    Both sides go into one stream ordered by time and the last right time is carried forward: linear
    in both inputs, and cut into time slices like every other series.
    """
    keys = list(keys)
    available = F.col(right_ts) if available is None else available
    rows = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(None).cast("timestamp").alias("_p"),
                       F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    marks = right.select(*keys, available.alias("_t"), F.col(right_ts).alias("_p"), F.lit(0).alias("_side"))
    stream = rows.unionByName(marks, allowMissingColumns=True).withColumn(
        "_order", F.unix_micros("_t") * 2 + F.col("_side"))
    pointed = carry_last(stream, {"_p": name}, keys, "_t", step, order="_order")
    return pointed.filter(F.col("_side") == 1).select("_row.*", name)


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], step: int,
    left_ts: str = "ts", right_ts: str = "ts", available: Column | None = None, how: str = "left",
) -> DataFrame:
    """Columns of the as-of row of ``right`` next to each row of ``left``; its time is ``asof_ts``.

    Only the time travels through the carry; the wide columns come by an equi-join on it.
    """
    keys = list(keys)
    pointed = asof_pointer(left, right, keys, step, left_ts, right_ts, available)
    other = right.withColumnRenamed(right_ts, "asof_ts")
    return pointed.join(other, [*keys, "asof_ts"], how)
