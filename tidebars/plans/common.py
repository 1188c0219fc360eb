"""Small helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (adding 0.0 turns a negative zero into zero)."""
    return df.select(*[
        (F.round(F.col(name), digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes
    ])
