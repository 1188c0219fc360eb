from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidebars.schema import BARS  # noqa: E402
from tidebars.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def walk(n: int, symbol: str = "XAUUSD", timeframe: str = "5m", seed: int = 42, minutes: int = 5,
         start: datetime = datetime(2024, 1, 2)) -> pd.DataFrame:
    """Seeded random-walk bars."""
    rng = np.random.default_rng(seed)
    close = 2062.5 + np.cumsum(rng.uniform(-1.5, 1.5, n))
    opens = np.concatenate([[2062.5], close[:-1]])
    return pd.DataFrame({
        "symbol": symbol, "timeframe": timeframe, "ts": [start + timedelta(minutes=minutes * i) for i in range(n)],
        "open": opens, "high": np.maximum(opens, close) + rng.uniform(0.1, 1, n),
        "low": np.minimum(opens, close) - rng.uniform(0.1, 1, n), "close": close,
        "volume": rng.integers(800, 2000, n).astype(float), "is_complete": True,
    })


def frame(spark, pdf: pd.DataFrame):
    return spark.createDataFrame(pdf[BARS.fieldNames()], BARS)


def collect(df, *columns: str) -> pd.DataFrame:
    order = [c for c in ("symbol", "timeframe", "ts") if c in df.columns]
    return df.select(*order, *columns).toPandas().sort_values(order).reset_index(drop=True)


def same(left, right, tolerance: float = 1e-9) -> None:
    left, right = np.asarray(left, float), np.asarray(right, float)
    assert left.shape == right.shape
    assert (np.isnan(left) == np.isnan(right)).all(), np.flatnonzero(np.isnan(left) != np.isnan(right))[:10]
    np.testing.assert_allclose(left, right, rtol=tolerance, atol=tolerance)
