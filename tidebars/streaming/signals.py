"""Live signals: features in, regime decisions and trade signals out."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.records import from_record, to_record
from tidebars.schema import SIGNALS
from tidebars.sources.tables import add_missing
from tidebars.streaming.features import proxy_bars, regime_stream
from tidebars.streaming.publish import Handler, as_records

log = logging.getLogger(__name__)

Scorer = Callable[[DataFrame], DataFrame]  # feature rows -> the same with direction, confidence, ...


def decisions(features: DataFrame, hidden_states: DataFrame | None = None) -> DataFrame:
    """Regime decisions for the warm rows of a feature stream; the features travel along as a record.

    ``hidden_states`` (symbol, hmm_state, hmm_prob) is the static table of current daily states.
    """
    warm = features.filter("warmup_complete")
    rows = proxy_bars(warm.withColumn("features", to_record("features")))
    if hidden_states is not None:
        rows = rows.join(hidden_states, "symbol", "left")
    return regime_stream(rows, keep=["features"])


def signal_handler(score: Scorer, publish: Handler) -> Handler:
    """Per batch: publish all decisions, then score the rows that may trade and publish their signals.

    A batch that fails to score is logged, and the stream goes on with the next.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            records = as_records(batch, "regime")
            open_rows = batch.filter("should_trade").select(from_record("features", "features").alias("f")).select("f.*")
            try:
                signals = score(open_rows).filter(F.col("direction") != "neutral")
                records = records.unionByName(as_records(
                    add_missing(signals, SIGNALS).withColumn("warmup_complete", F.lit(True)), "signal"))
                publish(records, number)
            except Exception:
                log.exception("batch %d could not be scored", number)
                publish(as_records(batch, "regime"), number)
        finally:
            batch.unpersist()

    return handle
