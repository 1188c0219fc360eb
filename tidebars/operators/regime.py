"""Market regime of every bar: trend strength, volatility, session, hidden state and persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.sessions import avoid_trading, session_bias, session_text
from tidebars.operators.automaton import run_automaton
from tidebars.operators.blocks import block_window, blocked, carry_last, own_rows
from tidebars.operators.changepoint import with_change_points
from tidebars.operators.indicators import adx
from tidebars.schema import SERIES
from tidebars.session import materialize

# fixed values
STATES = ("low_vol_trend", "high_vol_trend", "ranging")  # the order decides ties
LOW, HIGH, RANGING = STATES
MULTIPLIERS = {LOW: 1.5, HIGH: 0.5, RANGING: 1.0}
RANGE_ADX, TREND_ADX, ATR_EXPANSION = 20.0, 25.0, 1.5
PERSISTENCE_BARS, MIN_CONFIDENCE, MIN_DAILY_ROWS = 3, 0.60, 30


def intraday_regime(rows: DataFrame) -> DataFrame:
    """``intraday_state``, ``intraday_conf`` and ``atr_expanding`` from ``adx_14`` and ``atr_14``; ``explicit_state`` is
    what the row says by itself, if anything.

    Rows without an ADX and rows between the thresholds keep the state before them (ranging at first).
    """
    a, ratio = F.col("adx_14"), F.col("atr_14") / F.nullif(F.col("_prev_atr"), F.lit(0.0))
    with_previous = own_rows(blocked(rows, back=1).withColumn("_prev_atr", F.lag("atr_14").over(block_window())))
    expanding = F.coalesce((F.col("_prev_atr") > 0) & (ratio >= ATR_EXPANSION), F.lit(False))
    explicit = (
        F.when(a.isNull(), None)
        .when(F.col("atr_expanding"), HIGH)
        .when(a < RANGE_ADX, RANGING)
        .when(a > TREND_ADX, LOW))
    confidence = (
        F.when(a.isNull(), 0.5)
        .when(F.col("atr_expanding"), F.least(a / 50.0, F.lit(1.0)))
        .when(a < RANGE_ADX, F.greatest(F.lit(0.5), F.least(1.0 - a / RANGE_ADX, F.lit(1.0))))
        .when(a > TREND_ADX, F.greatest(F.lit(0.5), F.least(a / 50.0, F.lit(1.0))))
        .otherwise(0.5))
    stated = with_previous.withColumn("atr_expanding", expanding).withColumns(
        {"explicit_state": explicit, "intraday_conf": confidence})
    kept = carry_last(stated, {"explicit_state": "_kept"})
    return kept.withColumn("intraday_state", F.coalesce("_kept", F.lit(RANGING))).drop("_prev_atr", "_kept")


def combine_votes(state: Column, conf: Column, hmm_state: Column, hmm_prob: Column, changed: Column
                  ) -> tuple[Column, Column]:
    """(proposed state, confidence) from the intraday, hidden-state and change-point votes."""
    scores = {
        s: F.when(state == s, 0.6 * conf).otherwise(0.0) + F.when(hmm_state == s, 0.3 * hmm_prob).otherwise(0.0)
        + (F.when(changed, 0.1).otherwise(0.0) if s == HIGH else F.lit(0.0))
        for s in STATES
    }
    best, total = F.greatest(*scores.values()), sum(scores.values(), F.lit(0.0))
    winner = F.coalesce(*[F.when(scores[s] == best, F.lit(s)) for s in STATES])
    voted = hmm_state.isNotNull() & hmm_prob.isNotNull()
    alone = F.when(changed, conf * 0.9).otherwise(conf)
    return (
        F.when(voted, winner).otherwise(state),
        F.when(voted, F.when(total > 0, best / F.nullif(total, F.lit(0.0))).otherwise(best)).otherwise(alone),
    )


def persistence_table(bars: int) -> list[list[int]]:
    """Machine over (current state, run of differing proposals): the ``bars``-th in a row switches."""
    table = []
    for proposed in range(len(STATES)):
        row = []
        for current in range(len(STATES)):
            for run in range(bars):
                if proposed == current:
                    row.append(current * bars)
                elif run + 1 >= bars:
                    row.append(proposed * bars)
                else:
                    row.append(current * bars + run + 1)
        table.append(row)
    return table


def state_code(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), state).cast("int") - 1


def persist(rows: DataFrame, proposed: str = "proposed_state", bars: int = PERSISTENCE_BARS,
            keys: Sequence[str] = SERIES, block_rows: int = 4096) -> DataFrame:
    """``state``: the proposal once ``bars`` rows in a row differed from the state in force."""
    table = persistence_table(bars)
    coded = rows.withColumn("_code", state_code(F.col(proposed)))
    run = run_automaton(coded, "_code", table, keys, start=STATES.index(RANGING) * bars, name="_before", rows=block_rows)
    flat = F.array(*[F.lit(v) for row in table for v in row])
    after = F.element_at(flat, F.col("_code") * (len(STATES) * bars) + F.col("_before") + 1)
    names = F.array(*[F.lit(s) for s in STATES])
    return run.withColumn("state", F.element_at(names, F.floor(after / bars).cast("int") + 1)).drop("_code", "_before")


def text_number(x: Column) -> Column:
    return F.format_string("%.2f", x)


def decide(rows: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Trade gate, size multiplier and reason from ``state``, ``vote_conf``, ``recent_change`` and the time."""
    avoid, low_conf = avoid_trading("ts"), F.col("vote_conf") < min_confidence
    base = F.lit(1.0)
    for s, v in MULTIPLIERS.items():
        base = F.when(F.col("state") == s, v).otherwise(base)
    changed = F.col("recent_change")
    parts = F.array_compact(F.array(
        F.when(avoid, session_text("ts")),
        F.when(low_conf, F.concat(F.lit("Low confidence ("), text_number(F.col("vote_conf")), F.lit(" < "),
                                  F.lit(f"{min_confidence:.2f}"), F.lit(")"))),
        F.when(changed, F.lit("Recent structural break detected")),
    ))
    usual = F.concat(F.col("state"), F.lit(" regime — "), session_text("ts"))
    size = base * session_bias("ts") * F.when(changed, 0.7).otherwise(1.0)
    return rows.withColumns({
        "confidence": F.col("vote_conf") * F.when(changed, 0.8).otherwise(1.0),
        "position_multiplier": F.bround(size, 3),
        "should_trade": ~avoid & ~low_conf,
        "reason": F.when(F.size(parts) == 0, usual).otherwise(F.array_join(parts, "; ")),
        "session_bias": session_bias("ts"),
    })


def votes(rows: DataFrame, daily_states: DataFrame | None = None) -> DataFrame:
    """``rows`` (bars with ``atr_14``) with all that a regime decision is made of.

    ``daily_states`` gives (symbol, day, hmm_state, hmm_prob) in force on a day: states of the day
    before, for symbols with at least 30 daily rows (see ``previous_day_states``).
    """
    strength = adx(rows.select(*SERIES, "ts", "high", "low", "close")).select(*SERIES, "ts", "adx_14")
    base = materialize(rows.drop("adx_14").join(strength, [*SERIES, "ts"]))
    staged = materialize(with_change_points(intraday_regime(base)))
    if daily_states is None:
        staged = staged.withColumns({"hmm_state": F.lit(None).cast("string"), "hmm_prob": F.lit(None).cast("double")})
    else:
        days = daily_states.select("symbol", F.col("day").alias("_day"), "hmm_state", "hmm_prob")
        staged = staged.withColumn("_day", F.to_date("ts")).join(days, ["symbol", "_day"], "left").drop("_day")
    return staged


def classify(rows: DataFrame, daily_states: DataFrame | None = None) -> DataFrame:
    """Regime decision per row of ``rows``, all series at once; for ``daily_states`` see ``votes``."""
    staged = votes(rows, daily_states)
    proposed, confidence = combine_votes(*[F.col(c) for c in (
        "intraday_state", "intraday_conf", "hmm_state", "hmm_prob", "recent_change")])
    voted = staged.withColumns({"proposed_state": proposed, "vote_conf": confidence})
    return decide(persist(voted)).withColumn("adx_value", F.col("adx_14")).drop("explicit_state")


def previous_day_states(states: DataFrame) -> DataFrame:
    """Daily states moved to the next day they are known on, from the 30th daily bar of a series on."""
    moved = own_rows(blocked(states, fwd=1).withColumn("_next", F.lead("ts").over(block_window())))
    known = moved.filter(F.col("bar_number") >= MIN_DAILY_ROWS)
    day = F.to_date(F.coalesce("_next", F.col("ts") + F.expr("INTERVAL 1 DAY")))
    return known.select("symbol", day.alias("day"), "hmm_state", "hmm_prob")
