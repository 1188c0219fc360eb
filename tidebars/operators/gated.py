"""Replaying signals behind a regime that is asked, and moves on, only while no position is open.

What is asked at a bar then depends on the trades before it, and whether it lets a signal through on the regime, so
dead zone, persistence and holding are one machine: its states are their products, a bar's code holds what each of
them would do. It composes over blocks like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.sessions import avoid_trading
from tidebars.operators.automaton import run_automaton
from tidebars.operators.regime import MIN_CONFIDENCE, PERSISTENCE_BARS, RANGING, STATES, combine_votes, persistence_table, state_code
from tidebars.operators.trades import priced_ahead, trade_rows
from tidebars.schema import SERIES

_N = len(STATES)
VOTES = ["explicit_state", "intraday_conf", "hmm_state", "hmm_prob", "recent_change"]


def gated_table(horizon: int, bars: int) -> np.ndarray:
    """transitions[code][state]. A state is ((dead zone * 3 bars) + persistence) * (horizon + 1) + bars left to hold.

    Code 0 is a bar that may not be looked at. Others are 1 + (((explicit * 27 + proposals) * 8 + gates) * 2 + signal):
    the explicit state (3 for none), and for each dead-zone state what would be proposed and whether it may trade.
    """
    persistence = np.array(persistence_table(bars))
    zone, kept, left = (a.ravel() for a in np.meshgrid(np.arange(_N), np.arange(_N * bars), np.arange(horizon + 1), indexing="ij"))
    code = np.arange(4 * _N ** _N * 2 ** _N * 2)[:, None]
    signal, rest = code % 2, code // 2
    gates, rest = rest % 2 ** _N, rest // 2 ** _N
    proposals, explicit = rest % _N ** _N, rest // _N ** _N
    idle = np.maximum(left - 1, 0)
    flat = idle == 0
    now = np.where(explicit < _N, explicit, zone)
    proposed = proposals // _N ** (_N - 1 - now) % _N
    may = gates // 2 ** (_N - 1 - now) % 2 == 1
    opened = flat & may & (signal == 1)
    table = (np.where(flat, now, zone) * _N * bars + np.where(flat, persistence[proposed, kept], kept)) * (horizon + 1) + np.where(opened, horizon, idle)
    waiting = (zone * _N * bars + kept) * (horizon + 1) + idle
    return np.concatenate([waiting[None], table]).astype(np.int16)


def _digits(values: Sequence[Column], base: int) -> Column:
    total = F.lit(0)
    for v in values:
        total = total * base + v
    return total


def replay_while_flat(
    rows: DataFrame,
    horizon: int,
    spread: float = 0.0,
    eligible: Column | None = None,
    min_confidence: float = MIN_CONFIDENCE,
    bars: int = PERSISTENCE_BARS,
    keys: Sequence[str] = SERIES,
    block_rows: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """(trades, checked bars) of bars with a ``direction`` and votes (``explicit_state``, ``intraday_conf``,
    ``hmm_state``, ``hmm_prob``, ``recent_change``).

    At an eligible bar without an open position the regime takes in the bar's votes; where it may trade, the bar is
    checked, and a long or short signal enters as in ``replay``. Trades and checked bars carry the state then in force.
    At all other bars the regime keeps what it knew, its run of differing proposals included. Null votes are none; a
    null direction is no signal; an ineligible bar is not looked at.
    """
    keys = list(keys)
    if horizon < 1 or _N * _N * bars * (horizon + 1) > np.iinfo(np.int16).max:
        raise ValueError("the machine takes horizons from 1 on of which states fit into 16 bits")
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    changed = F.coalesce("recent_change", F.lit(False))
    proposals, gates = [], []
    for state in STATES:
        proposed, confidence = combine_votes(F.lit(state), F.col("intraday_conf"), F.col("hmm_state"), F.col("hmm_prob"), changed)
        proposals.append(state_code(proposed))
        gates.append((~avoid_trading("ts") & (confidence >= min_confidence)).cast("int"))
    signal = F.coalesce((F.col("direction").isin("long", "short") & (F.col("_entry") > 0)).cast("int"), F.lit(0))
    explicit = F.coalesce(state_code(F.col("explicit_state")), F.lit(_N))
    code = F.when(ok, 1 + ((explicit * _N ** _N + _digits(proposals, _N)) * 2 ** _N + _digits(gates, 2)) * 2 + signal).otherwise(0)
    priced = priced_ahead(rows, horizon, keys, block_rows).withColumns({"_signal": signal, "_code": code})
    table = gated_table(horizon, bars)
    start = (STATES.index(RANGING) * _N * bars + STATES.index(RANGING) * bars) * (horizon + 1)
    run = run_automaton(priced, "_code", table, keys, start=start, name="_before", rows=block_rows)
    # the machine's own step, for the bar at hand
    before, size = F.col("_before"), horizon + 1
    flat = (F.col("_code") > 0) & (F.greatest(before % size - 1, F.lit(0)) == 0)
    zone, kept = F.floor(before / (size * _N * bars)).cast("int"), F.floor(before / size).cast("int") % (_N * bars)
    body = F.col("_code") - 1
    said = F.floor(body / (2 * 2 ** _N * _N ** _N)).cast("int")
    now = F.when(said < _N, said).otherwise(zone)
    place = F.array(*[F.lit(_N ** (_N - 1 - i)) for i in range(_N)])
    bit = F.array(*[F.lit(2 ** (_N - 1 - i)) for i in range(_N)])
    proposed = F.floor(F.floor(body / (2 * 2 ** _N)) % _N ** _N / F.element_at(place, now + 1)).cast("int") % _N
    may = F.floor(F.floor(body / 2) % 2 ** _N / F.element_at(bit, now + 1)).cast("int") % 2 == 1
    steps = F.array(*[F.lit(v) for row in persistence_table(bars) for v in row])
    state = F.floor(F.element_at(steps, proposed * (_N * bars) + kept + 1) / bars).cast("int")
    seen = run.filter(flat).withColumns({"_may": may, "regime_state": F.element_at(F.array(*[F.lit(s) for s in STATES]), state + 1)})
    checked = seen.filter("_may")
    trades = trade_rows(checked.filter("_signal = 1"), horizon, spread, "direction", "regime_state", keys)
    return trades, checked.select(*keys, "ts", "regime_state")
