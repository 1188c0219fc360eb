"""Account ledger over a log of position decisions, and the episode windows decisions are made in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.operators.blocks import block_window, blocked, carry_last, own_rows, time_bucket
from tidebars.operators.labels import chronological_position
from tidebars.schema import SERIES
from tidebars.session import materialize

FLAT, LONG, SHORT = 0, 1, 2
KEYS, AT = ["episode_id"], "_at"
STEPS = 4096


@dataclass(frozen=True)
class AccountConfig:
    """Fixed values of the account, with the usual settings."""

    initial_balance: float = 10_000.0
    leverage: float = 100.0
    units_per_lot: float = 100.0
    commission_per_lot: float = 7.0
    lot_size: float = 0.01
    margin_call_pct: float = 50.0
    episode_length: int | None = 2016

    def __post_init__(self) -> None:
        for name in ("initial_balance", "leverage", "units_per_lot", "lot_size"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive, got {getattr(self, name)}")
        if self.commission_per_lot < 0:
            raise ValueError("commission_per_lot cannot be negative")
        if self.episode_length is not None and self.episode_length <= 0:
            raise ValueError("episode_length must be positive")
        if not 0 < self.margin_call_pct <= 100:
            raise ValueError("margin_call_pct must be in (0, 100]")

    def margin_per_lot(self, price: Column) -> Column:
        return price * self.units_per_lot / self.leverage


def account_ledger(decisions: DataFrame, config: AccountConfig = AccountConfig()) -> DataFrame:
    """State of the account after every decision.

    An action is the position wanted (0 flat, 1 long, 2 short), so trades are the changes between
    steps, filled at the step's close. An episode ends with its last step, after ``episode_length``
    steps, or when the account is liquidated; what is open then is closed.
    """
    c = config
    size, half = c.lot_size * c.units_per_lot, c.lot_size * c.commission_per_lot / 2
    log = decisions if c.episode_length is None else decisions.filter(F.col("step") <= c.episode_length)
    log = log.withColumn(AT, F.timestamp_seconds(F.col("step").cast("long")))
    w = block_window(KEYS, AT)
    # 1. changes of position, from the one and two steps before
    moves = blocked(log, back=2, keys=KEYS, ts=AT, step=1).withColumns({
        "_a1": F.lag("action", 1, 0).over(w), "_a2": F.lag("action", 2, 0).over(w), "_c1": F.lag("close").over(w)})
    opened = (F.col("action") != FLAT) & (F.col("action") != F.col("_a1"))
    opened_before = (F.col("_a1") != FLAT) & (F.col("_a1") != F.col("_a2"))
    moves = own_rows(moves.withColumns({
        "trade_opened": opened, "_px": F.when(opened, F.col("close")), "_px1": F.when(opened_before, F.col("_c1")),
        "_st": F.when(opened, F.col("step"))}))
    # 2. entry price and step of the open position and of the one before
    held = carry_last(moves, {"_px": "_entry", "_px1": "_entry1", "_st": "_since"}, KEYS, AT, step=1)
    side, side1 = _side(F.col("action")), _side(F.col("_a1"))
    closing = (F.col("_a1") != FLAT) & (F.col("action") != F.col("_a1"))
    gross = F.when(closing, side1 * (F.col("close") - F.col("_entry1")) * size).otherwise(0.0)
    paid = half * (closing.cast("double") + F.col("trade_opened").cast("double"))
    amounts = materialize(held.withColumns({
        "trade_closed": closing, "realized_pnl": F.when(closing, gross - half).otherwise(0.0),
        "_cash": gross - paid, "_fees": paid,
        "unrealized_pnl": F.when(F.col("action") != FLAT, side * (F.col("close") - F.col("_entry")) * size).otherwise(0.0),
    }))
    # 3. running totals and the highest equity seen while a position was open
    totals = _totals(amounts, c)
    margin = F.when(F.col("action") != FLAT, F.col("close") * size / c.leverage).otherwise(0.0)
    equity = F.col("balance") + F.col("unrealized_pnl")
    state = totals.withColumns({
        "margin_used": margin, "equity": equity,
        "is_liquidated": (F.col("action") != FLAT) & (margin > 0) & (equity <= margin * (c.margin_call_pct / 100.0))})
    # 4. end of the episode
    ends = state.groupBy(*KEYS).agg(F.coalesce(F.min(F.when(F.col("is_liquidated"), F.col("step"))),
                                               F.max("step")).alias("_last"))
    live = state.join(ends, KEYS).filter(F.col("step") <= F.col("_last"))
    forced = (F.col("step") == F.col("_last")) & (F.col("action") != FLAT)
    final = F.col("unrealized_pnl") - half
    bars = (F.col("step") - F.col("_since") + 1).cast("int")

    def settled(open_value: Column, closed_value: Column) -> Column:
        return F.when(forced, closed_value).otherwise(open_value)

    balance = settled(F.col("balance"), F.col("balance") + final)
    left = settled(F.col("unrealized_pnl"), F.lit(0.0))
    notional = F.col("_entry") * size
    return live.select(
        *[x for x in decisions.columns],
        settled(F.col("action"), F.lit(FLAT)).cast("int").alias("position"), F.col("_a1").cast("int").alias("previous_position"),
        F.col("trade_opened"), (F.col("trade_closed") | forced).alias("trade_closed"),
        settled(F.col("realized_pnl"), F.col("realized_pnl") + final).alias("realized_pnl"),
        left.alias("unrealized_pnl"),
        F.when(left != 0, left / F.nullif(notional, F.lit(0.0)) * 100).otherwise(0.0).alias("unrealized_pnl_pct"),
        balance.alias("balance"), (balance + left).alias("equity"), "peak_equity",
        F.when(F.col("peak_equity") == 0, 0.0).otherwise(
            (F.col("peak_equity") - balance - left) / F.nullif(F.col("peak_equity"), F.lit(0.0)) * 100).alias("drawdown_pct"),
        settled(F.col("margin_used"), F.lit(0.0)).alias("margin_used"),
        F.when(forced | (F.col("action") == FLAT), 0).otherwise(bars).alias("bars_held"),
        (F.col("_trades") + forced.cast("long")).alias("total_trades"),
        settled(F.col("_fees_sum"), F.col("_fees_sum") + half).alias("commission_paid"),
        settled(F.col("_realized_sum"), F.col("_realized_sum") + final).alias("cumulative_realized"),
        "is_liquidated", (F.col("step") == F.col("_last")).alias("episode_end"))


def _side(action: Column) -> Column:
    return F.when(action == LONG, 1.0).when(action == SHORT, -1.0).otherwise(0.0)


def _totals(rows: DataFrame, c: AccountConfig) -> DataFrame:
    part = "_slice"
    w = Window.partitionBy(*KEYS, part).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sums = {"_cash": "_cash_sum", "_fees": "_fees_sum", "realized_pnl": "_realized_sum", "_one": "_trades"}
    cut = rows.withColumn(part, time_bucket(STEPS, KEYS, AT, 1)).withColumn("_one", F.col("trade_closed").cast("long"))
    local = cut.withColumns({out: F.sum(x).over(w) for x, out in sums.items()})
    local = local.withColumn("_peak", F.max(F.when(F.col("action") != FLAT, F.col("_cash_sum") + F.col("unrealized_pnl"))).over(w))
    ends = local.groupBy(*KEYS, part).agg(
        *[F.max_by(out, "step").alias(out) for out in sums.values()], F.max("_peak").alias("_peak"))
    before = Window.partitionBy(*KEYS).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumns({f"_b{out}": F.coalesce(F.sum(out).over(before), F.lit(0)) for out in sums.values()})
    carry = carry.withColumn("_past", F.max(F.col("_b_cash_sum") + F.col("_peak")).over(before)).select(
        *KEYS, part, "_past", *[f"_b{out}" for out in sums.values()])
    joined = local.join(carry, [*KEYS, part])
    start = F.lit(c.initial_balance)
    return joined.withColumns({
        **{out: F.col(out) + F.col(f"_b{out}") for out in sums.values()},
        "peak_equity": F.greatest(start, start + F.col("_past"), start + F.col("_b_cash_sum") + F.col("_peak")),
    }).withColumn("balance", start + F.col("_cash_sum")).drop(part, *[f"_b{out}" for out in sums.values()])


def with_position_features(rows: DataFrame, config: AccountConfig = AccountConfig(), vector: str = "observation"
                           ) -> DataFrame:
    """Position code and unrealized share of the initial balance appended to the vectors."""
    return rows.withColumn(vector, F.concat(vector, F.array(
        F.col("position").cast("double"), F.col("unrealized_pnl") / config.initial_balance)))


def episode_starts(rows: DataFrame, length: int, episodes: int, seed: int = 42) -> DataFrame:
    """(symbol, timeframe, episode_id, start): seeded random starts with room for ``length`` + 1 rows."""
    sizes = rows.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n"))
    room = F.col("_n") - length
    checked = sizes.withColumn("_room", F.when(room > 0, room).otherwise(
        F.raise_error(F.lit(f"too few rows for episodes of {length} steps")).cast("long")))
    numbered = checked.withColumn("episode_id", F.explode(F.sequence(F.lit(0), F.lit(episodes - 1))))
    draw = F.pmod(F.xxhash64(F.lit(seed), *SERIES, "episode_id"), F.col("_room"))
    return numbered.select(*SERIES, F.col("episode_id").cast("long"), draw.alias("start"))


def evaluation_starts(rows: DataFrame) -> DataFrame:
    """One episode per series that begins with its first row."""
    return rows.select(*SERIES).distinct().withColumns({"episode_id": F.lit(0).cast("long"), "start": F.lit(0).cast("long")})


def episode_rows(rows: DataFrame, starts: DataFrame, length: int | None) -> DataFrame:
    """Rows of every episode with ``step`` (0 at the start, at most ``length``).

    Positions are matched by slices of ``length``: an episode touches two of them, so this is an
    equi-join on (series, slice), not a range join.
    """
    placed = chronological_position(rows).drop("series_rows")
    at = F.col("position")
    if length is None:
        joined = placed.join(starts, list(SERIES)).filter(at >= F.col("start"))
    else:
        span = length + 1
        sliced = starts.withColumn("_s", F.explode(F.array_distinct(F.array(
            F.floor(F.col("start") / span), F.floor((F.col("start") + length) / span)))))
        joined = placed.withColumn("_s", F.floor(at / span)).join(sliced, [*SERIES, "_s"]).filter(
            (at >= F.col("start")) & (at <= F.col("start") + length)).drop("_s")
    return joined.withColumn("step", (at - F.col("start")).cast("int")).drop("start", "position")
