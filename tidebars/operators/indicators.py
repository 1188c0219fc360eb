"""Technical indicators as column programs over blocks.

Each program is a list of stages; a stage's columns depend only on earlier stages. ``run_stages``
merges programs stage by stage, so a table with every indicator costs one shuffle and one sort.
Scratch columns start with ``_t_`` and disappear at the end. Values are null during warm-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.operators.blocks import (
    BLOCK, HALO, OWN, ROW, ROWS, block_window, blocked, carry_last, decay_plan, decay_scan, hand_on, own_rows, run_stages,
    settling_rows,
)
from tidebars.schema import SERIES
from tidebars.session import materialize

Stages = list[dict[str, Column]]
Plan = tuple[int, int]  # look-back and rows of a block
USUAL: Plan = (HALO, ROWS)


def wilder(period: int) -> float:
    """Factor of Wilder's average."""
    return (period - 1) / period


def _running(column: str) -> Column:
    return F.sum(column).over(block_window().rowsBetween(Window.unboundedPreceding, 0))


def _tail(rows: int):
    return block_window().rowsBetween(-(rows - 1), 0)


def _seeded_scan(x: str, running: str, seed_row: int, seed_n: int, q: float, gain: float, plan: Plan = USUAL) -> Column:
    """Smoothing that starts at ``seed_row`` with a mean over ``seed_n`` and then follows ``q``."""
    rn = F.col(ROW)
    term = (
        F.when(rn == seed_row, F.col(running) / seed_n)
        .when(rn > seed_row, F.col(x) * gain)
        .otherwise(0.0)
    )
    return F.when(rn >= seed_row, decay_scan(term, q, back=plan[0], rows=plan[1]))


def rsi_stages(period: int = 14, name: str = "rsi_14", close: str = "close", plan: Plan = USUAL) -> Stages:
    """Wilder's RSI. Rows whose value rests on moves before the block are left null; see ``settle``."""
    t, w, rn = f"_t_{name}", block_window(), F.col(ROW)
    first, q = period + 1, wilder(period)
    change = F.col(close) - F.lag(close).over(w)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    known = (F.col(BLOCK) == 0) | (F.col(f"{t}_seen") >= settling_rows(q))
    up, down = F.col(f"{t}_up"), F.col(f"{t}_down")
    return [
        {f"{t}_ch": change, f"{t}_pos": F.row_number().over(w)},
        {f"{t}_g": F.greatest(F.col(f"{t}_ch"), F.lit(0.0)),
         f"{t}_l": F.greatest(-F.col(f"{t}_ch"), F.lit(0.0)),
         f"{t}_seen": F.last(F.when(F.col(f"{t}_ch") != 0, F.col(f"{t}_pos")), ignorenulls=True).over(upto)},
        {f"{t}_gs": _running(f"{t}_g"), f"{t}_ls": _running(f"{t}_l")},
        {f"{t}_up": _seeded_scan(f"{t}_g", f"{t}_gs", first, period, q, 1 / period, plan),
         f"{t}_down": _seeded_scan(f"{t}_l", f"{t}_ls", first, period, q, 1 / period, plan)},
        {name: F.when((rn >= first) & known,
                      F.when(down == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + up / F.nullif(down, F.lit(0.0)))))},
    ]


def settle(df: DataFrame, names: list[str]) -> DataFrame:
    """Fill values that a long run without any price move left open.

    Without moves both averages of the RSI shrink alike, so it keeps the value of the last move. That
    row may lie any number of blocks back, hence one value per block is handed on.
    """
    own = df.filter(F.col(OWN))
    fixed = {n: f"_t_{n}_fixed" for n in names}
    w = block_window().rowsBetween(Window.unboundedPreceding, 0)
    local = own.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names})
    out = hand_on(local, fixed, SERIES, BLOCK, ROW)
    return out.withColumns({n: F.col(f) for n, f in fixed.items()}).drop(*fixed.values())


def ema_stages(name: str, x: str, period: int, first: int = 1, plan: Plan = USUAL) -> Stages:
    """Exponential average of ``x`` seeded with the mean of its first ``period`` values (from row ``first``)."""
    t, k = f"_t_{name}", 2 / (period + 1)
    return [
        {f"{t}_s": _running(x)},
        {name: _seeded_scan(x, f"{t}_s", first + period - 1, period, 1 - k, k, plan)},
    ]


def macd_stages(fast: int = 12, slow: int = 26, signal: int = 9, plan: Plan = USUAL) -> Stages:
    a, b = ema_stages("_t_fast", "close", fast, plan=plan), ema_stages("_t_slow", "close", slow, plan=plan)
    return [
        {**a[0], **b[0]},
        {**a[1], **b[1]},
        {"macd_line": F.col("_t_fast") - F.col("_t_slow")},
        *ema_stages("macd_signal", "macd_line", signal, first=slow, plan=plan),
        {"macd_histogram": F.col("macd_line") - F.col("macd_signal")},
    ]


def bollinger_stages(period: int = 20, width: float = 2.0) -> Stages:
    full = F.col(ROW) >= period
    up, mid, low = F.col("bb_upper"), F.col("bb_middle"), F.col("bb_lower")
    return [
        {"bb_middle": F.when(full, F.avg("close").over(_tail(period))),
         "_t_bb_sd": F.when(full, F.stddev_pop("close").over(_tail(period)))},
        {"bb_upper": mid + width * F.col("_t_bb_sd"), "bb_lower": mid - width * F.col("_t_bb_sd")},
        {"bb_width": F.when(mid == 0, 0.0).otherwise((up - low) / F.nullif(mid, F.lit(0.0))),
         "bb_percent_b": F.when(full, F.when(up == low, 0.5).otherwise(
             (F.col("close") - low) / F.nullif(up - low, F.lit(0.0))))},
    ]


def true_range(prev_close: Column) -> Column:
    h, l = F.col("high"), F.col("low")
    return F.greatest(h - l, F.abs(h - prev_close), F.abs(l - prev_close))


def atr_stages(period: int = 14, name: str = "atr_14", plan: Plan = USUAL) -> Stages:
    w = block_window()
    return [
        {"_t_tr": F.when(F.col(ROW) == 1, F.col("high") - F.col("low")).otherwise(true_range(F.lag("close").over(w)))},
        {"_t_trs": _running("_t_tr")},
        {name: _seeded_scan("_t_tr", "_t_trs", period, period, wilder(period), 1 / period, plan)},
    ]


def rolling_mean_atr_stages(period: int = 14, name: str = "atr_mean") -> Stages:
    """Plain mean of the last true ranges, the stand-in where no smoothed ATR is at hand."""
    first = atr_stages()[0]["_t_tr"]
    return [
        {"_t_mtr": first},
        {name: F.when(F.col(ROW) >= period, F.avg("_t_mtr").over(_tail(period)))},
    ]


def return_stages() -> Stages:
    w, c = block_window(), F.col("close")

    def log_return(k: int) -> Column:
        old = F.lag("close", k).over(w)
        return F.when((c > 0) & (old > 0), F.ln(c / F.nullif(old, F.lit(0.0))))

    return [{f"return_{k}bar": log_return(k) for k in (1, 5, 12)}]


def momentum_stages(bars: int = 48) -> Stages:
    old = F.lag("close", bars).over(block_window())
    return [{f"momentum_{bars}": F.when(old > 0, (F.col("close") - old) / F.nullif(old, F.lit(0.0)))}]


def volatility_stages(window: int = 20) -> Stages:
    """Volatility where every return from row 2 on is known to exist (all prices above zero)."""
    name = f"rolling_volatility_{window}"
    return [{}, {name: F.when(F.col(ROW) > window, F.stddev_pop("return_1bar").over(_tail(window)))}]


def with_indicator(df: DataFrame, *stages: Stages, back: int = HALO, settled: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    out = run_stages(blocked(df, back=back, rows=rows), *stages)
    if settled:
        out = settle(out, settled)
    return own_rows(out)


def rsi(df: DataFrame, period: int = 14, name: str = "rsi_14") -> DataFrame:
    """RSI of any period; blocks are cut as the period asks for."""
    plan = decay_plan(wilder(period), spare=period + 2)
    return with_indicator(df, rsi_stages(period, name, plan=plan), settled=[name], back=plan[0], rows=plan[1])


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    plan = decay_plan(*[1 - 2 / (n + 1) for n in (fast, slow, signal)])
    return with_indicator(df, macd_stages(fast, slow, signal, plan), back=plan[0], rows=plan[1])


def bollinger(df: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    return with_indicator(df, bollinger_stages(period, width), back=period, rows=max(ROWS, 2 * period))


def atr(df: DataFrame, period: int = 14, name: str = "atr_14") -> DataFrame:
    plan = decay_plan(wilder(period), spare=2)
    return with_indicator(df, atr_stages(period, name, plan), back=plan[0], rows=plan[1])


def rolling_mean_atr(df: DataFrame) -> DataFrame:
    return with_indicator(df, rolling_mean_atr_stages(), back=15)


def log_returns(df: DataFrame) -> DataFrame:
    return with_indicator(df, return_stages(), back=12)


def momentum(df: DataFrame) -> DataFrame:
    return with_indicator(df, momentum_stages(), back=48)


def rolling_volatility(df: DataFrame, window: int = 20) -> DataFrame:
    """Population deviation of the last ``window`` returns that exist.

    Returns from or to a price at or below zero do not exist; such rows neither count nor hide the
    value of the rows before. So the returns that exist form a series of their own.
    """
    name = f"rolling_volatility_{window}"
    step = [{"return_1bar": return_stages()[0]["return_1bar"]}]
    returns = materialize(own_rows(run_stages(blocked(df, back=1), step)))  # used three times below
    real = returns.filter(F.col("return_1bar").isNotNull()).select(*SERIES, "ts", "return_1bar")
    spread = own_rows(blocked(real, back=window).withColumn(
        "_vol", F.when(F.col(ROW) >= window, F.stddev_pop("return_1bar").over(_tail(window)))
    )).select(*SERIES, "ts", "_vol")
    joined = returns.join(spread, [*SERIES, "ts"], "left")
    return carry_last(joined, {"_vol": name}).drop("_vol")


def _directional(df: DataFrame, period: int) -> DataFrame:
    """Directional index per bar (null before row ``period`` + 1 and while nothing has moved yet)."""
    w, rn = block_window(), F.col(ROW)
    q, gain = wilder(period), 1 / period
    plan = decay_plan(q, spare=period + 2)
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def smooth(x: str) -> Column:
        return _seeded_scan(x, f"{x}s", period, period, q, gain, plan)

    tr = F.col("_t_a_tr")
    plus, minus, total = F.col("_t_a_p"), F.col("_t_a_m"), F.col("_t_a_t")
    known = (F.col(BLOCK) == 0) | (F.col("_t_a_seen") >= settling_rows(q))
    di_p, di_m = 100.0 * plus / F.nullif(total, F.lit(0.0)), 100.0 * minus / F.nullif(total, F.lit(0.0))
    stages: Stages = [
        {"_t_a_up": up, "_t_a_dn": down, "_t_a_pos": F.row_number().over(w),
         "_t_a_tr": F.when(rn > 1, true_range(F.lag("close").over(w)))},
        {"_t_a_pd": F.when((F.col("_t_a_up") > F.col("_t_a_dn")) & (F.col("_t_a_up") > 0), F.col("_t_a_up"))
         .otherwise(0.0),
         "_t_a_md": F.when((F.col("_t_a_dn") > F.col("_t_a_up")) & (F.col("_t_a_dn") > 0), F.col("_t_a_dn"))
         .otherwise(0.0),
         "_t_a_seen": F.last(F.when(tr != 0, F.col("_t_a_pos")), ignorenulls=True).over(upto)},
        {f"{x}s": _running(x) for x in ("_t_a_pd", "_t_a_md", "_t_a_tr")},
        {"_t_a_p": smooth("_t_a_pd"), "_t_a_m": smooth("_t_a_md"), "_t_a_t": smooth("_t_a_tr")},
        {"_t_a_dip": di_p, "_t_a_dim": di_m},
        {"dx": F.when((rn > period) & known & (total != 0), F.coalesce(
            100.0 * F.abs(F.col("_t_a_dip") - F.col("_t_a_dim"))
            / F.nullif(F.col("_t_a_dip") + F.col("_t_a_dim"), F.lit(0.0)), F.lit(0.0)))},
    ]
    return own_rows(settle(run_stages(blocked(df, back=plan[0], rows=plan[1]), stages), ["dx"]))


def adx(df: DataFrame, period: int = 14, name: str = "adx_14") -> DataFrame:
    """Average directional index: Wilder smoothing of DX over the rows that have a DX."""
    dx = materialize(_directional(df, period))  # used three times below
    q, gain = wilder(period), 1 / period
    plan = decay_plan(q, spare=2)
    rows = blocked(dx.filter(F.col("dx").isNotNull()), back=plan[0], rows=plan[1])
    stages: Stages = [
        {"_t_dxs": _running("dx")},
        {name: _seeded_scan("dx", "_t_dxs", period, period, q, gain, plan)},
    ]
    averaged = own_rows(run_stages(rows, stages))
    early = dx.filter(F.col("dx").isNull()).withColumn(name, F.lit(None).cast("double"))
    return averaged.unionByName(early).drop("dx")
