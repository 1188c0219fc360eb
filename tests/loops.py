"""Row-by-row versions of the series operators, for comparison."""

from __future__ import annotations

import numpy as np


def smoothed(values, n, gain, start=0):
    """Mean of the first n values from ``start``, then moved by ``gain``; nan before."""
    out = np.full(len(values), np.nan)
    for i in range(start + n - 1, len(values)):
        out[i] = np.mean(values[start: start + n]) if i == start + n - 1 else out[i - 1] + gain * (values[i] - out[i - 1])
    return out


def rsi(close, n=14):
    change = np.diff(close, prepend=np.nan)
    up = smoothed(np.maximum(change, 0), n, 1 / n, 1)
    down = smoothed(np.maximum(-change, 0), n, 1 / n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))


def macd(close):
    line = smoothed(close, 12, 2 / 13) - smoothed(close, 26, 2 / 27)
    return line, smoothed(line, 9, 0.2, 25)


def true_ranges(high, low, close):
    prev = np.concatenate([[np.nan], close[:-1]])
    spread = np.fmax(np.fmax(np.abs(high - prev), np.abs(low - prev)), high - low)
    spread[0] = high[0] - low[0]
    return spread


def atr(high, low, close):
    return smoothed(true_ranges(high, low, close), 14, 1 / 14)


def adx(high, low, close, n=14):
    rise, fall = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus = np.where((rise > fall) & (rise > 0), rise, 0.0)
    minus = np.where((fall > rise) & (fall > 0), fall, 0.0)
    tr = true_ranges(high, low, close)
    plus[0] = minus[0] = tr[0] = 0.0
    p, m, t = (smoothed(x, n, 1 / n) for x in (plus, minus, tr))
    out, dx, value = np.full(len(close), np.nan), [], None
    for i in range(n, len(close)):
        if t[i] == 0:
            continue
        total = p[i] + m[i]
        dx.append(0.0 if total == 0 else 100 * abs(p[i] - m[i]) / total)
        if len(dx) == n:
            value = float(np.mean(dx))
        elif len(dx) > n:
            value += (dx[-1] - value) / n
        if value is not None:
            out[i] = value
    return out


def volatility(close, n=20):
    seen, out = [], np.full(len(close), np.nan)
    for i in range(1, len(close)):
        if close[i] > 0 and close[i - 1] > 0:
            seen.append(np.log(close[i] / close[i - 1]))
        if len(seen) >= n:
            out[i] = np.std(seen[-n:])
    return out


def persisted(proposals, bars=3):
    state, run, out = "ranging", 0, []
    for p in proposals:
        run = run + 1 if p != state else 0
        if run >= bars:
            state, run = p, 0
        out.append(state)
    return out


def chosen_trades(candidates, horizon):
    left, out = 0, []
    for i, candidate in enumerate(candidates):
        left = max(left - 1, 0)
        if left == 0 and candidate and i + 1 < len(candidates):
            out.append(i)
            left = horizon
    return out


def online_scores(values, minutes, alpha=0.97, n=20):
    mean = var = 0.0
    out = []
    for i, x in enumerate(values):
        if i < n:
            delta = x - mean
            mean += delta / (i + 1)
            var += (delta * (x - mean) - var) / (i + 1)
        else:
            a = alpha / 2 if minutes[i] - minutes[i - 1] > 180 else alpha
            sd = np.sqrt(max(var, 0))
            y = min(max(x, mean - 5 * sd), mean + 5 * sd) if sd > 1e-10 else x
            mean = a * mean + (1 - a) * y
            var = a * var + (1 - a) * (y - mean) ** 2
        sd = np.sqrt(max(var, 0))
        out.append(x if i + 1 < n else 0.0 if sd < 1e-10 else (x - mean) / sd)
    return np.asarray(out)
