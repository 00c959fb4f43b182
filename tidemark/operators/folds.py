"""Recurrences that no window frame can state, as Arrow grouped functions over one key's ordered rows.

A group is one series (or one series under one configuration); it is sorted once, scanned once, and only its
numeric columns are touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(df: DataFrame, keys: list[str], order: str, fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], inputs: list[str], outputs: dict[str, str]) -> DataFrame:
    """df with the columns outputs (name: Spark type) that fn makes from a group's ordered input columns.

    Numbers come as float64 with NaN for null, and NaN in the results becomes null.
    """
    schema = T.StructType(list(df.schema.fields))
    for name, kind in outputs.items():
        schema = schema.add(name, kind)
    names = df.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(order, "ascending")])
        made = fn({c: _numbers(group.column(c)) for c in inputs})
        for name in outputs:
            values = made[name]
            group = group.append_column(name, pa.array(values, from_pandas=True) if isinstance(values, np.ndarray) else pa.array(values))
        return group.select([*names, *outputs])

    return df.groupBy(*keys).applyInArrow(run, schema)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) if pa.types.is_integer(column.type) or pa.types.is_floating(column.type) else np.array(column.to_pylist(), dtype=object)


def ewm_values(x: np.ndarray, alpha: float, min_count: int = 0) -> np.ndarray:
    """Exponentially weighted mean, recursive form: starts at the first value; at a gap the last mean is
    repeated while its weight decays; null until min_count values have been seen."""
    out = np.full(len(x), np.nan)
    mean, old, seen = math.nan, 1.0, 0
    for i, v in enumerate(x.tolist()):
        if v == v:
            seen += 1
            if mean != mean:
                mean = v
            else:
                old *= 1 - alpha
                mean = (old * mean + alpha * v) / (old + alpha)
            old = 1.0
        elif mean == mean:
            old *= 1 - alpha
        if seen >= max(1, min_count):
            out[i] = mean
    return out


def ewm(df: DataFrame, columns: dict[str, tuple[str, dict]], key: str | list[str] = "symbol", order: str = "ts") -> DataFrame:
    """df with EWM columns: out -> (input, span= or alpha=, min_count=)."""
    specs = {out: (x, how.get("alpha") or 2 / (how["span"] + 1), how.get("min_count", 0)) for out, (x, how) in columns.items()}
    inputs = sorted({x for x, _, _ in specs.values()})
    return scan(df, [key] if isinstance(key, str) else key, order, lambda c: {out: ewm_values(c[x], a, m) for out, (x, a, m) in specs.items()}, inputs, dict.fromkeys(specs, "double"))


def last_ewm(key: str, order: str, x: str, span: float):
    """Aggregate expression: the last value of a null-free series' EWM."""
    alpha = 2 / (span + 1)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, x))), lambda r: r[x])
    return F.aggregate(F.slice(ordered, F.lit(2), F.size(ordered)), F.get(ordered, F.lit(0)), lambda a, e: a + alpha * (e - a))


def band_positions(z: np.ndarray, entry: float, exit_: float) -> np.ndarray:
    """Three-state rule: enter against the band, leave when z has come back to the exit level; the bar of an
    exit cannot enter again; a missing z keeps the state."""
    out = np.zeros(len(z))
    state = 0.0
    for i, v in enumerate(z.tolist()):
        if math.isfinite(v):
            if state == 0:
                state = -1.0 if v >= entry else 1.0 if v <= -entry else 0.0
            elif (state > 0 and v >= -exit_) or (state < 0 and v <= exit_):
                state = 0.0
        out[i] = state
    return out


def positions(df: DataFrame, z: str, entry: str | float, exit_: float, keys: list[str], order: str, out: str = "position") -> DataFrame:
    """entry is a number, or the name of a column that is constant within a group."""
    if isinstance(entry, str):
        return scan(df, keys, order, lambda c: {out: band_positions(c[z], float(c[entry][0]), exit_)}, [z, entry], {out: "double"})
    return scan(df, keys, order, lambda c: {out: band_positions(c[z], entry, exit_)}, [z], {out: "double"})


#: Default exit parameters.
EXIT = {"tp": 0.02, "sl": 0.01, "atr_tp": 2.0, "atr_sl": 1.0, "bars": 24, "trail": 0.10}


def exit_scan(mode: str, target: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, p: dict[str, float]) -> dict[str, np.ndarray]:
    """Positions under one exit mode. A bar enters, flips or tests its exits, in that order and only one of them;
    a stop is tested before a profit target; the extreme follows the bar before the trailing stop is tested."""
    n = len(target)
    pos, price, held, why = np.zeros(n), np.full(n, np.nan), np.zeros(n), [""] * n
    state, entry, hold, best = 0.0, math.nan, 0, math.nan
    for i in range(n):
        want = target[i] if target[i] == target[i] else 0.0
        turn = state != 0 and want != 0 and (want > 0) != (state > 0)
        if want != 0 and (state == 0 or turn):
            why[i] = "flip" if turn else "enter"
            state, entry, hold, best = want, close[i], 0, close[i]
        elif state != 0:
            hold += 1
            side = 1.0 if state > 0 else -1.0
            against, along = (low[i], high[i]) if side > 0 else (high[i], low[i])
            best = side * max(side * best, side * along)
            stop = gain = math.nan
            if mode == "fixed":
                stop, gain = entry * (1 - side * p["sl"]), entry * (1 + side * p["tp"])
            elif mode == "atr" and atr[i] > 0:
                stop, gain = entry - side * p["atr_sl"] * atr[i], entry + side * p["atr_tp"] * atr[i]
            elif mode == "trailing":
                stop = best * (1 - side * p["trail"])
            reason = ""
            if side * against <= side * stop:
                reason = "trailing_stop" if mode == "trailing" else "stop_loss"
            elif side * along >= side * gain:
                reason = "take_profit"
            elif mode == "time" and hold >= p["bars"]:
                reason = "time_stop"
            elif want == 0:
                reason = "signal_flat"
            if reason:
                why[i] = reason
                state, entry, hold, best = 0.0, math.nan, 0, math.nan
        pos[i], price[i], held[i] = state, entry, hold
    return {"position": pos, "entry_price": price, "hold_bars": held.astype(np.int64), "exit_reason": why}


def exit_rules(df: DataFrame, keys: list[str], order: str = "ts", mode: str = "mode", **params: float) -> DataFrame:
    """df (target, high, low, close, atr, mode) with position, entry_price, hold_bars, exit_reason; groups hold one mode."""
    p = EXIT | params
    return scan(df, keys, order, lambda c: exit_scan(c[mode][0], c["target"], c["high"], c["low"], c["close"], c["atr"], p), ["target", "high", "low", "close", "atr", mode],
                {"position": "double", "entry_price": "double", "hold_bars": "long", "exit_reason": "string"})


def average_rule(z1: np.ndarray, z2: np.ndarray, buy: float, sell: float) -> np.ndarray:
    """Mean of two threshold rules that both start from the common state of the bar before."""
    out = np.zeros(len(z1))
    state = 0.0
    for i, (a, b) in enumerate(zip(z1.tolist(), z2.tolist(), strict=True)):
        if a == a and b == b:
            one = 1.0 if a < buy else 0.0 if a > sell else state
            two = 1.0 if b < buy else 0.0 if b > sell else state
            state = (one + two) / 2
        out[i] = state
    return out


def all_in_book(signal: np.ndarray, close: np.ndarray, hold: int, cash: float, slippage: float, fee: float) -> dict[str, np.ndarray]:
    """A cash-and-shares book that buys with all its cash on a signal and sells after hold bars. Entry cost is
    charged on one share's price, exit cost on each share of the position."""
    n = len(close)
    equity, shares_at, event = np.zeros(n), np.zeros(n), [""] * n
    shares, bought = 0.0, -1
    for i in range(n):
        if shares > 0 and i - bought >= hold:
            cash += shares * (close[i] * (1 - slippage) - close[i] * fee)
            shares, event[i] = 0.0, "sell"
        elif shares == 0 and signal[i] == 1 and i + 1 < n:
            price = close[i] * (1 + slippage)
            cash -= price * fee
            shares, bought = cash / price, i
            cash, event[i] = 0.0, "buy"
        equity[i], shares_at[i] = cash + shares * close[i], shares
    return {"equity": equity, "shares": shares_at, "event": event}
