"""Stateful operators with bounded state: rolling features, jump checks, cooldowns.

The per-key state is a bounded list of recent values, so it does not grow with the
stream. The same step functions serve batch tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Prices a key's state holds at most.
HISTORY = 1000
FEATURES = "symbol string, ts timestamp, price double, sma_20 double, std_20 double, rsi_14 double, change double, is_jump boolean, is_outlier boolean"


def tick_features(history: list[float], prices: list[float]) -> tuple[list[float], list[tuple]]:
    """Features of each new price from the history before it, and the new history."""
    out = []
    for price in prices:
        past = np.array(history[-HISTORY:])
        window = np.append(past, price)[-20:]
        moves = np.diff(np.append(past, price)[-15:])
        if len(moves) < 14:
            rsi = 50.0
        else:
            gain, loss = moves.clip(0).mean(), (-moves).clip(0).mean()
            rsi = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        change = price / past[-1] - 1 if len(past) and past[-1] else None
        spread = past.std() if len(past) >= 20 else 0.0
        outlier = bool(spread > 0 and abs(price - past.mean()) > 3 * spread)
        full = len(window) == 20
        out.append((price, float(window.mean()) if full else None, float(window.std()) if full else None, rsi, change, bool(change is not None and abs(change) > 0.1), outlier))
        history = [*history[-(HISTORY - 1) :], price]
    return history, out


def rolling_features(ticks: DataFrame, key: str = "symbol") -> DataFrame:
    """Rolling features of a stream of (symbol, ts, price); state expires an hour after a key's last tick."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        history = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts")
        history, found = tick_features(history, rows["price"].tolist())
        state.update((history,))
        state.setTimeoutDuration(3_600_000)
        names = ["price", "sma_20", "std_20", "rsi_14", "change", "is_jump", "is_outlier"]
        yield pd.DataFrame(found, columns=names).assign(symbol=keys[0], ts=rows["ts"].to_numpy())[["symbol", "ts", *names]]

    return ticks.select(key, "ts", "price").groupBy(key).applyInPandasWithState(step, FEATURES, "history array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def with_cooldown(alerts: DataFrame, seconds: int, key: str = "rule") -> DataFrame:
    """Alerts of which those within ``seconds`` of a key's last emitted one are dropped; state is one timestamp a key."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for ts, value in pd.concat(list(batches)).sort_values("ts")[["ts", "value"]].itertuples(index=False):
            now = int(ts.timestamp())
            if last is None or now - last >= seconds:
                kept.append((keys[0], ts, value))
                last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[key, "ts", "value"])

    return alerts.select(key, "ts", "value").groupBy(key).applyInPandasWithState(step, f"{key} string, ts timestamp, value double", "last long", "append", GroupStateTimeout.NoTimeout)
