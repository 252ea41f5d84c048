"""Exponentially weighted means and other recurrences, one ordered key at a time.

A recurrence needs a key's rows in order. The scan below holds one batch of a key in
memory, never the whole group: rows are dealt by key, sorted within partitions, and the
state is carried from row to row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_scan(df: DataFrame, key: str, order: list[str], columns: dict[str, str], start: Callable[[], object], step: Callable[[object, pd.DataFrame], tuple[object, dict[str, np.ndarray]]]) -> DataFrame:
    """Adds ``columns`` (name -> type) computed by folding each key's rows in order.

    ``step`` gets the state and the next rows of one key, and returns the new state and the values
    of the added columns. Keys may span batches and batches may hold many keys.
    """
    fields = df.schema.fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, begun = None, None, False
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].fillna("\0null") if pdf[key].dtype == object else pdf[key]
            cuts = np.flatnonzero(np.append(True, keys.to_numpy()[1:] != keys.to_numpy()[:-1]))
            parts = []
            for a, b in zip(cuts, [*cuts[1:], len(pdf)]):
                if not begun or keys.iloc[a] != current:
                    current, state, begun = keys.iloc[a], start(), True
                own = pdf.iloc[a:b]
                state, values = step(state, own)
                parts.append(own.assign(**values))
            yield pd.concat(parts)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{n}` {t}" for n, t in columns.items()])
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


#: Rows that one product with the matrix of powers takes on.
BLOCK = 64


def decayed(a: float, b: np.ndarray, first: float) -> np.ndarray:
    """y with y[i] = a y[i - 1] + b[i] and y[-1] = ``first``: blocks by a matrix of powers of a, the state carried between them."""
    n = len(b)
    power = a ** np.arange(BLOCK + 1)
    gap = np.arange(BLOCK)[:, None] - np.arange(BLOCK)
    inside = np.where(gap >= 0, power[np.maximum(gap, 0)], 0.0)
    blocks = np.zeros((-(-n // BLOCK), BLOCK))
    blocks.reshape(-1)[:n] = b
    out = blocks @ inside.T
    carry = np.empty(len(out))
    for i, end in enumerate(out[:, -1].tolist()):  # one number a block
        carry[i] = first
        first = end + power[BLOCK] * first
    return (out + carry[:, None] * power[1:]).reshape(-1)[:n]


def _held(values: np.ndarray, known: np.ndarray, before: float) -> np.ndarray:
    """The values of the known rows, each until the next one; ``before`` ahead of the first."""
    return np.append(before, values)[np.cumsum(known)]


def _ewm_step(x: str, out: str, alpha: float, adjust: bool):
    def step(state, rows):
        num, den = state
        values = rows[x].to_numpy(float)
        known = values == values
        v = values[known]
        before = num / den if den else np.nan
        if not len(v):
            return state, {out: np.full(len(values), before)}
        if adjust:
            nums, dens = decayed(1 - alpha, v, num), decayed(1 - alpha, np.ones(len(v)), den)
            return (float(nums[-1]), float(dens[-1])), {out: _held(nums / dens, known, before)}
        b = alpha * v
        if not den:
            b[0], before_mean = v[0], 0.0
        else:
            before_mean = before
        means = decayed(1 - alpha, b, before_mean)
        return (float(means[-1]), 1.0), {out: _held(means, known, before)}

    return step


def ewm(df: DataFrame, x: str, out: str, span: float | None = None, alpha: float | None = None, com: float | None = None, adjust: bool = True, key: str = "k", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Exponentially weighted mean by span, com or alpha; with ``adjust`` weights are normalised, else recursive."""
    if alpha is None:
        alpha = 2 / (span + 1) if span is not None else 1 / (1 + com)
    return ordered_scan(df, key, list(order), {out: "double"}, lambda: (0.0, 0.0), _ewm_step(x, out, alpha, adjust))


def ewm_many(df: DataFrame, specs: list[tuple[str, str, float, bool]], key: str = "k", order: tuple[str, ...] = ("t",), gaps: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Several (column, name, alpha, adjust) in one pass; later ones may read earlier ones' results, and ``gaps`` (name: a, b) of them, a - b."""
    steps, gaps = [_ewm_step(*s) for s in specs], gaps or {}

    def step(states, rows):
        new, values = [], {}
        for state, one in zip(states, steps):
            s, v = one(state, rows.assign(**values))
            new.append(s)
            values |= v
            values |= {name: values[a] - values[b] for name, (a, b) in gaps.items() if name not in values and a in values and b in values}
        return new, values

    return ordered_scan(df, key, list(order), {n: "double" for n in [*(s[1] for s in specs), *gaps]}, lambda: [(0.0, 0.0)] * len(specs), step)


def macd(df: DataFrame, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, **kw) -> DataFrame:
    """MACD line, signal and histogram from adjusted means, in one pass."""
    specs = [(x, "__fast", 2 / (fast + 1), True), (x, "__slow", 2 / (slow + 1), True), ("macd", "macd_signal", 2 / (signal + 1), True)]
    found = ewm_many(df, specs, gaps={"macd": ("__fast", "__slow")}, **kw)
    return found.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("__fast", "__slow")


def riskmetrics_variance(df: DataFrame, x: str, out: str, lam: float = 0.94, seed_rows: int = 20, key: str = "k", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """EWMA variance that starts from the variance (ddof 1) of a key's first ``seed_rows`` values; null before."""

    def step(state, rows):
        seen, variance = state
        values = rows[x].to_numpy(float)
        known = values == values
        v, before, result = values[known], np.nan if variance is None else variance, np.full(int(known.sum()), np.nan)
        at = 0
        if variance is None:
            at = min(seed_rows - len(seen), len(v))
            seen = [*seen, *v[:at].tolist()]
            if len(seen) == seed_rows:
                variance = result[at - 1] = float(np.var(seen, ddof=1))
        if variance is not None and at < len(v):
            result[at:] = decayed(lam, (1 - lam) * v[at:] ** 2, variance)
            variance = float(result[-1])
        return (seen, variance), {out: np.where(known, _held(result, known, before), np.nan)}

    return ordered_scan(df, key, list(order), {out: "double"}, lambda: ([], None), step)


def garch_variance(df: DataFrame, x: str, out: str, omega: float = 1e-6, alpha: float = 0.1, beta: float = 0.85, first: float = 1e-4, key: str = "k", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """The GARCH(1,1) recursion with fixed parameters."""

    def step(h, rows):
        v = np.nan_to_num(rows[x].to_numpy(float), nan=0.0)
        after = decayed(beta, omega + alpha * v * v, h)
        return float(after[-1]), {out: np.append(h, after[:-1])}

    return ordered_scan(df, key, list(order), {out: "double"}, lambda: first, step)


def kalman_level(df: DataFrame, x: str, out: str, q: float = 1e-5, r: float = 1e-2, key: str = "k", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Scalar Kalman filter of a constant level with process noise q and measurement noise r."""

    def step(state, rows):
        level, p = state
        result = np.empty(len(rows))
        for i, v in enumerate(rows[x].to_numpy(float)):
            if level is None:
                level = v
            p += q
            if v == v:
                gain = p / (p + r)
                level, p = level + gain * (v - level), (1 - gain) * p
            result[i] = level
        return (level, p), {out: result}

    return ordered_scan(df, key, list(order), {out: "double"}, lambda: (None, 1.0), step)


def cooldown(df: DataFrame, seconds: int, out: str = "emitted", at: str = "t", key: str = "k") -> DataFrame:
    """Greedy suppression: a row is emitted if the last emitted row of its key is at least ``seconds`` old."""

    def step(last, rows):
        times = rows[at].astype("datetime64[us]").astype("int64").to_numpy()
        result = np.zeros(len(rows), bool)
        i = 0 if last is None else int(np.searchsorted(times, last + seconds * 1_000_000))
        while i < len(times):  # from one emitted row to the next
            result[i], last = True, int(times[i])
            i = max(i + 1, int(np.searchsorted(times, last + seconds * 1_000_000)))
        return last, {out: result}

    return ordered_scan(df, key, [at], {out: "boolean"}, lambda: None, step)
