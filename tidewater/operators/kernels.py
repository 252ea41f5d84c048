"""Operators without a relational form: numerical kernels over one key's series at a time.

``per_key`` gives a kernel one key's ordered values, the whole series at once: models are
fitted once a key, and no border falls into a series. Keys are the unit of work, so a task
holds one key's series (a row is some tens of bytes; reduce events to bars first). ``chunk``
cuts series into windows, each a result of its own, where windows are what is asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of values that are compared at once.
CELLS = 1_000_000


def per_key(df: DataFrame, key: str, t: str, x: str, kernel: Callable[[np.ndarray], list[tuple]], schema: str, chunk: int | None = None, timed: bool = False) -> DataFrame:
    """(key, chunk, *schema): ``kernel`` on each key's values in order: the whole series (chunk 0) or, if asked for, windows of ``chunk`` rows.

    Missing values are left out. With ``timed`` the kernel's first value is the number of one of the
    values it was given, and its time stands in the result instead.
    """
    number = F.lit(0) if chunk is None else (F.row_number().over(Window.partitionBy(key).orderBy(t)) - 1) / chunk
    numbered = df.select(F.col(key).cast("string").alias("k"), t, F.col(x).cast("double").alias("x"), number.cast("long").alias("chunk"))

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x"]).sort_values(t)
        rows = kernel(pdf["x"].to_numpy(float))
        if timed:
            at = pdf[t].tolist()
            rows = [(at[i], *rest) for i, *rest in rows]
        return pd.DataFrame([(*keys, *r) for r in rows], columns=["k", "chunk", *[c.split()[0] for c in schema.split(", ")]])

    return numbered.groupBy("k", "chunk").applyInPandas(run, f"k string, chunk long, {schema}")


def fft_cycles(x: np.ndarray, top: int = 5) -> list[tuple]:
    """The strongest periods after removing the mean; the constant term is no cycle."""
    if len(x) < 8:
        return []
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    best = np.argsort(-power[1:], kind="stable")[:top] + 1
    return [(int(r + 1), float(len(x) / k), float(power[k] / max(power[1:].sum(), 1e-300))) for r, k in enumerate(best)]


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float | None:
    """Of all pairs of the series that match over ``m`` values, the share that match over one more, as -log; in blocks of rows."""
    tolerance, n = r * x.std(), len(x) - m
    if n < 2 or tolerance == 0:
        return None
    a = b = 0
    rows = max(CELLS // len(x), 1)
    for i in range(0, n, rows):
        k = min(rows, n - i)
        near = np.abs(x[i : i + k + m, None] - x) <= tolerance
        both = near[:k, :n].copy()
        for j in range(1, m):
            both &= near[j : k + j, j : n + j]
        b += int(both.sum()) - k
        a += int((both & near[m : k + m, m : n + m]).sum()) - k
    return float(-np.log(a / b)) if a and b else None


def hurst(x: np.ndarray) -> float | None:
    """Slope of the logarithm of the rescaled range over the logarithm of the window."""
    sizes = [n for n in (8, 16, 32, 64, 128, 256) if n <= len(x) // 2]
    if len(sizes) < 2:
        return None
    means = []
    for n in sizes:
        v = x[: len(x) // n * n].reshape(-1, n)
        z = (v - v.mean(1, keepdims=True)).cumsum(1)
        s = v.std(1)
        means.append(np.mean((z.max(1) - z.min(1))[s > 0] / s[s > 0]) if (s > 0).any() else np.nan)
    slope = np.polyfit(np.log(sizes), np.log(means), 1)[0] if np.isfinite(means).all() else np.nan
    return float(slope) if np.isfinite(slope) else None


def lempel_ziv(x: np.ndarray) -> float | None:
    """Number of phrases of the sequence of above-median flags, normalised by n / log2(n)."""
    n = len(x)
    if n < 4:
        return None
    middle = np.median(x)
    s = "".join("1" if v > middle else "0" for v in x)
    seen, phrase, count = set(), "", 0
    for ch in s:
        phrase += ch
        if phrase not in seen:
            seen.add(phrase)
            phrase, count = "", count + 1
    return float((count + bool(phrase)) * np.log2(n) / n)


def detrended_fluctuation(x: np.ndarray) -> float | None:
    y = (x - x.mean()).cumsum()
    sizes = [n for n in (8, 16, 32, 64, 128) if n <= len(x) // 4]
    if len(sizes) < 2:
        return None
    flows = []
    for n in sizes:
        v = y[: len(y) // n * n].reshape(-1, n)
        i = np.arange(n)
        fit = np.polyfit(i, v.T, 1)
        flows.append(np.sqrt(np.mean((v - (np.outer(fit[0], i) + fit[1][:, None])) ** 2)))
    return float(np.polyfit(np.log(sizes), np.log(np.maximum(flows, 1e-12)), 1)[0])


def spectral(x: np.ndarray) -> tuple[float | None, float | None]:
    """Spectral centroid and 85 % roll-off, as shares of the sampling rate."""
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2 if len(x) > 3 else np.zeros(1)
    if power.sum() <= 0:
        return None, None
    f = np.arange(len(power)) / len(x)
    return float((f * power).sum() / power.sum()), float(f[np.searchsorted(power.cumsum(), 0.85 * power.sum())])


def entropy_suite(x: np.ndarray) -> list[tuple]:
    raw = np.round(x, 2).tobytes()
    centroid, rolloff = spectral(x)
    return [(len(x), sample_entropy(x), hurst(x), lempel_ziv(x), detrended_fluctuation(x), centroid, rolloff, float(len(zlib.compress(raw)) / max(len(raw), 1)))]


def savitzky_golay(x: np.ndarray, width: int = 11, degree: int = 3) -> np.ndarray:
    """Local polynomial smoothing; the edges take the polynomials of the first and last window."""
    if len(x) < width:
        return x
    half, i = width // 2, np.arange(width) - width // 2
    a = np.vander(i, degree + 1, increasing=True)
    inner = np.convolve(x, np.linalg.pinv(a)[0][::-1], "valid")
    head = a[:half] @ np.linalg.lstsq(a, x[:width], rcond=None)[0]
    tail = a[half + 1 :] @ np.linalg.lstsq(a, x[-width:], rcond=None)[0]
    return np.concatenate([head, inner, tail])


def hodrick_prescott(x: np.ndarray, lam: float = 1600.0) -> np.ndarray:
    """Trend that solves (I + lam D'D) z = x."""
    n = len(x)
    if n < 3:
        return x
    main, side, z = np.ones(n), np.zeros(n), np.array(x, float)
    for at, weight in ((slice(0, n - 2), 1), (slice(1, n - 1), 4), (slice(2, n), 1)):
        main[at] += lam * weight
    side[1 : n - 1] -= 2 * lam  # of rows i and i - 1
    side[2:] -= 2 * lam
    # L D L' of the five diagonals, row by row
    one, two, d, z = [0.0] * n, [0.0] * n, main.tolist(), z.tolist()
    side = side.tolist()
    for i in range(1, n):
        if i > 1:
            two[i] = lam / d[i - 2]
        one[i] = (side[i] - (two[i] * d[i - 2] * one[i - 1] if i > 1 else 0.0)) / d[i - 1]
        d[i] -= one[i] ** 2 * d[i - 1] + (two[i] ** 2 * d[i - 2] if i > 1 else 0.0)
        z[i] -= one[i] * z[i - 1] + (two[i] * z[i - 2] if i > 1 else 0.0)
    for i in range(n - 1, -1, -1):
        z[i] = z[i] / d[i] - (one[i + 1] * z[i + 1] if i + 1 < n else 0.0) - (two[i + 2] * z[i + 2] if i + 2 < n else 0.0)
    return np.array(z)


def haar_threshold(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """Soft thresholding of Haar wavelet details by the universal threshold."""
    n = len(x)
    if n < 2**levels:
        return x
    pad = -n % 2**levels
    a, details = np.append(x, np.full(pad, x[-1])), []
    for _ in range(levels):
        details.append((a[::2] - a[1::2]) / np.sqrt(2))
        a = (a[::2] + a[1::2]) / np.sqrt(2)
    limit = np.median(np.abs(details[0])) / 0.6745 * np.sqrt(2 * np.log(n))
    for d in reversed(details):
        d = np.sign(d) * np.maximum(np.abs(d) - limit, 0)
        out = np.empty(2 * len(a))
        out[::2], out[1::2] = (a + d) / np.sqrt(2), (a - d) / np.sqrt(2)
        a = out
    return a[:n]


def wiener(x: np.ndarray, width: int = 5) -> np.ndarray:
    if len(x) < width:
        return x
    p = np.pad(x, width // 2, mode="reflect")
    v = np.lib.stride_tricks.sliding_window_view(p, width)
    mean, var = v.mean(1), v.var(1)
    noise = var.mean()
    return mean + np.where(var > noise, 1 - noise / np.maximum(var, 1e-300), 0) * (x - mean)


def denoised(x: np.ndarray) -> list[tuple]:
    if not len(x):
        return []
    p = np.pad(x, 2, mode="reflect") if len(x) > 2 else np.pad(x, 2, mode="edge")
    v = np.lib.stride_tricks.sliding_window_view(p, 5)
    taps = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    both = (np.median(v, axis=1) + v @ (taps / taps.sum())) / 2
    cols = (savitzky_golay(x), both, hodrick_prescott(x), haar_threshold(x), wiener(x))
    return [(i, *map(float, r)) for i, r in enumerate(zip(*cols))]


def hidden_markov(x: np.ndarray, states: int = 3, rounds: int = 15) -> list[tuple]:
    """Gaussian hidden Markov model by expectation maximisation: the likeliest state of each row, ordered by variance."""
    if len(x) < states * 5:
        return []
    mean = np.quantile(x, (np.arange(states) + 0.5) / states)
    var = np.full(states, x.var() + 1e-12)
    trans = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(trans, 0.9)
    start, n = np.full(states, 1 / states), len(x)
    for _ in range(rounds):
        density = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        fwd, back, scale = np.empty((n, states)), np.empty((n, states)), np.empty(n)
        a = start * density[0]
        for i in range(n):
            if i:
                a = (fwd[i - 1] @ trans) * density[i]
            scale[i] = a.sum()
            fwd[i] = a / scale[i]
        back[-1] = 1
        for i in range(n - 2, -1, -1):
            back[i] = trans @ (density[i + 1] * back[i + 1]) / scale[i + 1]
        post = fwd * back
        post /= post.sum(1, keepdims=True)
        step = np.einsum("ij,jk,ik->jk", fwd[:-1], trans, density[1:] * back[1:] / scale[1:, None])
        trans = step / step.sum(1, keepdims=True)
        weight = post.sum(0) + 1e-9
        mean = (post * x[:, None]).sum(0) / weight
        var = (post * (x[:, None] - mean) ** 2).sum(0) / weight + 1e-9
        start = post[0]
    rank = np.argsort(np.argsort(var))
    return [(i, int(rank[s]), float(p)) for i, (s, p) in enumerate(zip(post.argmax(1), post.max(1)))]


def isolation_scores(x: np.ndarray, trees: int = 64, size: int = 128, seed: int = 42) -> list[tuple]:
    """Isolation forest of one variable: shorter paths to isolation score higher."""
    n = len(x)
    if n < 4:
        return []
    rng, depth = np.random.default_rng(seed), np.zeros(n)
    m = min(size, n)
    limit = int(np.ceil(np.log2(m)))
    harmonic = lambda k: 2 * (np.log(max(k - 1, 1)) + 0.5772156649) - 2 * (k - 1) / max(k, 1) if k > 1 else 0.0
    for _ in range(trees):
        stack = [(rng.choice(x, m, replace=False), np.arange(n), 0)]
        while stack:
            sample, at, level = stack.pop()
            if level >= limit or len(sample) <= 1 or sample.min() == sample.max():
                depth[at] += level + harmonic(len(sample))
                continue
            cut = rng.uniform(sample.min(), sample.max())
            low = x[at] < cut
            stack += [(sample[sample < cut], at[low], level + 1), (sample[sample >= cut], at[~low], level + 1)]
    score = 2.0 ** (-depth / trees / max(harmonic(m), 1e-9))
    limit_ = np.quantile(score, 0.9)
    return [(i, float(s), bool(s > limit_)) for i, s in enumerate(score)]


def spaced_peaks(x: np.ndarray, distance: int = 12) -> list[tuple]:
    """Local maxima at least ``distance`` apart, the highest kept first."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    kept: list[int] = []
    near = np.zeros(len(x), bool)
    for i in at[np.argsort(-x[at], kind="stable")]:
        if not near[i]:
            kept.append(int(i))
            near[max(i - distance + 1, 0) : i + distance] = True
    return [(i, float(x[i])) for i in sorted(kept)]


def support_resistance(x: np.ndarray, distance: int = 12, within: float = 0.02, least: int = 2) -> list[tuple]:
    """Peaks and troughs that ``least`` of their kind lie near (``within`` of the level, itself included): levels.

    Each with its kind, strength, distance from the last value in percent, and whether it is the nearest
    resistance above or support below it.
    """
    out = []
    for kind, sign in (("resistance", 1), ("support", -1)):
        found = spaced_peaks(sign * x, distance) if len(x) > 2 else []
        values = np.sort([sign * v for _, v in found])
        levels = []
        for i, v in found:
            level = sign * v
            strength = int(np.searchsorted(values, level * (1 + within), "left") - np.searchsorted(values, level * (1 - within), "right"))
            if strength >= least:
                levels.append((i, kind, float(level), strength, float(100 * sign * (level - x[-1]) / x[-1])))
        nearest = min((d for *_, d in levels if d > 0), default=None)
        out += [(*row, row[-1] == nearest) for row in levels]
    return out


def simulated_paths(stats: DataFrame, key: str, mean: str, dev: str, paths: int = 10_000, steps: int = 168, seed: int = 42) -> DataFrame:
    """(key, path, step, value): growth paths of normal returns, generated by tasks from path numbers, key and seed.

    A path is the same in every run and task; unknown means or deviations give null values. Tasks send 256 paths at a time.
    """
    grid = stats.select(key, mean, dev).withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).repartition(key, "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                draws = np.stack([np.random.default_rng([seed, p, zlib.crc32(str(k).encode())]).standard_normal(steps) for k, p in zip(pdf[key], pdf["path"])])
                growth = np.cumprod(1 + pdf[mean].to_numpy(float)[:, None] + pdf[dev].to_numpy(float)[:, None] * draws, axis=1)
                each = {key: pdf[key].to_numpy().repeat(steps), "path": pdf["path"].to_numpy().repeat(steps), "step": np.tile(np.arange(1, steps + 1), len(pdf)), "value": growth.ravel()}
                yield pd.DataFrame(each)

    return grid.mapInPandas(run, f"{key} string, path int, step int, value double")
