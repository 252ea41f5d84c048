"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is reduced to shape features. Their values are binned at quantiles, and boosting
visits the features in turn: a shallow tree on the gradient by bin adds a small step to
that feature's lookup table. Then the pairs with the greatest gain left get tables of
their own, boosted in turn likewise. A score is the sigmoid of the intercept plus one table
entry for each feature and pair: vectorised additions of looked-up bins.

The tables are fitted on a bounded sample of labelled rows (``max_train``, chosen by a hash
of the id); scoring reads every whole text once.

Defined results: a null or empty text has all features 0 and gets the score of that; without
labelled rows every score is 0.5; rows that repeat an id in the labels count once, with the
greatest label; null labels are ignored; documents that repeat give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, whole_text

FEATURES = (
    "log_words", "word_length", "distinct", "adjacent_repeats", "top_word", "symbols", "marks", "upper",
    "digits", "pipes", "lines", "duplicate_lines", "stops", "repeated_trigrams",
)
#: Labelled rows the tables are fitted on at most.
MAX_TRAIN = 60_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 6, 120, 0.15


def features(text: str) -> list[float]:
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    count = lambda chars: float(by_byte[list(chars)].sum())
    counts = Counter(words)
    upper, letters = float(by_byte[65:91].sum()), float(by_byte[65:91].sum() + by_byte[97:123].sum() + by_byte[0xC3:].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    trigrams = Counter(zip(words, words[1:], words[2:]))
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, len(counts) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n, count(b"#*$%&<>") / size, count(b"!?") / size, upper / max(letters, 1.0),
        float(by_byte[48:58].sum()) / size, count(b"|") / n, len(lines) / n, 1 - len(set(lines)) / len(lines),
        count(b".") / n, sum(c for c in trigrams.values() if c > 1) / n,
    ]


def feature_matrix(texts: pd.Series) -> np.ndarray:
    """A row of FEATURES for each text."""
    return np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES))


def sampled(rows: DataFrame, most: int, id_col: str = "id") -> DataFrame:
    """All rows, or about ``most`` of them, chosen by a hash of the id."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps by bin of a tree of ``depth`` splits over ordered bins with gradient and curvature sums g, h."""
    G, H = g.sum(), h.sum()
    out = np.full(len(g), G / (H + 1.0))
    if depth and len(g) > 1:
        a, b = g.cumsum()[:-1], h.cumsum()[:-1]
        gain = a**2 / (b + 1.0) + (G - a) ** 2 / (H - b + 1.0) - G**2 / (H + 1.0)
        at = int(gain.argmax())
        if gain[at] > 1e-9:
            out[: at + 1] = _tree(g[: at + 1], h[: at + 1], depth - 1)
            out[at + 1 :] = _tree(g[at + 1 :], h[at + 1 :], depth - 1)
    return out


def _tree_pair(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """As _tree on a grid: one cut across, then one cut along on each side; also the gain."""
    best = (np.zeros_like(g), 0.0)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(a)):
            out = np.empty_like(a)
            for part in (slice(None, cut), slice(cut, None)):
                out[part] = _tree(a[part].sum(0), b[part].sum(0), 1)[None, :]
            gain = float((out * a).sum() - 0.5 * (out**2 * b).sum())
            if gain > best[1]:
                best = (out.T if turn else out, gain)
    return best


class AdditiveModel:
    """Bin edges, lookup tables of features and pairs, and the intercept."""

    def __init__(self, edges: list[np.ndarray], coarse: list[np.ndarray]):
        self.edges, self.coarse = edges, coarse
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.intercept = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for i, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, i], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            out += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
    return cuts[cuts > column.min()] if len(column) else cuts


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of single features, then of the pairs with the greatest gain."""
    if not len(x):
        return AdditiveModel([np.empty(0)] * x.shape[1], [np.empty(0)] * x.shape[1])
    model = AdditiveModel([_edges(c, BINS) for c in x.T], [_edges(c, PAIR_BINS) for c in x.T])
    model.intercept = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    logit = np.full(len(y), model.intercept)
    bins = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            logit += step[b]
    grids = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T)]
    shape = [len(e) + 1 for e in model.coarse]

    def summed(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = grids[i] * shape[j] + grids[j]
        return np.bincount(cell, g, shape[i] * shape[j]).reshape(shape[i], shape[j]), np.bincount(cell, h, shape[i] * shape[j]).reshape(shape[i], shape[j])

    gains = sorted(((_tree_pair(*summed(i, j))[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(ROUNDS // 4):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = RATE * _tree_pair(*summed(i, j))[0]
            table += step
            logit += step[grids[i], grids[j]]
    return model


def labelled(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """(id, y): one row for each id outside the held-out fold."""
    known = labels.where((fold(F.col("doc_id"), modulus) != held) & F.col(label).isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("double").alias("y"))


def fit_quality(df: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """The model of the labels whose crc32(id) mod 5 is not 0, on the features of at most about ``max_train`` texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame(feature_matrix(pdf["text"]), columns=list(FEATURES))
            yield found.assign(id=pdf["id"].to_numpy(), y=pdf["y"].to_numpy())

    docs = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    chosen = sampled(labelled(labels, "quality", 5, 0), max_train)  # so many rows at most are broadcast
    rows = docs.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInPandas(run, ", ".join(f"{f} double" for f in FEATURES) + ", id long, y double")
    train = rows.toPandas().sort_values(["id", *FEATURES])
    return fit(train[list(FEATURES)].to_numpy(float), train["y"].to_numpy(float))


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """The score of a text: 0 to 1, higher where the label 1 is likelier."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(feature_matrix(texts)))

    return score(text)


def score_quality(df: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted)."""
    model = fit_quality(df, labels, max_train, id_col, text_col)
    found = df.select(F.col(id_col).cast("long").alias("id"), quality_score(model, whole_text(text_col)).alias("score"))
    held = F.coalesce(fold(F.col("id"), 5) == 0, F.lit(False))
    return found.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
