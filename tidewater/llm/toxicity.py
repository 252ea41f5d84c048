"""Toxicity by weak supervision.

Many weak voters each vote "toxic" or abstain: a word of a lexicon, or a pattern (a word
that begins with certain letters, shouting, an address to the reader). A seed lexicon is given; further
words and beginnings are mined from labelled training texts. A generative label model
estimates, by expectation maximisation over the voters' outputs, how often each voter votes
for toxic and for clean texts, with the training label as one more voter of fixed trust.
The correlations of the voters beyond what the class explains are estimated along the way, and voters that
repeat each other share their weight. A linear classifier is then trained on the model's
posterior labels; it scores every text.

The model is fitted on a bounded sample of labelled rows (``max_train``, chosen by a hash of
the id); scoring reads every whole text once.

Defined results: a null or empty text has no votes and gets the score of that; without
labelled rows the seed lexicon alone votes; ids repeated in the labels count once, with the
greatest label; null labels are ignored; repeated documents give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, hold, materialise, whole_text
from .quality import labelled, sampled

#: Labelled rows the model is fitted on at most.
MAX_TRAIN = 20_000
#: What a mined voter needs: toxic documents that hold it, and a log ratio of its shares of toxic and clean documents.
MIN_SUPPORT, MIN_LIFT = 3, 1.5
#: The share of mined voters that may be in by chance.
FALSE_VOTERS = 0.05
#: Lengths of word beginnings that can be voters.
BEGINNINGS = (4, 5, 6)
#: How often the training label is right.
LABEL_TRUST = 0.97
# Seed lexicon of insults.
SEED = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "trash", "scum", "loser", "clown")

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = (re.compile(r"[A-Z]{4,}!!"), re.compile(r"\b(?:you|your|du|dein|tu|vous|usted)\b", re.I))


def words_of(text: str) -> Counter[str]:
    return Counter(_WORD.findall(text.lower()))


def tokens(words: Counter[str]) -> set[str]:
    """Words, and their beginnings marked with a star."""
    out = set(words)
    for k in BEGINNINGS:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


def chance(bad: int, good: int, share: float) -> float:
    """How likely a token of ``bad`` + ``good`` documents has ``bad`` toxic ones or more, if ``share`` of all documents are."""
    n = bad + good
    whole, yes, no = math.lgamma(n + 1), math.log(share), math.log1p(-share)
    return min(1.0, math.fsum(math.exp(whole - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * yes + (n - x) * no) for x in range(bad, n + 1)))


def apart(ranked: list[str]) -> list[str]:
    """The tokens of which none before is the beginning, or begins with theirs: nested ones vote together, the first speaks for all."""
    kept: list[str] = []
    stems: set[str] = set()  # of the kept ones
    inner: set[str] = set()  # beginnings of the kept ones
    for token in ranked:
        stem = token.rstrip("*")
        if stem not in inner and not any(stem[:k] + "*" in stems for k in range(1, len(stem) + 1)) and token not in stems:
            kept.append(token)
            stems.add(token)
            if token.endswith("*"):
                inner.update(stem[:k] for k in range(1, len(stem) + 1))
            else:
                inner.update(stem[:k] for k in BEGINNINGS if k < len(stem))
    return kept


def mined(texts: DataFrame, rate: float = FALSE_VOTERS) -> list[str]:
    """Tokens that stand in toxic texts more often than in others. ``texts``: (id, y, text).

    Of all tokens in MIN_SUPPORT toxic documents those stay that chance explains too badly, at a false-discovery rate of
    ``rate`` (Benjamini and Hochberg's step-up over exact binomial tails), however many they are; of nested ones the least
    likely (whole words first). Tasks count their own rows first; the sample bounds what reaches the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad, good = Counter(), Counter()
        for pdf in batches:
            for y, text in zip(pdf["y"], pdf["text"]):
                (bad if y > 0 else good).update(tokens(words_of(text)))
        yield pd.DataFrame({"token": list(bad), "bad": list(bad.values()), "good": [good[t] for t in bad]}).astype({"token": object, "bad": "int64", "good": "int64"})
        rest = [t for t in good if t not in bad]
        yield pd.DataFrame({"token": rest, "bad": 0, "good": [good[t] for t in rest]}).astype({"token": object, "bad": "int64", "good": "int64"})

    total = texts.agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).collect()[0]
    if not total["bad"] or not total["good"]:
        return []
    counts = texts.select("y", "text").mapInPandas(run, "token string, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = F.log((F.col("bad") + 0.5) / total["bad"]) - F.log((F.col("good") + 0.5) / total["good"])
    tested = materialise(counts.where(f"bad >= {MIN_SUPPORT}").withColumn("lift", lift))
    n, share = tested.count(), total["bad"] / (total["bad"] + total["good"])
    rows = sorted((chance(r["bad"], r["good"], share), -r["bad"], r["token"].endswith("*"), r["token"]) for r in tested.where(F.col("lift") > MIN_LIFT).collect())
    kept = max((i + 1 for i, (p, *_) in enumerate(rows) if p <= rate * (i + 1) / n), default=0)
    return apart([token for *_, token in rows[:kept]])


class Voters:
    """Turns texts into votes."""

    def __init__(self, lexicon: list[str]):
        self.names = list(dict.fromkeys([*SEED, *lexicon]))
        self.at = {t: i for i, t in enumerate(self.names)}
        self.starts = {t.rstrip("*")[:4] for t in self.names}
        self.n = len(self.names) + len(_PATTERNS)

    def votes(self, text: str) -> tuple[list[int], int]:
        """Voters that vote toxic, and the number of words that lexicon voters spoke up for."""
        found, hits = set(), 0
        get, starts = self.at.get, self.starts
        for w, c in words_of(text).items():
            if w[:4] in starts:
                own = [i for t in (w, *[w[:k] + "*" for k in BEGINNINGS if len(w) > k]) if (i := get(t)) is not None]
                found.update(own)
                hits += c * bool(own)
        found.update(len(self.names) + k for k, p in enumerate(_PATTERNS) if p.search(text))
        return sorted(found), hits


#: Pairs of votes that are counted at once.
PAIRS = 2_000_000


class Votes:
    """A vote matrix of zeros and ones by its ones: (row, voter), sorted by row."""

    def __init__(self, on: list[list[int]], width: int):
        self.n, self.width = len(on), width
        size = np.array([len(x) for x in on], np.int64)
        self.start = np.append(0, size.cumsum())
        self.row = np.repeat(np.arange(self.n), size)
        self.voter = np.concatenate([np.asarray(x, np.int64) for x in on]) if len(self.row) else np.zeros(0, np.int64)

    def of_rows(self, weight: np.ndarray) -> np.ndarray:
        """The voters' weights summed for each row."""
        return np.bincount(self.row, weight[self.voter], self.n)

    def of_voters(self, value: np.ndarray) -> np.ndarray:
        """The rows' values summed for each voter."""
        return np.bincount(self.voter, value[self.row], self.width)

    def together(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(j, k, rows) of each pair of voters j < k that some row has both of."""
        size = np.diff(self.start)
        ends = (size * (size - 1) // 2).cumsum()
        keys, counts, low = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while low < self.n:
            done = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            part = [keys]
            for k in np.unique(size[low:high]):
                if k > 1:
                    rows = low + np.flatnonzero(size[low:high] == k)
                    held = np.sort(self.voter[self.start[rows, None] + np.arange(k)], axis=1)
                    a, b = np.triu_indices(int(k), 1)
                    part.append((held[:, a] * self.width + held[:, b]).ravel())
            weight = np.concatenate([counts, np.ones(sum(map(len, part[1:])), np.int64)])
            keys, at = np.unique(np.concatenate(part), return_inverse=True)
            counts = np.bincount(at, weight, len(keys)).astype(np.int64)
            low = high
        return keys // self.width, keys % self.width, counts


def label_model(votes: Votes, y: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior probability of toxic for each row of ``votes``; ``y`` votes along with LABEL_TRUST."""
    n = len(y)
    trust = np.log(LABEL_TRUST / (1 - LABEL_TRUST)) * (2 * y - 1)
    q = np.where(y > 0, LABEL_TRUST, 1 - LABEL_TRUST)
    one, two, both = votes.together()
    alone = votes.of_voters(np.ones(n))
    for _ in range(rounds):
        prior = (q.sum() + 1) / (n + 2)
        sides = np.stack([q, 1 - q])
        seen = np.stack([votes.of_voters(side) for side in sides])
        # how often each voter votes for toxic texts, and for clean ones
        on, off = np.clip((seen + 0.1) / (sides.sum(1)[:, None] + 1.0), 1e-5, 1 - 1e-5)
        # correlation of voters that vote together beyond what the class explains: products of what is left of the votes, from sums
        expected = np.stack([on, off])
        mixed = (sides @ sides.T) @ expected

        def rest(j: np.ndarray, k: np.ndarray, count: np.ndarray, seen=seen, expected=expected, mixed=mixed) -> np.ndarray:
            return count - (seen[:, j] * expected[:, k]).sum(0) - (seen[:, k] * expected[:, j]).sum(0) + (expected[:, j] * mixed[:, k]).sum(0)

        every = np.arange(votes.width)
        spread = np.sqrt(np.maximum(rest(every, every, alone), 0)) + 1e-9
        correlation = np.abs(rest(one, two, both) / (spread[one] * spread[two]))
        correlation[correlation <= 0.2] = 0
        shared = 1.0 + np.bincount(one, correlation, votes.width) + np.bincount(two, correlation, votes.width)
        weight = 1.0 / shared
        yes, no = weight * np.log(on / off), weight * np.log((1 - on) / (1 - off))
        logit = np.log(prior / (1 - prior)) + votes.of_rows(yes - no) + no.sum() + trust
        q = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
    return q


def linear_classifier(votes: Votes, hits: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression on soft labels q: one a voter, one for ``hits``, the intercept.

    Newton's steps, each solved by conjugate gradients, so no matrix of voters by voters is built.
    """
    size = votes.width + 2
    w = np.zeros(size)
    w[-1] = np.log((q.sum() + 1) / (len(q) - q.sum() + 1))
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    forth = lambda v: votes.of_rows(v[:-2]) + hits * v[-2] + v[-1]
    back = lambda r: np.concatenate([votes.of_voters(r), [hits @ r, r.sum()]])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(forth(w), -30, 30)))
        curve = p * (1 - p) + 1e-6
        scale = penalty + np.concatenate([votes.of_voters(curve), [(hits * hits) @ curve, curve.sum()]])
        step, left = np.zeros(size), back(q - p) - penalty * w
        least = 1e-20 * (left @ (left / scale))
        ahead, now = left / scale, left @ (left / scale)
        for _ in range(4 * size):
            if now <= least:
                break
            bent = back(curve * forth(ahead)) + penalty * ahead
            far = now / (ahead @ bent)
            step, left = step + far * ahead, left - far * bent
            before, now = now, left @ (left / scale)
            ahead = left / scale + now / before * ahead
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return w


class ToxicityModel:
    """The voters and the linear classifier's weights: one a voter, one for the hits, the intercept."""

    def __init__(self, voters: Voters, weights: np.ndarray):
        self.voters, self.weights = voters, weights

    def score(self, text: str) -> float:
        on, hits = self.voters.votes(text)
        z = self.weights[on].sum() + self.weights[-2] * np.log1p(hits) + self.weights[-1]
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -30, 30))))


def fit_toxicity(df: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """The model of the labels whose crc32(id) mod 4 is not 2, on at most about ``max_train`` texts."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    chosen = sampled(labelled(labels, "toxic", 4, 2), max_train)  # so many rows at most are broadcast
    texts = materialise(docs.join(F.broadcast(chosen), "id").select("id", "y", "text"))
    voters = Voters(mined(texts))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [voters.votes(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "on": [on for on, _ in found], "hits": [h for _, h in found]})

    rows = texts.mapInPandas(vote, "id long, y double, on array<int>, hits long").toPandas().sort_values(["id", "hits"])
    if not len(rows):
        return ToxicityModel(voters, np.concatenate([np.full(len(SEED), 2.0), np.zeros(voters.n - len(SEED)), [2.0, -3.0]]))
    votes = Votes(rows.pop("on").tolist(), voters.n)
    q = label_model(votes, rows["y"].to_numpy(float))
    return ToxicityModel(voters, linear_classifier(votes, np.log1p(rows["hits"].to_numpy(float)), q))


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """The score of a text: 0 to 1, higher where it is likelier toxic."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        hold("toxicity")
        return pd.Series([model.score(t or "") for t in texts], dtype=float)

    return score(text)


def score_toxicity(df: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted)."""
    model = fit_toxicity(df, labels, max_train, id_col, text_col)
    found = df.select(F.col(id_col).cast("long").alias("id"), toxicity_score(model, whole_text(text_col)).alias("score"))
    held = F.coalesce(fold(F.col("id"), 4) == 2, F.lit(False))
    return found.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
