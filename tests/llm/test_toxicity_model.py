"""The label model and its classifier against dense brute force, and voters against counting."""

import math
import random
import tracemalloc

import numpy as np

from tidewater.llm import toxicity


def some_votes(rng, n, width):
    on = [sorted(rng.sample(range(width), rng.randrange(min(6, width) + 1))) for _ in range(n)]
    dense = np.zeros((n, width))
    for i, x in enumerate(on):
        dense[i, x] = 1
    return toxicity.Votes(on, width), dense


def test_label_model_matches_dense_sums():
    rng = random.Random(1)
    for n, width, at_once in ((40, 7, 10), (200, 30, 2_000_000), (5, 3, 1)):
        toxicity.PAIRS, before = at_once, toxicity.PAIRS
        votes, v = some_votes(rng, n, width)
        y = np.array([float(rng.random() < 0.3) for _ in range(n)])
        trust = np.log(toxicity.LABEL_TRUST / (1 - toxicity.LABEL_TRUST)) * (2 * y - 1)
        q = np.where(y > 0, toxicity.LABEL_TRUST, 1 - toxicity.LABEL_TRUST)
        for _ in range(15):
            prior = (q.sum() + 1) / (n + 2)
            on, off = (np.clip((v.T @ w + 0.1) / (w.sum() + 1), 1e-5, 1 - 1e-5) for w in (q, 1 - q))
            left = v - np.outer(q, on) - np.outer(1 - q, off)
            rest = left.T @ left
            spread = np.sqrt(np.diag(rest)) + 1e-9
            correlation = np.abs(rest / np.outer(spread, spread)) * (v.T @ v > 0)
            np.fill_diagonal(correlation, 1)
            weight = 1 / np.where(correlation > 0.2, correlation, 0).sum(1).clip(1)
            z = v @ (weight * np.log(on / off)) + (1 - v) @ (weight * np.log((1 - on) / (1 - off)))
            q = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + z + trust, -30, 30)))
        assert np.allclose(toxicity.label_model(votes, y), q, atol=1e-9)
        toxicity.PAIRS = before


def test_linear_classifier_is_the_optimum():
    rng = random.Random(2)
    votes, v = some_votes(rng, 300, 40)
    hits = np.array([math.log1p(rng.randrange(9)) for _ in range(300)])
    q = np.array([rng.random() for _ in range(300)])
    w = toxicity.linear_classifier(votes, hits, q)
    x = np.hstack([v, hits[:, None], np.ones((300, 1))])
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (q - p) - np.r_[np.ones(41), 1e-6] * w).max() < 1e-6


def test_ten_thousand_voters_stay_small():
    rng = np.random.default_rng(3)
    on = [np.unique(rng.integers(0, 10_000, 12)).tolist() for _ in range(6_000)]
    y = (rng.random(6_000) < 0.1).astype(float)
    tracemalloc.start()
    votes = toxicity.Votes(on, 10_000)
    w = toxicity.linear_classifier(votes, np.zeros(6_000), toxicity.label_model(votes, y))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w) == 10_002 and peak < 300e6


def test_chance_is_the_binomial_tail():
    for bad, good, share in ((3, 0, 0.1), (4, 7, 0.2), (0, 5, 0.3), (30, 100, 0.25)):
        n = bad + good
        want = sum(math.comb(n, x) * share**x * (1 - share) ** (n - x) for x in range(bad, n + 1))
        assert math.isclose(toxicity.chance(bad, good, share), want, rel_tol=1e-9)


def test_nested_tokens_have_one_voter():
    assert toxicity.apart(["trash", "tras*", "idio*", "idiot", "idiotic", "idioti*", "scum", "scumm*", "clown*", "clow*", "clowns"]) == ["trash", "idio*", "scum", "scumm*", "clown*"]
    assert toxicity.apart([]) == []
