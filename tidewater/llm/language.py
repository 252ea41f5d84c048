"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place; a text's vector bundles (adds)
those of its n-grams, and a language's prototype those of all its training texts. A text is
given the language whose prototype has the greatest cosine with it.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to
the language first in alphabetical order; where nothing can be learned from (an empty
table, no languages) every text is ``und``; repeated rows count as often as they stand; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, whole_text

DIMENSIONS, N, SLOTS = 1024, 3, 4096
SEED = 1729

_vectors: list[np.ndarray] = []
_is_letter: list[np.ndarray] = []


def letter_vectors() -> list[np.ndarray]:
    """The letters' vectors rotated for each place of an n-gram (place 0 first)."""
    if not _vectors:
        base = np.random.default_rng(SEED).integers(0, 2, (SLOTS, DIMENSIONS), dtype=np.int8) * 2 - 1
        _vectors.extend(np.roll(base, N - 1 - i, axis=1).astype(np.int8) for i in range(N))
    return _vectors


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of slots and their counts. Slot 0 stands for any run of what is no letter."""
    if not _is_letter:
        _is_letter.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "ignore"), np.uint32)
    letter = _is_letter[0][code]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    slot = np.where(letter, code.astype(np.int64) * 2654435761 % 4294967291 % (SLOTS - 1) + 1, 0)
    slot = slot[np.concatenate([[True], letter[1:] | letter[:-1]])]
    key = slot[: len(slot) - N + 1].copy()
    for i in range(1, N):
        key = key * SLOTS + slot[i : len(slot) - N + 1 + i]
    return np.unique(key, return_counts=True)


def bundle(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the n-grams' vectors."""
    vectors, total = letter_vectors(), np.zeros(DIMENSIONS)
    for at in range(0, len(keys), 4096):
        k = keys[at : at + 4096]
        bound = vectors[N - 1][k % SLOTS]
        for i in range(N - 2, -1, -1):
            k = k // SLOTS
            bound = bound * vectors[i][k % SLOTS]
        total += counts[at : at + 4096].astype(np.float32) @ bound.astype(np.float32)
    return total


def prototypes(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[tuple[str, np.ndarray]]:
    """(language, unit vector) of every language in ``train``; each task sends one vector a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                found = [ngrams(t) for t in texts]
                keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([c for _, c in found]), len(keys))
                sums[lang] = sums.get(lang, 0) + bundle(keys, counts)
        for lang, vector in sums.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(DIMENSIONS), "value": np.rint(vector)})

    parts = train.select(F.col(lang_col).alias("lang"), whole_text(text_col).alias("text")).mapInPandas(run, "lang string, dim int, value double")
    rows = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()  # a vector for each language
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["dim"]] = r["value"]
    return [(lang, v / norm) for lang, v in sorted(out.items()) if (norm := np.linalg.norm(v)) > 0]


def identify(df: DataFrame, learned: list[tuple[str, np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the language of the nearest prototype and the cosine with it (0 if negative)."""
    names = [lang for lang, _ in learned]
    matrix = np.array([v for _, v in learned]).reshape(len(learned), DIMENSIONS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, score = [], []
            for text in pdf["text"]:
                keys, counts = ngrams(text)
                if not len(keys) or not names:
                    lang.append("und")
                    score.append(0.0)
                    continue
                vector = bundle(keys, counts)
                cosine = matrix @ vector / max(np.linalg.norm(vector), 1e-12)
                best = int(cosine.argmax())
                lang.append(names[best])
                score.append(float(min(max(cosine[best], 0.0), 1.0)))
            yield pd.DataFrame({"id": pdf["id"], "lang_pred": lang, "score": score})

    source = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return source.mapInPandas(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def language_id(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, lang_pred, score), learned from the rows whose crc32(id) mod 3 is not 1 and whose lang is known."""
    train = df.where((fold(F.col(id_col), 3) != 1) & F.col("lang").isNotNull())
    found = identify(df, prototypes(train), id_col)
    return found.select(id_col, F.coalesce(fold(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
