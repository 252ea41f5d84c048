"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every position, the polynomial hash of what stands
before it, modulo a Mersenne prime and for two bases. Any two spans are compared in
constant time from the arrays, and the longest common extension of two positions is
found by binary search. The fingerprint takes the hashes of all spans of ``SPAN`` code
points from the array and keeps the smallest in each of ``CELLS`` cells (a one-permutation
sketch), after the hash of the whole text.

Defined results: a null text is empty; an empty text has an empty sketch and is like
itself (1) and nothing else (0); texts shorter than a span are one span; rows are ordered
by id, null ids first, then by a hash of the text; a lone document is its own next one; every row gives a
row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

P = np.uint64((1 << 31) - 1)
BASES = (1_000_003_847, 1_618_033_991)
SPAN, CELLS = 16, 64


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime P, for x below 2**63."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, reduced(out * np.uint64(pow(base, len(out), int(P))))])
    return out


_tables: dict[str, list[np.ndarray]] = {}


def powers(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Powers of the bases and of their inverses, at least n; kept and doubled as texts need."""
    if not _tables or len(_tables["up"][0]) < n:
        size = 1 << max(14, int(n - 1).bit_length())
        _tables["up"] = [_powers(b, size) for b in BASES]
        _tables["down"] = [_powers(pow(b, -1, int(P)), size) for b in BASES]
    return _tables["up"], _tables["down"]


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(code)
        up, self.down = powers(self.n + 1)
        zero = np.zeros(1, np.uint64)
        self.prefix = [np.concatenate([zero, reduced(np.cumsum(reduced(code * u[: self.n])))]) for u in up]

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of text[start:end], the same wherever the span stands."""
        p = int(P)
        return tuple((int(g[end]) - int(g[start])) * int(d[start]) % p for g, d in zip(self.prefix, self.down))

    def spans(self, width: int) -> np.ndarray:
        """62-bit hashes of all spans of ``width`` code points."""
        a, b = [reduced((g[width:] + P - g[: self.n - width + 1]) * d[: self.n - width + 1]) for g, d in zip(self.prefix, self.down)]
        return a << np.uint64(31) | b

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Code points for which text[start:] and other[at:] agree, by binary search over span hashes."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, start + mid) == other.span(at, at + mid):
                low = mid
            else:
                high = mid - 1
        return low


def sketch(hashed: PrefixHash) -> np.ndarray:
    """Per cell the smallest 32-bit value of the spans that fall in it; 2**32 - 1: none."""
    cells = np.full(CELLS, 0xFFFFFFFF, np.uint64)
    if hashed.n:
        h = hashed.spans(min(SPAN, hashed.n))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        value = np.minimum((h >> np.uint64(26)) & np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFE))
        np.minimum.at(cells, (h >> np.uint64(58)).astype(np.intp), value)
    return cells


def fingerprint(hashed: PrefixHash, cells: np.ndarray) -> str:
    """Length and hash of the whole text, then the sketch's cells, in hexadecimal."""
    a, b = hashed.span(0, hashed.n)
    return f"{hashed.n:x}.{a << 31 | b:016x}.{cells.astype('>u4').tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of cells in use in either sketch whose values agree: about the Jaccard similarity of the spans."""
    used = (a != 0xFFFFFFFF) | (b != 0xFFFFFFFF)
    n = int(used.sum())
    return float((a == b)[used].sum() / n) if n else 1.0


def cells_of(fingerprint_: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint_.rsplit(".", 1)[1]), ">u4").astype(np.uint64)


def with_next(docs: DataFrame, then, schema: str) -> DataFrame:
    """Runs ``then`` (an iterator of (id, text, next text) in, of data frames out) along the order of (id, hash of the text).

    Ids are cut into ranges of about equal counts, one for each shuffle partition, whose bounds and first ids
    alone reach the driver. Each range's first document is also sent to the range before it, behind its rows,
    so each task can walk its range in order without any global sort in one place.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("o", F.coalesce("id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = Counter(int(q) for q in docs.approxQuantile("o", [i / ranges for i in range(1, ranges)], 0.2 / ranges))
    # an id that several quantiles fall on has a range of its own, cut into parts by the texts' hashes
    bounds = np.array(sorted({x for q, n in quantiles.items() for x in ((q, q + 1) if n > 1 else (q,))}), np.int64)
    parts = np.ones(len(bounds) + 1, np.int64)
    for q, n in quantiles.items():
        if n > 1:
            parts[np.searchsorted(bounds, q, "right")] = n + 1
    start = np.concatenate([[0], parts.cumsum()])

    @F.pandas_udf("long")
    def range_of(o: pd.Series, h: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, o.to_numpy(np.int64), "right")
        place = (h.to_numpy(np.int64) / 2.0**64 + 0.5) * parts[at]
        return pd.Series(start[at] + np.minimum(place.astype(np.int64), parts[at] - 1))

    firsts = {r["b"]: (r["f"]["o"], r["f"]["h"]) for r in docs.select("o", "h").withColumn("b", range_of("o", "h")).groupBy("b").agg(F.min(F.struct("o", "h")).alias("f")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    heads = {firsts[b]: before[b] for b in order}

    @F.pandas_udf("long")
    def sent_to(o: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([heads.get(x, -1) for x in zip(o.tolist(), h.tolist())], dtype="int64")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            held = None
            for pdf in batches:
                for b, s, doc, text in zip(pdf["b"], pdf["s"], pdf["id"], pdf["text"]):
                    if held is not None and held[0] == b:
                        yield held[1], held[2], text
                        held = None
                    if s == 0:
                        held = (b, doc, text)

        yield from then(rows())

    sent = docs.withColumn("b", range_of("o", "h")).withColumn("p", sent_to("o", "h"))
    sent = sent.withColumn("to", F.explode(F.expr("filter(array(named_struct('b', b, 's', 0), named_struct('b', p, 's', 1)), x -> x.b >= 0)")))
    dealt = sent.select("to.b", "to.s", "o", "h", "id", "text").repartitionById(int(start[-1]), F.col("b").cast("int")).sortWithinPartitions("b", "s", "o", "h", "text")
    return dealt.select("b", "s", "id", "text").mapInPandas(walk, schema)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix).

    The edited text has the last half of its code points replaced by the first as many of the next document.
    ``common_prefix`` is the longest common extension of the two at their starts.
    """
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]

    def then(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out, known = [], (None, None, None)
        for doc, text, following in rows:
            hashed, cells = known[1:] if known[0] == text else ((h := PrefixHash(text)), sketch(h))
            nexth = PrefixHash(following)
            next_cells = sketch(nexth)
            known = (following, nexth, next_cells)
            n = len(text)
            edited = text[: n - n // 2] + following[: n // 2]
            edh = PrefixHash(edited)
            edited_cells = sketch(edh)
            out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint(hashed, cells), fingerprint(edh, edited_cells), likeness(cells, edited_cells), likeness(cells, next_cells), hashed.extension(0, edh, 0)))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=names).astype({"id": "Int64"})

    docs = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return with_next(docs, then, schema).withColumnRenamed("id", id_col)
