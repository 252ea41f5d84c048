"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join.

A document's signature is ``SYMBOLS`` b-bit MinHash values (b = 16). Signatures that
differ in at most ``THRESHOLD`` symbols are candidates. By the pigeonhole principle,
if the symbols are split into ``CHUNKS`` chunks, such a pair differs in at most
``THRESHOLD // CHUNKS`` = 1 symbol of some chunk; so each document is entered, for each
chunk, under the chunk with each one of its symbols masked (the allowed chunk errors),
and every pair under the threshold meets under some key. The threshold is chosen so
that a pair of Jaccard similarity 0.8 exceeds it with a probability of about 3e-5,
and more similar pairs practically never. Every candidate is confirmed on the full
shingle sets.

No group is expanded into all its pairs: documents with equal sets are one class; in
every bucket each class is compared with the bucket's smallest one; classes that these
links have joined are one component, and only pairs in a bucket that lie in different
components are compared then, each in the first bucket it shares. That loses no link that
matters to the components.

Defined results: a null or blank text has an empty set, no links, and is its own
component; fewer words than a shingle make one shingle of the whole sequence; every input
row gives one row, also where a doc_id repeats (its texts then count as one document's in
links); a row with a null doc_id is kept and never represents a class, but takes the
component of a class with its set; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, materialise, whole_text
from .components import components

SYMBOLS, CHUNKS, THRESHOLD = 80, 16, 31
WIDTH = SYMBOLS // CHUNKS
#: Bit planes of the first 64 symbols: symbols that differ in one of these bits differ, so no pair within THRESHOLD
#: symbols differs at more than THRESHOLD places of the planes. Three planes show 7 of 8 differing symbols.
PLANES = 3
#: Shingles are told apart by how many documents hold them: up to 2, 4, 8, ... or more.
SHARED_BY = (2, 4, 8, 16, 32, 64, 128)
#: A set of ids is broadcast up to so many rows (16 MB); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Words whose hashes a Python worker keeps, and shingles it hands on at once; both bound its memory.
WORDS, AT_ONCE = 65_536, 200_000


class _Words(dict):
    """Word to 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


_words = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.encode().lower().split()  # bytes: A-Z only, and white space as in WORD_SPACE
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * _MIX + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """b-bit MinHash: 16 bits of each of ``SYMBOLS`` minima."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        block = (hashes[None, at : at + 2048] ^ _MASKS[:, None]) * _MULTIPLIERS[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return (mixed(low) >> np.uint64(48)).astype(np.uint16)


def bucket_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of signatures (n, SYMBOLS): each chunk with each symbol masked, (n, CHUNKS * WIDTH)."""
    chunks = symbols.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(chunks), CHUNKS, WIDTH), np.uint64)
    family = np.arange(CHUNKS, dtype=np.uint64)[None, :] * np.uint64(WIDTH)
    for masked in range(WIDTH):
        key = mixed((family + np.uint64(masked + 1)) * _MIX)
        key = np.broadcast_to(key, chunks.shape[:2])
        for i in range(WIDTH):
            if i != masked:
                key = mixed(key * _MIX + chunks[:, :, i] + np.uint64(1))
        out[:, :, masked] = key
    return out.reshape(len(chunks), -1)


def _sets(pdf: pd.DataFrame, size: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The ids and shingle sets of a batch, in parts of about AT_ONCE shingles (or one document)."""
    ids, found, n = [], [], 0
    for at, text in zip(pdf["id"], pdf["text"]):
        ids.append(at)
        found.append(shingles(text, size))
        n += len(found[-1])
        if n >= AT_ONCE:
            yield ids, found
            ids, found, n = [], [], 0
    if ids:
        yield ids, found


def _signed(df: DataFrame, size: int) -> DataFrame:
    """(id, n, k1, k2, sig): set size, 128-bit identity of the set, signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("near_dup", _words.clear)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingles(text, size)
                k = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                rows.append((len(s), k[0], k[1], signature(s).tobytes() if len(s) else b""))
            n, k1, k2, sig = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"id": pdf["id"], "n": np.array(n, np.int64), "k1": np.array(k1, np.int64), "k2": np.array(k2, np.int64), "sig": list(sig)})

    return df.mapInPandas(run, "id long, n long, k1 long, k2 long, sig binary")


def _keyed(classes: DataFrame) -> DataFrame:
    """(key, place, id, p0, p1, ...): one row for each bucket a class is entered in; ``place`` is chunk * WIDTH + masked symbol."""
    planes = [f"p{i}" for i in range(PLANES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, SYMBOLS)
            weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
            bits = {p: (((sig[:, :64] >> np.uint16(i)).astype(np.uint64) & np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64).view(np.int64) for i, p in enumerate(planes)}
            keys = bucket_keys(sig)
            each = keys.shape[1]
            place = np.tile(np.arange(each, dtype=np.int32), len(sig))
            yield pd.DataFrame({"key": keys.ravel().view(np.int64), "place": place, "id": np.repeat(pdf["id"].to_numpy(), each)} | {p: np.repeat(v, each) for p, v in bits.items()})

    return classes.select("id", "sig").mapInPandas(run, f"key long, place int, id long, {', '.join(f'{p} long' for p in planes)}")


def first_shared(place: str, one: str, two: str) -> str:
    """SQL: of the buckets that two signatures share, the one at ``place`` is the first.

    They share a bucket of a chunk if at most one of its symbols differs: the bucket that masks the
    differing symbol, or, if none differs, all of the chunk's. A pair met in many buckets so counts once.
    """
    differs = f"substring({one}, 2 * (k) + 1, 2) <> substring({two}, 2 * (k) + 1, 2)"
    earlier = differs.replace("(k)", f"({WIDTH} * c + i)")
    chunks, symbols = (f"array({', '.join(map(str, range(n)))})" for n in (CHUNKS, WIDTH))
    return f"""({place} % {WIDTH} = 0 OR {differs.replace("(k)", place)})
        AND NOT exists({chunks}, c -> c < {place} div {WIDTH} AND size(filter({symbols}, i -> {earlier})) <= 1)"""


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most THRESHOLD symbols and whose sizes allow the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = np.frombuffer(b"".join(pdf["sig_a"]), np.uint16).reshape(-1, SYMBOLS)
            b = np.frombuffer(b"".join(pdf["sig_b"]), np.uint16).reshape(-1, SYMBOLS)
            yield pdf.loc[(a != b).sum(axis=1) <= THRESHOLD, ["a", "b"]]

    one = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    sized = pairs.join(one, "a").join(two, "b").where("100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b)")
    return sized.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long")


def _checked(ids: DataFrame) -> DataFrame:
    """``ids``, marked for broadcast if a count shows that it is small; else a shuffle joins it."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _ids_of(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids``."""
    return df.join(_checked(ids), "id", "left_semi")


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id is not in ``ids`` (id); rows without an id stay."""
    gone = _checked(ids.withColumnRenamed("id", "__gone"))
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, found in _sets(pdf, size):
                yield pd.DataFrame({"id": ids, "s": [s.tobytes() for s in found]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["s_a"], pdf["s_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    pairs = materialise(pairs)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    full = materialise(_ids_of(docs, ids).mapInPandas(sets, "id long, s binary"))
    joined = pairs.join(full.select(F.col("id").alias("a"), F.col("s").alias("s_a")), "a").join(full.select(F.col("id").alias("b"), F.col("s").alias("s_b")), "b")
    return materialise(joined.select("a", "b", "s_a", "s_b").mapInPandas(run, "a long, b long"))


def _of_many(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    apart = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    return members.join(apart, "key", "left_semi")


def _linkable(ids: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, c0, c1, ...): ids that can have a link into another component, with set size and shared shingles.

    What a document shares with one of another component is among its shingles that any other
    component holds; if those are fewer than ``percent`` of its set, no such link exists. They are
    counted by kind, that is by how many documents hold them (SHARED_BY). ``ids``: (id, component).
    """
    ids = _checked(materialise(ids))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, found in _sets(pdf, size):
                n = [len(s) for s in found]
                yield pd.DataFrame({"id": np.repeat(ids, n), "n": np.repeat(n, n), "s": np.concatenate(found).view(np.int64)})

    rows = docs.join(ids, "id", "left_semi").mapInPandas(each, "id long, n long, s long").join(ids, "id")
    kind = sum((F.col("d") > most).cast("int") for most in SHARED_BY)
    shared = rows.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("d")).where("x <> y").select("s", kind.alias("kind"))
    by_kind = [F.count_if(F.col("kind") == i).alias(f"c{i}") for i in range(len(SHARED_BY) + 1)]
    counts = rows.join(shared, "s").groupBy("id").agg(F.max("n").alias("n"), F.count("*").alias("c"), *by_kind)
    return counts.where(F.col("c") * 100 >= F.col("n") * percent).drop("c")


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): the components of documents linked by Jaccard similarity >= percent / 100."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    signed = materialise(_signed(docs, shingle))
    same = ["k1", "k2", "n"]
    classes = materialise(signed.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    # the text of a class is that of its smallest document
    keyed = _keyed(classes)

    # only buckets that several classes share matter; a class that shares many with many stands amid its group, and
    # links to it are likelier than to any other: it represents its buckets, and each class meets the one of its
    # buckets' representatives that stands most amid first. So a large group is mostly one component before the
    # other buckets are looked at: what they then still compare lies in two components
    crowded = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = materialise(keyed.select("key", "id").join(crowded, "key"))
    ranked = shared.select("key", "id").join(shared.groupBy("id").agg(F.sum("c").alias("w")), "id")
    central = ranked.groupBy("key").agg(F.max(F.struct("w", (-F.col("id")).alias("o"))).alias("m"))
    stars = materialise(shared.join(central, "key").select((-F.col("m.o")).alias("a"), F.col("id").alias("b"), "m.w").where("a <> b").distinct())
    nearest = stars.groupBy("b").agg(F.max_by("a", F.struct("w", (-F.col("a")).alias("o"))).alias("a"))
    links = _confirmed(_near(nearest.select("a", "b"), classes), docs, shingle, percent)
    early = materialise(components(links))
    side = lambda x: early.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    apart = stars.join(nearest, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = apart.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    later = _confirmed(_near(apart, classes), docs, shingle, percent)
    links = links.union(later)
    joined = early if later.isEmpty() else materialise(components(links))

    grouped = keyed.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = materialise(_of_many(grouped))
    linkable = materialise(_linkable(members.select("id", "component").distinct(), docs, shingle, percent))
    # written before it meets itself: unwritten, its joins would stand four times in one plan, all of which the driver holds
    members = materialise(_of_many(members.join(linkable, "id")).join(classes.select("id", "sig"), "id"))
    kinds = range(len(SHARED_BY) + 1)
    left = members.selectExpr("key", "place", "sig AS u", "id AS a", "component AS x", "n AS n_a", *[f"c{i} AS a{i}" for i in kinds], *[f"p{i} AS x{i}" for i in range(PLANES)])
    right = members.selectExpr("key", "sig AS v", "id AS b", "component AS y", "n AS n_b", *[f"c{i} AS b{i}" for i in kinds], *[f"p{i} AS y{i}" for i in range(PLANES)])
    # of each kind of shingles two documents have at most the lesser number in common
    common = " + ".join(f"least(a{i}, b{i})" for i in kinds)
    possible = F.expr(f"{100 + percent} * ({common}) >= {percent} * (n_a + n_b)")
    close = F.expr(f"bit_count({' | '.join(f'(x{i} ^ y{i})' for i in range(PLANES))}) <= {THRESHOLD}")
    first = F.expr(first_shared("place", "u", "v"))
    cross = left.join(right, "key").where((F.col("x") < F.col("y")) & possible & close & first).select("a", "b").distinct()
    more = _confirmed(_near(cross, classes), docs, shingle, percent)

    # a document of a class stands in its class's component
    roots = (joined if more.isEmpty() else components(links.union(more))).withColumnRenamed("node", "id")
    by_class = classes.join(roots, "id", "left").select("k1", "k2", "n", F.coalesce("component", "id").alias("component"))
    found = signed.select("id", "n", "k1", "k2").join(by_class, same, "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
