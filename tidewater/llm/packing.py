"""Best-fit packing of tokenised documents into fixed-length sequences.

The tasks turn documents into pieces of at most ``capacity`` tokens; only the histogram
of piece lengths (at most ``capacity`` counts for each of ``BUCKETS`` buckets, whatever
the input) reaches the driver. There the configuration linear program - how often to use
each way of filling a sequence so that every length is served - is solved by
multiplicative weights: lengths that are served too little gain weight, and a knapsack
dynamic program prices the best configurations under the weights. The fractional solution
is rounded down as far as the counts allow, and the program is solved again for the lengths
left over, until it places little more; lengths that fill no sequence exactly get
configurations with waste, and best fit decreasing takes the rest. The plan is a list of runs "this configuration,
repeated n times", so its size does not follow the input; tasks look up the place of the
r-th piece of a length in it.

Defined results: a null text is an empty document (the end token alone); repeated rows
are packed each on their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import hold, materialise, whole_text

#: Ranks within a length are dealt out in so many buckets, so that a frequent length is no single group.
BUCKETS = 64


def tokenised_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, bucket): documents, an end token after each, cut where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("packing", encoder.cache_clear)
        enc, end = encoder(tokenizer_path, library_merges=True), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                raw = enc.encode_bytes(text) + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["id", "piece", "start", "length", "ids_crc32"])

    source = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    pieces = source.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))


def priced(weight: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack dynamic program: the highest value of pieces of weights ``weight`` in every room 0..capacity."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max((best[:c][::-1] + weight[:c]).max(), best[c - 1])
    return best


def configuration(first: int, best: np.ndarray, weight: np.ndarray, capacity: int, waste: bool = False) -> dict[int, int] | None:
    """Length to copies: ``first`` and the best filling of the room beside it; None if that does not fill the sequence.

    With ``waste`` room that no length is worth anything in stays empty.
    """
    used, c = {first: 1}, capacity - first
    while c > 0:
        k = int((best[:c][::-1] + weight[:c]).argmax()) + 1
        if waste and best[c - 1] >= best[c - k] + weight[k - 1]:
            c -= 1
            continue
        if weight[k - 1] == -np.inf:
            return None
        used[k] = used.get(k, 0) + 1
        c -= k
    return used


def fractional(counts: np.ndarray, capacity: int, batches: int, step: float, waste: bool = False) -> list[tuple[dict[int, int], float]]:
    """The configuration linear program by multiplicative weights: (configuration, how often), all of them full unless ``waste``.

    Lengths are taken from the longest on, in ``batches``. A knapsack prices what the room beside a
    piece can hold, and the best configuration is used until something in it is served; weights then
    fall by the share of their demand that was served, to nothing at the whole, and the next
    configuration is priced. At the optimum weights are as the lengths (the volume bound's dual
    values), so that small changes steer; the power a little over one prefers few long pieces.
    """
    sizes, need = np.arange(1, capacity + 1), counts.astype(float)
    start, demand, out = sizes**1.0001, np.maximum(need, 1), []
    weight = np.where(need > 0, start, -np.inf)
    for group in np.array_split(np.flatnonzero(counts)[::-1] + 1, batches):
        best = priced(weight, capacity)
        for first in group.tolist():
            while need[first - 1] > 1e-9:
                config = configuration(first, best, weight, capacity, waste)
                if config is None:
                    break
                often = min(need[k - 1] / n for k, n in config.items())
                for k, n in config.items():
                    need[k - 1] -= n * often
                    weight[k - 1] *= 1 - step * min(n * often / demand[k - 1], 1)
                    if need[k - 1] <= 1e-9:
                        weight[k - 1] = -np.inf
                out.append((config, often))
    return out


Runs = list[tuple[dict[int, int], int]]


def solve(counts: np.ndarray, capacity: int, rounds: int = 4, batches: int = 16, step: float = 1e-3) -> Runs:
    """Runs (length to copies, repeats) that use every piece of the histogram ``counts`` exactly once.

    ``rounds`` is how often at most the linear program is solved and rounded, ``batches`` the prices
    worked out in each, ``step`` the learning rate of the weights. Full configurations come first; what has
    none is put to the program once more with waste allowed, and to best fit alone, and the shorter plan stays.
    """
    left, runs = counts.astype(np.int64).copy(), []

    def place(config: dict[int, int], n: int, into: Runs, left: np.ndarray) -> int:
        n = min(n, *[int(left[k - 1]) // m for k, m in config.items()])
        if n > 0:
            for k, m in config.items():
                left[k - 1] -= m * n
            into.append((config, n))
        return max(n, 0)

    place({capacity: 1}, int(left[capacity - 1]), runs, left)  # a piece of the whole capacity has only one configuration
    for round_ in range(rounds):
        before = int(left.sum())
        if not before:
            break
        for config, often in fractional(left, capacity, batches, step):
            # a share of one counts as one from the second round on, where the counts are small
            place(config, int(often) if round_ == 0 else max(int(often), 1), runs, left)
        if round_ and before - left.sum() < 0.02 * before:
            break

    rest, loose = left.copy(), []
    for config, often in fractional(left, capacity, batches, step, waste=True):
        place(config, int(often), loose, rest)
    plans = [loose + best_fit(rest, capacity), best_fit(left, capacity)]
    return runs + min(plans, key=lambda plan: sum(n for _, n in plan))


def best_fit(counts: np.ndarray, capacity: int) -> Runs:
    """Best fit decreasing: each piece goes to the fullest sequence that has room.

    Equal sequences are one entry with a count, so the work follows the lengths and not the pieces: of n pieces of a
    length each of the fullest sequences that have room takes as many as fit, one after the other.
    """
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}  # room left: sequences
    rooms: list[int] = []  # in order

    def put(config: dict[int, int], n: int, room: int) -> None:
        if room not in bins:
            bisect.insort(rooms, room)
            bins[room] = []
        bins[room].append((config, n))

    for length in (np.flatnonzero(counts)[::-1] + 1).tolist():
        n = int(counts[length - 1])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                config, there = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room, config, there = capacity, {}, n  # new sequences
            each = room // length
            whole, rest = min(there, n // each), 0
            if whole:
                put(config | {length: config.get(length, 0) + each}, whole, room - each * length)
            elif n:
                rest = 1
                put(config | {length: config.get(length, 0) + n}, 1, room - n * length)
                whole, each = 0, n
            n -= whole * each if whole else each
            if config and there - whole - rest:
                put(config, there - whole - rest, room)
    return [run for room in rooms for run in bins[room]]


def lookup(runs: Runs, capacity: int) -> dict[str, np.ndarray]:
    """The plan by length: for each run in which a length stands, the rank it begins at, the copies in each
    sequence, its first sequence and the place of its first copy; ``first[l]`` is where length l begins."""
    rows, sequence, rank = [], 0, np.zeros(capacity + 1, np.int64)
    for config, n in runs:
        place = 0
        for length in sorted(config, reverse=True):
            rows.append((length, rank[length], config[length], sequence, place))
            rank[length] += config[length] * n
            place += config[length] * length
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "copies": table[:, 2], "sequence": table[:, 3], "place": table[:, 4], "first": np.searchsorted(table[:, 0], np.arange(capacity + 2))}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds (sequence_id, offset) to ``tokenised_pieces``; reads ``pieces`` twice, so give a written table."""
    spark = pieces.sparkSession
    # bounded by capacity * BUCKETS rows of two small numbers
    rows = pieces.groupBy("length", "bucket").count().collect()
    by = np.zeros((capacity + 1, BUCKETS), np.int64)
    for r in rows:
        by[r["length"], r["bucket"]] = r["count"]
    before = np.concatenate([np.zeros((capacity + 1, 1), np.int64), by.cumsum(1)[:, :-1]], 1)
    plan = spark.sparkContext.broadcast((before, lookup(solve(by.sum(1)[1:], capacity), capacity)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, p = plan.value
        for pdf in batches:
            length = pdf["length"].to_numpy(np.int64)
            rank = start[length, pdf["bucket"].to_numpy(np.int64)] + pdf.pop("rank").to_numpy(np.int64)
            # ranks of a length ascend within its rows of the plan: one search over (length, rank)
            big = np.int64(1) << 44
            row = np.searchsorted(p["length"] * big + p["rank"], length * big + rank, "right") - 1
            nth = rank - p["rank"][row]
            copies = p["copies"][row]
            yield pdf.assign(sequence_id=p["sequence"][row] + nth // copies, offset=p["place"][row] + nth % copies * length).drop(columns="bucket")

    order = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.mapInPandas(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for all documents of ``df``."""
    pieces = materialise(tokenised_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col))
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
