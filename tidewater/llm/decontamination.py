"""Benchmark decontamination with a generalised suffix automaton.

The items' normalised words (letters, digits and all that isn't ASCII, A-Z lowered) are built
into one suffix automaton: a state stands for all word sequences that end at the same places
of the items. The corpus streams through it word by word; the state and the length of the
longest match that ends at a word say which windows end there: where the match is ``window``
words or more, the state's ancestor that holds the last ``window`` words names the items; an
item of fewer words is one window, and its end is a state that the suffix links lead to.

Stretches in which no match can reach the shortest window are passed over in numpy: a match
of m words needs m words in a row of the items' vocabulary whose neighbours are neighbours in
an item. Everything else goes through the automaton, whole texts, whatever their length.

Items go in blocks of ``BLOCK_WORDS`` words (by hash of the item), each with an automaton of
its own that is broadcast; with more than one block the corpus is streamed once for each and
the findings of a row are merged.

Defined results: null, empty and wordless texts have no words and stay; items without words
have no windows; rows that stand twice are judged each; equal items all count; an item that
stands in several rows is one item by its id (a null id is written empty); without items or
documents nothing is found; other columns are ignored by ``find_overlaps`` and kept by
``decontaminate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_text
from .words import ALPHANUMERIC, Vocabulary, Words, find_words, mixed, slices, utf8, word_lists

#: Words of the items in one automaton (some 100 MB in a Python worker).
BLOCK_WORDS = 400_000
#: Text bytes that are worked on at once.
SLICE_BYTES = 12 << 20


class SuffixAutomaton:
    """The generalised suffix automaton of word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary = Vocabulary([w for _, words in items for w in words])
        self.window, self.base = window, max(1, len(self.vocabulary.words))
        number = {w: i for i, w in enumerate(self.vocabulary.words)}
        self.step: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        self._arcs: list[list[int]] = [[]]  # the words that lead on from a state, to copy them when it is split
        names = sorted({name for name, _ in items})
        rank = {name: i for i, name in enumerate(names)}
        self.names = names
        ends: list[tuple[int, int, int]] = []
        pairs = set()
        self.shortest = window
        for name, words in items:
            sequence = [number[w] for w in words]
            last = 0
            for i, w in enumerate(sequence):
                last = self._append(last, w)
                if i + 1 >= min(window, len(sequence)):
                    ends.append((last, min(window, len(sequence)), rank[name]))
                if i:
                    pairs.add(sequence[i - 1] * self.base + w)
            if sequence:
                self.shortest = min(self.shortest, len(sequence))
        del self._arcs
        self._name_windows(ends)
        self._pair_bits = np.uint64(64 - max(16, len(pairs).bit_length() + 4))
        self.pairs = np.zeros(1 << (64 - int(self._pair_bits)), bool)
        self.pairs[self._slot(np.array(sorted(pairs), np.int64))] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._pair_bits).astype(np.int64)

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self._arcs.append([])
        return len(self.length) - 1

    def _lead(self, state: int, w: int, to: int) -> None:
        self.step[state * self.base + w] = to
        self._arcs[state].append(w)

    def _split(self, state: int, w: int, old: int) -> int:
        """A state for the words of ``old`` up to those that ``state`` and ``w`` make."""
        new = self._state(self.length[state] + 1)
        for x in self._arcs[old]:
            self.step[new * self.base + x] = self.step[old * self.base + x]
        self._arcs[new] = [*self._arcs[old]]
        self.link[new], self.link[old] = self.link[old], new
        while state >= 0 and self.step.get(state * self.base + w) == old:
            self.step[state * self.base + w] = new
            state = self.link[state]
        return new

    def _append(self, last: int, w: int) -> int:
        """The state of the sequence that stands at ``last`` and goes on with ``w``."""
        there = self.step.get(last * self.base + w)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        new, state = self._state(self.length[last] + 1), last
        while state >= 0 and (state * self.base + w) not in self.step:
            self._lead(state, w, new)
            state = self.link[state]
        if state >= 0:
            there = self.step[state * self.base + w]
            self.link[new] = there if self.length[there] == self.length[state] + 1 else self._split(state, w, there)
        return new

    def _name_windows(self, ends: list[tuple[int, int, int]]) -> None:
        """For each state the one that holds its last ``window`` words, and the nearest end of a short item."""
        n = len(self.length)
        self.whole, self.short = [-1] * n, [-1] * n
        self.items: dict[int, set[int]] = {}
        shorts: set[int] = set()
        for state, size, item in ends:
            # a whole short item is the longest sequence of its state; a window belongs to an ancestor
            at = state
            while at and self.length[self.link[at]] >= size:
                at = self.link[at]
            self.items.setdefault(at, set()).add(item)
            if size < self.window:
                shorts.add(at)
        for state in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[state]
            self.short[state] = state if state in shorts else self.short[up]
            if self.length[state] >= self.window:
                self.whole[state] = state if self.length[up] < self.window else self.whole[up]

    def windows(self, sequence: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(last word, words, state, length of the match) of each window that occurs in a run of numbered words."""
        step, link, length, whole, short = self.step, self.link, self.length, self.whole, self.short
        base, window, state, matched = self.base, self.window, 0, 0
        for i, w in enumerate(sequence):
            to = step.get(state * base + w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step.get(state * base + w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                yield i, window, whole[state], matched
            at = short[state] if matched == length[state] else short[link[state]]
            while at > 0:
                yield i, length[at], at, matched
                at = short[link[at]]


class Findings:
    """What the automaton finds in a slice of texts: hit words, and items and the longest match of each row."""

    def __init__(self, automaton: SuffixAutomaton, words: Words):
        self.words = words
        n = len(words.start)
        ids = automaton.vocabulary.ids(words).astype(np.int64)
        known = ids >= 0
        joined = np.zeros(n, bool)
        if n > 1:
            at = np.flatnonzero(known[:-1] & known[1:] & (words.row[:-1] == words.row[1:]))
            joined[at] = automaton.pairs[automaton._slot(ids[at] * automaton.base + ids[at + 1])]
        before = np.zeros(n, bool)
        before[1:] = joined[:-1]
        first, last = np.flatnonzero(known & ~before), np.flatnonzero(known & ~joined)
        some = last - first + 1 >= automaton.shortest
        steps = np.zeros(n + 1, np.int64)
        self.items: dict[int, set[int]] = {}
        self.longest: dict[int, int] = {}
        for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True):
            row = int(words.row[a])
            for i, size, state, matched in automaton.windows(ids[a : b + 1].tolist()):
                steps[a + i + 1 - size] += 1
                steps[a + i + 1] -= 1
                self.items.setdefault(row, set()).update(automaton.items[state])
                self.longest[row] = max(self.longest.get(row, 0), matched)
        self.hit = steps.cumsum()[:n] > 0
        self.n_hit = np.bincount(words.row[self.hit], minlength=len(words.counts))

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, last word + 1) of each stretch of hit words, as word positions in the slice."""
        n, row = len(self.hit), self.words.row
        same = np.zeros(n, bool)
        same[1:] = self.hit[1:] & self.hit[:-1] & (row[1:] == row[:-1])
        first = np.flatnonzero(self.hit & ~same)
        last = np.flatnonzero(self.hit & ~np.append(same[1:], False)) if n else first
        return row[first], first, last + 1


FOUND = "n_words long, n_hit long, longest long, items array<string>, spans array<struct<start:long,end:long>>"


def _found_columns(automaton: SuffixAutomaton, texts: pa.Array) -> list[pa.Array]:
    found = Findings(automaton, find_words(texts, ALPHANUMERIC))
    rows = range(len(texts))
    start = np.concatenate([[0], found.words.counts.cumsum()])
    spans: dict[int, list[dict]] = {}
    for row, a, b in zip(*(x.tolist() for x in found.spans()), strict=True):
        spans.setdefault(row, []).append({"start": int(a - start[row]), "end": int(b - start[row])})
    return [
        pa.array(found.words.counts, pa.int64()),
        pa.array(found.n_hit, pa.int64()),
        pa.array([found.longest.get(r, 0) for r in rows], pa.int64()),
        pa.array([sorted(automaton.names[i] for i in found.items.get(r, ())) for r in rows], pa.list_(pa.string())),
        pa.array([spans.get(r, []) for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]


def automata(items: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[SuffixAutomaton]:
    """An automaton for each block of items; of the items' words only a block's reach the driver at a time."""
    own = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), whole_text(text_col).alias("text"))
    n_words = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(n_words / 6 / BLOCK_WORDS))
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        held = word_lists([r["text"] for r in rows])
        yield SuffixAutomaton([(r["item"], words) for r, words in zip(rows, held, strict=True) if words], window)


def find_overlaps(df: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document: (id, n_words, n_hit, longest, items, spans).

    ``spans`` are ranges of word positions inside occurrences of windows, ``items`` the ids of the items whose
    windows occur (sorted as strings), ``longest`` the words of the longest match that reaches a window.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    built = list(automata(items, window, item_col, item_text_col))

    def scan(docs: DataFrame, automaton: SuffixAutomaton, id_type: str) -> DataFrame:
        held = spark.sparkContext.broadcast(automaton)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, 1, SLICE_BYTES):
                    yield pa.RecordBatch.from_arrays([some.column(0), *_found_columns(held.value, some.column(1))], ["id", "n_words", "n_hit", "longest", "items", "spans"])

        return docs.mapInArrow(find, f"id {id_type}, {FOUND}")

    if len(built) == 1:
        return scan(own, built[0], id_type).withColumnRenamed("id", id_col)
    # rows may share ids: each has a number of its own while its findings are brought together
    rows = materialise(own.withColumn("row", F.monotonically_increasing_id()))
    numbered = rows.select(F.col("row").alias("id"), "text")
    first, *others = (scan(numbered, automaton, "long") for automaton in built)
    for other in others:
        first = first.unionByName(other.where("n_hit > 0"))
    merged = first.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.max("longest").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    # stretches that touch or overlap become one
    joined = F.expr(
        "aggregate(spans, cast(array() AS array<struct<start:long,end:long>>), (done, x) -> if(size(done) > 0 AND try_element_at(done, -1).end >= x.start,"
        " concat(slice(done, 1, size(done) - 1), array(named_struct('start', try_element_at(done, -1).start, 'end', greatest(try_element_at(done, -1).end, x.end)))), concat(done, array(x))))"
    )
    merged = merged.withColumn("spans", joined).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)"))
    found = merged.join(rows.select("row", F.col("id").alias(id_col)), F.col("id") == F.col("row"))
    return found.select(id_col, "n_words", "n_hit", "longest", "items", "spans")


def decontaminate(df: DataFrame, items: DataFrame, window: int = 10, longest: int | None = None, coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, without what stands in the items.

    Hit stretches of ``longest`` words (default: all) and more are cut out of the text; a document of which
    more than ``coverage`` of the words are hit goes as a whole. With several blocks of items each is judged on
    what the blocks before have left.
    """
    spark, at, least = df.sparkSession, df.columns.index(text_col), longest or 0
    for automaton in automata(items, window, item_col, item_text_col):
        held = spark.sparkContext.broadcast(automaton)

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in slices(batch, at, SLICE_BYTES):
                    words = find_words(some.column(at), ALPHANUMERIC)
                    found = Findings(held.value, words)
                    cuts: dict[int, list[tuple[int, int]]] = {}
                    for row, a, b in zip(*(x.tolist() for x in found.spans()), strict=True):
                        if b - a >= least:
                            cuts.setdefault(row, []).append((int(words.start[a]), int(words.end[b - 1])))
                    if cuts:
                        texts = some.column(at).to_pylist()
                        data, begin = utf8(some.column(at))
                        for row, spans in cuts.items():
                            ends = [int(begin[row]), *(x for span in spans for x in span), int(begin[row + 1])]
                            texts[row] = b"".join(data[a:b].tobytes() for a, b in zip(ends[::2], ends[1::2], strict=True)).decode()
                        some = some.set_column(at, some.schema.field(at), pa.array(texts, some.schema.field(at).type))
                    yield some.filter(pa.array(found.n_hit <= coverage * words.counts))

        df = df.mapInArrow(clean, df.schema)
    return df

