"""Words of Arrow string columns as numpy arrays, without a Python object a word.

The operators that stream all words of the corpus (collocations, decontamination, search)
read UTF-8 bytes straight from the Arrow buffers. All separators are ASCII, so bytes can be
classed one by one. A word is a pair of byte positions and a 64-bit hash; hashes only select,
the bytes decide (``Vocabulary.ids``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once (a longer word is taken whole).
BLOCK = 1 << 19
WORD, BREAK, CUT = 0, 1, 2

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_code = (LOWER.astype(np.uint64) + np.uint64(0x51)) * np.uint64(0xD6E8FEB86659FD93)
_tables: list[np.ndarray] = []


def byte_kinds(breaks: bytes, cuts: bytes = b"") -> np.ndarray:
    """The kind of each byte: ``breaks`` end words, ``cuts`` end words and pieces, the others are words'."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(breaks)] = BREAK
    kinds[list(cuts)] = CUT
    return kinds


#: Letters, digits and all that isn't ASCII.
ALPHANUMERIC = byte_kinds(bytes(b for b in range(128) if not chr(b).isalnum()))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, BLOCK) + 1
        _tables[:] = [np.full(size, b, np.uint64).cumprod(dtype=np.uint64) * np.uint64(pow(b, -1, 1 << 64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _tables if n <= BLOCK + 1 else [t[: n + 1] for t in _tables]


@dataclass
class Words:
    """The words of a batch of texts: byte positions in ``data``, hashes, the row of each, and where pieces begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    fresh: np.ndarray  # the word is the first one of its piece
    counts: np.ndarray  # words of each row


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins and ends; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text (a longer text is a run of its own)."""
    at = utf8(batch.column(column))[1]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def _blocks(data: np.ndarray, kinds: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Ranges that end behind a byte that is no word's, of about ``BLOCK`` bytes."""
    while low < high:
        end = min(low + BLOCK, high)
        while end < high:
            breaks = np.flatnonzero(kinds[data[low:end]])
            if len(breaks):
                end = low + int(breaks[-1]) + 1
                break
            end = min(end + BLOCK, high)
        yield low, end
        low = end


def find_words(texts: pa.Array, kinds: np.ndarray) -> Words:
    """All words of all rows. Words never reach over rows."""
    data, at = utf8(texts)
    rows = np.zeros(0, bool)
    parts: list[tuple[np.ndarray, ...]] = []
    for low, high in _blocks(data, kinds, int(at[0]), int(at[-1])):
        block = data[low:high]
        kind = kinds[block]
        word = kind == WORD
        begins = at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        before[begins] = False
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        after[begins[begins > 0] - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        up, down = _powers(high - low)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_code[block] * up[: high - low], out=sums[1:])
        hashes = mixed((sums[end] - sums[start]) * down[start])
        cut = kind == CUT
        cuts = np.cumsum(cut, dtype=np.int32)[start] if cut.any() else np.zeros(len(start), np.int32)
        fresh = np.ones(len(start), bool)
        fresh[1:] = cuts[1:] != cuts[:-1]
        if low > at[0] and parts and len(start):  # was there a cut since the last word of the block before?
            last = parts[-1][1][-1] if len(parts[-1][1]) else int(at[0])
            fresh[0] = bool((kinds[data[last : low + start[0]]] == CUT).any())
        parts.append((start + low, end + low, hashes, fresh))
        if not len(start):
            parts.pop()
    if parts:
        start, end, hashes, fresh = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        start = end = np.zeros(0, np.int64)
        hashes, fresh = np.zeros(0, np.uint64), rows
    firsts = np.searchsorted(start, at)
    counts = np.diff(firsts)
    row = np.repeat(np.arange(len(counts)), counts)
    fresh[firsts[:-1][counts > 0]] = True
    return Words(data, start, end, hashes, row, fresh, counts)


def lowered(data: np.ndarray, start: int, end: int) -> bytes:
    return LOWER[data[start:end]].tobytes()


def word_lists(texts: list[str], kinds: np.ndarray = ALPHANUMERIC) -> list[list[bytes]]:
    """The lowered words of each of some texts."""
    words = find_words(pa.array(texts, pa.string()), kinds)
    flat = [lowered(words.data, a, b) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
    ends = words.counts.cumsum().tolist()
    return [flat[b - n : b] for b, n in zip(ends, words.counts.tolist(), strict=True)]


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each word, lowered, equals ``size`` bytes of ``other`` from ``at``. Work goes by word length."""
    length = end - start
    equal = length == size
    order = np.flatnonzero(equal)
    order = order[np.argsort(length[order], kind="stable")]
    lengths, firsts = np.unique(length[order], return_index=True)
    for n, rows in zip(lengths.tolist(), np.split(order, firsts[1:]), strict=False):
        for some in np.array_split(rows, 1 + len(rows) * n // (4 * BLOCK)):
            wide = np.arange(n)
            equal[some] = (LOWER[data[start[some, None] + wide]] == other[at[some, None] + wide]).all(axis=1)
    return equal


class Vocabulary:
    """A set of lowered words, numbered in their sorted order, that finds a batch's words."""

    def __init__(self, words: list[bytes]):
        self.words = sorted(set(words))
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)
        size = np.array([len(w) for w in self.words], np.int64)
        end = size.cumsum()
        self.at, self.size = end - size, size
        hashes = find_words(pa.array([w.decode() for w in self.words], pa.string()), np.zeros(256, np.uint8)).hash
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        # a table of twice the size by the leading bits says quickly that a word isn't there
        self.bits = np.uint64(64 - max(12, len(self.words).bit_length() + 4))
        self.seen = np.zeros(1 << (64 - int(self.bits)), bool)
        self.seen[(hashes >> self.bits).astype(np.int64)] = True
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two words share a 64-bit hash")

    def ids(self, words: Words) -> np.ndarray:
        """The number of each word, -1 for those that are not in the vocabulary."""
        out = np.full(len(words.start), -1, np.int32)
        if not len(self.words):
            return out
        maybe = np.flatnonzero(self.seen[(words.hash >> self.bits).astype(np.int64)])
        place = np.searchsorted(self.hashes, words.hash[maybe])
        place[place == len(self.hashes)] = 0
        hit = self.hashes[place] == words.hash[maybe]
        maybe, found = maybe[hit], self.order[place[hit]]
        same = same_bytes(words.data, words.start[maybe], words.end[maybe], self.bytes, self.at[found], self.size[found])
        out[maybe[same]] = found[same]
        return out
