"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring byte symbols that never stand side by side inside any
vocabulary token can never be merged across, so the place between them is a
certain cut. Each pre-token is cut at all such places, the fragments are encoded
on their own, and the ids are concatenated: the result is that of merging the
whole pre-token.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows give repeated results; texts of any length are encoded whole (long
fragments use a heap, O(n log n)); columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Entries an encoder keeps of each kind before it starts afresh; bounds a worker's memory.
CACHE = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(0x100 + next(rest)) for b in range(256)]


class Encoder:
    """Encodes and decodes with a ``tokenizers`` BPE file that marks word ends.

    White-space chunks, pre-tokens and fragments repeat a lot, so each level keeps a
    bounded memo of what it has encoded; a memo never changes a result.
    """

    def __init__(self, path: str, library_merges: bool = False):
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.pairs = {self.vocab[a] << 32 | self.vocab[b]: rank for (a, b), rank in self.ranks.items()}
        self.merged, self.none = [self.vocab[a + b] for a, b in pairs], len(pairs)
        self.by_id = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.added_start = next(iter({a[:2] for a in self.added}), "")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        # the library's own steps, for characters on which Unicode versions may differ
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.pre_tokenizer = pre_tokenizers.Split(Regex(split), "removed", invert=True)
        self.library = Tokenizer.from_file(path).model if library_merges else None
        self.symbol = byte_symbols()
        # one-character tokens are symbols themselves; a token's inner pairs are never forced boundaries
        self.joined = {t[i : i + 2] for token in self.vocab for t in [token.removesuffix(self.suffix)] for i in range(len(t) - 1)}
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.chunks: dict[bytes, bytes] = {}

    # -- splitting -----------------------------------------------------------------
    def cuts(self, symbols: str) -> list[str]:
        """The fragments between forced boundaries."""
        out, start = [], 0
        pairs = list(map(str.__add__, symbols, symbols[1:]))
        if self.joined.issuperset(pairs):
            return [symbols]
        for i, pair in enumerate(pairs, 1):
            if pair not in self.joined:
                out.append(symbols[start:i])
                start = i
        out.append(symbols[start:])
        return out

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without white space, normalised."""
        if text.isascii():
            return [text.lower()] if text.isalpha() else self.split.findall(text.lower())
        if max(text) < "ɐ" and "İ" not in text:
            return self.split.findall(unicodedata.normalize("NFC", text).lower())
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    # -- merging -------------------------------------------------------------------
    def fragment(self, symbols: str, last: bool) -> tuple[int, ...]:
        """Ids of one fragment; ``last``: it ends its pre-token."""
        found = self.fragments.get((symbols, last))
        if found is None:
            parts = list(symbols)
            if last:
                parts[-1] += self.suffix
            if last and self.library is not None:
                found = tuple([t.id for t in self.library.tokenize(symbols)])
            else:
                found = self._merge(parts) if len(parts) <= 48 else self._merge_long(parts)
            if len(self.fragments) >= CACHE:
                self.fragments.clear()
            self.fragments[symbols, last] = found
        return found

    def _merge(self, parts: list[str]) -> tuple[int, ...]:
        get, none = self.pairs.get, self.none
        ids = [self.vocab[p] for p in parts]
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            ids[i] = self.merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return tuple(ids)

    def _merge_long(self, parts: list[str]) -> tuple[int, ...]:
        n, get = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else -1
            if j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return tuple(self.vocab[p] for p in parts if p)

    # -- texts ---------------------------------------------------------------------
    def _plain(self, text: str) -> list[int]:
        ids: list[int] = []
        symbol = self.symbol
        for token in self.pre_tokens(text):
            known = self.fragments.get((token, True)) if token.isascii() else None
            if known is not None:
                ids += known
                continue
            symbols = token if token.isascii() and token.isprintable() else "".join([symbol[b] for b in token.encode()])
            *inner, end = self.cuts(symbols)
            for part in inner:
                ids += self.fragment(part, False)
            ids += self.fragment(end, True)
        return ids

    def chunk(self, raw: bytes) -> bytes:
        """Little-endian 32-bit ids of a run without ASCII white space."""
        text, ids = raw.decode(), []
        if self.added_pattern is not None and self.added_start in text:
            for part in self.added_pattern.split(text):
                ids += [self.added[part]] if part in self.added else self._plain(part)
        else:
            ids = self._plain(text)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= 64:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            self.chunks[raw] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        get, chunk = self.chunks.get, self.chunk
        return b"".join([get(raw) or chunk(raw) for raw in text.encode().split()])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: the tokens, a space between them; unknown ids are skipped."""
        return " ".join([t for t in map(self.by_id.get, ids) if t is not None])


@lru_cache(maxsize=4)
def encoder(path: str, library_merges: bool = False) -> Encoder:
    """One encoder per worker process and file; ``library_merges``: the tokenizers library merges the fragments that end a pre-token."""
    return Encoder(path, library_merges)


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            ids = [np.frombuffer(enc.encode_bytes(t), "<u4").astype("i4") for t in batch["text"].to_pylist()]
            decoded = [enc.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    source = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return source.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ``encode_documents`` reduced to digests inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch["text"].to_pylist():
                raw = enc.encode_bytes(text)
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(enc.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
