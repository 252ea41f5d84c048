"""Phrase collocations through weighted acyclic automata.

An n-gram is a path (language, first word, second word, ...) of an acyclic automaton whose
states carry counts. Each shard (a slice of an Arrow batch) sorts its n-grams and builds its
transducer level by level: a state is (state of the words before, next word), so equal
prefixes are one path. The transducers are cut by prefix range (the first two words), dealt,
and united range by range, the weights of equal paths summed. Parts of a phrase are looked up
by composing the sorted candidates with the counts: along a candidate's own path stand the
counts of all its beginnings, along its path in the reversed automaton those of all its ends.

Only n-grams that can reach ``min_count`` are built. An n-gram occurs no more often than any
part of it, so two passes over the corpus first count hashes of words and of word pairs; those
that reach the threshold set a bit in a filter of fixed size (``FILTER_BITS``, the only thing
that passes through the driver). A hash counts at least what its words count and a bit may be
set by others, so the filters never lose an n-gram; the final counts are exact, on the bytes
of the words.

Everything is per language. Prefix ranges and hash ranges grow in number with the corpus, so a
task's memory does not. Hot first words are dealt by their second word as well.

Defined results: a null language is ``und``; null, empty and blank texts have no words; rows
that stand twice count twice; an empty table gives no rows; ties rank by count, then phrase
(bytes); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, whole_text
from .words import Words, byte_kinds, find_words, lowered, mixed, same_bytes, slices

#: Words stand between spaces and tabs; these marks and line ends cut pieces.
PIECES = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Bits of each filter (16 MB), whatever the corpus.
FILTER_BITS = 27
#: Text bytes of a shard.
SHARD_BYTES = 8 << 20
#: Text bytes of the corpus for each range that hashes and prefixes are dealt in.
RANGE_BYTES = 12 << 20
#: Parts that the paths of one first (or last) word are dealt in.
SALTS = 8


def ranges_of(n_bytes: int) -> int:
    """How many bits of a hash tell ranges apart (at least 64 ranges), by the texts' bytes."""
    return min(22, max(6, math.ceil(math.log2(max(1, n_bytes / RANGE_BYTES)))))


def salt_of(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Shard:
    """A shard's words with hashes that tell languages apart, and its word pairs."""

    def __init__(self, batch: pa.RecordBatch):
        self.words: Words = find_words(batch.column(1), PIECES)
        lang = batch.column(0).dictionary_encode()
        self.langs: list[str] = lang.dictionary.to_pylist()
        self.lang = lang.indices.to_numpy(zero_copy_only=False)[self.words.row] if len(self.words.row) else np.zeros(0, np.int64)
        salts = np.array([salt_of(x) for x in self.langs], np.uint64)
        self.hash = self.words.hash ^ salts[self.lang] if len(self.langs) else self.words.hash
        self.hash = mixed(self.hash)

    def pairs(self) -> np.ndarray:
        """Hash of each word and the next one."""
        return mixed(self.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hash[1:])

    def joined(self) -> np.ndarray:
        """Whether the next word is of the same piece."""
        return ~self.words.fresh[1:]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for some in slices(batch, 1, SHARD_BYTES):
            shard = Shard(some)
            if len(shard.hash):
                yield shard


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


# -- which n-grams can reach the threshold ------------------------------------------------
TALLY = "slot long, lang string, n long, hashes binary, counts binary"


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed bytes, those of equal weight together."""
    raw = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(raw, "zstd", asbytes=True) if raw else b""


def unpacked(data: bytes, size: int) -> np.ndarray:
    raw = pa.decompress(data, 4 * size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def tallies(hashes: np.ndarray, range_bits: int) -> dict[str, list]:
    """Counts of the hashes' first 32 + ``range_bits`` bits, cut by hash range: sorted, as steps, with their counts."""
    found, counts = np.unique(hashes >> np.uint64(32 - range_bits), return_counts=True)
    slots, firsts = np.unique((found >> np.uint64(32)).astype(np.int64), return_index=True)
    ends = np.append(firsts, len(found))[1:]
    rest = found & np.uint64(0xFFFFFFFF)
    out: dict[str, list] = {"slot": slots.tolist(), "lang": [None] * len(slots), "n": (ends - firsts).tolist(), "hashes": [], "counts": []}
    for a, b in zip(firsts, ends, strict=True):
        out["hashes"].append(packed(np.diff(rest[a:b], prepend=np.uint64(0))))
        out["counts"].append(packed(counts[a:b]))
    return out


def batch_of(columns: dict[str, list], like: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.strip().split(" ") for x in like.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def reached(tallied: DataFrame, range_bits: int, min_count: int) -> np.ndarray:
    """The filter of all hashes whose counts sum to ``min_count``: each range gives its slice of the bits."""
    width = 1 << FILTER_BITS - range_bits

    def bits(group: pa.Table) -> pa.Table:
        slot = group["slot"][0].as_py()
        n, steps, counts = (group[c].to_pylist() for c in ("n", "hashes", "counts"))
        hashes = np.concatenate([np.cumsum(unpacked(x, k), dtype=np.uint64) for x, k in zip(steps, n, strict=True)])
        counts = np.concatenate([unpacked(x, k) for x, k in zip(counts, n, strict=True)])
        order = np.argsort(hashes)
        hashes, sums = hashes[order], np.cumsum(counts[order], dtype=np.int64)
        last = np.append(np.flatnonzero(hashes[1:] != hashes[:-1]), len(hashes) - 1)
        total = np.diff(sums[last], prepend=0)
        at = (hashes[last[total >= min_count]] >> np.uint64(32 + range_bits - FILTER_BITS)).astype(np.int64)
        flags = np.zeros(width, bool)
        flags[at] = True
        return pa.table({"slot": [slot], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    dealt = tallied.where("slot >= 0").select("slot", "n", "hashes", "counts")
    for row in dealt.groupBy("slot").applyInArrow(bits, "slot long, bits binary").collect():
        out[row["slot"] * width // 8 : (row["slot"] + 1) * width // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


# -- the transducers ----------------------------------------------------------------------
#: A piece of a transducer: its languages and words, and for each level the states' parents, words and weights.
PIECE = "slot long, langs array<binary>, n_words long, words binary, sizes array<int>, arcs binary"


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the place of each key among them."""
    codes, found = pd.factorize(keys)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[codes]


def word_numbers(words: Words, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct words at ``at``, sorted, and the number of each; words, not hashes, are told apart."""
    codes, found = pd.factorize(words.hash[at])
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = at[::-1]
    names = [lowered(words.data, words.start[i], words.end[i]) for i in first]
    size = np.array([len(x) for x in names], np.int64)
    held = np.frombuffer(b"".join(names), np.uint8)
    same = same_bytes(words.data, words.start[at], words.end[at], held, (size.cumsum() - size)[codes], size[codes])
    if not same.all():
        known = {x: i for i, x in enumerate(names)}
        for j in np.flatnonzero(~same):
            codes[j] = known.setdefault(lowered(words.data, words.start[at[j]], words.end[at[j]]), len(known))
        names = list(known)
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    return [names[i] for i in order], place[codes]


def build(shard: Shard, word_bits: np.ndarray, pair_bits: np.ndarray, longest: int, range_bits: int) -> Iterator[dict]:
    """The transducer of a shard's n-grams that pass the filters, cut by prefix range."""
    alive = passes(word_bits, shard.hash)
    pairs = shard.pairs()
    run = alive[:-1] & alive[1:] & shard.joined()
    run[run] = passes(pair_bits, pairs[run])
    at = np.flatnonzero(alive)
    if not len(at):
        return
    names, numbers = word_numbers(shard.words, at)
    number = np.full(len(alive), -1, np.int64)
    number[at] = numbers
    shift = np.uint64(64 - range_bits)
    # level by level: (parent, word, weight, slot) of the states in sorted order
    keys, state = distinct(shard.lang[at].astype(np.int64) * len(names) + numbers)
    levels = [(keys // len(names), keys % len(names), np.bincount(state, minlength=len(keys)), np.zeros(len(keys), np.int64))]
    levels[0][3][state] = (mixed(shard.hash[at]) >> shift).astype(np.int64)
    of = np.full(len(alive), -1, np.int64)  # the state that the n-gram from a position leads to
    of[at] = state
    going = run
    for k in range(2, longest + 1):
        at = np.flatnonzero(going)
        if not len(at):
            break
        keys, state = distinct(of[at] * len(names) + number[at + k - 1])
        slot = np.zeros(len(keys), np.int64)
        slot[state] = (mixed(pairs[at]) >> shift).astype(np.int64)
        levels.append((keys // len(names), keys % len(names), np.bincount(state, minlength=len(keys)), slot))
        of[at] = state
        going = np.zeros_like(run)
        on = at[at + k - 1 < len(run)]
        going[on] = run[on + k - 1]
    order = [np.argsort(x[3], kind="stable") for x in levels]
    slots = np.unique(np.concatenate([np.unique(x[3]) for x in levels]))
    bounds = [(np.searchsorted(x[3][o], slots, "left"), np.searchsorted(x[3][o], slots, "right")) for x, o in zip(levels, order, strict=True)]
    for i, slot in enumerate(slots.tolist()):
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        before = np.zeros(0, np.int64)
        for k, (parent, word, weight, own) in enumerate(levels):
            some = order[k][bounds[k][0][i] : bounds[k][1][i]]
            if k == 0 and len(levels) > 1:  # words of other ranges stay as beginnings, without weight
                some = np.union1d(some, levels[1][0][order[1][bounds[1][0][i] : bounds[1][1][i]]])
            up = parent[some] if k == 0 else np.searchsorted(before, parent[some])
            parts.append((up, word[some], np.where(own[some] == slot, weight[some], 0)))
            before = some
        used = np.unique(np.concatenate([x[1] for x in parts]))
        # parents ascend, so their steps are small; no word holds the line end that parts them
        arcs = [x for up, word, weight in parts for x in (np.diff(up, prepend=0), np.searchsorted(used, word), weight)]
        text = b"\n".join(names[j] for j in used)
        yield {"slot": slot, "langs": [x.encode() for x in shard.langs], "n_words": len(text), "words": pa.compress(text, "zstd", asbytes=True), "sizes": [len(x[0]) for x in parts], "arcs": packed(np.concatenate(arcs))}


def united(pieces: pa.Table, min_count: int) -> pa.Table:
    """One transducer of all pieces of a prefix range, weights summed; its paths of weight ``min_count`` and more."""

    def numbers(lists: list[list[bytes]]) -> tuple[pa.Array, list[np.ndarray]]:
        """The sorted distinct entries, and the numbers of each list's."""
        coded = pa.array([x for held in lists for x in held], pa.binary()).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return coded.dictionary.take(pa.array(order)), np.split(rank[coded.indices.to_numpy()], np.cumsum([len(x) for x in lists])[:-1])

    langs, lang_of = numbers(pieces["langs"].to_pylist())
    texts = zip(pieces["words"].to_pylist(), pieces["n_words"].to_pylist(), strict=True)
    names, word_of = numbers([pa.decompress(x, n, "zstd", asbytes=True).split(b"\n") for x, n in texts])
    sizes = pieces["sizes"].to_pylist()
    arcs = [unpacked(x, 3 * sum(size)).astype(np.int64) for x, size in zip(pieces["arcs"].to_pylist(), sizes, strict=True)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place: list[np.ndarray] = lang_of  # of each piece, where its states of the level before are in the union
    offset = [0] * len(arcs)
    for k in range(max(map(len, sizes))):
        keys, weights, cuts = [], [], []
        for i, (size, flat) in enumerate(zip(sizes, arcs, strict=True)):
            n = size[k] if k < len(size) else 0
            up, word, weight = (flat[offset[i] + j * n : offset[i] + (j + 1) * n] for j in range(3))
            offset[i] += 3 * n
            keys.append(place[i][up.cumsum()] * len(names) + word_of[i][word])
            weights.append(weight)
            cuts.append(n)
        found, state = distinct(np.concatenate(keys))
        total = np.zeros(len(found), np.int64)
        np.add.at(total, state, np.concatenate(weights))
        out.append((found // len(names), found % len(names), total))
        place = np.split(state, np.cumsum(cuts)[:-1])
    columns: list[list] = [[], [], []]
    for k, (_, _, total) in enumerate(out):
        here = at = np.flatnonzero(total >= min_count)
        path = []
        for parent, word, _ in reversed(out[: k + 1]):
            path.append(word[at])
            at = parent[at]
        flat = names.take(pa.array(np.stack(path[::-1], axis=1).ravel())).cast(pa.string())
        columns[0].append(langs.take(pa.array(at)).cast(pa.string()))
        columns[1].append(pa.ListArray.from_arrays(pa.array(np.arange(len(here) + 1, dtype=np.int32) * (k + 1)), flat))
        columns[2].append(pa.array(total[here]))
    return pa.table({name: pa.concat_arrays(x) for name, x in zip(("lang", "words", "a"), columns, strict=True)})


def frequent_phrases(df: DataFrame, min_count: int, longest: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, words, a) of all n-grams of up to ``longest`` words that occur ``min_count`` times, and (lang, n)."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    range_bits = ranges_of(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            out = tallies(shard.hash, range_bits)
            for lang, n in zip(shard.langs, np.bincount(shard.lang, minlength=len(shard.langs)).tolist(), strict=True):
                for name, x in (("slot", -1), ("lang", lang), ("n", n), ("hashes", None), ("counts", None)):
                    out[name].append(x)
            yield batch_of(out, TALLY)

    counted = materialise(texts.mapInArrow(count_words, TALLY))
    totals = counted.where("slot < 0").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    word_bits = spark.sparkContext.broadcast(reached(counted, range_bits, min_count))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            alive = passes(word_bits.value, shard.hash)
            yield batch_of(tallies(shard.pairs()[alive[:-1] & alive[1:] & shard.joined()], range_bits), TALLY)

    pair_bits = spark.sparkContext.broadcast(reached(texts.mapInArrow(count_pairs, TALLY), range_bits, min_count))

    def transduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            rows = list(build(shard, word_bits.value, pair_bits.value, longest, range_bits))
            if rows:
                kinds = (pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary())
                names = list(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], kind) for x, kind in zip(names, kinds, strict=True)], names)

    pieces = texts.mapInArrow(transduce, PIECE)
    found = pieces.groupBy("slot").applyInArrow(lambda group: united(group, min_count), "lang string, words array<string>, a long")
    return materialise(found), totals


# -- parts and scores ---------------------------------------------------------------------
PARTS = "lang string, words array<string>, a long, first array<long>, last array<long>, covered boolean"


def composed(paths: DataFrame, backwards: bool) -> DataFrame:
    """Each phrase with the counts of all its beginnings (ends if ``backwards``), read off its own path.

    Beside them a row for each phrase that one word more occurs as often as: it is covered.
    """
    ordered = paths.select("lang", (F.reverse("words") if backwards else F.col("words")).alias("w"), "a")
    # all paths through a first word meet in SALTS places by their second word; the word alone goes to each
    salt = F.when(F.size("w") > 1, F.array(F.pmod(F.xxhash64(F.col("w")[1]), F.lit(SALTS)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = ordered.withColumn("salt", F.explode(salt)).withColumn("head", F.col("w")[0])
    dealt = dealt.repartition("lang", "head", "salt").sortWithinPartitions("lang", "salt", "w").select("lang", "salt", "w", "a")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path, weights = None, [], []  # where the walk stands, and the counts of the states behind it
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("lang", "words", "a", "first", "last", "covered")}

            def put(*row, out=out) -> None:
                for x, v in zip(out.values(), row, strict=True):
                    x.append(v)

            for lang, salt, words, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (lang, salt):
                    place, path, weights = (lang, salt), [], []
                n = len(words) - 1
                path, weights = [*words], [*weights[:n], a]
                if n:
                    turn = words[::-1] if backwards else words
                    put(lang, turn, a, None if backwards else weights[:n], weights[:n] if backwards else None, False)
                    if n > 1 and weights[n - 1] == a:
                        put(lang, turn[1:] if backwards else turn[:-1], None, None, None, True)
            kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds, strict=True)], list(out))

    return dealt.mapInArrow(walk, PARTS)


def exact(column: Column, digits: int = 16) -> Column:
    return column.cast(f"decimal({digits},0)")


def phrases(df: DataFrame, min_count: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All candidates: (lang, words, phrase, a, l, r, n, score, cut, covered).

    ``score`` is the lowest over all cuts of 1000 a n / (l r), rounded down, ``cut`` the words before that
    cut; ``covered`` tells whether a longer candidate that holds the phrase occurs as often.
    """
    found, totals = frequent_phrases(df, min_count, longest, text_col, lang_col)
    both = composed(found, False).unionByName(composed(found, True))
    parts = both.groupBy("lang", "words").agg(*[F.max(c).alias(c) for c in ("a", "first", "last", "covered")])
    scored = parts.join(totals, "lang")

    def cut(k: Column) -> Column:
        left, right = F.get("first", k - 1), F.get("last", F.size("words") - k - 1)
        product = exact(F.lit(1000), 4) * exact(F.col("a")) * exact(F.col("n"))
        return F.struct(F.call_function("div", product, exact(left) * exact(right)).alias("score"), k.alias("cut"), left.alias("l"), right.alias("r"))

    scored = scored.withColumn("best", F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)))
    return scored.select("lang", "words", F.concat_ws(" ", "words").alias("phrase"), "a", "best.l", "best.r", "n", "best.score", "best.cut", "covered")


def collocations(df: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``top`` uncovered phrases by score: (lang, rank, phrase, a, l, r, n, score, words)."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases(df, min_count, longest, text_col, lang_col).where("not covered").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words")
