"""Language-model scores from a subword lattice.

A word is spelled by the pieces of an existing vocabulary in many ways. The vocabulary's
scores weight them all: its ranks give each piece a Zipf probability, which ``ROUNDS`` of
expectation maximisation over the lattices of all distinct training words fit to the corpus
(the expected uses of a piece, with ``PRIOR`` pseudo-uses spread by rank). A forward
recursion in log space over the word's lattice adds up the probabilities of every
segmentation (any character can also be spelled by its bytes). Words begin with the
vocabulary's word mark, so no piece crosses words and a document's lattice is the chain of
its words' lattices: the marginal probability of a document is the product of theirs and
that of its end. The corpus enters as counts as well: with c the training count of a token, N
all training tokens, V their distinct number and L the token's lattice probability, the model
gives (c - D) / N + (D V / N) L, where the discount D = (n1 + 1) / (n1 + 2 n2 + 2) comes from
the numbers of tokens seen once and twice: what is taken from the seen words is what the
lattice hands out. The tables of words are Spark's; nothing of the corpus but piece counts
(one a piece of the vocabulary) reaches the driver.

Scoring reads the frequent words (at most ``MAX_FREQUENT``, by count) from a broadcast and
joins the rest, one row for each document and word, with the table of words by a shuffle,
so that nothing grows with the corpus in one place and no word is dropped.

Defined results: a null or empty text is the end alone; rows with equal id and text are
scored each; null ids are in no training fold; without training texts N = V = 0, the
base score is 0 and the lattice alone scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, whole_text

#: Words whose figures are broadcast at most.
MAX_FREQUENT = 150_000
#: Distinct words a task gathers before it sends their counts on.
MAX_HELD = 400_000
#: Share of the probability that spelling by bytes has before it is fitted.
BYTE_SHARE = 1e-3
#: Rounds of expectation maximisation, and the weight of the vocabulary's own scores in them.
ROUNDS, PRIOR = 1, 500.0
#: Up to so many characters, and down to such a probability, plain numbers hold a word's sums, of a batch's words side
#: by side; beyond, logarithms do, word by word.
PLAIN, LEAST = 48, 1e-200
MARK = "▁"


def ranked(path: str) -> tuple[dict[str, float], float]:
    """Natural log probabilities of a sentencepiece model's pieces by their ranks, and that of one byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        if not special and model.get_score(i) > -1e8:
            weights[model.id_to_piece(i)] = 1.0 / (1.0 - model.get_score(i))  # scores are negative ranks
    total = sum(weights.values()) / (1 - BYTE_SHARE)
    return {piece: math.log(w / total) for piece, w in weights.items()}, math.log(BYTE_SHARE / 256)


class Lattice:
    """Piece log probabilities (natural), and the recursions over a word's lattice."""

    def __init__(self, log_p: dict[str, float], byte: float):
        self.log_p, self.byte = log_p, byte
        self.longest = max(map(len, log_p))
        self.p, self.byte_p = {piece: math.exp(v) for piece, v in log_p.items()}, math.exp(byte)
        self.pieces = list(log_p)

    @cached_property
    def _trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' prefixes as sorted keys (parent, character), their numbers, and the piece each number is (-1: none)."""
        number, keys = {"": 0}, []
        for piece in self.pieces:
            for j in range(1, len(piece) + 1):
                if piece[:j] not in number:
                    number[piece[:j]] = len(number)
                    keys.append(number[piece[: j - 1]] << 21 | ord(piece[j - 1]))
        order = np.argsort(keys)
        ends = np.full(len(number), -1, np.int64)
        ends[[number[piece] for piece in self.pieces]] = np.arange(len(self.pieces))
        return np.array(keys, np.int64)[order], order + 1, ends

    def _edges(self, code: np.ndarray, left: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in the joined characters ``code`` of many words.

        ``left``: characters from here to the word's end; ``inner``: the marks inside a word, where no piece starts.
        """
        keys, child, ends = self._trie
        at, state, out = np.flatnonzero(~inner), 0, []
        for depth in range(self.longest):
            key = state << 21 | code[at + depth]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = keys[found] == key
            at, state = at[ok], child[found[ok]]
            piece = ends[state]
            whole = piece >= 0
            out.append((at[whole], np.full(whole.sum(), depth + 1), piece[whole]))
            on = left[at] > depth + 1
            at, state = at[on], state[on]
            if not len(at):
                break
        start, length, piece = map(np.concatenate, zip(*out))
        return start, length, piece

    def many(self, words: list[str], into: dict[str, float] | None = None) -> np.ndarray:
        """``log10`` of each word and, if ``into`` is given, ``expected`` over all: the same sums, words side by side."""
        out = np.empty(len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        alone = sizes > PLAIN
        short = np.flatnonzero(~alone)
        if len(short):
            size = sizes[short]
            code = np.frombuffer("".join([MARK + words[i] for i in short]).encode("utf-32-le"), np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(short)), size)
            first = np.cumsum(size) - size
            place = np.arange(len(code)) - first[owner]
            n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            start, length, piece = self._edges(code, size[owner] - place, (code == ord(MARK)) & (place > 0))
            p = np.array([self.p[x] for x in self.pieces])[piece]
            # a word has a node before each character and one at its end; of a start, each edge has an end of its own
            node = np.arange(len(code)) + owner
            by_bytes = self.byte_p ** n_bytes.astype(float)
            a, b = node[start], node[start] + length
            steps = range(int(size.max()))
            forward = np.zeros(len(code) + len(short))
            forward[first + np.arange(len(short))] = 1.0
            order, order_c = np.argsort(place[start], kind="stable"), np.argsort(place, kind="stable")
            cut, cut_c = (np.searchsorted(x, np.arange(len(steps) + 1)) for x in (place[start][order], place[order_c]))
            for i in steps:
                c, e = order_c[cut_c[i] : cut_c[i + 1]], order[cut[i] : cut[i + 1]]
                forward[node[c] + 1] += forward[node[c]] * by_bytes[c]
                forward[b[e]] += forward[a[e]] * p[e]
            last = first + np.arange(len(short)) + size
            total = forward[last]
            low = total < LEAST
            alone[short[low]] = True
            out[short] = np.log10(np.where(low, 1.0, total))
        if into is not None and len(short):
            backward = np.zeros(len(forward))
            backward[last] = 1.0
            stop = place[start] + length - 1  # the place of an edge's last character
            order = np.argsort(stop, kind="stable")
            cut = np.searchsorted(stop[order], np.arange(len(steps) + 1))
            for i in reversed(steps):
                c, e = order_c[cut_c[i] : cut_c[i + 1]], order[cut[i] : cut[i + 1]]
                backward[node[c]] += by_bytes[c] * backward[node[c] + 1]
                backward[a[e]] += p[e] * backward[b[e]]
            share = np.where(low, 0.0, 1.0 / np.where(low, 1.0, total))
            uses = np.bincount(piece, forward[a] * p * backward[b] * share[owner[start]], len(self.pieces))
            for i in np.flatnonzero(uses):
                into[self.pieces[i]] = into.get(self.pieces[i], 0.0) + float(uses[i])
            into[""] = into.get("", 0.0) + float((forward[node] * by_bytes * backward[node + 1] * share[owner] * n_bytes).sum())
        for i in np.flatnonzero(alone):
            out[i] = self.log10(words[i])
            if into is not None:
                self.expected(words[i], into)
        return out

    def expected(self, word: str, into: dict[str, float]) -> None:
        """Adds to ``into`` how often a segmentation drawn by its probability uses each piece ("": bytes)."""
        text, get, longest = MARK + word, self.p.get, self.longest
        n = len(text)
        if n > PLAIN:
            self._expected_long(text, into)
            return
        forward, backward, edges = [0.0] * (n + 1), [0.0] * (n + 1), []
        forward[0] = backward[n] = 1.0
        for i in range(n):
            here, c = forward[i], text[i]
            size = len(c.encode()) if c >= "\x80" else 1
            p = self.byte_p**size
            forward[i + 1] += here * p
            edges.append((i, i + 1, p, ""))
            if c == MARK and i:
                continue
            for j in range(i + 1, min(i + longest, n) + 1):
                piece = text[i:j]
                p = get(piece)
                if p is not None:
                    forward[j] += here * p
                    edges.append((i, j, p, piece))
        whole = forward[n]
        if whole < LEAST:
            self._expected_long(text, into)
            return
        for i, j, p, piece in reversed(edges):
            rest = p * backward[j]
            backward[i] += rest
            share = forward[i] * rest / whole
            if piece:
                into[piece] = into.get(piece, 0.0) + share
            else:
                into[""] = into.get("", 0.0) + share * len(text[i].encode())

    def _expected_long(self, text: str, into: dict[str, float]) -> None:
        n, add, edges = len(text), np.logaddexp, []
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        for i in range(n):
            found = [(i + 1, self.byte * len(text[i].encode()), "")]
            if text[i] != MARK or not i:
                found += [(j, self.log_p[text[i:j]], text[i:j]) for j in range(i + 1, min(i + self.longest, n) + 1) if text[i:j] in self.log_p]
            for j, p, piece in found:
                forward[j] = add(forward[j], forward[i] + p)
                edges.append((i, j, p, piece))
        for i, j, p, piece in reversed(edges):
            backward[i] = add(backward[i], p + backward[j])
            share = math.exp(min(forward[i] + p + backward[j] - forward[n], 0.0))
            into[piece] = into.get(piece, 0.0) + share * (1 if piece else len(text[i].encode()))

    def log10(self, word: str) -> float:
        """log10 of the summed probability of all segmentations of the marked word."""
        text, get, longest = MARK + word, self.log_p.get, self.longest
        n = len(text)
        ways: list[list[float]] = [[] for _ in range(n + 1)]
        ways[0].append(0.0)
        for i in range(n):
            terms = ways[i]
            ways[i] = []  # type: ignore[assignment]
            if len(terms) == 1:
                here = terms[0]
            else:
                top = max(terms)
                here = top + math.log(sum([math.exp(t - top) for t in terms]))
            c = text[i]
            ways[i + 1].append(here + self.byte * (len(c.encode()) if c >= "\x80" else 1))
            if c == MARK and i:
                continue  # a mark inside a word is only spelled by bytes
            for j in range(i + 1, min(i + longest, n) + 1):
                p = get(text[i:j])
                if p is not None:
                    ways[j].append(here + p)
        top = max(ways[n])
        return (top + math.log(sum([math.exp(t - top) for t in ways[n]]))) / math.log(10)


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(*ranked(path))


def fitted(words: DataFrame, start: Lattice, rounds: int = ROUNDS, prior: float = PRIOR) -> Lattice:
    """``start`` after expectation maximisation over the distinct ``words`` (word, c) with c > 0.

    Tasks add up the expected uses of their own words; one row for each piece reaches the driver.
    """
    now = start
    for _ in range(rounds):
        model = words.sparkSession.sparkContext.broadcast((now.log_p, now.byte))

        def uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            run, sums = Lattice(*model.value).many, {}
            for pdf in batches:
                run([w.decode() for w in pdf["word"]], sums)
            yield pd.DataFrame({"piece": list(sums), "n": list(sums.values())}).astype({"piece": object, "n": float})

        rows = words.where("c > 0").select("word").mapInPandas(uses, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        sums = {r["piece"]: r["n"] for r in rows}
        total = sum(sums.values()) + prior
        log_p = {piece: math.log((sums.get(piece, 0.0) + prior * math.exp(v)) / total) for piece, v in start.log_p.items()}
        now = Lattice(log_p, math.log((sums.get("", 0.0) + prior * math.exp(start.byte) * 256) / total / 256))
    return now


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words."""
    return text.encode().lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word of the corpus stands in training texts. ``docs``: (train, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train, other = Counter(), set()

        def sent() -> pd.DataFrame:
            rest = other.difference(train)
            out = pd.DataFrame({"word": [*train, *rest], "c": [*train.values(), *[0] * len(rest)]})
            train.clear()
            other.clear()
            return out.astype({"c": "int64"})

        for pdf in batches:
            for learn, text in zip(pdf["train"], pdf["text"]):
                (train if learn else other).update(words_of(text))
                if len(train) + len(other) > MAX_HELD:
                    yield sent()
        yield sent()

    return docs.mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns where crc32(id) mod 10 is not 0."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    docs = docs.withColumn("train", F.coalesce(fold(F.col("id"), 10) != 0, F.lit(False)))

    words = materialise(count_words(docs.select("train", "text")))
    model = fitted(words, lattice(vocabulary))
    held = docs.sparkSession.sparkContext.broadcast((model.log_p, model.byte))

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = Lattice(*held.value).many
        for pdf in batches:
            yield pdf.assign(l=run([w.decode() for w in pdf["word"]]))

    words = materialise(words.mapInPandas(spelled, "word binary, c long, l double"))
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()[0]
    ends = docs.where("train").count()
    n, v = seen["n"] + ends, seen["v"] + (ends > 0)
    discount = (seen["n1"] + 1) / (seen["n1"] + 2 * seen["n2"] + 2)
    spread = discount * v / n if n else 1.0  # without training texts the lattice alone counts
    low = math.log10(n + 0.1 * (v + 1))

    def model_log(c: float, log_l: float) -> float:
        return math.log10((c - discount) / n + spread * 10**log_l) if c else math.log10(spread) + log_l

    end_base, end_score = math.log10(ends + 0.1) - low, math.log10((ends - discount) / n) if ends else 0.0

    # how many words have each count tells from which count on words are frequent enough for the broadcast
    least, sum_ = None, 0
    for r in words.where("c > 1").groupBy("c").count().orderBy(F.desc("c")).limit(MAX_FREQUENT).collect():
        sum_ += r["count"]
        if sum_ > MAX_FREQUENT:
            break
        least = r["c"]
    frequent_rows = words.where(F.col("c") >= (least or 1 << 62))
    frequent = docs.sparkSession.sparkContext.broadcast({bytes(r["word"]): (math.log10(r["c"] + 0.1) - low, model_log(r["c"], r["l"])) for r in frequent_rows.toLocalIterator()})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = frequent.value.get
        for pdf in batches:
            rows, rare, owner, key = [], [], [], []
            for doc, k, text in zip(pdf["id"], pdf["key"], pdf["text"]):
                counts = Counter(words_of(text))
                total, known, base, score = 1, int(ends > 0), end_base, end_score
                own = []
                for word, f in counts.items():
                    total += f
                    found = get(word)
                    if found is None:
                        own.append((word, f))
                    else:
                        known += f
                        base += f * found[0]
                        score += f * found[1]
                rows.append((doc, k, None, total, known, base, score))
                rare += own
                owner += [doc] * len(own)
                key += [k] * len(own)
            names = ["id", "key", "word", "n", "known", "base", "score"]
            yield pd.DataFrame(rows, columns=names).astype({"id": "Int64"})
            if rare:
                yield pd.DataFrame({"id": owner, "key": key, "word": [w for w, _ in rare], "n": [f for _, f in rare], "known": 0, "base": 0.0, "score": 0.0}).astype({"id": "Int64"})

    source = docs.select("id", F.xxhash64("text").alias("key"), "text")
    parts = materialise(source.mapInPandas(read, "id long, key long, word binary, n long, known long, base double, score double"))
    own = parts.where("word IS NULL").drop("word")
    gain = F.when(F.col("c") > 0, F.log10((F.col("c") - discount) / max(n, 1) + spread * F.pow(F.lit(10.0), "l"))).otherwise(F.lit(math.log10(spread)) + F.col("l"))
    rest = parts.where("word IS NOT NULL").select("id", "key", "word", "n").join(words, "word")
    sums = rest.groupBy("id", "key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 0.1) - low)).alias("b"),
        F.sum(F.col("n") * gain).alias("s"),
    )
    copies = own.groupBy("id", "key").agg(F.count("*").alias("copies"))  # rows of equal id and text share their sums
    shared = copies.join(sums.withColumnsRenamed({"id": "i2", "key": "k2"}), F.col("id").eqNullSafe(F.col("i2")) & (F.col("key") == F.col("k2"))).select(
        F.col("id").alias("i"), F.col("key").alias("h"), (F.col("k") / F.col("copies")).cast("long").alias("k"), (F.col("b") / F.col("copies")).alias("b"), (F.col("s") / F.col("copies")).alias("s")
    )
    found = own.join(shared, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("h")), "left")
    return found.select(
        F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), 10) == 0, F.lit(False)).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
