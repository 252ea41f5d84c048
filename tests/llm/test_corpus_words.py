"""Collocations, decontamination and lexical search against brute force, and on awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import collocations, decontamination, search, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long, rank string, start int, a double"
ITEM_SCHEMA = "item_id long, text string, doc_id string, score int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 0, 7, "x", 1, 0.5) for r in rows], SCHEMA)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], ITEM_SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def normal(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


AWKWARD = [(None, "no id here but words", "en"), (1, None, "en"), (2, "", None), (3, " \n\t .,;", "fr"), (4, "x" * 2_000_000, "en"), (5, "same text twice", "en"), (5, "same text twice", "en"), (6, "ünï 日本語 😀 İΣς\x00\x01b", "de")]


# -- words ------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [7, 64, 1 << 19])
def test_words_match_a_plain_split(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    monkeypatch.setattr(words, "_tables", [])
    rng = random.Random(block)
    texts = ["".join(rng.choice(["a", "B", "é", " ", "\t", ".", "\n", "x\x00y", "日本", "Ab1", "--"]) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, ""]
    for column in (pa.array(texts).slice(3), pa.array(texts, pa.large_string()).slice(5, 90), pa.array([], pa.string())):
        found = words.find_words(column, collocations.PIECES)
        want = [(r, w, j == 0) for r, t in enumerate(column.to_pylist()) for p in re.split("[.,;:!?\n-\r]", lower(t)) for j, w in enumerate(re.findall("[^ \t]+", p))]
        got = [(r, words.lowered(found.data, a, b).decode(), bool(f)) for r, a, b, f in zip(found.row, found.start, found.end, found.fresh)]
        assert got == want
        assert found.counts.tolist() == [sum(r == x for r, _, _ in want) for x in range(len(column))]
        hashes = {w: h for h, (_, w, _) in zip(found.hash.tolist(), got)}
        assert [hashes[w] for _, w, _ in got] == found.hash.tolist() and len(set(hashes.values())) == len(hashes)


def test_vocabulary_tells_equal_hashes_apart():
    held = words.Vocabulary([b"one", b"three", "zwölf".encode()])
    found = words.find_words(pa.array(["one two THREE Zwölf x"]), words.ALPHANUMERIC)
    assert held.ids(found).tolist() == [0, -1, 1, 2, -1]
    found.hash[:] = found.hash[0]  # all words under the hash of "one": the bytes decide
    assert held.ids(found).tolist() == [0, -1, -1, -1, -1]
    same = words.find_words(pa.array(["b a b c"]), words.ALPHANUMERIC)
    same.hash[:] = 5
    assert collocations.word_numbers(same, np.arange(4))[1].tolist() == [1, 0, 1, 2]


# -- 11: collocations -------------------------------------------------------------------
def plain_phrases(rows, least, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            held = re.findall("[^ \t]+", piece)
            n[lang] += len(held)
            f.update((lang, *held[i : i + k]) for k in range(1, longest + 1) for i in range(len(held) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {(p[0], *p[i:j]) for p, a in held.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1 and 100 * a >= 100 * held[(p[0], *p[i:j])]}
    found = {}
    for (lang, *p), a in held.items():
        if (lang, *p) not in covered:
            score, _, left, right = min((1000 * a * n[lang] // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def test_collocations_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        text = "".join(f"{rng.choice(['Of', 'the', 'a', 'é', 'hot', f'w{rng.randrange(12)}', 'New York City'])}{rng.choice(['  ', ' ', chr(9), '. ', chr(10)])}" for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und"])))
    rows += [(1000, "a b c d e f " * 400, "xx"), (1001, "q r. " * 30, "xx"), *AWKWARD]
    for least, top in ((4, 2000), (25, 5)):
        got = sorted(tuple(r)[:8] for r in collocations.collocations(docs_of(spark, rows).repartition(5), min_count=least, top=top).collect())
        assert got == plain_phrases([r[1:3] for r in rows], least, 5, top)


def test_collocations_are_exact_beyond_64_bits(spark):
    found = docs_of(spark, [(1, "left right", "en")]).selectExpr("array('left', 'right') words", "9000000000000 a", "array(9000000000000) first", "array(9100000000000) last", "9900000000000000 n")
    left, right = 9_000_000_000_000, 9_100_000_000_000
    product = collocations.exact(collocations.F.lit(1000), 4) * collocations.exact(found["a"]) * collocations.exact(found["n"])
    parts = collocations.exact(found["first"][0]) * collocations.exact(found["last"][0])
    assert found.select(collocations.F.call_function("div", product, parts)).first()[0] == 1000 * 9_000_000_000_000 * 9_900_000_000_000_000 // (left * right)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, AWKWARD[:5]), min_count=1).where("lang = 'fr'").count() == 0


# -- 12: decontamination ----------------------------------------------------------------
def plain_hits(text, items, window):
    held, hit, found = normal(text), set(), set()
    for name, item in items:
        own = normal(item)
        k = min(window, len(own))
        for i in range(len(own) - k + 1):
            for j in range(len(held) - k + 1) if k else ():
                if held[j : j + k] == own[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add("" if name is None else str(name))
    return len(held), len(hit), sorted(found)


@pytest.mark.parametrize("block", [400_000, 20])
def test_overlaps_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice("abc") + rng.choice(["", "", "x"]) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 6, 7, 12]))) for i in range(2, 14)] + [(1, "Only One"), (10, None), (11, " .. "), (13, "ünï-日本"), (14, "a a a a a a a a"), (14, "b cx, A-bx c"), (None, "the missing id"), (15, "zz")]
    docs = [(i, some(rng.randrange(60)), "en") for i in range(80)] + [(90, "this is only ONE!! or zz zz", "en"), (91, "x ünï 日本 y the missing, id", "en"), *AWKWARD]
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), sum(s["end"] - s["start"] for s in r["spans"])) for r in decontamination.find_overlaps(docs_of(spark, docs).repartition(3), items_of(spark, items), window=6).collect())
    want = Counter((i, n, hit, tuple(names), hit) for i, text, _ in docs for n, hit, names in [plain_hits(text, items, 6)])
    assert got == want


def test_automaton_of_repetitive_items():
    rng = random.Random(9)
    for _ in range(60):
        items = [(str(i), [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(1, 9))]) for i in range(rng.randrange(1, 6))]
        automaton = decontamination.SuffixAutomaton(items, 3)
        number = {w: i for i, w in enumerate(automaton.vocabulary.words)}
        text = [rng.choice([b"a", b"b"]) for _ in range(40)]
        text = [w for w in text if w in number]
        got = {(i, size, name) for i, size, state, _ in automaton.windows([number[w] for w in text]) for name in (automaton.names[x] for x in automaton.items[state])}
        want = {(j + k - 1, k, name) for name, own in items for k in [min(3, len(own))] for i in range(len(own) - k + 1) for j in range(len(text) - k + 1) if text[j : j + k] == own[i : i + k]}
        assert got == want


def test_decontaminated_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"Before, ONE Two-three four five six seven eight nine TEN! after {'w ' * 20}é", "en"), (2, item, "en"), (3, "clean text", "en"), (4, None, "en"), (5, f"é日 {item} {item} " + "v " * 40, "en"), *[(100 + (i or 0), text, lang) for i, text, lang in AWKWARD]]
    got = decontamination.decontaminate(docs_of(spark, docs), items_of(spark, [(7, item)])).collect()
    kept = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(docs) - 1 and 2 not in kept and got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "item_id", "rank", "start", "a"}
    assert kept[1] == f"Before, ! after {'w ' * 20}é" and kept[3] == "clean text" and kept[4] is None
    assert kept[5] == "é日  " + "v " * 40
    long_only = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs_of(spark, docs), items_of(spark, [(7, item)]), longest=11, coverage=1.0).collect()}
    assert long_only[1] == docs[0][1] and long_only[2] == ""


def test_overlaps_with_nothing(spark):
    assert decontamination.find_overlaps(docs_of(spark, []), items_of(spark, [(1, "a b")])).count() == 0
    none = decontamination.find_overlaps(docs_of(spark, AWKWARD), items_of(spark, [])).collect()
    assert len(none) == len(AWKWARD) and all(r["n_hit"] == 0 and r["items"] == [] for r in none)
    assert decontamination.decontaminate(docs_of(spark, AWKWARD), items_of(spark, [])).count() == len(AWKWARD)


# -- 13: ranked search --------------------------------------------------------------------
def plain_ranks(docs, items, top):
    held = [(i, Counter(normal(text))) for i, text, _ in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for name, item in items:
        scored = []
        for doc, c in held:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in normal(item) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(name, r + 1, None if gone else doc, -s) for r, (s, gone, doc) in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.mark.parametrize(("block", "cells", "handed"), [(500_000, 2_000_000, 4_000_000), (12, 30, 50)])
def test_ranks_match_brute_force(spark, monkeypatch, block, cells, handed):
    for name, value in (("BLOCK_TERMS", block), ("CELLS", cells), ("HANDED", handed)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(8)
    some = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(n))
    docs = [(i % 270, some(rng.randrange(40)), "en") for i in range(300)] + [(400 + i, "w1 w2 Equal-scores", "en") for i in range(40)] + AWKWARD
    items = [(i, some(rng.randrange(1, 20))) for i in range(12)] + [(3, "equal SCORES scores"), (20, "nowhere at all"), (21, None), (None, "w1 w1 日本語"), (22, "x" * 2_000_000)]
    got = Counter(tuple(r) for r in search.rank_documents(docs_of(spark, docs).repartition(4), items_of(spark, items), top=20).collect())
    assert got == plain_ranks(docs, items, 20)


def test_ranks_of_nothing(spark):
    assert search.rank_documents(docs_of(spark, []), items_of(spark, [(1, "a")])).count() == 0
    assert search.rank_documents(docs_of(spark, AWKWARD), items_of(spark, [])).count() == 0
