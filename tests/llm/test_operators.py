"""The training-data operators against brute force, and on nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import bpe, fingerprint, language, lattice, near_dup, packing, perplexity, pii, quality, toxicity
from tidewater.llm.components import components
from tidewater.llm.queries import PIECES, WORD_BPE, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, "k", 1) for i, t, lang in rows], SCHEMA)


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


AWKWARD = [(None, "some text without an id", "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", "fr"), (4, "x" * 30_000, "en"), (5, "same text here twice over", "en"), (5, "same text here twice over", "en"), (6, "ünïcödé 日本語 😀 İΣς", "de")]
def marks(df):
    """Labels of every other id, some of them null or repeated."""
    own = df.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality", "cast(doc_id % 3 = 0 AS int) AS toxic")
    return own.union(df.selectExpr("doc_id", "cast(NULL AS int)", "cast(NULL AS int)"))


OPERATORS = {
    "quality": lambda df: quality.score_quality(df, marks(df)),
    "toxicity": lambda df: toxicity.score_toxicity(df, marks(df)),
    "pii": lambda df: pii.find_personal_data(df),
    "near_dup": lambda df: near_dup.near_duplicates(df),
    "packing": lambda df: packing.pack_documents(df, tokenizer_path(WORD_BPE)),
    "perplexity": lambda df: perplexity.apply_rules(df),
    "lattice": lambda df: lattice.score_documents(df, tokenizer_path(PIECES)),
    "language": lambda df: language.language_id(df),
    "fingerprint": lambda df: fingerprint.fingerprints(df),
    "bpe": lambda df: bpe.digest_documents(df, tokenizer_path(WORD_BPE)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_give_one_row_each(spark, name):
    rows = OPERATORS[name](frame(spark, AWKWARD)).collect()
    n = Counter(r["doc_id"] for r in rows)
    if name == "packing":  # a piece for each 2048 tokens
        assert n[5] == 2 and n[4] >= 2 and n[1] == n[2] == n[3] == n[None] == 1
    else:
        assert n == Counter(i for i, _, _ in AWKWARD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).count() == 0


# -- 1: PII -----------------------------------------------------------------------------
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    counts, out = [], []
    for kind, pattern in PATTERNS:
        n = 0
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                n += 1
                out.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return counts, ",".join(out)


def test_pii_base_spans_match_brute_force(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "a@b.c_d@e.f", "x.y%z@h-1.io.", "@", ".", " ", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "5" * 16, "+1 (555) 123-4567", "+44.20.7946.0958-", "++1", "é😀", "\n", "12", "-", "w@w.w@w.w", "日本"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14))), "en") for i in range(400)] + [(400, "1 " * 30_000, "en"), (401, "a." * 20_000 + "@b" + ".c" * 9_000, "en")]
    # the base spans alone: here no pair has documents enough for a term
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, docs), min_support=10_000).collect()}
    for i, text, _ in docs:
        counts, spans = base_spans(text)
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert r["spans"] == spans


def test_pii_terms_that_reveal_an_entity_go(spark):
    rng = random.Random(5)
    docs = [(i, words(rng, 40), "en") for i in range(60)]
    docs += [(100 + i, words(rng, 20) + " contact the lighthouse keeper Brindlewax at bw@harbour.example today", "en") for i in range(6)]
    docs += [(200 + i, words(rng, 20) + f" contact u{i}@mail.example today", "en") for i in range(30)]
    found = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, docs)).collect()}
    for i, text, _ in docs[:60]:
        assert found[i] == text
    for i in range(6):
        assert "Brindlewax" not in found[100 + i] and "lighthouse" not in found[100 + i]
        assert "[EMAIL]" in found[100 + i] and " contact " in found[100 + i]
    assert all("contact [EMAIL] today" in found[200 + i] for i in range(30))


def test_pii_terms_go_wherever_they_stand(spark):
    rng = random.Random(11)
    docs = [(1000 + i, words(rng, 40), "en") for i in range(160)]
    # names far from the address, short and with digits, and in documents without it
    docs += [(100 + i, "Brindlewax Oq R2x7 " + words(rng, 150) + " bw@harbour.example", "en") for i in range(16)]
    docs += [(200 + i, words(rng, 10) + " BRINDLEWAX, oq (r2x7) " + words(rng, 10), "en") for i in range(3)]
    docs += [(300 + i, f"{words(rng, 10)} u{i}@mail.example", "en") for i in range(20)]
    found = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, docs)).collect()}
    for i in [*range(100, 116), *range(200, 203)]:
        assert not re.search(r"brindlewax|\boq\b|r2x7", found[i].lower())
    for i, text, _ in docs[176:179]:
        assert re.fullmatch(r"(w[0-9]+ |\[TERM\] ){10}\[TERM\], \[TERM\] \(\[TERM\]\)( w[0-9]+| \[TERM\]){10}", found[i]), found[i]


def key_of(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.xxhash64("t").alias("h")).collect()
    return [r["h"] for r in rows]


def test_pii_near_copies_reveal_nothing(spark):
    rng = random.Random(21)
    docs = [(i, words(rng, 60, 3000), "en") for i in range(150)]
    base = [f"own{rng.randrange(10**6)}" for _ in range(60)]
    for i in range(8):  # copies with every eighth word changed
        docs.append((200 + i, " ".join(w if rng.random() < 0.88 else f"new{rng.randrange(10**6)}" for w in base) + " who@copy.example", "en"))
    docs += [(300, docs[-1][1], "en")] * 4
    docs += [(400 + i, words(rng, 40, 3000) + " Wolverton bw@harbour.example", "en") for i in range(4)]
    found = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, docs)).collect()}
    assert all(found[i] == t.replace("who@copy.example", "[EMAIL]") for i, t, _ in docs if i < 400)
    assert all("Wolverton" not in found[400 + i] for i in range(4))


def test_pii_terms_match_brute_force(spark):
    rng = random.Random(12)
    docs = [(i, words(rng, 30, 120) + rng.choice(["", " a@b.c", " a@b.c é1.2.3.4x", " İx+44 20 7946 0958"]), "en") for i in range(150)] + [(3, "rare one", "en")] * 3
    docs += [(700 + i, "thrice seen quokka q@r.st " + words(rng, 24, 120), "en") for i in range(5)]
    # one source, however often it is copied with small changes
    base = words(rng, 30, 120)
    docs += [(800 + i, f"once copied {base} extra{i} z@y.xw", "en") for i in range(6)]
    docs += [] + [(500 + i, "rare one a@b.c w1", "en") for i in range(4)]
    token = re.compile(r"(?<![^\W_])(?:[^\W\d_]++(?!\d)|(?<!\uffff)(?<![\d\uffff][.-])[^\W_]++(?:(?<=\d)[.-](?=\d)[^\W_]++)*+(?!\uffff)(?!(?<=\d)[.-]\uffff))")
    held, entities, bare = [], [], []
    for _, text, _ in docs:
        spans = [tuple(s.split(":")) for s in base_spans(text)[1].split(",") if s]
        plain = text
        for _, a, b in spans:
            plain = plain[: int(a)] + "\uffff" * (int(b) - int(a)) + plain[int(b) :]
        entities.append({(k, re.sub("[^0-9]", "", text[int(a) : int(b)]) if k in ("card", "phone") else text[int(a) : int(b)].lower()) for k, a, b in spans})
        held.append({m[0].lower() for m in token.finditer(plain)})
        bare.append(plain)
    n_t = Counter(t for h in held for t in h)
    by_text = {t: (e, h) for (_, t, _), e, h in zip(docs, entities, held) if e}
    keys = {t: h for t, h in zip(by_text, key_of(spark, by_text))}
    # near copies, by all pairs: each text's source is the least key among those it shares 0.4 of its terms with
    near = {t: min([keys[t], *[keys[o] for o in by_text if o != t and len(by_text[t][1] & by_text[o][1]) >= 0.4 * len(by_text[t][1] | by_text[o][1])]]) for t in by_text}
    assert len(set(near.values())) < len(near)
    n_e = Counter(x for x, _ in {(x, near[t]) for t, (e, _) in by_text.items() for x in e})
    n_te = Counter((x, w) for x, w, _ in {(x, w, near[t]) for t, (e, h) in by_text.items() for x in e for w in h})
    docs_te = Counter((x, w) for (i, t) in {(i, t) for i, t, _ in docs if t in by_text} for x in by_text[t][0] for w in by_text[t][1])

    def bound(k, n, z=1.64):  # the least share of which k of n would not be out of reach
        p = k / n
        return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    least = {(e, t): bound(n, n_t[t] - docs_te[e, t] + n) for (e, t), n in n_te.items()}
    marks = {t for (e, t), n in n_te.items() if n >= 2 and least[e, t] >= 0.5 and np.log(least[e, t] * len(docs) / n_e[e]) >= 0.8 * np.log(len(docs) / n_e[e])}
    assert {"quokka", "seen"} <= marks and not marks & {"once", "copied"}
    want = Counter((i, ",".join([base_spans(text)[1]] * bool(base_spans(text)[1]) + [f"term:{m.start()}:{m.end()}" for m in token.finditer(b) if m[0].lower() in marks])) for (i, text, _), b in zip(docs, bare))
    assert Counter((r["doc_id"], r["spans"]) for r in pii.find_personal_data(frame(spark, docs)).collect()) == want


def test_pii_many_matches_in_one_text(spark):
    n = 30_000
    text = "a@b.c 1 " * n
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, [(1, text, "en"), (2, "x", "en")])).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, [(1, text, "en"), (2, "x", "en")])).collect()}
    assert time.perf_counter() - began < 120
    want = ",".join(f"email:{8 * i}:{8 * i + 5}" for i in range(n))
    assert got[1]["n_email"] == n and got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert clean == {1: "[EMAIL] 1 " * n, 2: "x"}


# -- 2: near-duplicates -----------------------------------------------------------------
def brute_components(docs, size, percent):
    sets = {}
    for i, t, _ in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    docs, at = [], 0
    for _ in range(25):
        base = words(rng, rng.choice([3, 12, 60, 150]), 5000).split()
        for edits in (0, 0, 1, 2, 5, 9, 14):
            w = list(base)
            for _ in range(min(edits, len(w))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            docs.append((at, " ".join(w), "en"))
            at += 1
    shared = words(rng, 40, 5000)
    docs += [(1000 + i, shared + " " + words(rng, 60, 10**6), "en") for i in range(40)]
    for size in (4, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(frame(spark, docs), size, 80).collect()}
        assert got == brute_components(docs, size, 80)


def test_near_copies_that_link_only_to_one_are_not_paired_with_each_other(spark, monkeypatch):
    rng, compared = random.Random(31), []
    base = words(rng, 200, 10**6).split()
    docs = []
    for i in range(150):  # 0.81 like the base, 0.66 like one another; the base's id is not the lowest
        w = list(base)
        for k in range(4):
            w[rng.randrange(50 * k + 5, 50 * k + 45)] = f"e{i}x{k}"
        docs.append((i, " ".join(w), "en"))
    docs.append((999, " ".join(base), "en"))
    near = near_dup._near
    monkeypatch.setattr(near_dup, "_near", lambda pairs, classes: compared.append(pairs.count()) or near(pairs, classes))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(frame(spark, docs), 5, 80).collect()}
    assert got == brute_components(docs, 5, 80)
    assert sum(compared) < 10 * len(docs)


def test_pigeonhole_keys_find_all_pairs_under_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, near_dup.SYMBOLS).astype(np.uint16)
    for _ in range(300):
        b = a.copy()
        at = rng.choice(near_dup.SYMBOLS, near_dup.THRESHOLD, replace=False)
        b[at] ^= np.uint16(1)
        assert set(near_dup.bucket_keys(a[None])[0]) & set(near_dup.bucket_keys(b[None])[0])


def test_a_pair_is_compared_in_its_first_shared_bucket_only(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in range(120):
        a = rng.integers(0, 1 << 16, near_dup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(near_dup.SYMBOLS, n % 60, replace=False)] ^= np.uint16(256)
        keys = near_dup.bucket_keys(np.stack([a, b]))
        shared = np.flatnonzero(keys[0] == keys[1])
        rows += [(n, int(at), a.tobytes(), b.tobytes(), bool(at == shared[0])) for at in shared]
    pairs = spark.createDataFrame(rows, "n int, place int, u binary, v binary, first boolean")
    got = pairs.selectExpr("first", near_dup.first_shared("place", "u", "v") + " AS got").collect()
    assert got and all(r["got"] == r["first"] for r in got)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, None), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 3, 4: classifiers ------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(500):
        good = rng.random() < 0.6
        text = words(rng, 120, 3000) if good else " ".join(w + rng.choice(["###", "$$$"]) for w in words(rng, 120).split()) if i % 2 else ("spam " * 100)
        rows.append((i, text, "en"))
        marks.append((i, int(good), 0))
    labels = spark.createDataFrame([*marks, (3, None, None), (None, 1, 1), marks[4]], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(frame(spark, rows + [(900, None, "en"), (None, "", "en")]), labels).collect()}
    assert len(got) == 502 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [i for i, _, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i, _, _ in marks)
    assert np.mean([got[i]["predicted"] == marks[i][1] for i in held]) > 0.95
    none = quality.score_quality(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.5] * 3


def test_toxicity_finds_seeded_and_mined_words(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        bad = rng.random() < 0.2
        w = words(rng, 60, 3000).split()
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["idiot", "moron"]) if i % 2 else "grumbl" + rng.choice(["ex", "on", "ak", "um"])
        rows.append((i, " ".join(w), "en"))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame(spark, rows + [(900, None, "en")]), labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == marks[i][2] for i in held]) > 0.97
    assert got[900]["predicted"] == 0
    alone = toxicity.score_toxicity(frame(spark, [(1, "you idiot, you moron", "en"), (2, "a fine day", "en")]), labels.limit(0)).collect()
    assert {r["doc_id"]: r["predicted"] for r in alone} == {1: 1, 2: 0}


# -- 5: packing -------------------------------------------------------------------------
def test_packing_is_gapless_complete_and_tight(spark):
    rng = random.Random(8)
    docs = [(i, words(rng, rng.choice([3, 40, 200, 700])), "en") for i in range(120)]
    enc = bpe.encoder(tokenizer_path(WORD_BPE))
    got = packing.pack_documents(frame(spark, docs), tokenizer_path(WORD_BPE)).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for i, text, _ in docs:
        ids = np.array([*enc.encode(text), 0], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_seq) <= -(-total // 2048) + 1


def test_the_plan_uses_each_piece_once():
    rng = np.random.default_rng(1)
    for counts in (rng.integers(0, 40, 64), np.eye(64, dtype=int)[40] * 9, np.zeros(64, int)):
        for runs in (packing.solve(counts, 64), packing.best_fit(counts, 64)):
            used = Counter()
            for c, n in runs:
                used.update({k: m * n for k, m in c.items()})
                assert n > 0 and sum(k * m for k, m in c.items()) <= 64
            assert used == {i + 1: n for i, n in enumerate(counts) if n}


def test_best_fit_by_counts_is_best_fit_by_pieces():
    rng = np.random.default_rng(5)
    for trial in range(60):
        counts = rng.integers(0, 1 + trial % 9, 40) * (rng.random(40) < 0.4)
        bins: list[list[int]] = []
        for length in np.repeat(np.arange(40, 0, -1), counts[::-1]).tolist():
            fits = [b for b in bins if sum(b) + length <= 40]
            max(fits, key=sum).append(length) if fits else bins.append([length])
        got = Counter()
        for config, n in packing.best_fit(counts, 40):
            got[sum(k * m for k, m in config.items())] += n
        assert got == Counter(map(sum, bins))


def test_long_pieces_are_packed_in_little_room():
    rng = np.random.default_rng(6)
    counts = np.zeros(2048, np.int64)
    counts[1100:1900] = rng.multinomial(1_000_000, np.full(800, 1 / 800))
    tracemalloc.start()
    began = time.perf_counter()
    runs = packing.solve(counts, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for _, n in runs) == 1_000_000 and peak < 200e6 and time.perf_counter() - began < 60 and len(runs) < 10_000


def test_mined_voters_do_not_depend_on_the_partitions(spark):
    # each clean text has "thin" once; spread over tasks, each task sees it once
    rows = [(i, 1, "thin venom") for i in range(8)] + [(100 + i, 0, f"thin c{i}") for i in range(24)] + [(200, 0, "plain")]
    df = spark.createDataFrame(rows, "id long, y int, text string")
    one, many = toxicity.mined(df.coalesce(1)), toxicity.mined(df.repartitionByRange(len(rows), "id"))
    assert one == many and "venom" in one and "thin" not in one


# -- 6: perplexity rules ----------------------------------------------------------------
def test_base_rules_match_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "ab ", "\n", "a b a b ", "#x ", "|", "é\t", "line\n"]) for _ in range(rng.randrange(60)))
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, duplicates = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                duplicates += line in seen
                seen.add(line)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        assert perplexity.base_rules(text) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered))


def test_kneser_ney_sums_to_one_and_rejects_noise(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "ran"]) for _ in range(80)) + f" {i}", "en") for i in range(60)]
    noise = "".join(rng.choice("qxzjkvw#%&.,!19 ") for _ in range(600))
    source = frame(spark, docs).select("lang", "text")
    own = perplexity.inventories(source)
    parts = {r["part"]: bytes(r["data"]) for r in perplexity.train(source, own).collect()}
    model = perplexity.KneserNey.of(parts)
    for before in ("the cat", "qqq", "cat s", "ran 1"):
        context = perplexity.symbols(before, own["en"])[-4:-1]
        ids = np.array([perplexity.ngram_ids(np.append(context, s))[0] for s in range(perplexity.ALPHABET)])
        assert abs((10.0 ** model.log10(ids).astype(float)).sum() - 1) < 1e-4
    got = {r["doc_id"]: r for r in perplexity.apply_rules(frame(spark, docs + [(99, noise, "en")])).collect()}
    assert not got[99]["kept"] and sum(got[i]["kept"] for i in range(60) if not got[i]["base_failed"]) >= 0.95 * sum(not got[i]["base_failed"] for i in range(60))


def test_kneser_ney_matches_brute_force(spark):
    """Probabilities from the textbook's recursion over plain dictionaries, and the perplexities and bands they give."""
    rng = random.Random(17)
    letters = "абвгдежз ιωλ"
    docs = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(60 + i)), "xx") for i in range(40)]
    counts = Counter(c for _, t, _ in docs for c in re.sub(r"\s+", " ", t.lower()) if c != " ")
    rank = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    seqs = {i: [0] * 3 + [rank.get(c, 0) for c in re.sub(r"\s+", " ", t.lower())] + [0] for i, t, _ in docs}
    level = {4: Counter(tuple(s[k : k + 4]) for s in seqs.values() for k in range(len(s) - 3))}
    for n in (3, 2, 1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    discounts = {}
    for n, c in level.items():
        n1, n2, n3, n4 = (max(sum(v == k for v in c.values()), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[n] = [0, min(max(1 - 2 * y * n2 / n1, 0.05), 0.95), min(max(2 - 3 * y * n3 / n2, 0.05), 1.9), min(max(3 - 4 * y * n4 / n3, 0.05), 2.8)]
    followers = {n: Counter() for n in level}
    freed = {n: Counter() for n in level}
    for n, c in level.items():
        for g, v in c.items():
            followers[n][g[:-1]] += v
            freed[n][g[:-1]] += min(discounts[n][min(v, 3)], v)

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / perplexity.ALPHABET
        total = followers[n][gram[:-1]]
        if not total:
            return p(gram[1:])
        v = level[n][gram]
        return max(v - discounts[n][min(v, 3)], 0) / total + freed[n][gram[:-1]] / total * p(gram[1:])

    got = {r["doc_id"]: r for r in perplexity.apply_rules(frame(spark, docs)).collect()}
    for i, s in seqs.items():
        want = -np.mean([np.log10(p(tuple(s[k : k + 4]))) for k in range(len(s) - 3)])
        assert got[i]["log10_perplexity"] == pytest.approx(want, rel=1e-4)
    assert perplexity.groups_of({"a": 5, "b": 6, "c": 1, "d": 20}, 11) == [["a", "b"], ["c"], ["d"]]


def test_rare_characters_have_probabilities_of_their_own(spark):
    """Two characters of one class: the class's probability is shared by their counts, so the texts' scores differ by just that."""
    letters = [chr(0x4E00 + i) for i in range(perplexity.REAL)]
    table = perplexity.symbol_table(np.array([ord(c) for c in letters], np.int64))
    one = chr(0x5F00)
    two = next(chr(c) for c in range(0x5F01, 0x9000) if table[c] == table[0x5F00])
    body = " ".join("".join(letters) for _ in range(60))
    docs = [(1, body + one, "zh"), (2, body + two, "zh"), (3, body + one, "zh"), (4, body + one, "zh"), (5, body, "zh"), (6, "", "zh"), (7, "plain words", None)]
    got = {r["doc_id"]: r["log10_perplexity"] for r in perplexity.apply_rules(frame(spark, docs)).collect()}
    assert (got[2] - got[1]) * (len(body) + 2) == pytest.approx(np.log10(3), rel=1e-3) and got[1] == got[3]
    assert all(math.isfinite(x) for x in got.values())


# -- 7: lattice -------------------------------------------------------------------------
def test_lattice_adds_up_all_segmentations():
    model = lattice.lattice(tokenizer_path(PIECES))

    def brute(text):
        if not text:
            return 1.0
        c = text[0]
        total = np.exp(model.byte * (len(c.encode()) if c >= "\x80" else 1)) * brute(text[1:])
        for j in range(1, len(text) + 1):
            if text[:j] in model.log_p:
                total += np.exp(model.log_p[text[:j]]) * brute(text[j:])
        return total

    for word in ("a", "the", "thing", "größe", "zzq", "日本"):
        assert abs(model.log10(word) - np.log10(brute(lattice.MARK + word))) < 1e-9
    assert np.isfinite(model.log10("x" * 50_000))

    def segmentations(text):
        if not text:
            yield 0.0, Counter()
            return
        size = len(text[0].encode())
        for p, uses in segmentations(text[1:]):
            yield p + model.byte * size, uses + Counter({"": size})
        for j in range(1, len(text) + 1):
            if text[:j] in model.log_p:
                for p, uses in segmentations(text[j:]):
                    yield p + model.log_p[text[:j]], uses + Counter([text[:j]])

    for word in ("a", "the", "thing", "größe"):
        got, logs, want = {}, {}, Counter()
        model.expected(word, got)
        model._expected_long(lattice.MARK + word, logs)
        ways = list(segmentations(lattice.MARK + word))
        whole = sum(np.exp(p) for p, _ in ways)
        for p, uses in ways:
            for piece, k in uses.items():
                want[piece] += k * np.exp(p) / whole
        for found in (got, logs):
            assert set(found) == set(want) and all(found[x] == pytest.approx(want[x], abs=1e-12) for x in want)


def test_lattice_sums_of_many_words_equal_those_of_each():
    model, rng = lattice.lattice(tokenizer_path(PIECES)), random.Random(3)
    found = ["a", "", "größe", "日本", "▁", "a▁b", "▁▁▁x", "\0", "\U0001f996" * 20, "x" * 47, "y" * 48, "z" * 300, "the", "the"]
    found += ["".join(rng.choice("abcdefghiklmnorstuéß▁日") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    got, want, none = {}, {}, {}
    np.testing.assert_allclose(model.many(found, got), [model.log10(w) for w in found], rtol=1e-11)
    for w in found:
        model.expected(w, want)
    assert {x for x, v in want.items() if v > 1e-300} <= set(got) <= set(want)
    assert all(got[x] == pytest.approx(want[x], rel=1e-9, abs=1e-300) for x in got)
    assert len(model.many([], none)) == 0 and none == {}
    np.testing.assert_allclose(model.many(["q" * 60, "w"]), [model.log10("q" * 60), model.log10("w")])


def test_lattice_learns_from_words_below_plain_numbers(spark):
    rare = "\U0001f996" * 20  # spelled by bytes only: its probability is no plain number
    model, found = lattice.lattice(tokenizer_path(PIECES)), {}
    model.expected(rare, found)
    assert found[""] >= 80 and math.isfinite(model.log10(rare))
    texts = spark.createDataFrame([(1, rare), (2, "\u1234" * 40 + " word"), (3, "word " * 3)], "doc_id long, text string")
    for r in lattice.score_documents(texts, tokenizer_path(PIECES)).collect():
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_lattice_base_score_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "MAX_FREQUENT", 30)  # so that most words go by the join
    rng = random.Random(12)
    docs = [(i, words(rng, rng.randrange(80), 200).replace("w1", "W1"), "en") for i in range(100)]
    counts = Counter()
    for i, t, _ in docs:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(t.encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lattice.score_documents(frame(spark, docs), tokenizer_path(PIECES)).collect()}
    for i, t, _ in docs:
        w = [*t.encode().lower().split(), None]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    # the score, from counts and the lattice of the fitted weights
    seen = Counter(v for x, v in counts.items() if x is not None)
    discount = (seen[1] + 1) / (seen[1] + 2 * seen[2] + 2)
    start, sums = lattice.lattice(tokenizer_path(PIECES)), {}
    for x in counts:
        if x is not None:
            start.expected(x.decode(), sums)
    total = sum(sums.values()) + lattice.PRIOR
    log_p = {x: np.log((sums.get(x, 0) + lattice.PRIOR * np.exp(q)) / total) for x, q in start.log_p.items()}
    model = lattice.Lattice(log_p, np.log((sums.get("", 0) + lattice.PRIOR * lattice.BYTE_SHARE) / total / 256))
    for i, t, _ in docs:
        want = np.log10((counts[None] - discount) / n)
        for x in t.encode().lower().split():
            lent = discount * v / n * 10 ** model.log10(x.decode())
            want += np.log10((counts[x] - discount) / n + lent) if counts[x] else np.log10(lent)
        assert got[i]["score"] == pytest.approx(want)


# -- 8, 9, 10 ---------------------------------------------------------------------------
def test_languages_are_told_apart(spark):
    rng = random.Random(13)
    parts = {"aa": ["the", "ing", "shon", "wh"], "bb": ["eau", "ment", "éti", "oux"], "cc": ["sch", "ung", "über", "keit"]}
    docs = []
    for i in range(150):
        lang = rng.choice(sorted(parts))
        docs.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)), lang))
    got = {r["doc_id"]: r for r in language.language_id(frame(spark, docs + [(500, "123 !!", None), (501, None, "aa")])).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in docs)
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[500]["score"] == 0


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(14)
    docs = [(rng.randrange(10**6) * 3, words(rng, rng.randrange(90)) + rng.choice(["", "😀é"]), "en") for _ in range(150)]
    docs = list({i: (i, t, x) for i, t, x in docs}.values()) + [(-5, "tail", "en"), (10**9, "", "en")]
    order = sorted(docs)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark, docs)).collect()}
    for k, (i, text, _) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        common = next((j for j, (a, b) in enumerate(zip(text, edited)) if a != b), min(n, len(edited)))
        assert r["common_prefix"] == common
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1 if text == edited else True)


def test_span_equality_and_extensions():
    rng = random.Random(15)
    a, b = ("".join(rng.choice("ab") for _ in range(300)) for _ in range(2))
    x, y = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
    for _ in range(500):
        i, j, w = rng.randrange(280), rng.randrange(280), rng.randrange(1, 8)
        assert (x.span(i, i + w) == y.span(j, j + w)) == (a[i : i + w] == b[j : j + w])
        k = 0
        while i + k < 300 and j + k < 300 and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    rng = random.Random(16)
    alphabet = [*"aAbBzéÉßİΣσς's'T 123½²٣ ́  \x1c\x85日本語한글😀ﬁﬀǅ\x00\t\n!?#*~", "<|startoftext|>", "<|endoftext|>", "'re", "the", "ing"]
    docs = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40))), "en") for i in range(1500)] + [(9000, "abcdefghij" * 2000, "en"), (9001, "é日" * 5000, "en")]
    got = {r["doc_id"]: r for r in bpe.digest_documents(frame(spark, docs), tokenizer_path(WORD_BPE)).collect()}
    for i, text, _ in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    row = bpe.encode_documents(frame(spark, docs[:1]), tokenizer_path(WORD_BPE)).collect()[0]
    assert row["ids"] == library.encode(docs[0][1], add_special_tokens=False).ids


def test_cuts_stand_only_where_no_token_joins(spark):
    enc = bpe.encoder(tokenizer_path(WORD_BPE))
    for symbols in ("hello", "zqxjkv", "aæÿ"):
        parts = enc.cuts(symbols)
        assert "".join(parts) == symbols
        assert all(parts[i][-1] + parts[i + 1][0] not in enc.joined for i in range(len(parts) - 1))


def test_session_setting_names_the_shared_folder(spark):
    from tidewater.llm.common import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.range(3).select(F.lit(1)).count() == 3
