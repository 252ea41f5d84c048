"""One query for each operator, over the whole ``documents`` table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontamination, fingerprint, language, lattice, near_dup, packing, perplexity, pii, quality, search, toxicity
from .common import benchmark, documents, labels

#: Vocabulary files are parameters; these are the ones the queries take.
WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op2_multi_index_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), shingle=4, percent=80)


def op3_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_weakly_supervised_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path(WORD_BPE), capacity=2048, end_id=0)


def op6_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.apply_rules(documents(spark, sf_dir))


def op7_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(documents(spark, sf_dir), tokenizer_path(PIECES))


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir))


def op9_prefix_hash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op10_bpe_forced_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op11_weighted_automata_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), min_count=100, longest=5, top=2000).drop("words")


def op12_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(documents(spark, sf_dir), benchmark(spark, sf_dir), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op13_reversed_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(documents(spark, sf_dir), benchmark(spark, sf_dir), top=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_disclosure_sanitisation": op1_disclosure_sanitisation,
    "op2_multi_index_near_duplicates": op2_multi_index_near_duplicates,
    "op3_additive_quality": op3_additive_quality,
    "op4_weakly_supervised_toxicity": op4_weakly_supervised_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_kneser_ney_rules": op6_kneser_ney_rules,
    "op7_subword_lattice": op7_subword_lattice,
    "op8_hyperdimensional_language": op8_hyperdimensional_language,
    "op9_prefix_hash_fingerprints": op9_prefix_hash_fingerprints,
    "op10_bpe_forced_boundary": op10_bpe_forced_boundary,
    "op11_weighted_automata_collocations": op11_weighted_automata_collocations,
    "op12_suffix_automaton_decontamination": op12_suffix_automaton_decontamination,
    "op13_reversed_lexical_search": op13_reversed_lexical_search,
}

#: Where SQL can express an operator: all pairs through an inverted index, components by recursion.
ORACLE_SQL: dict[str, str] = {
    "op2_multi_index_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.other FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, any_value(len(s.s)) AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
""",
    "op11_weighted_automata_collocations": r"""
WITH w AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS _(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k >= 2),
b AS (SELECT x.lang, x.phrase FROM c x JOIN c y ON x.lang = y.lang AND x.k < y.k AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') GROUP BY ALL),
s AS (SELECT lang, phrase, a, k, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS lp, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c ANTI JOIN b USING (lang, phrase))),
o AS (SELECT s.lang, s.phrase, s.a, s.j, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * s.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM s JOIN t USING (lang) JOIN f x ON x.lang = s.lang AND x.phrase = lp JOIN f y ON y.lang = s.lang AND y.phrase = rp),
m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM m QUALIFY rank <= 2000
""",
    "op12_suffix_automaton_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (
  SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
g AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM (
  SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
m AS (SELECT r, p, g.k, item_id FROM g JOIN v ON g.k = v.k AND g.s = v.s),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
""",
    "op13_reversed_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS x, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS y, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark),
q AS (SELECT y, item_id, t, count(*) AS c FROM i GROUP BY ALL),
u AS (SELECT x, t, count(*) AS tf FROM (SELECT x, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
g AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
f AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM u, g GROUP BY t, n),
m AS (SELECT x, doc_id, 100 - 25 + (25 * len(w) * n) // l AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT y, item_id, doc_id, x, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM u JOIN q USING (t) JOIN f USING (t) JOIN m USING (x) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY y ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
""",
}
