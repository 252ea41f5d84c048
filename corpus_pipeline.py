"""The corpus pipeline: documents to packed training sequences.

Each stage works on all rows its predecessor kept: toxic documents go, low-quality
documents go, one document of each near-duplicate group (five-word shingles, similarity
0.8) stays, personal data is sanitised in the texts, and the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import near_dup, packing, pii, quality, toxicity
from tidewater.llm.common import documents, labels, materialise, whole_text
from tidewater.llm.queries import WORD_BPE, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Scores from which a document counts as toxic, and as good.
TOXIC_FROM, GOOD_FROM = 0.3, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under ``TOXIC_FROM``.

    Null and empty texts have no votes and stay; repeated rows and rows without an id are scored each and
    stay or go alike; without labelled rows the seed lexicon decides; an empty table stays empty; columns
    beyond those of documents are left out.
    """
    model = toxicity.fit_toxicity(docs, labels(spark, sf_dir))
    return docs.where(toxicity.toxicity_score(model, whole_text()) < TOXIC_FROM).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is ``GOOD_FROM`` or more.

    Null and empty texts are scored by their shape like others; without labelled rows every score is 0.5
    and all stay; repeated rows and rows without an id are scored each; an empty table stays empty.
    """
    model = quality.fit_quality(docs, labels(spark, sf_dir))
    return docs.where(quality.quality_score(model, whole_text()) >= GOOD_FROM).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the lowest id, rows without an id last.

    Rows are told apart by themselves, not by their ids, so of repeated rows one stays and of two texts
    under one id each is judged alone. Null, blank and empty texts are like nothing and all stay.
    """
    # ids may be missing or stand more than once: each row is judged by a number of its own
    rows = materialise(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()))
    found = materialise(near_dup.near_duplicates(rows, shingle=5, percent=80, id_col="__row").select("__row", "component_id"))
    # of each group the lowest id stays, a missing one last
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    stay = found.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(F.min(order)["__row"].alias("__row"))
    dropped = found.join(stay.select("__row"), "__row", "left_anti").select(F.col("__row").alias("id"))
    return near_dup.without(rows, "__row", materialise(dropped)).select(*COLUMNS)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what reveals it replaced in the texts, and n_chars counted anew.

    Null texts stay null (n_chars too), empty ones empty; repeated rows and rows without an id are
    sanitised each.
    """
    clean = pii.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2,048 tokens.

    A null or empty text is one end token; repeated rows and rows without an id are packed each; an empty
    table gives no rows.
    """
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", sanitise),
    ("best-fit packing", pack),
]

#: No SQL expresses the fitted models; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
