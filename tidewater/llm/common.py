"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these (the contract's ``[^\x20\x09-\x0D]+``).
WORD_SPACE = r"[\x20\x09-\x0D]+"

_held: dict[str, Callable[[], None]] = {}

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one machine (local mode,
    tests) may leave it out: a temporary folder stands in. Elsewhere that raises an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own_dir()
    return at.rstrip("/")


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tidewater-")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors. The tables are
    removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewater-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_tables() -> None:
    for spark, path in _written:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has gone; nothing is left to do
            return


def hold(name: str, clear: Callable[[], None] | None = None) -> None:
    """Makes ``name`` the one operator whose caches this Python worker keeps.

    Workers serve one stage after another; a task calls this first, and what an earlier
    operator has cached (``clear`` empties it) goes.
    """
    for other in [x for x in _held if x != name]:
        _held.pop(other)()
    if clear is not None:
        _held[name] = clear


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
