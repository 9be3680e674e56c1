"""Small numpy helpers used inside tasks."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import cut

HELD_OUT_FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text, modulo 5, is 0: such rows are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0


def documents_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of all rows that have a doc_id; whatever else the table holds is left behind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null")


def with_part(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and more) with ``part``, which tells the texts of a repeated doc_id apart; it is 0 where an id has one row."""
    repeated = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("_repeated")))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(repeated, "doc_id", "left").withColumn("part", F.when(F.col("_repeated"), text).otherwise(F.lit(0).cast("long"))).drop("_repeated")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't multiply a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def mix64(h: np.ndarray) -> np.ndarray:
    """A full-avalanche mix of unsigned 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
