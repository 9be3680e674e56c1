"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``; the last returns the packed pieces. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.decontam import contaminated_pairs
from tabulon.llm.lines import dedup_lines
from tabulon.llm.neardup import near_duplicates
from tabulon.llm.packing import op7_packing
from tabulon.llm.toxicity import learn_toxicity, score_toxicity
from tabulon.session import cut, table

#: No stage but the first one's filter and the joins is expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def _like_documents(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    Null and empty texts stay, and so do rows without an id unless their text is toxic; repeated rows are scored each for itself. Extra
    columns, whatever their names, pass through. An empty table gives an empty one.
    """
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select(F.struct("*").alias("doc")), model, "doc.text")
    return scored.where("toxicity.score < 0.5").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; a document of which no line is left goes too, unless it was blank before.

    A null text stays null. Rows without an id keep all their lines, and so do both rows of an id that is repeated whole, where
    they are the first. Extra columns, whatever their names, pass through. An empty table gives an empty one.
    """
    found = dedup_lines(docs.select("doc_id", "text", F.struct("*").alias("doc")))
    emptied = (F.size("removed_lines") > 0) & ~F.col("text").rlike(r"\S")
    own = [F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return _like_documents(found.where(~F.coalesce(emptied, F.lit(False))).select(*own))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) the document with the smallest id stays, and one row of each id.

    An id of which any row is kept stays; of its rows the one with the least text in Spark's order does. Null, empty and wordless texts are
    in no group and stay; so do all rows without an id. Extra columns, whatever their names, pass through. An empty table gives an empty one.
    """
    decided = near_duplicates(docs, words=5, percent=80).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    dropped = decided.where(~F.col("kept")).select("doc_id")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id")
    rows = kept.join(repeated, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("doc"))
    ones = rows.groupBy("doc_id").agg(F.min_by("doc", F.struct("doc.text")).alias("doc")).select("doc.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(ones)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go, with all rows of their id.

    Null and empty texts and rows without an id stay; repeated rows share their id's decision. Extra columns, whatever their names, pass
    through. An empty table, of documents or of items, removes nothing.
    """
    found = contaminated_pairs(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed.

    Null and empty texts are pieces of one token; repeated rows are pieces of their own; rows without an id are left out. Extra columns
    are ignored. An empty table gives an empty one.
    """
    return op7_packing(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        gc.collect()  # models refer to themselves; what they sent goes with them, on the driver's JVM too
        pa.default_memory_pool().release_unused()
    return STAGES[-1][1](spark, docs, sf_dir)
