"""The corpus pipeline: toxicity, line de-duplication, near-duplicates, benchmark decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on every document that its predecessor kept. All but the last
return the columns of ``documents``, whatever further ones there are and whatever they are called. Rows with a null
doc_id, null and empty texts, very long texts, repeated rows and empty tables go through every stage; what becomes of
them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import decontam, line_dedup, neardup, packing, toxicity
from winnow.llm.shared import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars of the text as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labelled ones among them, doesn't reject.

    A null or empty text is scored as one unknown word. Without labels of both classes all documents stay.
    """
    return _as_documents(toxicity.keep_clean(docs, _table(spark, sf_dir, "labels")), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that several share; one that loses all its lines stays, with an empty text.

    A null text becomes one empty line, that is an empty text; a row without a doc_id loses none.
    """
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id.

    Documents without a doc_id, a text or words are in no group and stay; so do all rows of the doc_id that stays.
    """
    return _as_documents(neardup.keep_one(docs), docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contaminated ones, and without benchmark passages in the others.

    Each row by its own text, also where rows share a doc_id or have none; texts without passages stay as they are.
    """
    return _as_documents(decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and their places in sequences of 2048 tokens.

    A null or empty text is one closing id; each row is packed, also one without a doc_id and one that repeats another.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: The classifier of the first stage can't be expressed in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input; an empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
