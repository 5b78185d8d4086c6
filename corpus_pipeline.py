"""A training corpus from documents: identified languages, no repeated lines or near copies, no benchmark items, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back as the next
stage's docs. All but the last keep the columns of documents.

Every stage takes an empty table, columns beside those of documents under whatever names, repeated rows and nulls in
any column. A document without doc_id is judged by its text alone and never stands for another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semilattice.llm import decontam, langid, linededup, neardup, packing, queries
from semilattice.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the field is sure of; those with a null or letterless text or a mean posterior below a half go.

    Repeated rows stay or go together; the field is fitted anew on the documents given, and without any language all go.
    """
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)), 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one holds; a document that nothing is left of goes.

    The smaller doc_id is the earlier one; rows that share a doc_id are not compared; null texts stay as they are.
    """
    out = linededup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = out.where(F.coalesce(left, F.lit(True)))
    chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*(chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id; of rows that share it one stays, by text."""
    return neardup.keep_first(docs, 80, 100, collections=12)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and wordless texts contain none."""
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"), 80, 100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens.

    A null text is one end token; repeated rows are packed each; pieces of equal length take places in any order.
    """
    return packing.pack_documents(spark, docs, queries.tokenizer_path(), 2048, 0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch.write(docs, name)
    return docs


#: SQL can express neither the field's posteriors nor the alignment; the stages are tested against brute force.
ORACLE_SQL = None
