"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, documents, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  The query name is ``pipeline``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import op2_packing, op3_secrets, op4_neardup, op6_decontaminate, op9_quality
from quernel.llm.common import Workspace, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  Labels are those of the whole corpus."""
    model = op9_quality.train(docs, table(spark, sf_dir, "labels"))
    return op9_quality.keep(docs, model, op9_quality.CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of similarity 0.8 or more, the one with the least id."""
    return op4_neardup.distinct_documents(docs, per=80, of=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return op6_decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are masked; the words of the corpus cost little to guess."""
    return op3_secrets.redact(docs, words=op3_secrets.dictionary(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their ids."""
    return op2_packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        new = work.save(stage(spark, docs, sf_dir), name)
        work.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
