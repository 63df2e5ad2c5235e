"""Corpus preparation: quality, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes
what a stage returns as Parquet in the shared folder and reads it back for the next. All but
the last return the columns of ``documents``.

Defined results: null texts count as empty; rows that repeat a doc_id are documents of their own in every
stage; of equal or near-equal documents the smallest doc_id stays, and a null one loses; every stage takes an empty table and
returns one; other columns are passed on, whatever their names, by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlake.llm import decontaminate, exact_dedup, near_dedup, packing, quality, queries
from stintlake.llm.common import read, stored

QUALITY_FROM = 0.7
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ``QUALITY_FROM``. The model learns from the labels and
    the documents of this stage's input."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    meta = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.where(quality.quality_score(model, F.col("text"), meta) >= QUALITY_FROM)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts (white space aside)."""
    return exact_dedup.drop_exact_duplicates(docs).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, width=NEAR_WORDS, percent=NEAR_PERCENT).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed by minimum bin slack."""
    return packing.tokenize_and_pack(docs, queries.tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained score, MinHash groups and edit distance have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
