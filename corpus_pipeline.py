"""Corpus pipeline: toxicity, quality rules, near duplicates, mixing, BPE ids.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All stages but the last return the columns
of documents. Null, empty and repeated rows are handled as the operators' docstrings say; columns
beyond those of documents are passed on by all stages but the last.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.llm import op2_mixing, op5_jaccard, op7_quality, op8_toxicity, op10_bpe
from revspark.llm.common import Stage, table
from revspark.session import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    ship_package(spark)
    return op8_toxicity.without_toxic(docs, op8_toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the forest go."""
    ship_package(spark)
    return op7_quality.good_only(docs, op7_quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets stays."""
    return op5_jaccard.one_of_each(docs, Stage(spark, "pipeline-op5"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken 0 to 2 times, towards their sources' target words."""
    stage = Stage(spark, "pipeline-op2")
    return op2_mixing.take_copies(docs, op2_mixing.mix_sources(docs, stage), stage)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    ship_package(spark)
    coded = op10_bpe.encode(docs, op10_bpe.model_bytes(), keep=("doc_id", "source"))
    return coded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources", mixing), ("BPE ids", bpe_ids)]

#: trained classifiers and random rounding have no SQL form; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage.save(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
