"""From raw documents to packed token sequences, in five stages over ``documents``.

Each stage gets (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame that is written as Parquet and read again for the next.
The operators are imported when a stage is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.durable import Scratch, cut, discard


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from graphloom.llm.langid import language_stage

    return language_stage(spark, docs, sf_dir)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import quality_stage

    return quality_stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from graphloom.llm.neardup import neardup_stage

    return neardup_stage(spark, docs, sf_dir)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from graphloom.llm.substrings import substring_stage

    return substring_stage(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import packing_stage

    return packing_stage(spark, docs, sf_dir)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packing),
]

#: SQL cannot express the language model, the chunks or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of what the stages write, only the last one's result stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with Scratch() as s:
            docs = s.keep(cut(stage(spark, docs, sf_dir)))
        discard(before)
        before = docs
    return docs
