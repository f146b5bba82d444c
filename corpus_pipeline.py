"""From raw documents to token ids: each stage works on all rows that the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._shared import stage
from tidemark.llm.bpe import stage_bpe
from tidemark.llm.minhash import stage_near_duplicates
from tidemark.llm.mixing import stage_mix
from tidemark.llm.pii import stage_pii
from tidemark.llm.quality import stage_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_quality(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_near_duplicates(spark, docs, sf_dir)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_pii(spark, docs, sf_dir)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_mix(spark, docs, sf_dir)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stage_bpe(spark, docs, sf_dir)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixing", mixing), ("tokens", tokens)]

#: Signatures, expectation-maximisation, keyed permutations, seeded draws and merges have no SQL form; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
