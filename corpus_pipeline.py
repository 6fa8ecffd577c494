"""A training corpus from `documents`, in five stages. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waystone.llm import blocks, decontaminate, jaccard, packing, substrings, toxicity
from waystone.llm.queries import tokenizer
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The model learns from labelled documents of this stage's input."""
    return toxicity.drop_toxic(docs, _read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that stand elsewhere too; documents without repeats stay as they are."""
    out = substrings.remove_repeats(docs, keep_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    made = out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint"))
    return made.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1024 ids."""
    return packing.pack_sequences(docs.select("doc_id", "text"), tokenizer())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_of_each), ("substring_dedup", cut_repeats), ("decontamination", decontaminated), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = blocks.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned first stage and the tokenizer of the last cannot be put in SQL; tests check each stage by brute force.
ORACLE_SQL = None
