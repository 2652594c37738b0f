"""Documents to packed training sequences in stages, each written and reread as the next one's input.

Every stage but the last returns rows of `documents` with all columns. Stages judge whole texts; equal ids and
repeated rows are judged row by row; empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm import near_dedup, packing, quality_rules, toxicity
from voxelweave.session import delete, new_path, ship, temporaries


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the base rules or the perplexity bands reject go."""
    ship(spark)
    return quality_rules.filter_quality(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: documents predicted toxic go; the model learns from what stage 1 kept and its labels."""
    ship(spark)
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: one document of each class of near-duplicates stays."""
    ship(spark)
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: what is left is packed into sequences of 2048 ids."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("MinHash near-dedup", near), ("best-fit packing", pack)]

#: Perplexity, a trained classifier and signatures are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-").lower())
        with temporaries(spark):  # what a stage has written on its way goes once its result is written
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
