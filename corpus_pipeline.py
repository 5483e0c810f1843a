"""The corpus pipeline: each stage reads all that its predecessor kept.

``run`` writes each stage's rows as Parquet in the shared folder and hands the reread table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialise
from tidemark.llm.decontaminate import decontamination_stage
from tidemark.llm.jaccard import jaccard_stage
from tidemark.llm.language import language_stage
from tidemark.llm.packing import packing_stage
from tidemark.llm.suffix_dedup import suffix_stage

STAGES = [
    ("language", language_stage),
    ("jaccard", jaccard_stage),
    ("suffixes", suffix_stage),
    ("decontaminate", decontamination_stage),
    ("pack", packing_stage),
]

#: Models, components and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
