"""The corpus pipeline: documents through five operators of corpusmith.llm, one stage after another.

Each stage takes what the one before kept, with the columns of documents, and its decisions take effect: toxic documents go,
repeated and near-repeated lines leave their texts, one document of each group of near duplicates stays, documents that leak a benchmark
item go, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmith.llm.bpe import bpe_stage
from corpusmith.llm.common import staged
from corpusmith.llm.decontaminate import decontamination_stage
from corpusmith.llm.lines import line_stage
from corpusmith.llm.minhash import minhash_stage
from corpusmith.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", minhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_level_bpe", bpe_stage),
]

#: A trained model and a tokenizer can't be said in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
