"""Corpus pipeline: quality classifier, SimHash near-dedup, mixing to target weights, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm.common import scratch_path
from fieldloom.llm.mixing import mixed_documents
from fieldloom.llm.pieces import encode_stage
from fieldloom.llm.quality import keep_good
from fieldloom.llm.simhash import keep_one

STAGES = [
    ("quality", keep_good),
    ("simhash", keep_one),
    ("mixing", mixed_documents),
    ("pieces", encode_stage),
]

#: A trained model and a vocabulary file: not SQL. Tested stage by stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
