"""A corpus pipeline of five stages, each a call of one of the text operators with its production parameters.

Each stage gets what the one before it kept, in the columns of ``documents``; the last returns a manifest: for
each row of the mix, its document and its place in the shards.

Defined results, as the operators have them: null, empty and blank texts fail the quality rules; of rows equal in
doc_id and text one stays; documents without a doc_id are kept like others and come last where order matters; a null
source is a source; further columns of ``documents`` go along up to the mix; empty tables give an empty manifest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, mixing, quality, sharding, simhash
from tidelog.llm.common import settle, table
from tidelog.sources import shared_folder

#: Near-duplicates have this share of their five-word shingles in common; fingerprints (of two-word shingles) that differ
#: by at most so many bits propose them.
NEAR, NEAR_BITS = 0.8, 7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, limit=NEAR_BITS, threshold=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shards", shards),
]

#: SimHash needs a hash that DuckDB lacks, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. What each returns is written as Parquet and read again, in the shared
    folder of ``spark.checkpoint.dir``; all these files go when the last stage's result is settled, or on an error."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
        return settle(docs)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(base)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
