"""The corpus pipeline: stages that run one after the other, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollbook.llm.decontamination import decontamination_stage
from rollbook.llm.exact_dedup import exact_dedup_stage
from rollbook.llm.quality import quality_stage
from rollbook.llm.simhash_dedup import simhash_stage
from rollbook.llm.sp_sampling import encoding_stage
from rollbook.session import drop_folder, new_folder, scratch, table_of

STAGES = [
    ("quality", quality_stage),
    ("exact-dedup", exact_dedup_stage),
    ("simhash-dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The classifier, the near-duplicate links and the sampled segmentations are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives for the documents of sf_dir.

    Each stage works on all that the one before kept, written and read again; what a stage wrote for itself, and what the
    next one has read, goes. How stages treat nulls, long texts, repeated rows, empty tables and other columns is theirs to say.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        with scratch():
            docs = table_of(stage(spark, docs, sf_dir), f"stage-{name}", path)
        if last:
            drop_folder(spark, last)
        last = path
    return docs
