"""Cleaning a corpus in five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the
shared folder and reads again as the next one's docs.  All but the last return the
columns of documents.  Each works on ids, texts that are null, empty or repeated, and further columns of any name, as its
docstring says; an empty table goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candela.llm.common import scratch, stored
from candela.llm.decontaminate import stage_decontaminate
from candela.llm.quality import stage_quality
from candela.llm.segment import stage_segmentation
from candela.llm.simhash import stage_near_duplicates
from candela.llm.suffix import stage_suffix_dedup

STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("suffix_dedup", stage_suffix_dedup),
    ("decontaminate", stage_decontaminate),
    ("segmentation", stage_segmentation),
]

#: None of the stages but the fourth can be said in SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the last one's rows. What a stage read is dropped once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES:
            with scratch(spark):
                docs = stored(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
