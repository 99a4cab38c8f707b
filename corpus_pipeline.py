"""The corpus pipeline: stages from documents to packed sequences, by operators of knotwork.llm.

Quality rules and the quality classifier drop what they reject, SimHash near-dedup leaves one document of each group,
mixing repeats documents of rarer sources, and best-fit packing lays all of them out in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm.mixing import mixing_stage
from knotwork.llm.packing import packing_stage
from knotwork.llm.quality_classifier import quality_classifier_stage
from knotwork.llm.quality_rules import quality_rules_stage
from knotwork.llm.simhash import simhash_stage
from knotwork.llm.util import stored
from knotwork.storage import WRITTEN, discard

STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("simhash near-dedup", simhash_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: Suffix arrays, a trained field and packing aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that are left. Each stage's table is written to the shared folder; once it is,
    the table before it and all that the stage wrote on its way are deleted."""
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, first, -1)
    return STAGES[-1][1](spark, docs, sf_dir)
