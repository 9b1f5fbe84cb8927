"""From raw documents to packed sequences: filters, one of each near duplicate, no leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subdiv.llm.decontaminate import drop_leaks
from subdiv.llm.ngram_join import keep_one_of_each
from subdiv.llm.packing import pack_stage
from subdiv.llm.quality_model import keep_by_model
from subdiv.llm.quality_rules import keep_by_rules
from subdiv.session import materialize

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_model", keep_by_model),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("packing", pack_stage),
]

#: SQL cannot express the models, the edit distances or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
