"""From raw documents to a training mix: five stages, each one operator of `jobloom.llm`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm.decontaminate import decontamination_stage
from jobloom.llm.jaccard_join import near_duplicate_stage
from jobloom.llm.language_id import language_stage
from jobloom.llm.mixing import mixing_stage
from jobloom.llm.personal_data import personal_data_stage
from jobloom.session import fresh_path

STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
]

#: Learned stages (language, personal data) and fingerprint orders have no SQL; `tests/llm/test_pipeline.py` checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
