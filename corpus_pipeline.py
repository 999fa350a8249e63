"""The corpus pipeline: five operators of ``gradeloom.llm``, one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. The stages themselves are in ``gradeloom.llm.stages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import stages
from gradeloom.session import Scratch
from gradeloom.sources.tables import table

STAGES = [
    ("language_id", stages.language_id),
    ("toxicity", stages.toxic_documents),
    ("line_dedup", stages.common_lines),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("packing", stages.packed_sequences),
]

#: SQL expresses neither the language model nor the classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables between stages are deleted as soon as the next one is written."""
    batch = spark.conf.get(stages.BATCH)
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
            if before:
                scratch.drop(before)
            before = name
    finally:
        spark.conf.set(stages.BATCH, batch)
    return STAGES[-1][1](spark, docs, sf_dir)
