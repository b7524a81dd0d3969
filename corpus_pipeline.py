"""The training-text pipeline: stages over ``documents``, each written as Parquet and read again for the next.

A stage is ``(name, function)``; the function takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of ``documents``; the last one adds the mix's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftledger.llm import decontam, jaccard, mixing, pii, quality
from shiftledger.llm.common import saved, table

STAGES = [
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("benchmark decontamination", decontam.stage),
    ("personal data", pii.stage),
    ("mixing", mixing.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage{k}")
    return docs


ORACLE_SQL = None  # block-max WAND and the term spans are not SQL; tests hold run() against a plain Python version
