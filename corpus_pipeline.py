"""Corpus pipeline: documents in, token ids of the cleaned corpus out. Each stage takes (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontaminate, language_id, line_dedup, sentencepiece_codec, simhash
from inkwell.llm.common import stored, table

#: In order: documents without a recognised language go; repeated lines go; one document of each near-duplicate group stays;
#: contaminated documents go; what is left is encoded.
STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_dedup", simhash.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]

#: The stages' results cannot be expressed in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
