"""The corpus pipeline: five stages, each on all that its predecessor kept.

toxicity (rejected documents go), near-duplicates (one document of each group stays), benchmark
decontamination (documents that hold an item go), secret scans (found spans are replaced in the text) and
packing (the result: one row per piece of a sequence).  All but the last return the columns of `documents`.

Each stage is written as Parquet in the shared folder and read again as the next one's input.

Cases: empty and null texts pass every filter and are packed as the end id alone; an empty table gives an
empty result; extra columns pass through the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from athanor.llm.decontamination import without_leaks
from athanor.llm.near_duplicates import kept_documents
from athanor.llm.packing import pack_documents
from athanor.llm.scratch import Scratch
from athanor.llm.secrets import redact_secrets
from athanor.llm.toxicity import without_toxic

#: SQL can't express the stages; tests hold each against a plain version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, with_ids=False)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
