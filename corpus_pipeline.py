"""A corpus pipeline of five stages over documents: language, lines, near-duplicates, benchmark, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
run() writes what each stage returns to the shared folder and reads it back, so lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlace.llm import bpe, decontaminate, langid, lines, near, scratch

STAGES = [
    ("language", langid.keep_known),
    ("lines", lines.without_boilerplate),
    ("near", near.one_of_each),
    ("benchmark", decontaminate.without_benchmark),
    ("tokens", bpe.encode_texts),
]
#: SQL expresses neither the language model nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch.scope(spark):  # what a stage has stored on its way goes when its result is written
            docs = store.table(stage(spark, docs, sf_dir), name)
    return docs
