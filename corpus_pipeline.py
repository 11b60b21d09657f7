"""Corpus pipeline: quality rules, near-dedup, benchmark decontamination, mixing to target weights, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the next
stage's documents. All but the last return the columns of documents, whatever other columns these have.

quality_rules    A null or empty text has no words and goes. Rows are decided one by one, so repeated rows share a verdict.
near_dedup       One row of each class of equal and near texts stays, that of the least id; null texts, which have gone
                 before in a run, are classes of their own. Rows without an id, or with a shared one, are told apart.
decontamination  A document goes if a window of one benchmark item or more occurs in it; the others stay whole.
mixing           Repeats a document by repeating its row; null sources are a source, ids with equal hashes go together.
token_output     Null texts are empty ones; null ids come first; rows that share an id are ordered by their texts' hashes.
Empty tables give empty results in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, mixing, near_dedup, quality_rules
from quarry.llm.queries import table, tokenizer_path
from quarry.llm.store import release, written
from quarry.llm.token_output import token_output


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.stage(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.stage(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.stage(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(docs)


def output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", rules_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", output_stage),
]

#: The learned rules, the hashed signatures and the merges of the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
