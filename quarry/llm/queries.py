"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_gam import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_output import token_output

    return token_output(table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_mix_sources, op3_decontaminate, op4_token_output, op5_suffix_dedup, op6_license_scan, op7_language_id, op8_quality_rules, op9_toxicity, op10_near_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    from quarry.llm import decontaminate, mixing

    return {"op2_mix_sources": mixing.ORACLE, "op3_decontaminate": decontaminate.ORACLE}
