"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecal.llm import sql
from scorecal.llm.corpus import DOMAIN_SQL, WEIGHTS, documents, levels, tokenizer_path
from scorecal.llm.divergence import SQL as DIVERGENCE_SQL
from scorecal.llm.divergence import source_divergence
from scorecal.llm.exact_dedup import exact_dedup
from scorecal.llm.importance import importance_resample
from scorecal.llm.langid import identify_languages
from scorecal.llm.licenses import RULES, SENTENCES, scan_licenses
from scorecal.llm.line_dedup import line_dedup
from scorecal.llm.mixing import mix_sources
from scorecal.llm.near_dedup import near_dedup
from scorecal.llm.neighbours import nearest
from scorecal.llm.packing import pack
from scorecal.llm.quality_model import score_quality
from scorecal.llm.quality_rules import RULES as QUALITY_RULES
from scorecal.llm.quality_rules import apply_quality_rules
from scorecal.llm.substrings import substring_dedup


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), k=3, num=85, den=100)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), levels(), WEIGHTS, share=1.0, max_epochs=3, seed=7)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), risk=0.04, delta=0.05)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir), min_docs=30, top=50)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=5, min_words=20, buckets=10000, seed=42)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_source_mixing": op4_source_mixing,
    "op5_language_id": op5_language_id,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": pipeline,
}
ORACLE_SQL = {
    "op4_source_mixing": sql.mixing(DOMAIN_SQL, WEIGHTS, 1.0, 3, 7),
    "op6_license_scan": sql.license_scan(SENTENCES, RULES),
    "op8_quality_rules": sql.quality_rules(QUALITY_RULES, 0.04, 0.05),
    "op10_exact_dedup": sql.EXACT_DEDUP,
    "op11_source_divergence": DIVERGENCE_SQL.format(min_docs=30, top=50),
}
