"""Parameters that the queries and the pipeline share for the test corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; every worker has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def levels() -> dict[str, Column]:
    """The tree of the documents table; domains are ranges of source numbers."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)"), F.lit(99))
    return {"domain": F.when(number < 5, "hub").when(number < 15, "web").otherwise("tail"), "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {"domain": {"hub": 3, "web": 5, "tail": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "*": 1}}
DOMAIN_SQL = "CASE WHEN coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 99) < 5 THEN 'hub' WHEN coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 99) < 15 THEN 'web' ELSE 'tail' END"
