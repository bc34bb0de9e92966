"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprint, language, oracles, packing, pii, quality, similarity, token_counts, token_file, url_filter
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=1, limit=4096)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.languages(docs, language.learn(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scores(docs, quality.learn(docs, labels))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_documents(documents(spark, sf_dir), width=3, percent=90)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(documents(spark, sf_dir))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.token_file_path(spark)
    token_file.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return token_file.read_token_files(spark, path)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


#: verdict, host, path
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.url_verdicts(pages, URL_RULES, url_filter.page_outcome(F.col("html"), F.col("url")))


def queries() -> dict[str, Query]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """Learned scores, token ids and hashes that DuckDB doesn't have are tested against plain versions instead."""
    return {"op1_decontamination": oracles.decontamination(), "op6_jaccard_join": oracles.jaccard(), "op10_url_filter": oracles.url_verdicts(URL_RULES)}
