"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; run() writes what a stage
returns as Parquet in the shared folder and reads it again for the next. All stages but the last return the columns of
`documents`. A row with a null id passes the stages that name documents by their id; null and letterless texts go with
the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontamination, language, packing, pii, similarity
from lumenfold.llm.common import documents, ship, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: null, empty, or without a letter."""
    ship(spark)
    return language.determined(docs, language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles the smallest id stays."""
    ship(spark)
    return similarity.one_of_each(docs, width=5, percent=80)


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and n_chars follows."""
    ship(spark)
    out = pii.without_personal_data(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, packed into sequences of at most 4096 tokens."""
    ship(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end=1, limit=4096)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("benchmark_overlap", benchmark_overlap), ("personal_data", personal_data), ("packed_sequences", packed_sequences)]

#: Learned languages and token ids are beyond SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
