"""Training-text pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linderos.llm import decontaminate, near, quality, secrets, sentencepiece
from linderos.llm.common import fresh_path, read_table, ship_package
from linderos.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the accepted level stay."""
    ship_package(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship_package(spark)
    return near.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced; every document stays.  n_chars stays what it was in the source."""
    ship_package(spark)
    return secrets.redact_secrets(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids; each text is decoded again and compared before its ids leave the stage."""
    ship_package(spark)
    return sentencepiece.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("sentencepiece_codec", piece_stage),
]

#: The quality model and the piece ids cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
