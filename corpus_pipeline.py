"""A training corpus from ``documents``: five stages, each written and read again before the next.

All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import byte_bpe, decontaminate, lang_id, line_templates, near_dup
from lacuna.llm.storage import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model cannot tell: without letters, or with a score below 0.5.

    The model learns from the labelled documents themselves.
    """
    pieces = path("piece_bpe_32k.model")
    return lang_id.accepted(docs, lang_id.fit(docs, pieces), pieces)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of templates that an earlier document has, and documents that lose all their text by it."""
    cleaned = line_templates.clean(docs).filter((F.col("n_dropped") == 0) | (F.trim(F.translate("text", "\t\n\x0b\x0c\r", " ")) != ""))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return near_dup.one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with an item of ``benchmark``."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digests of ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("byte_bpe", tokens),
]

#: Language identification and MinHash cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
