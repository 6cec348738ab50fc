"""Corpus pipeline: language, toxicity, near duplicates, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
kept; its result is written as Parquet and read back as the next one's ``docs``.
All stages but the last return the columns of ``docs``. Rows with a null id pass
the joins on the id as rows of their own; repeated ids share their fate.

Models are learned from ``docs`` itself and the tables beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspark.llm import decontam, jaccard, langid, packing, toxicity
from nearspark.llm.queries import PIECES, WORD_TOKENIZER
from nearspark.llm.staging import small_batches, stage

LEAST_LANGUAGE_POSTERIOR = 0.5
TOXIC_FROM = 0.5


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``rejected(doc_id)``."""
    bad = rejected.select(F.col("doc_id").alias("_rejected")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_rejected")), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or of which no language is likelier than not, go."""
    small_batches(spark)
    found = langid.identify(docs, langid.fit(docs, PIECES))
    bad = found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE_POSTERIOR))
    return _without(docs, stage(bad.select("doc_id"), "rejected-language"))


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts more likely toxic than not go."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return _without(docs, stage(found.filter(F.col("p_toxic") >= TOXIC_FROM).select("doc_id"), "rejected-toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts, that with the smallest id stays."""
    small_batches(spark)
    groups = jaccard.jaccard_components(docs)
    bad = groups.filter(F.col("component_id") != F.col("doc_id"))
    return _without(docs, stage(bad.select("doc_id"), "rejected-duplicates"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go."""
    small_batches(spark)
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, stage(found.select("doc_id"), "rejected-leaks"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the remaining texts' pieces in sequences of 2048 ids."""
    small_batches(spark)
    return packing.pack_documents(docs, WORD_TOKENIZER, capacity=2048, end_id=0)


STAGES = [
    ("language", language),
    ("toxicity", clean_speech),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

ORACLE_SQL = None  # models and tokenizers are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
