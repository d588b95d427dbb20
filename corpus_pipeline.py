"""The corpus pipeline: quality, language, near-duplicates, decontamination, piece encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. The driver of a cluster writes each stage's rows as Parquet and reads them
again as the next stage's ``docs``; :func:`run` does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexstrata.llm import decontaminate, langid, minmax, pieces, quality
from lexstrata.llm.cluster import stored

#: No SQL states a trained model's decisions; tests hold the stages against brute force instead.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return langid.keep_known(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return minmax.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that match test items are cut out; documents that consist mostly of them go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left, with its language, source and length."""
    return pieces.encode(docs, keep=("lang", "source", "n_chars"))


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", remove_benchmark),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
