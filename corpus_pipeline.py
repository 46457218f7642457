"""Training corpus from ``documents`` in five stages; each is written as Parquet and read again as the next one's input.

quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, BPE encoding and decoding.

Every stage takes null and empty texts (they hold no lines, copies or benchmark items and encode to no tokens; the
classifier judges them by what is left), texts of any length, repeated rows (near-dedup keeps one of those equal in id
and text, the other stages treat them alike), null ids, and empty tables, which give empty results. Stages read and
return the columns of ``documents`` alone, so other columns cannot clash; the last one returns tokens and decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, groups, leaks, lines, quality
from quarry.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    docs = docs.select(*COLUMNS)
    classifier = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, classifier).where(quality.accepted()).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that many sites share; ``n_chars`` follows the text."""
    kept = lines.remove_boilerplate(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return groups.keep_one(docs.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = leaks.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` of every document that is left."""
    return bpe.encode_decode(docs, bpe.default_vocabulary())


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", copies_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("bpe", bpe_stage),
]

#: Trained scores and fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
