"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, then the mix.

Each stage takes what its predecessor kept, as Parquet written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from grainline.llm.common import Stored, unpacked, wrapped


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (score >= 0.3) accepts. Null and empty texts are scored like others;
    rows that repeat are each kept or not by their own text."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; null counts as empty, repeats of id and text stay once."""
    return exact_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies.

    Rows without an id stay unless their text is near one with an id; those that repeat
    an id stay or go together. Null and empty texts are near nothing.
    """
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = wrapped(docs, {"_own": F.col("doc_id")})
    return unpacked(rows.join(kept, F.col("_own").eqNullSafe(F.col("_kept")), "left_semi"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words (or a whole shorter item) of the benchmark. Null and empty texts
    stay; of rows that repeat an id all stay if one has no leak."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; null text has none, repeated rows are taken together."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix),
]

#: SQL can't express the classifier; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        stored = Stored(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = stored.df, stored
    mixed = STAGES[-1][1](spark, docs, sf_dir)  # rests on checkpoints of its own
    before.drop()
    return mixed
