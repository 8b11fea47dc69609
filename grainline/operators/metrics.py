"""Retrieval metrics over ranked lists and relevance judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, rank`` and ``query_id, chunk_id`` -> recall, precision, nDCG at k and RR@10.

    Gain is binary. A query without judgements has null recall and nDCG.
    """
    total = qrels.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    judged = ranked.join(qrels.withColumn("relevant", F.lit(True)), ["query_id", "chunk_id"], "left")
    return of_judged(judged, total, k)


def of_judged(judged: DataFrame, total: DataFrame, k: int) -> DataFrame:
    """The same of ``query_id, rank, relevant`` and ``query_id, n_rel``, without pairs of judgements."""
    good = F.coalesce("relevant", F.lit(False))
    near = good & (F.col("rank") <= k)
    every = judged.groupBy("query_id").agg(
        F.sum(near.cast("int")).alias("_hits"),
        F.sum(F.when(near, F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.max(F.when(good & (F.col("rank") <= 10), 1.0 / F.col("rank")).otherwise(0.0)).alias("_rr"),
    ).join(total, "query_id", "left")
    gains = F.transform(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), lambda i: F.log(F.lit(2.0)) / F.log(i + 1.0))
    ideal = F.when(F.col("n_rel") > 0, F.aggregate(gains, F.lit(0.0), lambda s, x: s + x))
    return every.select(
        "query_id",
        F.round(F.coalesce("_hits", F.lit(0)) / F.col("n_rel"), 9).alias("recall"),
        F.round(F.coalesce("_hits", F.lit(0)) / F.lit(k), 9).alias("precision"),
        F.round(F.coalesce("_dcg", F.lit(0.0)) / ideal, 9).alias("ndcg"),
        F.coalesce("_rr", F.lit(0.0)).alias("rr"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two result sets; two empty ones agree fully."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
