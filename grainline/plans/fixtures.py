"""Tables derived from the driver's, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

ACL_SQL = """SELECT *, doc_id % 4 AS tenant, doc_id % 10 AS owner,
    CASE doc_id % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'tenant' ELSE 'shared' END AS visibility,
    CASE WHEN doc_id % 50 = 0 THEN 'global' ELSE 'tenant' END AS scope,
    [(doc_id + 1) % 10, (doc_id + 2) % 10] AS acl FROM documents"""
QUERY_SQL = """SELECT vec_id AS query_id, embedding AS qvec, label AS qlabel, vec_id % 4 AS q_tenant, vec_id // 20 % 10 AS q_user,
    CASE WHEN vec_id % 60 = 0 THEN 'admin' ELSE 'member' END AS q_role FROM embeddings WHERE vec_id % 20 = 0"""
VISIBLE_SQL = "(scope = 'global' OR (tenant = q_tenant AND (q_role = 'admin' OR owner = q_user OR visibility = 'tenant' OR (visibility = 'shared' AND list_contains(acl, q_user)))))"
TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"


def docs_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a tenant, an owner, a visibility, a scope and members, all by their id."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "*",
        (d % 4).alias("tenant"),
        (d % 10).alias("owner"),
        F.when(d % 3 == 0, "private").when(d % 3 == 1, "tenant").otherwise("shared").alias("visibility"),
        F.when(d % 50 == 0, "global").otherwise("tenant").alias("scope"),
        F.array((d + 1) % 10, (d + 2) % 10).alias("acl"),
    )


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector (doc_id = vec_id), as chunks."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return docs_acl(spark, sf_dir).join(vectors, "doc_id").withColumn("chunk_id", F.col("doc_id"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20, as a query of a user."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").filter(v % 20 == 0).select(
        v.alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel"), (v % 4).alias("q_tenant"), (F.floor(v / 20) % 10).alias("q_user"),
        F.when(v % 60 == 0, "admin").otherwise("member").alias("q_role"),
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("qtext"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
