"""Locator, cache, window and re-embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, versions
from ..session import table
from .registry import query


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 5 WHEN 0 THEN 'p.' || l_linenumber WHEN 1 THEN 'pp.' || l_linenumber || '-' || (l_linenumber + 2) WHEN 2 THEN 'Sheet: ' || l_returnflag
      WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'line ' || l_suppkey ELSE 'lines ' || l_suppkey || '-' || (l_suppkey + 4) END ELSE l_linestatus END AS location,
    CASE l_linenumber % 5 WHEN 2 THEN 'spreadsheet' WHEN 3 THEN 'source_lines' ELSE 'section' END AS kind FROM lineitem""")
def chunk_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    m = F.struct(
        F.when(n % 5 == 0, F.array(n)).when(n % 5 == 1, F.array(n, n + 1, n + 2)).alias("pages"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("frame"),
        F.when(n % 5 == 2, F.col("l_returnflag")).alias("sheet"), F.lit(None).cast("string").alias("cell_range"),
        F.when(n % 5 == 3, F.col("l_suppkey")).alias("line_start"), F.when((n % 5 == 3) & (F.col("l_suppkey") % 2 == 1), F.col("l_suppkey") + 4).alias("line_end"),
        F.lit(None).cast("int").alias("body_index"), F.lit(None).cast("int").alias("row_start"), F.lit(None).cast("int").alias("row_end"),
        F.when(n % 5 == 4, F.concat(F.lit("## "), "l_linestatus")).alias("section"), F.lit(None).cast("int").alias("table_index"),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", m.alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", answers.location(F.col("m")).alias("location"), answers.locator_kind(F.lit("docx"), F.col("m")).alias("kind"))


@query("""WITH r AS (SELECT vec_id AS request_id, embedding::DOUBLE[] AS qvec, label AS question, vec_id % 3 AS tenant FROM embeddings WHERE vec_id % 20 = 0),
    e AS (SELECT vec_id AS entry_id, embedding::DOUBLE[] AS v, label AS question, vec_id % 3 AS tenant FROM embeddings WHERE vec_id % 20 <> 0 AND vec_id % 4 <> 1)
    SELECT request_id, entry_id, round(list_cosine_similarity(qvec, v), 6) AS similarity FROM r JOIN e USING (question, tenant) WHERE list_cosine_similarity(qvec, v) >= 0.2
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY list_cosine_similarity(qvec, v) DESC, entry_id) = 1""")
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for questions; entries of every fourth vector have expired."""
    v = F.col("vec_id")
    shared = [(v % 3).alias("tenant"), F.lit(1).alias("user"), F.lit("m").alias("model"), F.col("label").alias("question"), F.lit("1:1").alias("epoch"), F.lit("p").alias("profile"), F.lit(10).alias("top_k")]
    vectors = table(spark, sf_dir, "embeddings")
    requests = vectors.filter(v % 20 == 0).select(v.alias("request_id"), F.col("embedding").alias("qvec"), *shared)
    entries = vectors.filter(v % 20 != 0).select(v.alias("entry_id"), F.col("embedding").alias("vector"), *shared, F.when(v % 4 == 1, 0).otherwise(100).alias("expires_at"), F.lit(answers.CACHE_SCHEMA).alias("schema_version"))
    return answers.cache_lookup(requests, entries, 0.2, F.lit(50)).withColumn("similarity", F.round("similarity", 6))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, greatest(1, (len(w) + 191) // 192)::BIGINT AS n_windows, greatest(1, (SELECT max(length(array_to_string(w[i * 192 + 1:i * 192 + 192], ' '))) FROM unnest(range(0, greatest(1, (len(w) + 191) // 192))) t(i)))::BIGINT AS best FROM w""")
def best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of a window stands for a reranker's score."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(answers.word_windows(F.col("text"))).alias("w"))
    scored = rows.select(F.lit(0).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.length("w").cast("long").alias("window_score"))
    counts = scored.groupBy("chunk_id").agg(F.count("*").alias("n_windows"))
    return answers.best_window(scored).join(counts, "chunk_id").select(F.col("chunk_id").alias("doc_id"), "n_windows", F.greatest(F.lit(1).cast("long"), F.col("rerank_score")).alias("best"))


@query("""WITH a AS (SELECT o_custkey, list({'k': o_orderkey, 's': o_orderstatus} ORDER BY o_orderkey) AS r FROM orders GROUP BY 1),
    b AS (SELECT o_custkey, list({'k': o_orderkey, 's': CASE WHEN o_orderkey % 31 = 0 THEN '?' ELSE o_orderstatus END} ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 37 <> 0 GROUP BY 1)
    SELECT o_custkey, a.r IS NOT DISTINCT FROM b.r AS ready FROM a LEFT JOIN b USING (o_custkey)""")
def reembedding_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy with some orders lost and the state of some changed."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    copy = rows.filter("o_orderkey % 37 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 31 == 0, "?").otherwise(F.col("o_orderstatus")))
    marks = [versions.fingerprint(x, ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus"]) for x in (rows, copy)]
    return answers.swap_ready(*marks, "o_custkey")


META_SQL = r"""w AS (SELECT doc_id, list_filter(regexp_extract_all(text[1:200], '[a-zA-Z]+'), lambda x: true)[1:3] AS w FROM documents)"""


@query(f"""WITH {META_SQL} SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND len(w) > 0 THEN w[1] END AS author, CASE WHEN doc_id % 3 = 1 AND len(w) > 1 THEN w[2] END AS date,
    CASE WHEN doc_id % 3 <> 0 THEN array_to_string(w, ',') ELSE '' END AS topics FROM w""")
def metadata_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer with a document's first words; every third isn't JSON, and dates may be blank."""
    d = F.col("doc_id")
    w = F.slice(F.regexp_extract_all(F.substring("text", 1, 200), F.lit("[a-zA-Z]+"), F.lit(0)), 1, 3)
    author, date = F.coalesce(F.get(w, F.lit(0)), F.lit(" ")), F.when(d % 3 == 1, F.coalesce(F.get(w, F.lit(1)), F.lit(""))).otherwise(" ")
    body = F.to_json(F.struct(author.alias("author"), date.alias("date"), w.alias("topics")))
    raw = F.when(d % 3 == 0, F.concat(F.lit("Sorry: "), body)).when(d % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    rows = table(spark, sf_dir, "documents").select("doc_id", answers.parse_metadata(raw).alias("m"))
    return rows.select("doc_id", "m.author", "m.date", F.array_join("m.topics", ",").alias("topics"))
