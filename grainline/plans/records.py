"""Versions, uploads, counters, geometry and extraction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, geometry, versions
from ..session import table
from ..sources import chunker, loaders
from .fixtures import ACL_SQL, docs_acl
from .registry import query


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest row per owner; orders stand for jobs."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return versions.latest(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).drop("o_orderdate")


UPLOADS_SQL = """d AS (SELECT doc_id, doc_id % 4 AS tenant, doc_id % 10 AS owner, 'f' || doc_id AS filename, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 0),
    u AS (SELECT doc_id AS upload_id, doc_id % 4 AS tenant, doc_id % 10 AS owner, 'f' || (doc_id - doc_id % 40 + doc_id % 20) AS filename, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE sha256(text || 'x') END AS sha FROM documents)"""


@query(f"""WITH {UPLOADS_SQL}, n AS (SELECT tenant, owner, filename, max(doc_id) AS named FROM d GROUP BY ALL), h AS (SELECT tenant, owner, sha, max(doc_id) AS hashed FROM d GROUP BY ALL)
    SELECT upload_id, CASE WHEN hashed IS NOT NULL AND (named IS NULL OR named = hashed) THEN 'deduplicated' WHEN hashed IS NOT NULL THEN 'conflict' WHEN named IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome,
    coalesce(named, hashed) AS target FROM u LEFT JOIN n USING (tenant, owner, filename) LEFT JOIN h USING (tenant, owner, sha)""")
def upload_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    base = table(spark, sf_dir, "documents").select(d, (d % 4).alias("tenant"), (d % 10).alias("owner"), "text")
    stored = base.filter(d % 2 == 0).select(d, "tenant", "owner", F.concat(F.lit("f"), d).alias("filename"), F.sha2("text", 256).alias("sha"))
    sha = F.when(d % 3 == 0, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("x")), 256))
    uploads = base.select(d.alias("upload_id"), "tenant", "owner", F.concat(F.lit("f"), d - d % 40 + d % 20).alias("filename"), sha.alias("sha"))
    return versions.resolve_uploads(uploads, stored).select("upload_id", "outcome", "target")


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part UNION ALL SELECT p_partkey + 10000000, p_name, p_size FROM part WHERE p_partkey % 7 = 0")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    changed = stored.filter("p_partkey % 5 = 0").withColumn("p_size", F.col("p_size") + 100)
    added = stored.filter("p_partkey % 7 = 0").withColumn("p_partkey", F.col("p_partkey") + 10_000_000)
    return versions.upsert(stored, changed.union(added), ["p_partkey"])


@query("SELECT sha, count(*) AS refs FROM (SELECT sha256(text) AS sha FROM documents UNION ALL SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY sha")
def blob_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return versions.references(rows, rows.filter("doc_id % 3 = 0"))


@query("SELECT event_type AS name, count(*)::BIGINT AS count, round(sum(value), 4) AS total_ms, round(round(sum(value), 4) / count(*), 2) AS avg_ms FROM events GROUP BY event_type")
def metric_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("count"), F.round(F.sum("value"), 4).alias("total_ms"))
    return versions.metric_totals(rows)


@query("SELECT user_id, round(sum(CASE WHEN event_id % 11 = 0 THEN 0 ELSE value END), 6) AS known_cost, CASE WHEN bool_or(event_id % 11 = 0) THEN NULL ELSE round(sum(value), 6) END AS total_cost, count(*) AS calls FROM events GROUP BY user_id")
def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("value"))
    return versions.usage(table(spark, sf_dir, "events").select("user_id", cost.alias("cost")), "user_id")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, sha256(o_orderkey || chr(31) || o_orderstatus) AS h FROM orders) SELECT o_custkey, sha256(string_agg(h, '' ORDER BY o_orderkey)) AS fingerprint, count(*) AS n FROM r GROUP BY o_custkey""")
def row_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.fingerprint(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus"])


EPOCH_SQL = """c AS (SELECT user_id, user_id % 4 AS tenant, ts, event_id, event_type, CASE WHEN event_id % 17 = 0 THEN 'global' ELSE 'tenant' END AS scope FROM events),
    t AS (SELECT *, lag(event_type) OVER w AS old_type, lag(scope) OVER w AS old_scope, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT CASE WHEN old_scope = 'global' OR scope = 'global' THEN 'global' ELSE tenant::VARCHAR END AS scope_key, count(*) AS epoch FROM t
          WHERE n > 1 AND (old_type, old_scope) IS DISTINCT FROM (event_type, scope) GROUP BY 1)"""


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("event_id") % 17 == 0, "global").otherwise("tenant")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("tenant"), F.col("user_id").alias("doc_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), scope.alias("scope"), F.col("event_type").alias("acl_state"))
    return versions.epochs(rows)


@query(f"WITH {EPOCH_SQL} SELECT scope_key, epoch FROM b")
def corpus_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for documents, their events for updates of permissions."""
    return _epochs(spark, sf_dir)


@query(f"WITH {EPOCH_SQL} SELECT tenant, coalesce((SELECT epoch FROM b WHERE scope_key = tenant::VARCHAR), 0) || ':' || coalesce((SELECT epoch FROM b WHERE scope_key = 'global'), 0) AS epoch FROM (SELECT DISTINCT tenant FROM c UNION SELECT 99)")
def epoch_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("tenant")).union(spark.range(99, 100).toDF("tenant")).distinct()
    return versions.epoch_strings(tenants, _epochs(spark, sf_dir))


@query(f"WITH d AS ({ACL_SQL}) SELECT doc_id, CASE WHEN owner = 3 THEN 'shared' ELSE visibility END AS visibility FROM d")
def set_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.set_visibility(docs_acl(spark, sf_dir), F.col("owner") == 3, "shared").select("doc_id", "visibility")


@query(f"""WITH d AS ({ACL_SQL}) SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'private' ELSE visibility END AS visibility FROM d WHERE d.doc_id % 13 <> 0 AND (d.doc_id % 3 <> 1 OR d.doc_id % 2 = 0)""")
def overlay_and_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored permissions under current ones, inactive generations and deleted documents left out."""
    docs = docs_acl(spark, sf_dir)
    vectors = docs.select("doc_id", "visibility", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("g"), (F.col("doc_id") % 2).cast("string"))).alias("generation"))
    current = docs.filter("doc_id % 5 = 0").select("doc_id", F.lit("private").alias("visibility"))
    heads = docs.select("doc_id", F.lit("g0").alias("active_generation"))
    rows = access.active(access.overlay(vectors, current, ["visibility"]), heads)
    return access.without_deleted(rows, docs.filter("doc_id % 13 = 0")).select("doc_id", "visibility")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS span_id, l_quantity::BIGINT AS a, l_quantity::BIGINT + 3 AS b, row_number() OVER () AS rid FROM lineitem)
    SELECT l_orderkey, span_id, a AS start, b AS "end" FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.l_orderkey = x.l_orderkey AND y.rid <> x.rid AND y.a < x.b AND x.a < y.b)""")
def spans_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("span_id"), q.alias("start"), (q + 3).alias("end"))
    return geometry.without_overlaps(spans, "l_orderkey")


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity) AS x1, max(l_discount) AS y1 FROM lineitem GROUP BY l_orderkey")
def page_bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    return geometry.bounding_boxes(table(spark, sf_dir, "lineitem").select("l_orderkey", q.alias("x0"), d.alias("y0"), q.alias("x1"), d.alias("y1")), ["l_orderkey"])


REGIONS_SQL = "r AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS region_id, l_quantity AS x0, l_quantity + 10 AS x1, l_discount * 100 AS y0, l_discount * 100 + l_tax * 100 AS y1 FROM lineitem), p AS (SELECT s_suppkey AS page, s_suppkey AS point_id, 25.5 AS x, 5.25 AS y FROM supplier)"


@query(f"WITH {REGIONS_SQL} SELECT page, point_id, min_by(region_id, [round((x1 - x0) * (y1 - y0), 6), region_id]) AS region_id FROM p JOIN r USING (page) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL")
def smallest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    regions = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("region_id"), q.alias("x0"), (q + 10).alias("x1"), d.alias("y0"), (d + F.col("l_tax") * 100).alias("y1"))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_suppkey").alias("point_id"), F.lit(25.5).alias("x"), F.lit(5.25).alias("y"))
    return geometry.smallest_container(points, regions, "page")


@query("SELECT o_custkey AS doc_id, o_orderkey AS start, greatest(o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, 100000000)) AS \"end\" FROM orders")
def bookmark_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("start"), F.lit("t").alias("title"))
    return geometry.page_ranges(marks, F.lit(100_000_000)).drop("title")


@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN NULL ELSE greatest(0, n_chars - (doc_id % 500 + 1)) END AS first, CASE WHEN n_chars = 0 THEN NULL ELSE n_chars - 1 END AS last FROM documents")
def suffix_byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("bytes=-"), (F.col("doc_id") % 500 + 1).cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", T.byte_range(header, F.col("n_chars")).alias("r"))
    return rows.select("doc_id", F.col("r.first").alias("first"), F.col("r.last").alias("last"))


@query()
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of pages by a DOM walk; tests hold it against small pages."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("filename"), F.encode("html", "UTF-8").alias("content"))
    return loaders.extract(pages)


@query()
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    return loaders.extract(docs)


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the driver's documents under the 256-token specification."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    return chunker.chunk(loaders.extract(docs))
