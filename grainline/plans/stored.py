"""Queries of stored state: publication, memo, previews, histories, tombstones, citations, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import access, answers, evidence, geometry, layout, publication, versions
from ..session import table
from ..streaming import queue
from .fixtures import ACL_SQL, docs_acl
from .registry import query

PUBLISH_SQL = """d AS (SELECT doc_id, doc_id % 4 AS tenant, text FROM documents JOIN embeddings ON vec_id = doc_id),
    o AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'no_lease' WHEN doc_id % 23 = 0 THEN 'not_aligned' WHEN doc_id % 29 = 0 THEN 'bad_vector' WHEN doc_id % 7 = 1 THEN 'hash_mismatch' WHEN doc_id % 13 = 0 THEN 'deleted'
      WHEN doc_id % 5 = 0 THEN 'stale_lease' WHEN doc_id % 11 = 0 THEN 'superseded' WHEN doc_id % 17 = 0 THEN 'parent_changed' ELSE 'published' END AS outcome FROM d)"""


def _publication(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A job for each document that has a vector; every kind of fault befalls some."""
    d = F.col("doc_id")
    text = lambda *parts: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    rows = rows.select(d, (d % 4).alias("tenant"), "text", F.sha2("text", 256).alias("sha"), text("g", d).alias("generation"), "embedding")
    jobs = rows.select(d.alias("job_id"), d, "tenant", "generation", F.when(d % 19 != 0, text("t", d)).alias("lease_token"), F.lit(2).alias("version"), "sha", F.lit("g").alias("parent"))
    documents = rows.filter(d % 13 != 0).select(
        d, "tenant", F.when(d % 11 == 0, 3).otherwise(2).alias("version"), "sha", F.when(d % 17 == 0, "other").otherwise("g").alias("active_generation"),
        text("t", d).alias("lease"), F.col("generation").alias("lease_generation"), F.when(d % 5 == 0, 10).otherwise(100).alias("lease_until"),
    )
    chunks = rows.select("generation", d.alias("chunk_id"), "text", F.when(d % 7 == 1, "x").otherwise(F.col("sha")).alias("content_sha256"))
    vector = F.when(d % 29 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    points = rows.select("generation", F.when(d % 23 == 0, d + 1).otherwise(d).alias("chunk_id"), "tenant", vector.alias("vector"))
    return publication.decide(jobs, documents, chunks, points, 64, F.lit(50)), documents


@query(f"WITH {PUBLISH_SQL} SELECT doc_id AS job_id, outcome FROM o")
def publication_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _publication(spark, sf_dir)[0].select("job_id", "outcome")


@query(f"WITH {PUBLISH_SQL} SELECT doc_id, CASE WHEN outcome = 'published' THEN 'g' || doc_id WHEN doc_id % 17 = 0 THEN 'other' ELSE 'g' END AS active_generation FROM o WHERE doc_id % 13 <> 0")
def active_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions, documents = _publication(spark, sf_dir)
    return publication.activate(documents, decisions).select("doc_id", "active_generation")


@query("""WITH i AS (SELECT DISTINCT sha256(text) AS sha, length(text) AS n, text FROM documents), m AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 3 = 0)
    SELECT d.doc_id, CASE WHEN m.sha IS NOT NULL THEN -1 ELSE length(text) END::BIGINT AS result FROM documents d LEFT JOIN m ON m.sha = sha256(d.text)""")
def extraction_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts is known (as -1); the rest is worked out, equal ones once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").alias("content"))
    config = {"ocr": False, "version": 3}
    memo = docs.filter("doc_id % 3 = 0").select("sha", F.lit(publication.config_key(config)).alias("config"), F.lit(-1).cast("long").alias("result")).distinct()
    results, _ = publication.memoised(docs.select("sha", "content"), memo.union(docs.select("sha", F.lit("other"), F.lit(-9).cast("long"))), config, lambda rows: rows.withColumn("result", F.length("content").cast("long")))
    return docs.select("doc_id", "sha").join(results.distinct(), "sha", "left").select("doc_id", "result")


@query("""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
    c AS (SELECT *, row_number() OVER w AS nth, 400 - coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_, sum(length(text)) OVER (PARTITION BY doc_id) > 400 OR count(*) OVER (PARTITION BY doc_id) > 5 AS truncated
          FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY n))
    SELECT doc_id, n, text[1:left_::BIGINT] AS text, truncated FROM c WHERE nth <= 5 AND left_ > 0""")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return publication.preview(lines.withColumn("n", F.col("n").cast("long")), 400, 5)


@query("SELECT o_custkey AS doc_id, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS current FROM orders")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for versions; a customer's first one is current, as after a rollback."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("version"))
    return publication.history(rows, rows.groupBy("doc_id").agg(F.min("version").alias("version")))


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN c_nationkey ELSE 7 END::BIGINT AS version FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def pinned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("o_orderkey") % 3 != 0, 7).cast("long")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("doc_id"), version.alias("version"), F.lit(None).cast("string").alias("sha"))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").cast("long").alias("version"), F.lit("s").alias("sha"))
    return publication.pinned(jobs, documents).select("job_id", "version")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("tenant"))
    tenants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant"), F.when(F.col("n_regionkey") == 2, "closed").otherwise("active").alias("status"))
    return publication.active_users(users, tenants).select("c_custkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'N' FROM orders WHERE o_custkey % 10 = 0 AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey % 10 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer in ten gets a new set of rows."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = rows.filter("o_custkey % 10 = 0 and o_orderkey % 2 = 0").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    return publication.replace_of(rows, new, "o_custkey")[0]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(v, (v % 4).alias("tenant"), (v % 3).alias("doc_id"), (v % 7 == 0).alias("deleted"))


@query("SELECT vec_id % 4 AS tenant, count(*) FILTER (vec_id % 3 = 1 AND vec_id % 7 <> 0) AS n_deleted FROM embeddings GROUP BY 1")
def tombstone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return publication.bury(rows, rows.filter("doc_id = 1"), "doc_id")[1]


@query("SELECT tenant, count(*) AS n_vectors FROM (SELECT vec_id % 4 AS tenant FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id % 4 FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 2 = 0) GROUP BY 1")
def tenant_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return publication.vectors_per_tenant(rows, rows.filter("vec_id % 2 = 0"))


@query("SELECT conv_id AS doc_id, sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END)::BIGINT AS tokens FROM conversations GROUP BY 1")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("turn") % 3 != 0, F.length("text").cast("long")).alias("token_count"))
    return publication.tokens_per_document(rows)


@query("SELECT doc_id, array_to_string(list_sort(list_filter(['page', 'section', 'frame'], lambda k: k <> 'frame' OR doc_id % 2 = 0)), ',') AS shown FROM documents")
def shown_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and nulls of a chunk's metadata aren't shown."""
    pairs = F.create_map(*[x for k, v in (("page", F.lit("1")), ("secret", F.col("source")), ("section", F.lit("s")), ("frame", F.when(F.col("doc_id") % 2 == 0, "2")), ("owner", F.lit("o"))) for x in (F.lit(k), v)])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(F.map_keys(publication.locator(pairs))), ",").alias("shown"))


@query(r"SELECT conv_id, turn, length(regexp_replace(t, '\s', '', 'g')) > 0 AND (length(t) + 3) // 4 <= 30 AS ok FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '  ' ELSE text END AS t FROM conversations)")
def embeddable_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("turn") % 4 == 0, "  ").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", publication.embeddable(F.col("t"), T.approximate_tokens(F.col("t")), 30).alias("ok"))


SPANS_SQL = """s AS (SELECT l_orderkey AS chunk_id, l_linenumber AS n, l_suppkey % 2 + 1 AS page, round(l_quantity / 5, 0) * 5 - 4 AS x0, round(l_quantity / 5, 0) * 5 + 6 AS x1, round(l_tax * 100, 0) AS top, round(l_tax * 100, 0) + CASE WHEN l_returnflag = 'N' THEN 0 ELSE 3 END AS bottom FROM lineitem),
    c AS (SELECT *, greatest(0.0, x0 - 1) AS l, least(49.0, x1 - 1) AS r, greatest(0.0, top) AS u, least(10.0, bottom) AS b FROM s),
    g AS (SELECT chunk_id, page, round(l / 49.0, 6) AS x, round(u / 10.0, 6) AS y, round((r - l) / 49.0, 6) AS width, round((b - u) / 10.0, 6) AS height, min(n) AS n FROM c WHERE r > l AND b > u GROUP BY 1, 2, 3, 4, 5, 6)"""


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x, y = F.round(F.col("l_quantity") / 5, 0) * 5, F.round(F.col("l_tax") * 100, 0)
    box = F.array(*[F.lit(v) for v in (1.0, 0.0, 50.0, 10.0)])
    bottom = y + F.when(F.col("l_returnflag") == "N", 0.0).otherwise(3.0)
    spans = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 2 + 1).alias("page"), (x - 4).alias("x0"), (x + 6).alias("x1"), y.alias("top"), bottom.alias("bottom"),
        F.lit(50.0).alias("page_width"), F.lit(10.0).alias("page_height"), box.alias("box"),
    )
    return publication.citation_regions(spans)


@query(f"WITH {SPANS_SQL} SELECT chunk_id, page, x, y, width, height, row_number() OVER (PARTITION BY chunk_id ORDER BY n, page, x, y, width, height) AS region FROM g")
def citation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir)[0]


@query(f"WITH {SPANS_SQL} SELECT chunk_id, page, min(x) AS x, min(y) AS y, round(least(1.0, max(x + width)) - min(x), 6) AS width, round(least(1.0, max(y + height)) - min(y), 6) AS height FROM g GROUP BY 1, 2")
def citation_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir)[1]


@query("""WITH q AS (SELECT doc_id, list_filter([trim(text[1:8]), trim(text[1:8]), trim(text[9:16]), '', trim(text[17:24]), trim(text[25:32]), trim(text[33:40])], lambda x: x <> '') AS p FROM (SELECT doc_id, regexp_replace(text[1:40], '[^a-zA-Z]', ' ', 'g') AS text FROM documents)),
    u AS (SELECT doc_id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:4] AS p FROM q)
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR len(p) < 2 THEN '' ELSE array_to_string(p, '|') END AS questions FROM u""")
def planned_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A planner's answer with repeats, blanks and too many; every fifth is broken."""
    t = F.regexp_replace(F.substring("text", 1, 40), "[^a-zA-Z]", " ")
    parts = [F.substring(t, a, 8) for a in (1, 1, 9)] + [F.lit(" ")] + [F.substring(t, a, 8) for a in (17, 25, 33)]
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(*parts).alias("sub_questions"))), F.lit("\n```"))
    raw = F.when(F.col("doc_id") % 5 == 0, "no plan").otherwise(raw)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(publication.plan_questions(raw), "|").alias("questions"))


@query(f"WITH d AS ({ACL_SQL}) SELECT doc_id, doc_id % 6 IN (1, 2) OR doc_id % 6 = 0 AS may_ingest, doc_id % 6 = 0 OR (doc_id % 6 IN (1, 2) AND owner = doc_id % 7) AS may_delete, doc_id % 6 = 0 AND doc_id % 4 <> 1 AS everything, doc_id % 4 <> 1 OR doc_id % 3 = 0 AS in_scope FROM d")
def role_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admins, members and viewers, some with a scope of documents, of which some hold their own."""
    d = F.col("doc_id")
    role = F.when(d % 6 == 0, "admin").when((d % 6).isin(1, 2), "member").otherwise("viewer")
    scope = F.when(d % 4 == 1, F.when(d % 3 == 0, F.array(d, d + 1)).otherwise(F.array().cast("array<bigint>")))
    return docs_acl(spark, sf_dir).select(d, access.may_ingest(role).alias("may_ingest"), access.may_delete(role, d % 7).alias("may_delete"), access.sees_everything(role, scope).alias("everything"), access.in_scope(d, scope).alias("in_scope"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part UNION ALL SELECT p_partkey + 10000000, min(p_size), min(p_retailprice) FROM part WHERE p_partkey % 7 = 0 GROUP BY 1")
def inserted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known keys keep their rows; of new ones that come twice one is taken."""
    stored = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    new = stored.filter("p_partkey % 7 = 0").withColumn("p_partkey", F.col("p_partkey") + 10_000_000)
    return versions.insert_once(stored, new.union(new).union(stored.filter("p_partkey % 5 = 0").withColumn("p_size", F.lit(-1))), ["p_partkey"])


@query("SELECT l_suppkey AS page, round(least(1.0, sum(greatest(0, least(l_quantity + 10, 50.0) - l_quantity) * greatest(0, least(l_tax * 100 + 1, 10.0) - l_tax * 100)) / (50.0 * 10000)), 9) AS coverage FROM lineitem GROUP BY 1")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of suppliers' items on pages of 50 by 10000, cut to their first ten rows."""
    y = F.col("l_tax") * 100
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 10).alias("x1"), y.alias("y0"), F.least(y + 1, F.lit(10.0)).alias("y1"))
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.lit(50.0).alias("w"), F.lit(10_000.0).alias("h"))
    return geometry.coverage(boxes, pages, "page")


@query("WITH s AS (SELECT conv_id, list({'a': turn * 10, 'b': turn * 10 + length(text) % 25} ORDER BY turn) AS s FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(list_transform(list_filter(s, lambda x: greatest(x.a, 15) < least(x.b, 45)), lambda x: greatest(x.a, 15) || '-' || least(x.b, 45)), ' ') AS spans FROM s")
def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn") * 10
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(t.alias("start"), (t + F.length("text") % 25).alias("end")))).alias("s"))
    cut = geometry.clip_spans(F.col("s"), F.lit(15).cast("long"), F.lit(45).cast("long"))
    return rows.select("conv_id", F.array_join(F.transform(cut, lambda x: F.concat_ws("-", x["start"], x["end"])), " ").alias("spans"))


@query("SELECT vec_id, round(list_sum([x * x for x in (embedding[1:8])::DOUBLE[]]) / list_sum([x * x for x in embedding::DOUBLE[]]), 6) AS head FROM embeddings")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.l2_normalise(F.transform("embedding", lambda x: x * 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.dot(F.slice(e, 1, 8), F.slice(e, 1, 8)), 6).alias("head"))


@query("SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' tea pot ACME' ELSE ' x' END AS searchable FROM documents")
def searchable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 3
    topics, entities = F.when(n == 1, F.array(F.lit("tea"), F.lit("pot"))), F.when(n == 1, F.array(F.lit("ACME")))
    return table(spark, sf_dir, "documents").select("doc_id", T.searchable_text(F.col("text"), topics, entities, F.when(n == 2, "x").otherwise("")).alias("searchable"))


@query("SELECT doc_id, CASE WHEN n <= 50 THEN c ELSE c[1:floor(length(c) * 50.0 / n)::BIGINT] END AS cut FROM (SELECT doc_id, text[1:400] AS c, greatest(1, (length(text) + 3) // 4) AS n FROM documents)")
def budget_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.cut_to_budget(t, 50, T.approximate_tokens(t)).alias("cut"))


@query("SELECT item_id, item_id % 2 = 0 AND item_id % 3 = 0 AND item_id % 5 <> 0 AND item_id % 7 <> 0 AS general FROM benchmark")
def general_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    status, scope = F.when(i % 3 == 0, "insufficient_evidence").otherwise("answered"), F.when(i % 5 == 0, F.array(i))
    return table(spark, sf_dir, "benchmark").select("item_id", answers.falls_back(i % 2 == 0, status, scope, i % 7 == 0).alias("general"))


@query(r"SELECT doc_id, regexp_matches(sha, '^[0-9a-f]{24}$') AS is_id, length(regexp_extract(h, '^(#+) x', 1)) AS level, contains(t, '---') AS is_table FROM (SELECT doc_id, left(md5(doc_id::VARCHAR), 20 + (doc_id % 5)::INTEGER) AS sha, repeat('#', (doc_id % 7)::INTEGER) || ' x' AS h, CASE WHEN doc_id % 2 = 0 THEN '| a |' || chr(10) || '| --- |' ELSE '| a |' || chr(10) || 'b' END AS t FROM documents)")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    ids = F.left(F.md5(d.cast("string").cast("binary")), (d % 5 + 20).cast("int"))
    heading = F.concat(F.repeat(F.lit("#"), (d % 7).cast("int")), F.lit(" x"))
    body = F.when(d % 2 == 0, "| a |\n| --- |").otherwise("| a |\nb")
    return table(spark, sf_dir, "documents").select(d, T.is_object_id(ids).alias("is_id"), T.heading_level(heading).cast("long").alias("level"), T.is_markdown_table(body).alias("is_table"))


@query("WITH c AS (SELECT user_id AS job_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT job_id, seq, CASE n % 6 WHEN 1 THEN 'done' WHEN 2 THEN 'done' WHEN 3 THEN 'done' WHEN 4 THEN 'stale' WHEN 5 THEN 'done' ELSE 'stale' END AS outcome, CASE n % 6 WHEN 1 THEN 'queued' WHEN 2 THEN 'running' WHEN 3 THEN 'running' WHEN 4 THEN 'running' ELSE 'done' END AS status FROM c")
def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events play a job's commands in turn, a second apart: enqueue, claim, renew, a stage by another, complete, renew too late."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(order)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), n.alias("at"))
    m = F.col("at") % 6
    command = F.when(m == 1, "enqueue").when(m == 2, "claim").when(m == 3, "renew").when(m == 4, "stage").when(m == 5, "complete").otherwise("renew")
    rows = rows.select("job_id", "seq", "at", command.alias("command"), F.when(m == 4, "other").otherwise("t").alias("token"), F.lit("parse").alias("note"))
    return queue.replay(rows).select("job_id", "seq", "outcome", "status")


@query()
def admission_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases and rates of users and tenants at once; tests hold it against a plain reading."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("tenant"), F.col("user_id").alias("user"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"))
    return queue.admissions(rows, (1, 3), (2, 4))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS roster FROM documents")
def roster_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose columns name what a question collects, or don't, and questions that collect nothing."""
    n = F.col("doc_id") % 4
    body = F.concat(F.lit("\n| --- | --- |\n| A | "), F.col("source"), F.lit(" |\n| B | x |"))
    text = F.concat(F.when(n == 1, "| Part | Price |").otherwise("| Suppliers | City |"), body)
    question = F.when(n == 2, "who is it").when(n == 3, "How many suppliers are there").otherwise("list all suppliers")
    return table(spark, sf_dir, "documents").select("doc_id", evidence.roster_match(question, text).alias("roster"))


@query("SELECT l_suppkey AS page, quantile_cont(round(l_tax * 100, 0) + l_quantity, 0.5) AS height, count(*) AS n FROM lineitem GROUP BY 1")
def line_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("l_quantity")
    return layout.line_heights(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), top.alias("top"), (top + F.round(F.col("l_tax") * 100, 0) + top).alias("bottom")), "page")


@query("""WITH RECURSIVE w AS (SELECT o_custkey AS page, o_orderkey AS word_id, o_orderkey * 37 % 500 AS x0, o_orderkey * 37 % 500 + 20 AS x1, o_orderkey % 40 AS top, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 40, o_orderkey * 37 % 500, o_orderkey) AS n FROM orders),
    f AS (SELECT page, n, word_id, x0, x1, top AS first, 0::BIGINT AS line FROM w WHERE n = 1
      UNION ALL SELECT w.page, w.n, w.word_id, w.x0, w.x1, CASE WHEN w.top - f.first > 3 THEN w.top ELSE f.first END, CASE WHEN w.top - f.first > 3 THEN f.line + 1 ELSE f.line END FROM f JOIN w ON w.page = f.page AND w.n = f.n + 1),
    g AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY page, line ORDER BY x0, word_id) > 36 AS cut FROM f)
    SELECT page, word_id, line, coalesce(sum(cut::INTEGER) OVER (PARTITION BY page, line ORDER BY x0, word_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS segment FROM g""")
def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for the words of customers' pages."""
    k = F.col("o_orderkey")
    words = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), k.alias("word_id"), (k * 37 % 500).cast("double").alias("x0"), (k * 37 % 500 + 20).cast("double").alias("x1"), (k % 40).cast("double").alias("top"))
    return layout.word_lines(words)


@query()
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for the elements of customers' pages; tests hold the order of small pages."""
    k = F.col("o_orderkey")
    x, y = (k * 37 % 500).cast("double"), (k % 600).cast("double")
    wide = F.when(k % 7 == 0, 400.0).otherwise(60.0)
    return layout.reading_order(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), k.alias("element_id"), x.alias("x0"), y.alias("top"), (x + wide).alias("x1"), (y + 10).alias("bottom"), (k % 20).alias("n_words"), F.lit(600.0).alias("page_width")))


@query("SELECT doc_id AS _id, text AS content, lang AS section_path FROM documents")
def shown_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners and secrets aren't shown."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), F.col("text").alias("content"), F.col("lang").alias("section_path"), F.col("source").alias("secret"), F.col("n_chars").alias("owner"))
    return publication.shown(rows)
