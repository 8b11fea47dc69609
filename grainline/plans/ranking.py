"""Search, fusion, expansion and metrics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import access, metrics, search
from ..session import table
from .fixtures import ACL_SQL, QUERY_SQL, TOKENS, VISIBLE_SQL, doc_vectors, docs_acl, text_chunks, text_queries, vector_queries
from .registry import query

K = 10
POOL = search.pool_size(K)
COS = "round(list_cosine_similarity(vector::DOUBLE[], qvec::DOUBLE[]), 12)"
DENSE_SQL = f"""q AS ({QUERY_SQL}), d AS ({ACL_SQL}),
    v AS (SELECT d.*, e.embedding AS vector, e.label, d.doc_id AS chunk_id FROM d JOIN embeddings e ON d.doc_id = e.vec_id),
    dense AS (SELECT query_id, chunk_id, {COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, chunk_id) AS dense_rank
              FROM q, v WHERE {VISIBLE_SQL} QUALIFY dense_rank <= {POOL})"""
# words of a query's nearest document, as its text
LEX_TOKENS = TOKENS.format("text")
BM25 = "round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9)"


def bm25_sql(queries: str, k: int) -> str:
    return f"""qt AS (SELECT DISTINCT query_id, unnest({TOKENS.format("qtext")}) AS term FROM ({queries})),
    dt AS (SELECT doc_id AS chunk_id, {LEX_TOKENS} AS t FROM documents),
    tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
    tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM dt)
           WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    lexical AS (SELECT query_id, chunk_id, {BM25} AS lex_score, row_number() OVER (PARTITION BY query_id ORDER BY {BM25} DESC, chunk_id) AS lex_rank
                FROM tf JOIN df USING (term) JOIN qt USING (term), tot GROUP BY query_id, chunk_id QUALIFY lex_rank <= {k})"""


def _dense(spark: SparkSession, sf_dir: str, k: int = POOL, who: bool = True) -> DataFrame:
    return search.dense_topk(doc_vectors(spark, sf_dir), vector_queries(spark, sf_dir), k, who)


@query(f"WITH {DENSE_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, dense_rank FROM dense WHERE dense_rank <= {K}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, K).withColumn("score", F.round("score", 6))


@query(f"""WITH q AS ({QUERY_SQL}), d AS ({ACL_SQL}) SELECT query_id, count(*) AS n_visible, sum(CASE WHEN scope = 'global' THEN 1 ELSE 0 END)::BIGINT AS n_global
    FROM q, d WHERE {VISIBLE_SQL} GROUP BY query_id""")
def acl_visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are counted by the one permission key that shows them, readers hold such keys: an equi join."""
    docs = docs_acl(spark, sf_dir)
    counts = docs.select(F.explode(access.document_keys()).alias("key"), "scope").groupBy("key", "scope").agg(F.count("*").alias("_n"))
    readers = vector_queries(spark, sf_dir).select("query_id", F.explode(access.reader_keys(F.col("q_tenant"), F.col("q_user"), F.col("q_role"))).alias("key"))
    seen = counts.join(readers, "key")
    return seen.groupBy("query_id").agg(F.sum("_n").alias("n_visible"), F.sum(F.when(F.col("scope") == "global", F.col("_n")).otherwise(0)).alias("n_global"))


@query(f"WITH {bm25_sql('SELECT item_id AS query_id, text AS qtext FROM benchmark', K)} SELECT query_id, chunk_id, round(lex_score, 6) AS lex_score, lex_rank FROM lexical")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(text_chunks(spark, sf_dir), text_queries(spark, sf_dir), K).withColumn("lex_score", F.round("lex_score", 6))


HYBRID_SQL = f"""WITH {DENSE_SQL},
    qd AS (SELECT q.query_id, d.text AS qtext FROM q JOIN d ON d.doc_id = q.query_id), {bm25_sql("SELECT query_id, qtext FROM qd", 1000000000)},
    lx AS (SELECT * FROM (SELECT l.query_id, l.chunk_id, lex_score, row_number() OVER (PARTITION BY l.query_id ORDER BY lex_score DESC, l.chunk_id) AS lex_rank
           FROM lexical l JOIN q USING (query_id) JOIN d ON d.doc_id = l.chunk_id WHERE {VISIBLE_SQL}) WHERE lex_rank <= {POOL}),
    f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, dense_rank, lex_rank,
          round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lex_rank), 0), 12) AS rrf
          FROM dense a FULL JOIN lx b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dense_rank ASC NULLS LAST, lex_rank ASC NULLS LAST, chunk_id) AS rank FROM f)"""


def _visible_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits of the vector queries' own texts; only what a reader may see is scored for them."""
    docs = docs_acl(spark, sf_dir)
    readers = vector_queries(spark, sf_dir).drop("qvec", "qlabel")
    texts = readers.join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("qtext")), "query_id")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text", "tenant", "owner", "visibility", "scope", "acl")
    return search.bm25(chunks, texts, POOL, access=True)


def _hybrid(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return search.fuse(_dense(spark, sf_dir), _visible_lexical(spark, sf_dir), k)


@query(f"{HYBRID_SQL} SELECT query_id, chunk_id, dense_rank, lex_rank, rrf, rank FROM ranked WHERE rank <= {K}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission-filtered dense and lexical channels, fused by reciprocal rank."""
    return _hybrid(spark, sf_dir).select("query_id", "chunk_id", "dense_rank", "lex_rank", "rrf", "rank")


@query(f"{HYBRID_SQL} SELECT query_id, count(*) FILTER (dense_rank IS NOT NULL AND lex_rank IS NULL) AS dense_only, count(*) FILTER (dense_rank IS NULL) AS lex_only, count(*) FILTER (dense_rank IS NOT NULL AND lex_rank IS NOT NULL) AS both FROM f GROUP BY query_id")
def channel_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hybrid(spark, sf_dir, 1_000_000_000)
    d, x = F.col("dense_rank").isNotNull(), F.col("lex_rank").isNotNull()
    return rows.groupBy("query_id").agg(F.count_if(d & ~x).alias("dense_only"), F.count_if(~d).alias("lex_only"), F.count_if(d & x).alias("both"))


QRELS_SQL = "rel AS (SELECT query_id, chunk_id FROM q JOIN v ON v.label = q.qlabel AND v.chunk_id <> q.query_id)"
DCG = "sum(CASE WHEN r.rank <= 10 THEN ln(2.0) / ln(r.rank + 1.0) ELSE 0 END)"


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dense hits with ``relevant`` (of the query's label, but not itself), and ``query_id, n_rel`` by counts of labels."""
    labels = doc_vectors(spark, sf_dir).select("chunk_id", "label")
    asked = vector_queries(spark, sf_dir).select("query_id", "qlabel")
    hits = _dense(spark, sf_dir).select("query_id", "chunk_id", F.col("dense_rank").alias("rank")).join(labels, "chunk_id").join(asked, "query_id")
    hits = hits.select("query_id", "chunk_id", "rank", ((F.col("label") == F.col("qlabel")) & (F.col("chunk_id") != F.col("query_id"))).alias("relevant"))
    sizes = labels.groupBy(F.col("label").alias("qlabel")).agg(F.count("*").alias("_n"))
    own = labels.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("_own"))
    totals = asked.join(sizes, "qlabel").join(own, "query_id", "left")
    return hits, totals.select("query_id", (F.col("_n") - F.coalesce((F.col("_own") == F.col("qlabel")).cast("int"), F.lit(0))).alias("n_rel")).filter("n_rel > 0")


@query(f"""WITH {DENSE_SQL}, {QRELS_SQL}, r AS (SELECT query_id, chunk_id, dense_rank AS rank FROM dense),
    n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
    h AS (SELECT r.query_id, sum(CASE WHEN r.rank <= 10 THEN 1 ELSE 0 END) AS hits, {DCG} AS dcg, max(CASE WHEN r.rank <= 10 THEN 1.0::DOUBLE / r.rank ELSE 0 END) AS rr
          FROM r JOIN rel USING (query_id, chunk_id) GROUP BY r.query_id)
    SELECT query_id, round(coalesce(hits, 0)::DOUBLE / n_rel, 9) AS recall, round(coalesce(hits, 0)::DOUBLE / 10, 9) AS "precision",
      round(coalesce(dcg, 0) / list_sum([ln(2.0) / ln(i + 1.0) for i in range(1, least(n_rel, 10) + 1)]), 9) AS ndcg, coalesce(rr, 0)::DOUBLE AS rr
    FROM (SELECT DISTINCT query_id FROM r) LEFT JOIN n USING (query_id) LEFT JOIN h USING (query_id)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.of_judged(*_judged(spark, sf_dir), 10)


@query(f"""WITH {DENSE_SQL}, {QRELS_SQL}, b AS (SELECT query_id, min(dense_rank) AS best FROM dense JOIN rel USING (query_id, chunk_id) GROUP BY query_id)
    SELECT query_id, coalesce(best, {POOL + 1})::BIGINT AS best_rank FROM (SELECT DISTINCT query_id FROM dense) LEFT JOIN b USING (query_id)""")
def oracle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best rank of a relevant chunk; one past the pool where there is none."""
    best = _judged(spark, sf_dir)[0].groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_b"))
    return best.select("query_id", F.coalesce("_b", F.lit(POOL + 1)).cast("long").alias("best_rank"))


ASPECT_SQL = f"""WITH {DENSE_SQL}, h AS (SELECT query_id - query_id % 100 AS query_id, query_id % 100 AS aspect, chunk_id, dense_rank AS rank FROM dense WHERE dense_rank <= 20)"""


def _aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five queries in a row play the sub-questions of one."""
    q = F.col("query_id")
    return _dense(spark, sf_dir, 20).select((q - q % 100).alias("query_id"), (q % 100).alias("aspect"), "chunk_id", F.col("dense_rank").alias("rank"))


@query(f"""{ASPECT_SQL}, m AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min({{'a': aspect, 'r': rank}}) AS f FROM h GROUP BY ALL)
    SELECT query_id, chunk_id, rrf, f.a AS aspect, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, f.a, f.r, chunk_id) AS merged_rank FROM m QUALIFY merged_rank <= {K}""")
def decomposed_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.merge_aspects(_aspects(spark, sf_dir), K)


@query(f"""{ASPECT_SQL}, o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, aspect) = 1)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, aspect, chunk_id) AS slot FROM o QUALIFY slot <= {K}""")
def aspect_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.round_robin(_aspects(spark, sf_dir), K)


@query(f"""WITH {DENSE_SQL}, s AS (SELECT query_id, chunk_id, (chunk_id * 7919 + query_id) % 100 AS rerank_score FROM dense)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rerank_rank FROM s QUALIFY rerank_rank <= {K}) WHERE rerank_score >= 85""")
def rerank_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The injected score stands for a reranker; the floor cuts after the limit and nothing fills up."""
    hits = _dense(spark, sf_dir).select("query_id", "chunk_id", ((F.col("chunk_id") * 7919 + F.col("query_id")) % 100).alias("rerank_score"))
    return search.rerank(hits, "rerank_score", K, 85)


@query(f"""WITH {DENSE_SQL}, s AS (SELECT query_id, chunk_id, dense_rank, chunk_id % 3 = 0 AS roster FROM dense),
    g AS (SELECT *, roster AND row_number() OVER (PARTITION BY query_id, roster ORDER BY dense_rank) <= 3 AS first FROM s)
    SELECT query_id, chunk_id, dense_rank, roster, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN first THEN 0 ELSE 1 END, dense_rank) AS reserved_rank FROM g QUALIFY reserved_rank <= {K}""")
def roster_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _dense(spark, sf_dir).select("query_id", "chunk_id", "dense_rank", (F.col("chunk_id") % 3 == 0).alias("roster"))
    return search.reserve(hits, "roster", "dense_rank", K)


TURNS_SQL = "c AS (SELECT conv_id AS doc_id, turn AS ordinal, conv_id * 100 + turn AS chunk_id, role FROM conversations)"


@query(f"""WITH {TURNS_SQL}, a AS (SELECT chunk_id AS query_id, doc_id, ordinal FROM c),
    near AS (SELECT a.query_id, c.chunk_id, c.doc_id, c.ordinal, min(abs(c.ordinal - a.ordinal)) AS distance FROM a JOIN c ON a.doc_id = c.doc_id AND c.ordinal BETWEEN a.ordinal - 2 AND a.ordinal + 2 GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ordinal, chunk_id) AS n FROM near QUALIFY n <= 50""")
def surrounding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation play a document's chunks; each is an anchor."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.lit(None).cast("string").alias("generation"))
    anchors = turns.select(F.col("chunk_id").alias("query_id"), "doc_id", "generation", "ordinal")
    return search.surrounding(anchors, turns, 2)


@query(f"WITH {DENSE_SQL} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id % 7, chunk_id % 5, chunk_id) AS position FROM dense")
def evidence_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dense(spark, sf_dir).select("query_id", "chunk_id", (F.col("chunk_id") % 7).alias("doc_id"), (F.col("chunk_id") % 5).alias("ordinal"))
    return search.source_order(rows).select("query_id", "chunk_id", "position")


@query(f"""WITH {DENSE_SQL}, s AS (SELECT query_id, list(chunk_id ORDER BY chunk_id) AS ids FROM dense WHERE dense_rank <= 10 GROUP BY query_id)
    SELECT a.query_id AS a, b.query_id AS b, round(CASE WHEN len(list_distinct(list_concat(a.ids, b.ids))) = 0 THEN 1.0 ELSE len(list_intersect(a.ids, b.ids))::DOUBLE / len(list_distinct(list_concat(a.ids, b.ids))) END, 9) AS jaccard
    FROM s a JOIN s b ON b.query_id = a.query_id + 20""")
def result_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the results of each query and the next."""
    sets = _dense(spark, sf_dir, 10).groupBy("query_id").agg(F.collect_set("chunk_id").alias("ids"))
    nxt = sets.select((F.col("query_id") - 20).alias("a"), F.col("query_id").alias("b"), F.col("ids").alias("other"))
    return sets.join(nxt, sets["query_id"] == nxt["a"]).select("a", "b", F.round(metrics.jaccard(F.col("ids"), F.col("other")), 9).alias("jaccard"))


@query("SELECT label, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM (SELECT label, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings) GROUP BY label")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.round(F.col("embedding")[0].cast("double"), 6)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(*[F.percentile(x, p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


FAULTY_SQL = """f AS (SELECT vec_id, CASE vec_id % 6 WHEN 1 THEN NULL WHEN 2 THEN embedding[1:63]::DOUBLE[] WHEN 3 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE)
    WHEN 4 THEN list_concat(embedding[1:63]::DOUBLE[], ['nan'::DOUBLE]) WHEN 5 THEN list_concat(embedding[1:63]::DOUBLE[], [1e39::DOUBLE]) ELSE embedding::DOUBLE[] END AS e FROM embeddings)"""


@query(f"""WITH {FAULTY_SQL} SELECT vec_id, CASE WHEN e IS NULL THEN 'null' WHEN len(e) <> 64 THEN 'width' WHEN len(list_filter(e, lambda x: isnan(x) OR abs(x) > 3.4028234663852886e38)) > 0 THEN 'not finite'
    WHEN list_sum([x * x for x in e]) = 0 THEN 'zero' END AS fault FROM f""")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as they are and with each fault."""
    e, n = F.col("embedding").cast("array<double>"), F.col("vec_id") % 6
    with_last = lambda x: F.concat(F.slice(e, 1, 63), F.array(F.lit(x)))
    made = F.when(n == 2, F.slice(e, 1, 63)).when(n == 3, F.transform(e, lambda x: F.lit(0.0))).when(n == 4, with_last(float("nan"))).when(n == 5, with_last(1e39)).when(n == 0, e)
    return table(spark, sf_dir, "embeddings").select("vec_id", V.vector_fault(made, 64).alias("fault"))


@query(f"""WITH {DENSE_SQL}, s AS (SELECT query_id, chunk_id, dense_rank FROM dense) SELECT query_id, count(*) = count(DISTINCT chunk_id) AND bool_and(chunk_id IN (SELECT doc_id FROM documents)) AS valid FROM s GROUP BY query_id""")
def validate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result's sources are valid if they are unique and all still there."""
    hits = _dense(spark, sf_dir).select("query_id", "chunk_id")
    there = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("_there"))
    rows = hits.join(there, "chunk_id", "left")
    return rows.groupBy("query_id").agg(((F.count("*") == F.count_distinct("chunk_id")) & F.bool_and(F.col("_there").isNotNull())).alias("valid"))


@query(f"WITH d AS ({ACL_SQL}) SELECT doc_id, tenant FROM d ORDER BY doc_id LIMIT 20 OFFSET 40")
def document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a page: page 2 of 20."""
    return search.page(docs_acl(spark, sf_dir).select("doc_id", "tenant"), ["doc_id"], 2, 20)


@query(f"""WITH t AS (SELECT item_id AS query_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS raw FROM benchmark),
    c AS (SELECT query_id, len(raw) AS n, len(list_filter(raw, lambda w: regexp_matches(w, '\\p{{Nd}}') OR regexp_full_match(w, '\\p{{Lu}}{{2,}}'))) AS ids,
          len(list_filter(raw, lambda w: list_contains(string_split('{" ".join(T.STOPWORDS)}', ' '), lower(w)))) > 0 AS prose FROM t)
    SELECT query_id, 1.0::DOUBLE AS w_dense, CASE WHEN n > 0 AND ids * 2 >= n THEN 2.0::DOUBLE WHEN ids > 0 AND (n <= 3 OR NOT prose) THEN 1.5 ELSE 1.0 END AS w_lex FROM c""")
def query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries(spark, sf_dir).select("query_id", T.fusion_weights(F.col("qtext")).alias("w")).select("query_id", "w.w_dense", "w.w_lex")


@query(f"""WITH {DENSE_SQL}, w AS (SELECT *, dense_rank % 2 = 0 AS lex FROM dense)
    SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + dense_rank) + CASE WHEN lex THEN 1.5::DOUBLE / (60 + dense_rank // 2) ELSE 0 END, 12) AS rrf FROM w""")
def weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _dense(spark, sf_dir)
    lexical = dense.filter("dense_rank % 2 = 0").select("query_id", "chunk_id", F.lit(1.0).alias("lex_score"), F.floor(F.col("dense_rank") / 2).alias("lex_rank"))
    return search.fuse(dense, lexical, 1_000_000, 1.0, 1.5).select("query_id", "chunk_id", "rrf")


@query("""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, turn, role, sum(CASE WHEN role IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM t""")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    changed = ~F.col("role").eqNullSafe(F.lag("role").over(order))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.coalesce(changed, F.lit(True)), 1).otherwise(0).alias("_c"))
    return rows.select("conv_id", "turn", "role", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
