"""Tokens, tables, blocks and chunks queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, versions
from ..session import table
from .fixtures import TOKENS
from .registry import query


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, md5(array_to_string({TOKENS.format('text')}, ' ')) AS tokens_md5 FROM documents")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


@query(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents) GROUP BY term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    return tokens.groupBy("term").agg(F.count("*").alias("df"))


ASKED_SQL = """q AS (SELECT item_id, CASE item_id % 4 WHEN 1 THEN '"' || text || '"' WHEN 2 THEN 'not -' || text WHEN 3 THEN text || ' or else' ELSE text END AS text FROM benchmark)"""


@query(rf"""WITH {ASKED_SQL} SELECT item_id, CASE WHEN regexp_matches(text, '\"|(^|\s)-[\p{{L}}\p{{N}}_]|\b(OR|or|Or|oR)\b') THEN text
    ELSE array_to_string(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+(?:[-./][\p{{L}}\p{{N}}_]+)*'), ' OR ') END AS lexical FROM q""")
def lexical_or_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as they are, quoted, with a word denied, and with an OR of their own."""
    n, t = F.col("item_id") % 4, F.col("text")
    asked = F.when(n == 1, F.concat(F.lit('"'), t, F.lit('"'))).when(n == 2, F.concat(F.lit("not -"), t)).when(n == 3, F.concat(t, F.lit(" or else"))).otherwise(t)
    return table(spark, sf_dir, "benchmark").select("item_id", T.or_query(asked).alias("lexical"))


LAYER_SQL = """l AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN regexp_replace(text[1:12], '(.)', '\\1 ', 'g') WHEN 2 THEN repeat(chr(1), 4) || text[1:30] WHEN 3 THEN text || '(cid:3) (cid:14)' WHEN 4 THEN text[1:25] ELSE text END AS text FROM documents)"""


@query(rf"""WITH {LAYER_SQL}, s AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^\s\x1c-\x1f\x85\p{{Z}}]')) AS visible, len(regexp_extract_all(text, '[\x00-\x08\x0e-\x1b\x7f\x{{FFFD}}]')) AS broken, len(regexp_extract_all(text, '\(cid:\d+\)')) AS glyphs FROM l)
    SELECT doc_id, greatest(1, (length(text) + 3) // 4)::BIGINT AS tokens, octet_length(encode(text)) AS bytes,
    CASE WHEN broken >= greatest(2, ceil(visible * 0.1)) OR glyphs >= 2 THEN 'corrupt' WHEN visible < 20 THEN 'sparse' ELSE 'usable' END AS status FROM s""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text layers: whole, short, spaced out, with control characters, with glyph ids."""
    n, t = F.col("doc_id") % 5, F.col("text")
    layer = F.when(n == 1, F.regexp_replace(F.substring(t, 1, 12), "(.)", "$1 ")).when(n == 2, F.concat(F.lit("\u0001" * 4), F.substring(t, 1, 30)))
    layer = layer.when(n == 3, F.concat(t, F.lit("(cid:3) (cid:14)"))).when(n == 4, F.substring(t, 1, 25)).otherwise(t)
    rows = table(spark, sf_dir, "documents").select("doc_id", layer.alias("text"))
    return rows.select("doc_id", T.approximate_tokens(F.col("text")).alias("tokens"), F.octet_length("text").cast("long").alias("bytes"), T.native_text_status(F.col("text")).alias("status"))


@query(r"SELECT item_id, sha256('m|' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key FROM benchmark")
def question_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.cache_key(F.lit("m"), F.col("text")).alias("key"))


@query()
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RE2 has no look-behind, so SQL can't express it; tests hold it against Python."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))


@query("""SELECT n_regionkey, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |', chr(10) ORDER BY n_nationkey) AS markdown
    FROM nation GROUP BY n_regionkey""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row)).alias("_r"))
    cells = F.concat(F.array(F.array(F.lit("n_nationkey"), F.lit("n_name"))), F.transform("_r", lambda r: r["cells"]))
    return rows.select("n_regionkey", T.rows_to_markdown(cells).alias("markdown"))


ELEMENTS_SQL = """e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
    k AS (SELECT doc_id, CASE WHEN trim(t) = '' THEN 'omission' WHEN contains(t, '|') THEN 'table' ELSE 'text' END AS modality, CASE WHEN trim(t) = '' THEN 'blank_line' WHEN contains(t, '|') THEN 'pipe_row' ELSE 'prose' END AS reason FROM e)"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as elements: tables where they have a pipe, omissions where they are blank."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    blank, pipe = F.trim("t") == "", F.col("t").contains("|")
    kinds = [F.when(blank, a).when(pipe, b).otherwise(c) for a, b, c in (("omission", "table", "text"), ("blank_line", "pipe_row", "prose"))]
    return rows.select("doc_id", kinds[0].alias("modality"), F.lit("lines").alias("extractor"), kinds[1].alias("reason"))


@query(f"""WITH {ELEMENTS_SQL} SELECT doc_id, count(*) FILTER (modality = 'text') AS n_text, count(*) FILTER (modality = 'table') AS n_table, count(*) FILTER (modality = 'omission') AS n_omitted, count(*) FILTER (reason = 'pipe_row') AS n_pipe_row,
    CASE WHEN count(*) FILTER (modality <> 'omission') = 0 THEN 'empty' WHEN count(*) FILTER (modality = 'omission') > 0 THEN 'partial' ELSE 'complete' END AS status FROM k GROUP BY doc_id""")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions.route_summary(_elements(spark, sf_dir))
    count = lambda m, k: F.coalesce(F.try_element_at(F.col(m), F.lit(k)), F.lit(0)).cast("long")
    return found.select("doc_id", count("modality", "text").alias("n_text"), count("modality", "table").alias("n_table"), "n_omitted", count("reason", "pipe_row").alias("n_pipe_row"), "status")


CHUNK_SQL = "SELECT doc_id, i - 1 AS ordinal, trim(l) AS text, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).withColumn("text", F.trim("text"))


@query(f"""SELECT doc_id, ordinal, doc_id::VARCHAR || lpad((ordinal + 1)::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS chunk_id, sha256(text) AS content_sha256 FROM ({CHUNK_SQL})""")
def finalize_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.finalize(lines(spark, sf_dir)).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk_id", "content_sha256")


V2_SQL = "v2 AS (SELECT doc_id, ordinal, text FROM c WHERE ordinal % 7 <> 0 UNION ALL SELECT doc_id, ordinal + 100000, text FROM c WHERE ordinal % 5 = 0)"


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = lines(spark, sf_dir).withColumn("hash", versions.content_hash(F.col("text")))
    new = old.filter("ordinal % 7 <> 0").union(old.filter("ordinal % 5 = 0").withColumn("ordinal", F.col("ordinal") + 100000))
    return old, new


@query(f"""WITH c AS ({CHUNK_SQL}), {V2_SQL}, a AS (SELECT doc_id, sha256(text) AS h, count(*) AS o FROM c GROUP BY ALL), b AS (SELECT doc_id, sha256(text) AS h, count(*) AS n FROM v2 GROUP BY ALL)
    SELECT doc_id, sum(greatest(coalesce(n, 0) - coalesce(o, 0), 0))::BIGINT AS added, sum(greatest(coalesce(o, 0) - coalesce(n, 0), 0))::BIGINT AS removed, sum(least(coalesce(n, 0), coalesce(o, 0)))::BIGINT AS unchanged
    FROM a FULL JOIN b USING (doc_id, h) GROUP BY doc_id""")
def chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.diff(*_two_versions(spark, sf_dir))


@query(f"""WITH c AS ({CHUNK_SQL}), {V2_SQL}, b AS (SELECT *, sha256(text) AS h, count(*) OVER (PARTITION BY doc_id, sha256(text)) - (SELECT count(*) FROM c WHERE c.doc_id = v2.doc_id AND c.text = v2.text) AS surplus,
      row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY ordinal) AS nth FROM v2),
    p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM b WHERE nth <= surplus)
    SELECT doc_id, n, CASE WHEN length(f) <= 160 THEN f ELSE rtrim(f[1:160]) || '...' END AS preview FROM p WHERE n <= 10""")
def chunk_diff_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.added_previews(*_two_versions(spark, sf_dir))


@query(f"WITH c AS ({CHUNK_SQL}), {V2_SQL} SELECT doc_id, text, count(*) AS copies FROM (SELECT doc_id, text FROM c INTERSECT ALL SELECT doc_id, text FROM v2) GROUP BY ALL")
def multiset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_versions(spark, sf_dir)
    return old.select("doc_id", "text").intersectAll(new.select("doc_id", "text")).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(all|list|enumerate|how many|complete inventory)\b|\b(?:identify|name|show|give)\s+(?:me\s+)?(?:every|each)\b') AS collection,
    regexp_matches(text, '(?i)\b(for each|each of)\b') AS each FROM documents""")
def question_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.asks_for_collection(F.col("text")).alias("collection"), F.col("text").rlike(r"(?i)\b(for each|each of)\b").alias("each"))


PACK_SQL = """WITH RECURSIVE t AS (SELECT conv_id AS query_id, turn AS position, length(text) AS size, sha256(text) AS identity,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(text) <> ''),
    f AS (SELECT query_id, 0::BIGINT AS n, 600::BIGINT AS left_, []::VARCHAR[] AS seen, NULL::BIGINT AS position, false AS ok FROM (SELECT DISTINCT query_id FROM t)
      UNION ALL SELECT f.query_id, t.n, CASE WHEN t.size <= f.left_ AND NOT list_contains(f.seen, t.identity) THEN f.left_ - t.size ELSE f.left_ END,
        CASE WHEN t.size <= f.left_ AND NOT list_contains(f.seen, t.identity) THEN list_append(f.seen, t.identity) ELSE f.seen END, t.position,
        t.size <= f.left_ AND NOT list_contains(f.seen, t.identity) FROM f JOIN t ON t.query_id = f.query_id AND t.n = f.n + 1)
    SELECT query_id, position FROM f WHERE ok"""


@query(PACK_SQL)
def pack_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy-skip packing of a conversation's turns into 600 characters."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), "text", F.length("text").alias("size"), F.sha2("text", 256).alias("identity"))
    return evidence.pack(turns, 600)


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS hay, trim(regexp_replace(text[11:50], '\\s+', ' ', 'g')) AS needle FROM documents)
    SELECT doc_id, length(needle) > 0 AND len(list_filter(range(1, length(hay) + 1), lambda i: hay[i:i + length(needle) - 1] = needle)) = 1 AS once FROM d""")
def quote_occurs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.trim(F.substring("text", 11, 40)).alias("quote"))
    return docs.select("doc_id", evidence.quote_occurs_once(F.col("text"), F.col("quote")).alias("once"))


ANSWERS_SQL = """a AS (SELECT doc_id, doc_id % 9 AS a, doc_id % 6 AS b, doc_id % 5 AS kind, regexp_replace(text[1:40], '["\\\\\\[\\]\\s\\x00-\\x1f]', ' ', 'g') AS words FROM documents)"""


@query(rf"""WITH {ANSWERS_SQL} SELECT doc_id, CASE WHEN kind = 0 THEN 'invalid_json' WHEN kind = 1 THEN 'abstained' WHEN a > 4 OR b > 4 THEN 'references' WHEN kind = 2 AND a <> b THEN 'references' END AS failure,
    CASE WHEN kind IN (0, 1) OR a > 4 OR b > 4 OR (kind = 2 AND a <> b) THEN NULL WHEN kind = 2 THEN 'w' || words || '[' || a || ']' WHEN a = b THEN 'w' || rtrim(words, ' ') || ' [' || a || ']' ELSE 'w' || rtrim(words, ' ') || ' [' || a || '] [' || b || ']' END AS final_answer FROM a""")
def validate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in documents' words: broken ones, abstentions, with and without inline ids, of which 0 to 4 exist."""
    d = F.col("doc_id")
    a, b, kind = ((d % n).cast("string") for n in (9, 6, 5))
    words = F.concat(F.lit("w"), F.regexp_replace(F.substring("text", 1, 40), r'["\\\[\]\s\x00-\x1f]', " "))
    text = F.when(kind == "2", F.concat(words, F.lit("["), a, F.lit("]"))).otherwise(words)
    raw = F.concat(F.lit('{"status":"'), F.when(kind == "1", "insufficient").otherwise("answered"), F.lit('","answer":"'), text, F.lit('","source_ids":["'), a, F.lit('","'), b, F.lit('"]}'))
    raw = F.when(kind == "0", words).when(kind == "3", F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).otherwise(raw)
    rows = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), F.array(*[F.lit(str(i)) for i in range(5)]).alias("available"))
    return evidence.validate_answers(rows).select("doc_id", "failure", "final_answer")


@query("""WITH a AS (SELECT doc_id, lower(text) AS answer FROM documents) SELECT doc_id, contains(answer, 'the') AND contains(answer, 'and') AND NOT contains(answer, 'idiot') AS accepted FROM a""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("answer"), F.array(F.lit("the"), F.lit("AND")).alias("required"), F.array(F.lit("idiot")).alias("forbidden"))
    return evidence.acceptance(rows).select("doc_id", "accepted")
