"""The registered queries ``opN_<name>`` of the training-data operators, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, html_extract, lexical_search, licenses, line_dedup, mixing, near_dedup, quality, spelling, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    names = F.concat_ws(",", F.array_sort(F.array_distinct(F.col("matches.template"))))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), names.alias("templates"), F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("best_coverage"), "matches")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.repeated_lines(_table(spark, sf_dir, "documents"), gram=line_dedup.WORD)
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.array_join("removed", ","), 256).alias("removed_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path).withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe.decode(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_html_extraction": op10_html_extraction,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_bpe": op12_bpe,
    "op13_lexical_search": op13_lexical_search,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": rf"""
        WITH iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
                FROM iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
        dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        dg AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
               FROM dw, (SELECT DISTINCT l FROM win) AS ls, unnest(range(1, len(w) - l + 2)) AS t(i)),
        hit AS (SELECT doc_id, i, dg.l, item_id FROM dg JOIN win USING (g)),
        p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
               FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM dw LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS s FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
        FROM d""",
    "op9_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
          FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (
          SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w,
                 source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM s),
        r AS (
          SELECT *, cap / w AS lvl, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS rk,
                 (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                 / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
        o AS (SELECT min(rk) FILTER (lvl > share) AS op FROM r),
        t AS (
          SELECT source, source_size,
                 CASE WHEN op IS NULL OR rk < op THEN cap ELSE (SELECT share FROM r, o WHERE rk = op) * w END AS target FROM r, o),
        u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
        p AS (SELECT source, h, sum(size) AS m FROM d GROUP BY source, h),
        c AS (SELECT *, sum(m) OVER (PARTITION BY source ORDER BY h) AS cum FROM p)
        SELECT d.doc_id, d.size, u.source_size, u.target,
               (d.size * (times + CASE WHEN target - times * u.source_size > 0 AND (cum <= target - times * u.source_size
                 OR (cum - m <= target - times * u.source_size AND m <= 2 * (target - times * u.source_size - (cum - m)))) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
        JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h""",
    "op11_spelling_variants": rf"""
        WITH RECURSIVE bits AS (
          SELECT i, i AS c, 0 AS k FROM range(256) t(i)
          UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        g AS (SELECT id, r, count(*) AS c, hex(encode(id || ':' || r)) AS x
              FROM (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
              WHERE length(r) >= 7 GROUP BY ALL),
        h AS (SELECT r, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
                     lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) AS h FROM g, crc),
        v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(c)::BIGINT AS n
              FROM h GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
        cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS k FROM v, unnest(range(length(word))) AS t(i)),
        near AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
                 UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.k = v.word
                 UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.k = v.word),
        f AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS m FROM near JOIN v ON v.word = b GROUP BY a),
        o AS (SELECT v.word, CASE WHEN m >= 10 * n THEN b END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n
              FROM v LEFT JOIN f ON f.word = v.word),
        way AS (SELECT word, word AS root, form AS further FROM o
                UNION ALL SELECT way.word, o.word, o.form FROM way JOIN o ON o.word = way.further)
        SELECT word, form, root, n, n_near, form_n FROM o JOIN way USING (word) WHERE further IS NULL""",
    "op13_lexical_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
        p AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS len, unnest(w) AS t FROM d) GROUP BY ALL),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
        r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len * n) // l))))::BIGINT AS score
              FROM q JOIN w USING (t) JOIN p USING (t), s GROUP BY item_id, doc_id HAVING score > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM r QUALIFY rank <= 10""",
}
