"""Stored state: publication of generations, memo of extractions, previews, histories, allow-lists."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import vector_fault

# Fixed lists: what of a chunk's metadata locates it for a reader, and what of a vector's payload may leave the store.
LOCATORS = (
    "page pages frame sheet cell_range row column row_start row_end source_line source_line_start source_line_end body_index paragraph_index table_index "
    "section section_path relationship_id"
).split()
PAYLOAD = (
    "_id content filename source_type location section_path source_ordinal modality extractor route_reason token_count page pages sheet "
    "generation_id version scope visibility provenance score"
).split()
#: Most characters and blocks of a preview; most regions of a citation.
PREVIEW_CHARS, PREVIEW_BLOCKS, REGIONS = 2_000_000, 2_000, 4_096


def decide(jobs: DataFrame, documents: DataFrame, chunks: DataFrame, points: DataFrame, width: int, now: Column) -> DataFrame:
    """``job_id, outcome``: published, or the first reason why a job's generation can't be.

    ``jobs``: job_id, doc_id, tenant, generation, lease_token, version, sha, parent (what the job
    began with). ``documents``: doc_id, tenant, version, sha, active_generation, lease (token of
    its running job), lease_generation, lease_until. ``chunks``: generation, chunk_id, text,
    content_sha256. ``points``: generation, chunk_id, tenant, vector.
    """
    c = chunks.select("generation", "chunk_id", (F.sha2("text", 256) != F.col("content_sha256")).alias("_stale"))
    p = points.select("generation", "chunk_id", F.col("tenant").alias("_tenant"), vector_fault(F.col("vector"), width).alias("_fault"), F.lit(True).alias("_there"))
    both = c.withColumn("_chunk", F.lit(True)).join(p, ["generation", "chunk_id"], "full_outer")
    pairs = both.groupBy("generation").agg(
        F.bool_or(F.col("_chunk").isNull() | F.col("_there").isNull()).alias("_unlike"), F.bool_or(F.col("_fault").isin("width", "not finite", "null")).alias("_bad"),
        F.bool_or("_stale").alias("_changed"), F.count_distinct("_tenant").alias("_tenants"), F.max("_tenant").alias("_tenant"),
    )
    now_docs = documents.select("doc_id", F.col("tenant").alias("_dt"), F.col("version").alias("_version"), F.col("sha").alias("_sha"), "active_generation", "lease", "lease_generation", "lease_until")
    rows = jobs.join(pairs, "generation", "left").join(now_docs, "doc_id", "left")
    outcome = (
        F.when(F.col("lease_token").isNull() | F.col("generation").isNull(), "no_lease")
        .when(F.col("_unlike").isNull() | F.col("_unlike"), "not_aligned")
        .when((F.col("_tenants") != 1) | (F.col("_tenant") != F.col("tenant")), "not_aligned")
        .when(F.col("_bad"), "bad_vector")
        .when(F.col("_changed"), "hash_mismatch")
        .when(F.col("_dt").isNull() | (F.col("_dt") != F.col("tenant")), "deleted")
        .when(~(F.col("lease").eqNullSafe(F.col("lease_token")) & F.col("lease_generation").eqNullSafe(F.col("generation")) & F.coalesce(F.col("lease_until") > now, F.lit(False))), "stale_lease")
        .when((F.col("_version") != F.col("version")) | (F.col("_sha") != F.col("sha")), "superseded")
        .when(~F.col("active_generation").eqNullSafe(F.col("parent")), "parent_changed")
        .otherwise("published")
    )
    return rows.select("job_id", "doc_id", "generation", outcome.alias("outcome"))


def activate(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents with the generations that were published; the table is the manifest, written at once."""
    new = decisions.filter("outcome = 'published'").select("doc_id", F.col("generation").alias("_g"))
    return documents.join(new, "doc_id", "left").withColumn("active_generation", F.coalesce("_g", "active_generation")).drop("_g")


def config_key(config: dict) -> str:
    """SHA-256 of a configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def memoised(inputs: DataFrame, memo: DataFrame, config: dict, extract) -> tuple[DataFrame, DataFrame]:
    """Results of all inputs (``sha, content``), of which ``extract`` makes only those that ``memo``
    (sha, config, result) doesn't hold for this configuration; and the rows to add to the memo."""
    key = config_key(config)
    known = memo.filter(F.col("config") == key).select("sha", "result")
    new = extract(inputs.dropDuplicates(["sha"]).join(known, "sha", "left_anti")).select("sha", F.lit(key).alias("config"), "result")
    return inputs.select("sha").join(known.union(new.select("sha", "result")), "sha", "left"), new


def preview(blocks: DataFrame, chars: int = PREVIEW_CHARS, most: int = PREVIEW_BLOCKS) -> DataFrame:
    """The first blocks (doc_id, n, text) of a document, the last one cut, and if anything is missing."""
    order = Window.partitionBy("doc_id").orderBy("n")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumns({"_nth": F.row_number().over(order), "_left": F.lit(chars) - before})
    whole = Window.partitionBy("doc_id")
    rows = rows.withColumn("truncated", (F.sum(F.length("text")).over(whole) > chars) | (F.count("*").over(whole) > most))
    kept = rows.filter((F.col("_nth") <= most) & (F.col("_left") > 0))
    return kept.select("doc_id", "n", F.substring("text", F.lit(1), F.greatest(F.col("_left"), F.lit(0)).cast("int")).alias("text"), "truncated")


def history(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """A document's versions, newest first (``nth``), with the one that is current."""
    order = Window.partitionBy("doc_id").orderBy(F.col("version").desc())
    now = documents.select("doc_id", F.col("version").alias("_now"))
    return versions.join(now, "doc_id").withColumns({"nth": F.row_number().over(order), "current": F.col("version") == F.col("_now")}).drop("_now")


def pinned(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs that don't yet hold what they work on take it from their document."""
    now = documents.select("doc_id", F.col("version").alias("_v"), F.col("sha").alias("_s"))
    return jobs.join(now, "doc_id", "left").withColumns({"version": F.coalesce("version", "_v"), "sha": F.coalesce("sha", "_s")}).drop("_v", "_s")


def active_users(users: DataFrame, tenants: DataFrame) -> DataFrame:
    return users.join(tenants.filter("status = 'active'").select("tenant"), "tenant", "left_semi")


def replace_of(stored: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """All rows of the keys that ``new`` has are replaced by its rows; and how many went for each key."""
    gone = stored.join(new.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("n_removed"))
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new), gone


def bury(vectors: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with a tombstone on those of ``doomed``, and how many weren't buried before, by tenant."""
    marked = vectors.join(doomed.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    counts = marked.groupBy("tenant").agg(F.count_if(F.col("_gone") & ~F.col("deleted")).alias("n_deleted"))
    return marked.withColumn("deleted", F.col("deleted") | F.col("_gone")).drop("_gone"), counts


def vectors_per_tenant(*stores: DataFrame) -> DataFrame:
    """How many live vectors a tenant has in all stores."""
    counts = [s.filter("not deleted").groupBy("tenant").agg(F.count("*").alias("_n")) for s in stores]
    every = counts[0]
    for c in counts[1:]:
        every = every.union(c)
    return every.groupBy("tenant").agg(F.sum("_n").alias("n_vectors"))


def tokens_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))


def locator(meta: Column, keys: list[str] = LOCATORS) -> Column:
    """Of a map of metadata what may be shown."""
    return F.map_filter(meta, lambda k, v: k.isin(*keys) & v.isNotNull())


def shown(rows: DataFrame, fields: list[str] = PAYLOAD) -> DataFrame:
    """Of a search's rows the columns that may leave the store; the scan reads no others."""
    return rows.select(*[c for c in rows.columns if c in fields])


def embeddable(text: Column, tokens: Column, limit: int) -> Column:
    """Whether a text can be embedded: not blank, and within the model's limit."""
    return F.coalesce((F.regexp_replace(text, r"(?U)\s+", "") != "") & (tokens <= limit), F.lit(False))


def citation_regions(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes of chunks' sources as shares of their pages, each once in order, and the chunk's outline by page.

    Columns: chunk_id, n, page, x0, top, x1, bottom, page_width, page_height, and box (x0, y0, x1, y1
    of the page, or null). Boxes are cut to the page; what is not on it, or has no size, goes. The
    first REGIONS of a chunk stay, its outline is of all.
    """
    size = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = spans.filter(F.col("page").isNotNull() & size("x0") & size("top") & size("x1") & size("bottom") & (F.col("page_width") > 0) & (F.col("page_height") > 0))
    box = [F.coalesce(F.col("box")[i], x) for i, x in enumerate((F.lit(0.0), F.lit(0.0), F.col("page_width"), F.col("page_height")))]
    rows = rows.withColumns({"_w": box[2] - box[0], "_h": box[3] - box[1]}).filter("_w > 0 and _h > 0")
    cut = {
        "_l": F.greatest(F.lit(0.0), F.col("x0") - box[0]), "_r": F.least(F.col("_w"), F.col("x1") - box[0]),
        "_u": F.greatest(F.lit(0.0), F.col("top") - box[1]), "_b": F.least(F.col("_h"), F.col("bottom") - box[1]),
    }
    rows = rows.withColumns(cut).filter("_r > _l and _b > _u")
    part = lambda a, b: F.round(a / b, 6)
    regions = rows.select("chunk_id", "n", "page", part(F.col("_l"), F.col("_w")).alias("x"), part(F.col("_u"), F.col("_h")).alias("y"), part(F.col("_r") - F.col("_l"), F.col("_w")).alias("width"), part(F.col("_b") - F.col("_u"), F.col("_h")).alias("height"))
    once = regions.groupBy("chunk_id", "page", "x", "y", "width", "height").agg(F.min("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy("n", "page", "x", "y", "width", "height"))
    outline = once.groupBy("chunk_id", "page").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("_r"), F.max(F.col("y") + F.col("height")).alias("_b"))
    outline = outline.select("chunk_id", "page", "x", "y", F.round(F.least(F.lit(1.0), "_r") - F.col("x"), 6).alias("width"), F.round(F.least(F.lit(1.0), "_b") - F.col("y"), 6).alias("height"))
    return once.withColumn("region", nth).filter(F.col("region") <= REGIONS).drop("n"), outline


def plan_questions(raw: Column, most: int = 4) -> Column:
    """Sub-questions of a planner's JSON answer: distinct, not blank, up to ``most``; two at least or none."""
    found = F.from_json(F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*|\s*```$", ""), "sub_questions array<string>")["sub_questions"]
    kept = F.slice(F.array_distinct(F.filter(F.transform(found, lambda s: F.trim(s)), lambda q: q.isNotNull() & (q != ""))), 1, most)
    return F.when(F.size(kept) >= 2, kept).otherwise(F.array().cast("array<string>"))
