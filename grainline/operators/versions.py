"""Chunks, versions and stored state as joins: diff, publish, upsert, history, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id


def content_hash(text: Column, stored: Column | None = None) -> Column:
    own = F.sha2(F.coalesce(text, F.lit("")), 256)
    return own if stored is None else F.coalesce(stored, own)


def finalize(chunks: DataFrame) -> DataFrame:
    """``doc_id, ordinal, text`` -> ids padded to the number of a document's chunks, and hashes."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    return chunks.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("ordinal"), total)).withColumn("content_sha256", content_hash(F.col("text")))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Multiset difference by content hash: ``doc_id, added, removed, unchanged``."""
    a = old.groupBy("doc_id", "hash").agg(F.count("*").alias("_old"))
    b = new.groupBy("doc_id", "hash").agg(F.count("*").alias("_new"))
    both = a.join(b, ["doc_id", "hash"], "full_outer").na.fill(0, ["_old", "_new"])
    return both.groupBy("doc_id").agg(
        F.sum(F.greatest(F.col("_new") - F.col("_old"), F.lit(0))).alias("added"),
        F.sum(F.greatest(F.col("_old") - F.col("_new"), F.lit(0))).alias("removed"),
        F.sum(F.least("_old", "_new")).alias("unchanged"),
    )


def added_previews(old: DataFrame, new: DataFrame, limit: int = 10, chars: int = 160) -> DataFrame:
    """The first added chunks of a document in order, as many of a hash as are in surplus."""
    before = old.groupBy("doc_id", "hash").agg(F.count("*").alias("_old"))
    after = new.withColumn("_new", F.count("*").over(Window.partitionBy("doc_id", "hash")))
    rows = after.join(before, ["doc_id", "hash"], "left").withColumn("_surplus", F.col("_new") - F.coalesce("_old", F.lit(0)))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("ordinal"))).filter("_nth <= _surplus")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))).filter(F.col("n") <= limit)
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.select("doc_id", "n", F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, chars)), F.lit("..."))).alias("preview"))


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace stored ones of the same key."""
    return stored.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_once(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows win; of new ones of a key one is inserted."""
    return stored.unionByName(new.dropDuplicates(key).join(stored.select(*key), key, "left_anti"))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def resolve_uploads(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """created, updated, deduplicated or conflict, by owner with file name or hash.

    The same bytes are deduplicated; a known name with other bytes is an update,
    unless those bytes already belong to another document.
    """
    docs = documents.select("tenant", "owner", F.col("filename").alias("_f"), F.col("sha").alias("_s"), F.col("doc_id").alias("_d"))
    by_name = docs.groupBy("tenant", "owner", "_f").agg(F.max("_d").alias("named")).withColumnRenamed("_f", "filename")
    by_hash = docs.groupBy("tenant", "owner", "_s").agg(F.max("_d").alias("hashed")).withColumnRenamed("_s", "sha")
    rows = uploads.join(by_name, ["tenant", "owner", "filename"], "left").join(by_hash, ["tenant", "owner", "sha"], "left")
    outcome = (
        F.when(F.col("hashed").isNotNull() & (F.col("named").isNull() | (F.col("named") == F.col("hashed"))), "deduplicated")
        .when(F.col("hashed").isNotNull(), "conflict")
        .when(F.col("named").isNotNull(), "updated")
        .otherwise("created")
    )
    return rows.withColumn("outcome", outcome).withColumn("target", F.coalesce("named", "hashed"))


def references(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """How many rows of either table point at a blob."""
    return documents.select("sha").unionAll(versions.select("sha")).groupBy("sha").agg(F.count("*").alias("refs"))


def epochs(changes: DataFrame, state: str = "acl_state") -> DataFrame:
    """Revision of each scope: the updates of a document that change its permissions.

    Columns: doc_id, tenant, scope, at, seq and ``state``. A document's first row is
    no update. A change to or from the global scope counts for ``global``, any other
    for the tenant.
    """
    order = Window.partitionBy("doc_id").orderBy("at", "seq")
    now, old = F.struct(state, "scope"), F.lag(F.struct(state, "scope")).over(order)
    rows = changes.withColumns({"_old": old, "_first": F.row_number().over(order) == 1})
    rows = rows.filter(~F.col("_first") & ~F.col("_old").eqNullSafe(now))
    key = F.when((F.col("scope") == "global") | (F.col("_old.scope") == "global"), "global").otherwise(F.col("tenant").cast("string"))
    return rows.groupBy(key.alias("scope_key")).agg(F.count("*").alias("epoch"))


def epoch_strings(tenants: DataFrame, revisions: DataFrame) -> DataFrame:
    """``tenant`` -> its revision and the global one as ``t:g``, 0 where there is none."""
    everywhere = revisions.filter("scope_key = 'global'").agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("_g"))
    own = revisions.select(F.col("scope_key").alias("_k"), F.col("epoch").alias("_t"))
    rows = tenants.join(own, F.col("tenant").cast("string") == F.col("_k"), "left").crossJoin(F.broadcast(everywhere))  # one row
    return rows.select("tenant", F.concat_ws(":", F.coalesce("_t", F.lit(0)), "_g").alias("epoch"))


def fingerprint(df: DataFrame, by: list[str], key: str, columns: list[str]) -> DataFrame:
    """SHA-256 over the rows' hashes in key order, one for each group that ``by`` bounds."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("h")))).alias("_l"))
    return rows.select(*by, F.sha2(F.array_join(F.transform("_l", lambda x: x["h"]), ""), 256).alias("fingerprint"), F.size("_l").cast("long").alias("n"))


def metric_totals(events: DataFrame) -> DataFrame:
    sums = events.groupBy("name").agg(F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"))
    return sums.withColumn("avg_ms", F.when(F.col("count") == 0, 0.0).otherwise(F.round(F.col("total_ms") / F.col("count"), 2)))


def usage(calls: DataFrame, by: str) -> DataFrame:
    """Known cost, and the total cost, which is null if any call's is unknown."""
    return calls.groupBy(by).agg(
        F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("known_cost"),
        F.round(F.when(F.bool_or(F.col("cost").isNull()), None).otherwise(F.sum("cost")), 6).alias("total_cost"),
        F.count("*").alias("calls"),
    )


def route_summary(elements: DataFrame) -> DataFrame:
    """``doc_id, modality, extractor, reason`` of elements -> counts of each as maps, omissions and a status.

    A document without anything but omissions is empty, one with some is partial.
    """
    counted = elements.groupBy("doc_id", "modality", "extractor", "reason").agg(F.count("*").alias("_n"))
    kinds = counted.groupBy("doc_id").agg(*[F.collect_list(F.struct(c, "_n")).alias(c) for c in ("modality", "extractor", "reason")], F.sum(F.when(F.col("modality") == "omission", F.col("_n")).otherwise(0)).alias("n_omitted"), F.sum("_n").alias("_all"))
    total = lambda c: F.aggregate(c, F.create_map().cast("map<string,bigint>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x[c]), F.map_from_arrays(F.array(x[c]), F.array(F.coalesce(F.try_element_at(m, x[c]), F.lit(0)) + x["_n"]))))
    status = F.when(F.col("n_omitted") == F.col("_all"), "empty").when(F.col("n_omitted") > 0, "partial").otherwise("complete")
    return kinds.select("doc_id", *[total(c).alias(c) for c in ("modality", "extractor", "reason")], "n_omitted", status.alias("status"))
