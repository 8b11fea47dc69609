"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, lower_ascii, partitions, unpacked, wrapped

KEY = ["_sha", "_len", "_fp"]
#: Runs at the leaves of the tree, and how many are merged into one in a round (three binomial rounds at once).
RUNS, FAN_IN = 64, 8


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, in binary."""
    return F.unhex(F.sha2(lower_ascii(text), 256))


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, its run and the digest of its normalised text.

    A digest is SHA-256, length and an independent 64-bit hash of the same text,
    so an id is retained only for texts which agree in all three.
    """
    text = lower_ascii(F.col(text_col))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
        "_id",
        F.pmod(F.xxhash64("_id"), F.lit(runs)).cast("int").alias("_run"),
        F.unhex(F.sha2("_text", 256)).alias("_sha"),
        F.octet_length("_text").alias("_len"),
        F.xxhash64("_text").alias("_fp"),
    )


def leaves(stored: DataFrame, keep: str) -> DataFrame:
    """The first runs: each digest of a run once, with its best id and count; combined before they are dealt out."""
    pick = F.max if keep == "max" else F.min
    return stored.groupBy("_run", *KEY).agg(pick("_id").alias("_best"), F.count("*").alias("_n"))


def merge_round(level: DataFrame, fan_in: int, parts: int, keep: str) -> DataFrame:
    """``fan_in`` neighbouring runs each merged into one.

    Runs are cut into ``parts`` by the digest, so that the last one is not one task.
    Each part of a merged run comes together in one task, in order of digest; its
    rows of one digest, at most ``fan_in``, are neighbours there, and the first has
    the best id. Only the order of rows is used, no hash table.
    """
    best = F.col("_best").desc_nulls_last() if keep == "max" else F.col("_best").asc_nulls_last()
    part = F.pmod(F.conv(F.hex(F.substring("_sha", 1, 4)), 16, 10).cast("long"), F.lit(parts)).cast("int")
    dealt = level.withColumns({"_run": F.floor(F.col("_run") / fan_in).cast("int"), "_part": part})
    dealt = dealt.repartition(partitions(level.sparkSession), "_part", "_run").sortWithinPartitions("_part", "_run", *KEY, best)
    same = Window.partitionBy("_part", "_run", *KEY).orderBy(best)
    merged = dealt.withColumns({"_first": F.row_number().over(same), "_sum": F.sum("_n").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return merged.filter("_first = 1").select("_run", *KEY, "_best", F.col("_sum").alias("_n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    Documents are digested once; what is written is as large as the table of ids.
    They are dealt to ``runs`` runs by id, which also spreads a hot group of copies.
    Each run is reduced to (digest, best id, count) before any shuffle; then rounds
    merge ``fan_in`` neighbouring sorted runs each until one is left, keeping the
    best id of each digest. On the way down, only digests of several documents go to
    their runs (at most ``runs`` rows each) and from there to the documents, so
    that no task holds a whole group.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` for every row; other
    columns of any name aren't looked at. Null text counts as empty. Null ids lose
    against any id; in a group without ids, keep_id is null and its rows are kept.
    Repeated rows, the ties here, count each in group_size and share one verdict. Texts
    of any length are digested whole. An empty table gives an empty result.
    """
    leaf = Stored(digests(docs, runs, id_col, text_col)).df
    return verdicts(leaf, keep, runs, fan_in).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def verdicts(leaf: DataFrame, keep: str, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """``_id, _sha, _keep, _size`` of each row of ``digests``."""
    spark = leaf.sparkSession
    first = leaves(leaf, keep)
    level, left = first, runs
    while left > 1:
        left = -(-left // fan_in)
        level = merge_round(level, fan_in, max(1, 4 * partitions(spark) // left), keep)
    groups = level.filter("_n > 1").select(*KEY, F.col("_best").alias("_keep"), F.col("_n").alias("_size"))
    down = leaf.select("_run", *KEY).distinct().join(groups, KEY)
    found = leaf.join(down, ["_run", *KEY], "left")
    alone = F.col("_size").isNull()
    return found.select("_id", "_sha", F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_size", F.lit(1).cast("long")).alias("_size"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    Rows that repeat both id and text stay only once; rows without an id stay
    once for each text. Null text counts as empty; an empty table stays empty.
    """
    leaf = Stored(digests(docs, RUNS, id_col, text_col)).df
    names = {"_no": F.col("_id").isNull(), "_key": F.coalesce("_id", F.lit(0)), "_dig": F.col("_sha")}
    stay = verdicts(leaf, keep).filter(F.col("_id").eqNullSafe(F.col("_keep"))).select(*(c.alias(n) for n, c in names.items()))
    rows = wrapped(docs, {"_no": F.col(id_col).isNull(), "_key": F.coalesce(F.col(id_col), F.lit(0)), "_dig": digest(F.col(text_col))})
    kept = rows.join(stay, list(names), "left_semi")
    # in the order of the join, so that repeats are dropped where they lie
    kept = kept.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy(*names)))
    return unpacked(kept.filter("_nth = 1"))
