"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_col: Column) -> Column:
    """A stable 60-bit place of a document: the head of the MD5 of its id as text."""
    text = F.coalesce(id_col.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size`` -> the same with ``target``, by water-filling.

    A source whose weighted share is above ``cap`` times its size stops there and
    the excess goes to the others by weight. Sources in order of what a unit of
    weight may take fill up one after another, so one pass of running sums finds
    the final share per unit of weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("_level", F.col("_cap") / F.col("_w"))
    by_level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    rows = rows.withColumn("_share", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    rows = rows.withColumn("_rank", F.row_number().over(by_level))
    open_rank = F.min(F.when(F.col("_level") > F.col("_share"), F.col("_rank"))).over(everything)
    rows = rows.withColumn("_open", open_rank)
    final_share = F.max(F.when(F.col("_rank") == F.col("_open"), F.col("_share"))).over(everything)
    rows = rows.withColumn("_final", final_share)
    capped = F.col("_open").isNull() | (F.col("_rank") < F.col("_open"))
    return rows.select("source", "source_size", F.when(capped, F.col("_cap")).otherwise(F.col("_final") * F.col("_w")).alias("target"))


def by_source(df: DataFrame, small: DataFrame, n_sources: int) -> DataFrame:
    """Null-safe join on source. ``small`` has one row per source: it is broadcast
    below a proven 20,000 rows, and shuffled with AQE's skew split beyond."""
    small = small.withColumnRenamed("source", "_source")
    small = F.broadcast(small) if n_sources <= 20_000 else small
    return df.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, bits: int = 12) -> DataFrame:
    """How often each document enters a mix whose sources have target shares.

    Each document is taken ``floor(target / source_size)`` times whole. For what
    is left of the target, the documents of a source below a threshold of their
    hash place are taken once more. The threshold is found by nested histograms:
    sum the words by source and hash bucket, find the bucket in which the budget
    ends, and refine only that bucket by its next ``bits`` bits, until it holds
    one place; that place is taken if half of it or more fits. Nothing is sorted
    and no source is gathered in a task.

    Returns ``doc_id, size, source_size, target, taken`` for each row. Null text
    has size 0, a null source is a source of its own and comes last, null ids
    share one place, and rows that repeat an id are taken together.
    """
    size = n_words(F.col("text"))
    base = settle(docs.select("doc_id", "source", size.alias("size"), place(F.col("doc_id")).alias("_h")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = settle(targets(sizes, weights, budget, cap))
    n_sources = goal.count()
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("_times", times).withColumn("_left", F.col("target") - F.col("_times") * F.col("source_size"))
    state = goal.select("source", "_left", F.lit(0).cast("long").alias("_prefix"), F.lit(True).alias("_open"))
    known = HASH_BITS
    while known > 0:
        known -= bits
        bucket = F.shiftright("_h", known)
        inside = by_source(base, state.filter("_open"), n_sources).filter(F.shiftright("_h", known + bits) == F.col("_prefix"))
        histogram = inside.groupBy("source", "_left", bucket.alias("_bucket")).agg(F.sum("size").alias("_mass"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        running = F.sum("_mass").over(Window.partitionBy("source").orderBy("_bucket"))
        ends = histogram.withColumn("_cum", running).filter(F.col("_cum") > F.col("_left"))
        found = ends.groupBy("source").agg(F.min_by(F.struct("_bucket", "_mass", "_cum", "_left", (F.col("_lo") < F.col("_hi")).alias("_more")), "_bucket").alias("_e"))
        # a source without such a bucket (its budget is never reached) takes all
        now = found.select("source", (F.col("_e._left") - F.col("_e._cum") + F.col("_e._mass")).alias("_left"), F.col("_e._bucket").alias("_prefix"), F.col("_e._more").alias("_open"), F.col("_e._mass").alias("_mass"))
        limit = F.when(~F.col("_open") | F.lit(known == 0), F.shiftleft(F.col("_prefix") + F.when(F.col("_mass") <= 2 * F.col("_left"), 1).otherwise(0), known))
        done = now.select("source", limit.alias("_limit"))
        step = settle(now.join(done.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
        part = step.filter("_limit is not null").select("source", "_limit")
        limits = part if known == HASH_BITS - bits else limits.unionByName(part)
        state = step.filter("_limit is null").select("source", "_left", "_prefix", "_open")
        if state.isEmpty():
            break
    limits = limits.withColumnRenamed("source", "_ls")
    goal = goal.join(limits, F.col("source").eqNullSafe(F.col("_ls")), "left").drop("_ls")
    extra = F.when((F.col("_left") > 0) & (F.col("_h") < F.coalesce("_limit", F.lit(1 << HASH_BITS))), 1).otherwise(0)
    return by_source(base, goal, n_sources).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * (F.col("_times") + extra)).alias("taken"))
