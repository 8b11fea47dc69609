"""Approximate nearest vectors under permissions: an inverted file of sampled centroids, widened until it suffices."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..session import settle
from . import access, search

#: Readers of at most so many vectors are answered exactly. Fixed value.
EXACT = 1000
#: Lists of an index at most: bounds the centroids, which the driver and every task hold.
MOST_LISTS = 4096
#: Vectors that are asked for when an index is made, how many neighbours of each are looked at in doubling
#: steps, and the share of them that the lists probed first have to hold.
SAMPLE, DEPTHS, TARGET = 64, tuple(10 * 2**i for i in range(7)), 0.97
#: How many readable vectors (times k) a query has to have met before it stops.
ENOUGH = 4
#: Vectors of a part at least, where there are more parts than tasks need.
PART = 2 * search.TILE
PERMISSIONS = ("tenant", "owner", "visibility", "scope", "acl")
READER = ("q_tenant", "q_user", "q_role")


@dataclass
class Inverted:
    """Vectors with the number of their list, the lists' centroids, the number of vectors, and for
    each depth of neighbours how many lists hold TARGET of them."""

    table: DataFrame
    centroids: np.ndarray
    size: int
    widths: dict[int, int]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _nearness(vectors: pd.Series, centroids: np.ndarray) -> np.ndarray:
    return np.round(_unit(np.stack([np.asarray(v, np.float64) for v in vectors])) @ centroids.T, 12)


def build(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Inverted:
    """An index of ``corpus`` (chunk_id, vector and whatever else): every row is in the list of its nearest centroid.

    Centroids are the vectors of the ``lists`` smallest digests of chunk ids: a
    sample of a stated size, the square root of the number of rows unless told, and
    MOST_LISTS at most. Of equally near centroids the first in that order counts. Rows
    of a list lie together, long lists in several partitions. The next ``sample``
    vectors are asked for exactly, which tells how many lists their neighbours are in.
    Null vectors, and those of another length than the first, aren't indexed.
    """
    drawn = corpus.filter("vector IS NOT NULL").orderBy(F.md5(F.col("chunk_id").cast("string")), "chunk_id")
    n = corpus.count()
    lists = min(MOST_LISTS, lists or max(1, math.ceil(math.sqrt(n))))
    first = drawn.limit(lists + sample).select("chunk_id", "vector").collect()
    if not first:
        return Inverted(corpus.filter("vector IS NOT NULL").withColumn("list_no", F.lit(0)), np.zeros((1, 0)), 0, {})
    width = len(first[0][1])
    first = [(i, v) for i, v in first if len(v) == width]
    centroids = _unit(np.array([v for _, v in first[:lists]], np.float64))

    @F.pandas_udf("int")
    def nearest_list(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(_nearness(vectors, centroids).argmax(axis=1).astype(np.int32))

    whole = corpus.filter(F.size("vector") == width)
    table = settle(whole.withColumn("list_no", nearest_list("vector")).repartitionByRange("list_no", "chunk_id"))
    index = Inverted(table, centroids, n, {})
    if len(first) > lists:
        index.widths = _widths(index, first[lists:])
    return index


def _widths(index: Inverted, asked: list) -> dict[int, int]:
    """How many of a vector's nearest lists hold TARGET of its neighbours, for each of DEPTHS; by SAMPLE rows at most."""
    spark = index.table.sparkSession
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in asked], "query_id long, qvec array<double>")
    near = search.nearest(index.table.select("chunk_id", "vector"), queries, DEPTHS[-1] + 1, lambda tile, block: True).filter(F.col("chunk_id") != F.col("query_id"))
    depth = Window.partitionBy("query_id").orderBy("dense_rank")
    rows = near.withColumn("_d", F.row_number().over(depth)).join(index.table.select("chunk_id", "list_no"), "chunk_id").select("query_id", "_d", "list_no").collect()
    order = np.argsort(-np.round(_unit(np.array([v for _, v in asked], np.float64)) @ index.centroids.T, 12), axis=1, kind="stable")
    place = {i: np.argsort(o) + 1 for (i, _), o in zip(asked, order, strict=True)}
    found = np.array([(d, place[q][no]) for q, d, no in rows], np.int64).reshape(-1, 2)
    widths = {}
    for d in DEPTHS:
        own = np.sort(found[found[:, 0] <= d, 1])
        if len(own):
            widths[d] = int(own[math.ceil(TARGET * len(own)) - 1])
    return widths


def probe(index: Inverted, queries: DataFrame, k: int, enough: int = ENOUGH) -> DataFrame:
    """``query_id, chunk_id, score, dense_rank, scored, probes`` of queries (query_id, qvec, READER, n).

    ``n``: how many vectors the reader may see. If that is one in so many, the k nearest
    of them are about the k times so many nearest of all, and as many of a query's
    nearest lists are taken as hold TARGET of those. In further rounds there are
    twice as many, until it has met ``enough`` * k readable vectors, or all lists. Permissions
    are part of the search, not a filter behind it, so a selective one widens the search
    instead of emptying it. ``scored``: vectors multiplied with the query.
    """
    centroids, lists = index.centroids, len(index.centroids)

    @F.pandas_udf("array<int>")
    def order_of_lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(list(np.argsort(-_nearness(vectors, centroids), axis=1, kind="stable").astype(np.int32)), dtype=object)

    deep = F.lit(max(index.widths.values(), default=lists))
    for depth in sorted(index.widths, reverse=True):
        deep = F.when(F.lit(k * index.size) <= depth * F.col("n"), index.widths[depth]).otherwise(deep)
    waiting = settle(queries.select("query_id", "qvec", *READER, order_of_lists("qvec").alias("_lists"), F.lit(0).alias("_before"), F.least(deep, F.lit(lists)).alias("_width")))
    table, met, taken = index.table.select("chunk_id", "vector", *PERMISSIONS, "list_no"), None, waiting.select("query_id", "_width")
    while met is None or not waiting.isEmpty():
        now = settle(_met(table, waiting.withColumn("_now", F.slice("_lists", F.col("_before") + 1, F.col("_width") - F.col("_before"))), k, index.size))
        met = now if met is None else met.union(now)
        sizes = met.groupBy("query_id").agg(F.sum("readable").alias("_n"))
        short = waiting.filter(F.col("_width") < lists).join(sizes, "query_id", "left").filter(F.coalesce("_n", F.lit(0)) < enough * k).drop("_n")
        waiting = settle(short.select("query_id", "qvec", *READER, "_lists", F.col("_width").alias("_before"), F.least(F.col("_width") * 2, F.lit(lists)).alias("_width")))
        taken = taken.union(waiting.select("query_id", "_width"))
    work = met.groupBy("query_id").agg(F.sum("scored").alias("scored")).join(taken.groupBy("query_id").agg(F.max("_width").alias("probes")), "query_id")
    hits = met.filter("chunk_id IS NOT NULL").select("query_id", "chunk_id", F.round("score", 12).alias("score"))
    return search.top(hits, "score", k, "dense_rank").join(work, "query_id")


def _met(table: DataFrame, asked: DataFrame, k: int, size: int) -> DataFrame:
    """Tiles of a part of the lists with blocks of the queries that probe some of these: each query's best k of a part, and
    a row of counts without a chunk.

    A query goes to a part once, with the lists that it probes there, and only those are
    multiplied with it. A task holds one tile and one block, and what that block has found so far.
    """
    parts = max(4 * table.sparkSession.sparkContext.defaultParallelism, size // PART)
    # filled by part first, and then dealt to more partitions than there are parts, so that few parts share one
    dealt = lambda rows, size, name, *order: search.packed(rows.repartition("_key"), size, name, *order).repartition(4 * parts, "_key")
    part = lambda no: F.pmod(no, F.lit(parts)).cast("long")
    tiles = dealt(table.withColumn("_key", part(F.col("list_no"))), search.TILE, "_tile", "list_no")
    each = asked.select("query_id", "qvec", *READER, "_now", F.explode(F.array_distinct(F.transform("_now", part))).alias("_key"))
    each = each.withColumn("_now", F.filter("_now", lambda no: part(no) == F.col("_key")))
    blocks = dealt(each, search.QUERY_BLOCK, "_block")

    def told(query: np.ndarray, bar: search.Bar, counts: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
        row, chunk, score = _still(bar, found)
        zeros = np.zeros(len(row), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((query[row], query))), pa.concat_arrays([pa.array(chunk, pa.int64()), pa.nulls(len(query), pa.int64())]), pa.concat_arrays([pa.array(score, pa.float64()), pa.nulls(len(query), pa.float64())]),
                pa.array(np.concatenate((zeros, counts[0]))), pa.array(np.concatenate((zeros, counts[1]))),
            ],
            names=["query_id", "chunk_id", "score", "readable", "scored"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, query, bar, counts, found = b"", None, None, None, []
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                tile, block = search.opened(left), search.opened(right)
                chunk, asking = (t.column(0).to_numpy(zero_copy_only=False) for t in (tile, block))
                # tiles of a block come one after the other; if they didn't, there would only be more rows
                if asking.tobytes() != last:
                    if query is not None:
                        yield told(query, bar, counts, found)
                    last, query, bar, counts, found = asking.tobytes(), asking, search.Bar(len(asking), k), np.zeros((2, len(asking)), np.int64), []
                scores, probed = _probed(tile, block)
                allowed = search.may_read(tile, block) & probed
                counts += allowed.sum(axis=1), probed.sum(axis=1)
                scores[~allowed] = -np.inf
                row, at = bar.places(scores)
                found.append((row, chunk[at], scores[row, at]))
                if sum(len(f[0]) for f in found) > 4 * k * len(query):
                    found = [_still(bar, found)]
        if query is not None:
            yield told(query, bar, counts, found)

    return blocks.join(tiles, "_key").select("_tile", "_block").mapInArrow(run, "query_id long, chunk_id long, score double, readable long, scored long")


def _probed(tile: pa.RecordBatch, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of a block's queries and the vectors of the lists that each probes, and where these are."""
    vectors, asking = search.numbers(tile.column(1), tile.num_rows), search.numbers(block.column(1), block.num_rows)
    own, lists = tile.column(7).to_numpy(zero_copy_only=False), block.column(5)
    edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    wanted, rows = lists.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    scores, asks = np.full((block.num_rows, tile.num_rows), -np.inf), np.zeros((block.num_rows, len(edges) - 1), bool)
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        who = rows[wanted == own[low]]
        asks[who, i] = True
        scores[who, low:high] = asking[who] @ vectors[low:high].T
    return scores, np.repeat(asks, np.diff(edges), axis=1)


def _still(bar: search.Bar, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of what was found, what the bar still lets pass."""
    row, chunk, score = (np.concatenate(c) for c in zip(*found, strict=True))
    kept = score >= bar.best.min(axis=1)[row] - search.NEAR
    return row[kept], chunk[kept], score[kept]


def eligible(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, n``: how many rows each query's reader may see, by counts of permission keys."""
    counts = corpus.select(F.explode(access.document_keys()).alias("_k")).groupBy("_k").agg(F.count("*").alias("_n"))
    readers = queries.select("query_id", F.explode(access.reader_keys(*map(F.col, READER))).alias("_k"))
    return readers.join(counts, "_k", "left").groupBy("query_id").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def exact(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``probe``, for readers of few rows: these are joined by permission keys, nothing else is read."""
    own = corpus.select("chunk_id", "vector", F.explode(access.document_keys()).alias("_k"))
    asked = queries.select("query_id", "qvec", F.explode(access.reader_keys(*map(F.col, READER))).alias("_k"))
    scored = own.join(asked, "_k").select("query_id", "chunk_id", F.round(cosine(F.col("vector"), F.col("qvec")), 12).alias("score"))
    work = scored.groupBy("query_id").agg(F.count("*").alias("scored"))
    return search.top(scored, "score", k, "dense_rank").join(work, "query_id").withColumn("probes", F.lit(0))


def ann_topk(index: Inverted, queries: DataFrame, k: int, exact_below: int = EXACT, enough: int = ENOUGH) -> DataFrame:
    """``query_id, chunk_id, score, dense_rank, scored, probes``: k nearest vectors that each query's reader may see.

    Readers of at most ``exact_below`` vectors get exact answers (probes 0), others those
    of the widened search. Ties are by chunk id. Queries of readers who see nothing
    have no rows.
    """
    sizes = eligible(index.table, queries)
    told = settle(queries.select("query_id", "qvec", *READER).join(sizes, "query_id"))
    few = exact(index.table, told.filter(F.col("n") <= exact_below), k)
    many = probe(index, told.filter(F.col("n") > exact_below), k, enough)
    columns = ["query_id", "chunk_id", "score", "dense_rank", "scored", "probes"]
    return few.select(*columns).union(many.select(*columns))


def recall(found: DataFrame, truth: DataFrame, by: Column | None = None) -> DataFrame:
    """Share of ``truth`` (query_id, chunk_id) that ``found`` has: ``slice, queries, relevant, recalled, recall``.

    ``by`` is the slice of a query_id, such as who asks.
    """
    slice_of = F.lit("all") if by is None else by
    hit = truth.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    sums = hit.groupBy(slice_of.alias("slice")).agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("relevant"), F.count("_hit").alias("recalled"))
    return sums.withColumn("recall", F.round(F.col("recalled") / F.col("relevant"), 6))
