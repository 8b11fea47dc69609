"""Ranked lexical search: an inverted index per shard of documents, searched with MaxScore."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bytetext import NOT_ALNUM, blocks
from .common import Stored, frugal, settle

#: Bytes of documents in one shard.
SHARD_BYTES = 1 << 24
#: Distinct terms of queries, summed over the queries, in one block: bounds what is sent to executors at once.
BLOCK_TERMS = 1_000_000
TOP = 10
SHARD = "docs array<long>, lens binary, terms binary, dfs binary, places binary, tfs binary, fronts binary, front_tfs binary, front_lens binary, n_docs long, n_terms long"

#: Bytes to what they count as: separators are blanks, A-Z is lower-cased.
_FOLD = bytes(32 if NOT_ALNUM[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and all non-ASCII, in order; A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _packed(values: np.ndarray) -> bytes:
    return values.astype(np.int32).tobytes()


def _ints(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int32).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Shards of a batch one at a time; of their lists only the terms are copied out of it."""
    for i in range(batch.num_rows):
        yield {name: value.as_buffer() if pa.types.is_binary(value.type) and name != "terms" else value.as_py() for name, value in ((n, batch.column(n)[i]) for n in batch.schema.names)}


def shard_index(ids: list, texts: list[bytes]) -> dict:
    """The inverted index of one shard as a row of ``SHARD``.

    Terms are in byte order, each with its postings by place in the shard, and with
    its front: the (tf, length) of postings that no other posting of the list beats in
    both. A score rises with tf and falls with length, so the front gives a list's
    greatest score whatever the statistics of the whole corpus are.
    """
    numbers: defaultdict = defaultdict(count().__next__)
    codes = [np.fromiter(map(numbers.__getitem__, words := terms_of(t)), np.int64, len(words)) for t in texts]
    lens = np.array([len(c) for c in codes], np.int64)
    names = sorted(numbers)
    rank = np.empty(len(names), np.int64)
    rank[[numbers[t] for t in names]] = np.arange(len(names))
    words = np.concatenate([rank[c] for c in codes]) if codes else np.empty(0, np.int64)
    keys, tfs = np.unique(words * len(codes) + np.repeat(np.arange(len(codes)), lens), return_counts=True)
    term, place = np.divmod(keys, max(1, len(codes)))
    dfs = np.bincount(term, minlength=len(names))
    # along each list by length, then from the greatest tf: what exceeds all tfs before it is on the front
    order = np.lexsort((-tfs, lens[place], term))
    height = term[order] * (int(tfs.max(initial=0)) + 1) + tfs[order]
    front = order[height > np.concatenate(([-1], np.maximum.accumulate(height)[:-1]))] if len(order) else order
    return {
        "docs": ids, "lens": _packed(lens), "terms": b" ".join(names), "dfs": _packed(dfs), "places": _packed(place), "tfs": _packed(tfs),
        "fronts": _packed(np.bincount(term[front], minlength=len(names))), "front_tfs": _packed(tfs[front]), "front_lens": _packed(lens[place[front]]),
        "n_docs": int((lens > 0).sum()), "n_terms": int(lens.sum()),
    }


def _build(shard_bytes: int):
    kinds = {"docs": pa.list_(pa.int64()), "n_docs": pa.int64(), "n_terms": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, offsets, data in blocks(batch.column(1), shard_bytes):
                whole = data.tobytes()
                row = shard_index(ids[low:high], [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard of about ``shard_bytes`` of text, or one longer text; no shuffle takes place."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(frugal(_build(shard_bytes)), SHARD)


class Block:
    """Queries as lists of terms over their own vocabulary, with the terms' weights once they are known."""

    def __init__(self, queries: list[tuple[object, list[bytes]]], first: int):
        self.names = sorted({t for _, terms in queries for t in terms})
        self.number = {t: i for i, t in enumerate(self.names)}
        self.ids = [i for i, _ in queries]
        self.terms = [np.array([self.number[t] for t in terms], np.int64) for _, terms in queries]
        self.first, self.weights, self.n, self.total = first, None, 0, 1

    def weigh(self, dfs: dict[int, int], n: int, total: int) -> None:
        self.n, self.total = n, max(1, total)
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * dfs.get(i, 0) + 1))) for i in range(len(self.names))], np.int64)

    def found(self, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Which of a shard's terms queries have, and their numbers here."""
        number = [self.number.get(t, -1) for t in terms.split()]
        at = np.array(number, np.int64)
        here = np.flatnonzero(at >= 0)
        return here, at[here]


def query_blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[Block]:
    """Blocks of at most ``most`` terms (or one query), one at a time."""
    held, n, first = [], 0, 0
    for row in items.select(id_col, F.col(text_col).cast("string")).toLocalIterator():
        terms = sorted(set(terms_of((row[1] or "").encode())))
        if terms:
            held.append((row[0], terms))
            n += len(terms)
        if n >= most:
            yield Block(held, first)
            held, n, first = [], 0, first + len(held)
    if held:
        yield Block(held, first)


def _count(shared):
    """Of each shard's terms that queries have: number and document frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.names), np.int64)
        for batch in batches:
            for row in _rows(batch):
                here, number = shared.value.found(row["terms"])
                total[number] += _ints(row["dfs"])[here]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "df"])

    return run


def impacts(tfs: np.ndarray, lens: np.ndarray, n: int, total: int) -> np.ndarray:
    """What an occurrence count adds to a score per unit of its term's weight."""
    norm = 10 + (90 * lens * n) // total
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * norm)


class Shard:
    """A row of the index opened for a block of queries."""

    def __init__(self, row: dict, block: Block):
        self.block, self.lens = block, _ints(row["lens"])
        self.ids = row["docs"]
        self.places, self.tfs = _ints(row["places"]), _ints(row["tfs"])
        here, number = block.found(row["terms"])
        ends, front_ends = np.cumsum(_ints(row["dfs"])), np.cumsum(_ints(row["fronts"]))
        start, end = ends[here] - _ints(row["dfs"])[here], ends[here]
        best = impacts(_ints(row["front_tfs"]), _ints(row["front_lens"]), block.n, block.total)
        sizes, heads = _ints(row["fronts"])[here], front_ends[here]
        bounds = np.array([best[b - a : b].max() for a, b in zip(sizes.tolist(), heads.tolist(), strict=True)], np.int64)
        self.bound = np.zeros(len(block.names), np.int64)
        self.bound[number] = bounds * block.weights[number]
        self.span = {int(k): (int(a), int(b)) for k, a, b in zip(number, start, end, strict=True)}
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and what they score; worked out once for all queries of the block."""
        if term not in self.open:
            a, b = self.span[term]
            places = self.places[a:b]
            self.open[term] = places, self.block.weights[term] * impacts(self.tfs[a:b], self.lens[places], self.block.n, self.block.total)
        return self.open[term]

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of at least the best ``k`` of a query, but for those below ``least``.

        Lists are taken from the greatest bound down. Those read whole are essential;
        the rest are non-essential once all their bounds together stay below the k-th
        best score so far, which a document in none of the others can't reach then.
        Non-essential lists are only probed at places that can still qualify.
        """
        bound = self.bound[terms]
        order = np.argsort(-bound, kind="stable")
        terms, bound = terms[order][bound[order] > 0], bound[order][bound[order] > 0]
        rest = np.concatenate((np.cumsum(bound[::-1])[::-1], [0]))
        scores = np.zeros(len(self.lens), np.int64)
        i = 0
        while i < len(terms) and rest[i] >= least:
            places, adds = self.postings(int(terms[i]))
            scores[places] += adds
            i += 1
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
        held = np.flatnonzero((scores > 0) & (scores + rest[i] >= least))
        for j in range(i, len(terms)):
            if not len(held):
                break
            places, adds = self.postings(int(terms[j]))
            at = np.minimum(np.searchsorted(places, held), len(places) - 1)
            hit = places[at] == held
            scores[held[hit]] += adds[at[hit]]
            if len(held) >= k:
                least = max(least, int(np.partition(scores[held], -k)[-k]))
            held = held[scores[held] + rest[j + 1] >= least]
        return held, scores[held]


def _first(found: list[tuple], k: int) -> list[tuple]:
    """The best ``k`` of (score, id): higher scores, then lower ids, no id last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def _search(shared, k: int, kind: pa.DataType):
    """The best ``k`` of each query among all shards of a task; a shard starts with the bar that those before it set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        kept: list[list[tuple]] = [[] for _ in block.ids]
        for batch in batches:
            for row in _rows(batch):
                shard = Shard(row, block)
                for q, terms in enumerate(block.terms):
                    least = kept[q][-1][0] if len(kept[q]) == k else 1
                    places, scores = shard.best(terms, k, least)
                    if len(places) > 4 * k:
                        bar = np.partition(scores, -k)[-k]
                        places, scores = places[scores >= bar], scores[scores >= bar]
                    if len(places):
                        kept[q] = _first(kept[q] + [(s, shard.ids[p]) for p, s in zip(places.tolist(), scores.tolist(), strict=True)], k)
        rows = [(block.first + q, block.ids[q], i, s) for q, found in enumerate(kept) for s, i in found]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), kind, pa.int64(), pa.int64()), strict=True)], names=["_query", "_item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` highest-scoring documents of ``index`` for each row of ``items``: ``item_id, rank, doc_id, score``.

    Queries are taken in blocks of at most ``block_terms`` terms: the driver and a task
    hold one block. For each, document frequencies of its terms are summed over the
    shards, and then every shard is searched where it lies; of each task, at most ``k``
    documents a query are shuffled.
    """
    spark = index.sparkSession
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    kind = items.schema[id_col].dataType
    best, parts = Window.partitionBy("_query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()), []
    for block in query_blocks(items, id_col, text_col, block_terms) if n else ():
        shared = spark.sparkContext.broadcast(block)
        counted = index.select("terms", "dfs").mapInArrow(frugal(_count(shared)), "term long, df long").groupBy("term").agg(F.sum("df")).collect()
        shared.unpersist()
        block.weigh(dict(map(tuple, counted)), n, total)
        weighed = spark.sparkContext.broadcast(block)
        found = index.drop("n_docs", "n_terms").mapInArrow(frugal(_search(weighed, k, to_arrow_type(kind))), f"_query long, _item {kind.simpleString()}, doc_id long, score long")
        parts.append(settle(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)))
        weighed.unpersist()
    if not parts:
        empty = spark.createDataFrame([], f"_item {kind.simpleString()}, rank int, doc_id long, score long")
        return empty.withColumnRenamed("_item", id_col)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.select(F.col("_item").alias(id_col), "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index ``docs`` (doc_id, text) in the shared folder, search it for ``items`` (item_id, text), give it back.

    Score: the sum over a query's distinct terms of w * ((10^9 tf) div (1000 tf + 8 m)),
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 10 + (90 n N) div L, for N documents
    with a term, L terms in all and n in the document. Only scores above 0 are listed.

    Null and empty texts have no term: they aren't found and, as queries, find nothing.
    Texts of any length are indexed whole. Equal scores rank by ascending doc_id, null
    ids last. Repeated documents each count and are each listed; a repeated item is
    ranked once for each of its rows. Empty tables give no rows; other columns, of any
    name, aren't looked at.
    """
    stored = Stored(build_index(docs), most=1)
    found = search(stored.df, items, k)
    stored.drop()
    return found
