"""Benchmark decontamination with an FM-index per training shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import NOT_ALNUM, blocks, span_hashes, word_bounds
from .common import Stored, unpacked, wrapped
from .fm_index import FMIndex

#: Words of benchmark text in one phrase block: bounds what is sent to executors at once.
BLOCK_WORDS = 2_000_000
#: Bytes of documents in one shard.
SHARD_BYTES = 1 << 23
FOUND = "_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


class Phrases:
    """All windows of a block of benchmark items, over their own vocabulary."""

    def __init__(self, items: list[tuple[str, np.ndarray]], size: int):
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.empty(0, np.uint64)
        self.mask = (1 << max(16, len(self.vocabulary).bit_length() + 5)) - 1
        self.seen = np.zeros(self.mask + 1, bool)
        self.seen[(self.vocabulary & np.uint64(self.mask)).astype(np.int64)] = True
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        by_length: dict[int, list] = {}
        for name, words in items:
            symbols = np.searchsorted(self.vocabulary, words) + 1
            length = min(size, len(words))
            rows = np.lib.stride_tricks.sliding_window_view(symbols, length)
            by_length.setdefault(length, []).append((rows, np.full(len(rows), number[name])))
        #: length -> distinct windows, and item numbers grouped by window
        self.windows = {}
        for length, found in by_length.items():
            rows, owner = np.concatenate([r for r, _ in found]), np.concatenate([o for _, o in found])
            distinct, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
            first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
            self.windows[length] = distinct, pairs[:, 1], first
        self.shortest = min(self.windows, default=1)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words that no phrase has."""
        result = np.zeros(len(words), np.int64)
        maybe = np.flatnonzero(self.seen[(words & np.uint64(self.mask)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
            result[maybe] = np.where(self.vocabulary[at] == words[maybe], at + 1, 0)
        return result


def shard_text(symbols: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The text to index, and for each of its places the word it comes from.

    Words outside the phrase vocabulary end a run, as row ends do. A run shorter
    than the shortest window can't hold an occurrence and isn't indexed.
    """
    inside = symbols > 0
    edge = np.zeros(len(symbols) + 1, bool)
    edge[first] = True
    before = np.concatenate(([False], inside[:-1]))[: len(inside)]
    after = np.concatenate((inside[1:], [False]))[: len(inside)]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    long = ends - starts >= shortest
    starts, sizes = starts[long], (ends - starts)[long] + 1
    total = int(sizes.sum())
    origin = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    text = symbols[np.minimum(origin, len(symbols) - 1)] if total else np.zeros(0, np.int64)
    text[np.cumsum(sizes) - 1] = 0
    return text, origin


def occurrences(symbols: np.ndarray, first: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Word places of all window occurrences in a shard: places, length, window numbers."""
    if not phrases.windows:
        return
    text, origin = shard_text(symbols, first, phrases.shortest)
    if not len(text):
        return
    index = FMIndex(text, len(phrases.vocabulary))
    for length, (windows, _, _) in phrases.windows.items():
        low, high = index.search(windows)
        sizes = high - low
        which = np.repeat(np.arange(len(windows)), sizes)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        for at in range(0, len(rows), 1 << 20):
            yield origin[index.locate(rows[at : at + (1 << 20)])], length, which[at : at + (1 << 20)]


def _scan(shared, known: bool, carry: bool):
    """(_id, text[, spans, items of earlier blocks]) -> FOUND with those of a block added, and the text if ``carry``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high, _, _ in blocks(whole.column(1), SHARD_BYTES):
                yield _scan_shard(whole.slice(low, high - low), shared.value if shared else None, known, carry)

    return run


def _scan_shard(batch: pa.RecordBatch, phrases: Phrases | None, known: bool, carry: bool) -> pa.RecordBatch:
    words, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, _, offsets, data in blocks(batch.column(1)):
        starts, ends, first = word_bounds(offsets, data, NOT_ALNUM)
        words.append(span_hashes(data, starts, ends))
        counts.append(np.diff(first))
    words, counts = np.concatenate(words), np.concatenate(counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    cover = np.zeros(len(words) + 1, np.int32)
    items: list[set] = [set() for _ in counts]
    if known:
        old, lists = batch.column(2), batch.column(3).to_pylist()
        base = first[pc.list_parent_indices(old).to_numpy(zero_copy_only=False)]
        for name, step in (("start", 1), ("end", -1)):
            np.add.at(cover, base + old.flatten().field(name).to_numpy(zero_copy_only=False), step)
        items = [set(x) for x in lists]
    for places, length, which in occurrences(phrases.symbols(words), first, phrases) if phrases else ():
        np.add.at(cover, places, 1)
        np.add.at(cover, places + length, -1)
        row = np.searchsorted(first, places, "right") - 1
        _, owners, start = phrases.windows[length]
        for r, w in np.unique(np.stack([row, which], 1), axis=0):
            items[r].update(phrases.names[k] for k in owners[start[w] : start[w + 1]])
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.zeros(len(words) + 1, bool)
    edge[first] = True
    before = np.concatenate(([False], hit[:-1]))[: len(hit)]
    after = np.concatenate((hit[1:], [False]))[: len(hit)]
    begins = np.flatnonzero(hit & (~before | edge[:-1]))
    stops = np.flatnonzero(hit & (~after | edge[1:])) + 1
    row = np.searchsorted(first, begins, "right") - 1
    span_first = np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(span_first), pa.StructArray.from_arrays([pa.array(begins - first[row]), pa.array(stops - first[row])], ["start", "end"]))
    found = [spans, pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
    if carry:
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *found], names=["_id", "text", "spans", "items"])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *found], names=["_id", "n_words", "spans", "items"])


def phrase_blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[Phrases]:
    """Blocks of at most ``most`` benchmark words (or one item), one at a time."""
    held, n = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").filter("text is not null").toLocalIterator():
        for _, _, offsets, data in blocks(pa.array([row[1]])):
            starts, ends, _ = word_bounds(offsets, data, NOT_ALNUM)
            if len(starts):
                held.append((row[0], span_hashes(data, starts, ends)))
                n += len(starts)
        if n >= most:
            yield Phrases(held, size)
            held, n = [], 0
    if held:
        yield Phrases(held, size)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where documents hold ``size`` consecutive words of a benchmark item.

    Words are runs of letters and digits (and all non-ASCII), lower-cased A-Z. A
    shorter item is one window. Each SHARD_BYTES of an Arrow batch of documents (or
    one longer text) are a shard: its words become symbols of the phrase vocabulary, an
    FM-index is built over them, all windows are searched backward through wavelet-tree
    ranks, their occurrences located by sampled suffix positions and merged into
    word spans. A benchmark beyond ``block_words`` is searched block by block: the
    driver and a task hold one block, and documents are written between two.

    Returns ``doc_id, n_words, spans, items`` for each row; spans are maximal
    [start, end) runs of hit words, items the sorted ids whose windows occur. Null
    and empty texts have no words; a null item id reads 'null'; items sharing an id
    are one. Words are told by 64-bit hashes. No shuffle takes place; rows may repeat,
    and other columns aren't looked at.
    """
    spark = docs.sparkSession
    rows, written = docs.select(F.col("doc_id").cast("long").alias("_id"), "text"), None
    found = phrase_blocks(benchmark, size, block_words)
    block = next(found, None)
    while True:
        after = next(found, None)
        shared = spark.sparkContext.broadcast(block) if block else None
        if after is None:
            return rows.mapInArrow(_scan(shared, written is not None, False), FOUND).withColumnRenamed("_id", "doc_id")
        stored = Stored(rows.mapInArrow(_scan(shared, written is not None, True), FOUND.replace("n_words long", "text string")))
        shared.unpersist()
        if written is not None:
            written.drop()
        rows, written, block = stored.df, stored, after


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without a hit word, with all their columns."""
    clean = contamination(docs, benchmark, size).filter(F.size("spans") == 0).select(F.col("doc_id").alias("_clean")).distinct()
    rows = wrapped(docs, {"_own": F.col("doc_id")})
    return unpacked(rows.join(clean, F.col("_own").eqNullSafe(F.col("_clean")), "left_semi"))
