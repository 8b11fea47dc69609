"""Suffix-array dedup: remove bytes of long strings that also start earlier."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import EXACT, blocks, mix64, powers, rows_bytes, span_hashes
from .common import partitions
from .cover_sort import buckets, packed, same_prefix

#: Strings of LENGTH bytes are compared. Each has WINDOW grams of LENGTH - WINDOW + 1 bytes.
LENGTH, WINDOW = 100, 64
GRAM = LENGTH - WINDOW + 1
#: Flags in the lowest bits of a place: the slice repeats itself, is settled, or (both) is one string of a hot hash.
REPEATS, SETTLED, STRING = 1, 2, 3
#: Slices of one hash from which they are dealt out string by string, by a hash of all their bytes.
HOT_SLICES = 2048
#: Bytes of slices that one suffix sort takes (or one group of slices of one key).
SORT_BYTES = 1 << 21


def segments(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of string starts with the same least gram hash: row, start, strings, hash, repeats.

    Equal strings have equal least hashes, so a string can only recur in segments
    of its own hash. ``repeats`` tells that the least gram occurs twice within a
    segment; without that, no two strings of the segment are equal.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64), np.empty(0, bool))
    up, down = powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(EXACT[data] * up[:n], dtype=np.uint64)))
    least = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    least = mix64(least)
    twice = np.zeros(len(least), bool)
    width = 1
    while width < WINDOW:
        a, b = least[:-width], least[width:]
        ta, tb = twice[:-width], twice[width:]
        twice = (a == b) | np.where(a < b, ta, tb)
        least = np.minimum(a, b)
        width *= 2
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    start = np.arange(first[-1]) - first[row]
    at = start + offsets[row]
    value, twin = least[at], twice[at]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))[: len(value)]
    cuts = np.flatnonzero(new)
    size = np.diff(np.concatenate((cuts, [len(value)])))
    repeats = (np.logical_or.reduceat(twin, cuts) if len(cuts) else twin) | (size > WINDOW)
    return row[cuts], start[cuts], size, value[cuts], repeats


def _winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _text) in order of _id -> segments. A slice that the same batch had before is
    settled here: all its strings start earlier (marked SETTLED, under a hash of its own);
    hot passages so shrink to one row for each batch before slices are shuffled."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = []
        for first, _, offsets, data in blocks(batch.column(1)):
            row, start, size, value, repeats = segments(offsets, data)
            begin = start + offsets[row]
            content = span_hashes(data, begin, begin + size + LENGTH - 1, EXACT)
            parts.append((row + first, start, size, value, repeats, content))
        row, start, size, value, repeats, content = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = batch.column(0).to_numpy(zero_copy_only=False)[row]
        order = np.lexsort((start, own, content, value))
        new = np.ones(len(row), bool)
        new[1:] = (value[order][1:] != value[order][:-1]) | (content[order][1:] != content[order][:-1]) | (size[order][1:] != size[order][:-1])
        earliest = order[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
        again = np.zeros(len(row), bool)
        again[order] = (own[order] != own[earliest]) | (start[order] != start[earliest])
        # hashes found them; bytes decide
        offsets, data = rows_bytes(batch.column(1))
        lead = np.empty(len(row), np.int64)
        lead[order] = earliest
        which = np.flatnonzero(again)
        again[which] = same_bytes(data, offsets[row[which]] + start[which], offsets[row[lead[which]]] + start[lead[which]], size[which] + LENGTH - 1)
        ids = pa.array(own)
        place = start << 32 | size << 2 | np.where(again, SETTLED, repeats)
        value = np.where(again, mix64(value + np.arange(len(value), dtype=np.uint64)), value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), ids, pa.array(place)],
            names=["_hash", "_id", "_at"],
        )


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, at_once: int = 1 << 13) -> np.ndarray:
    """Whether the ``size`` bytes from each of ``a`` are those from each of ``b``."""
    equal = np.zeros(len(a), bool)
    for low in range(0, len(a), at_once):
        part = slice(low, low + at_once)
        ends = np.cumsum(size[part])
        inner = np.arange(ends[-1]) - np.repeat(ends - size[part], size[part])
        equal[part] = np.logical_and.reduceat(data[inner + np.repeat(a[part], size[part])] == data[inner + np.repeat(b[part], size[part])], ends - size[part])
    return equal


_PLACES = mix64(np.arange(LENGTH, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


def _strings(hashes: np.ndarray, ids: np.ndarray, begin: np.ndarray, start: np.ndarray, count: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The strings of slices of hot hashes, one by one, each under a hash of its bytes.

    Those that the same batch has before are settled here, as runs.
    """
    names = ["_hash", "_id", "_at", "_slice"]
    slice_of = np.repeat(np.arange(len(begin)), count)
    inner = np.arange(len(slice_of)) - np.repeat(np.cumsum(count) - count, count)
    at, own, first = begin[slice_of] + inner, ids[slice_of], start[slice_of] + inner
    content = np.empty(len(at), np.uint64)
    for low in range(0, len(at), 1 << 14):
        part = slice(low, low + (1 << 14))
        found = data[at[part, None] + np.arange(LENGTH)]
        content[part] = mix64((EXACT[found] * _PLACES).sum(axis=1, dtype=np.uint64))
    order = np.lexsort((first, own, content))
    new = np.concatenate(([True], content[order][1:] != content[order][:-1]))
    earliest = np.empty(len(at), np.int64)
    earliest[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (own != own[earliest]) | (first != first[earliest])
    which = np.flatnonzero(later)
    later[which] = same_bytes(data, at[which], at[earliest[which]], np.full(len(which), LENGTH))
    # runs of later strings of one slice
    edge = np.flatnonzero(np.diff(np.concatenate(([0], later.astype(np.int8), [0]))))
    low, high = edge[::2], edge[1::2]
    cuts = np.flatnonzero(slice_of[1:] != slice_of[:-1]) + 1
    cuts = cuts[later[cuts] & later[cuts - 1]]
    low, high = np.sort(np.concatenate((low, cuts))), np.sort(np.concatenate((high, cuts)))
    key = mix64(hashes[slice_of[low]].view(np.uint64) + low.astype(np.uint64))
    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own[low]), pa.array(first[low] << 32 | (high - low) << 2 | SETTLED), pa.array([b""] * len(low), pa.binary())], names=names)
    kept = np.flatnonzero(~later)
    for k in (kept[a : a + (1 << 14)] for a in range(0, len(kept), 1 << 14)):
        found = np.ascontiguousarray(data[at[k, None] + np.arange(LENGTH)])
        out = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer((np.arange(len(k) + 1) * LENGTH).astype(np.int32)), pa.py_buffer(found)])
        yield pa.RecordBatch.from_arrays([pa.array(content[k].view(np.int64)), pa.array(own[k]), pa.array(first[k] << 32 | 1 << 2 | STRING), out], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _text, _list of hash, place and if hot) -> one row for each slice, or string of a hot one, with its bytes."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(2)
        offsets, data = rows_bytes(batch.column(1))
        parents = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        hashes, places = flat.field(0), flat.field(1).to_numpy(zero_copy_only=False)
        hot = np.flatnonzero(flat.field(2).to_numpy(zero_copy_only=False) & (places & 3 != SETTLED))
        if len(hot):
            count = (places[hot] >> 2) & 0x3FFFFFFF
            yield from _strings(hashes.to_numpy(zero_copy_only=False)[hot], ids.to_numpy(zero_copy_only=False)[parents[hot]], offsets[parents[hot]] + (places[hot] >> 32), places[hot] >> 32, count, data)
            cold = np.ones(len(parents), bool)
            cold[hot] = False
            cold = np.flatnonzero(cold)
            hashes, places, parents = hashes.take(pa.array(cold)), places[cold], parents[cold]
        begin = offsets[parents] + (places >> 32)
        size = np.where(places & 3 == SETTLED, 0, ((places >> 2) & 0x3FFFFFFF) + LENGTH - 1)
        for low in range(0, len(parents), 1 << 14):
            b, s = begin[low : low + (1 << 14)], size[low : low + (1 << 14)]
            ends = np.cumsum(s)
            index = np.repeat(b - (ends - s), s) + np.arange(ends[-1])
            out = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data[index])])
            part = slice(low, low + (1 << 14))
            yield pa.RecordBatch.from_arrays([hashes[part], ids.take(pa.array(parents[part])), pa.array(places[part]), out], names=["_hash", "_id", "_at", "_slice"])


def later_strings(ids: np.ndarray, starts: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of these slices, runs that also start earlier: id, start, end."""
    sizes = np.diff(offsets)
    row_end = np.repeat(offsets[1:], sizes)
    counts = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    inner = np.arange(len(row)) - first[row]
    starts_of = offsets[row] + inner
    number = np.empty(len(data), np.int64)
    number[starts_of] = np.arange(len(row))
    rank_of_id = np.unique(ids, return_inverse=True)[1].ravel()
    when = (rank_of_id[row] << 36) + starts[row] + inner
    key = packed(data)
    later = np.zeros(len(row), bool)
    for order in buckets(data, row_end, starts_of, LENGTH):
        equal = same_prefix(key, order, LENGTH)
        cuts = np.flatnonzero(~equal)
        which = number[order]
        earliest = np.minimum.reduceat(when[which], cuts)
        later[which] = when[which] != np.repeat(earliest, np.diff(np.concatenate((cuts, [len(order)]))))
    edge_low = later & ~np.concatenate(([False], later[:-1] & (row[1:] == row[:-1])))[: len(later)]
    edge_high = later & ~np.concatenate((later[1:] & (row[1:] == row[:-1]), [False]))[: len(later)]
    low, high = np.flatnonzero(edge_low), np.flatnonzero(edge_high)
    return ids[row[low]], starts[row[low]] + inner[low], starts[row[high]] + inner[high] + LENGTH


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in order of (_hash, _slice, _id, _at) -> spans of strings that start earlier.

    Equal slices are adjacent: all but the first are spans as a whole. Hashes with
    several different slices, or one that repeats itself, are gathered up to
    SORT_BYTES and their suffixes sorted.
    """
    names = ["_id", "_from", "_to"]
    held: list[tuple] = []
    held_bytes = 0
    open_group: list[tuple] = []
    last: tuple = (None, None, None, 0, 0)

    def sort_held() -> pa.RecordBatch:
        slices = [x[3] for x in held]
        data = np.frombuffer(b"".join(slices), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in slices])))
        found = later_strings(np.array([x[1] for x in held], np.int64), np.array([x[2] >> 32 for x in held], np.int64), offsets, data)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=names)

    def close() -> None:
        nonlocal held_bytes
        if len(open_group) > 1 or (open_group and open_group[0][2] & REPEATS):
            held.extend(open_group)
            held_bytes += sum(len(x[3]) for x in open_group)
        open_group.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        hashes, ids, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        slices = batch.column(3)
        offsets, data = rows_bytes(slices)
        new = np.ones(len(ids), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | ~pc.equal(slices.slice(1), slices.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        new[0] = last[0] != hashes[0] or last[1] != slices[0].as_py()
        lead = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        lead_id, lead_at = np.where(lead < 0, last[3], ids[lead]), np.where(lead < 0, last[4], places[lead])
        again = (ids != lead_id) | (places != lead_at)
        last = (hashes[-1], slices[-1].as_py(), None, lead_id[-1], lead_at[-1])
        again |= places & 3 == SETTLED
        start, whole = places >> 32, ((places >> 2) & 0x3FFFFFFF) + LENGTH - 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[again]), pa.array(start[again]), pa.array(start[again] + whole[again])], names=names)
        kept = np.flatnonzero(~again & (places & 3 != STRING))
        if not len(kept):
            continue
        # of the hashes that end within this batch, those with one plain slice need no sorting
        own = hashes[kept]
        begins = np.concatenate(([True], own[1:] != own[:-1]))
        alone = begins & np.concatenate((begins[1:], [False])) & (places[kept] & REPEATS == 0)
        if open_group and open_group[0][0] == own[0]:
            alone[0] = False
        for k in kept[~alone].tolist():
            if open_group and open_group[0][0] != hashes[k]:
                close()
                if held_bytes >= SORT_BYTES:
                    yield sort_held()
                    held.clear()
                    held_bytes = 0
            open_group.append((hashes[k], ids[k], places[k], data[offsets[k] : offsets[k + 1]].tobytes()))
    close()
    if held:
        yield sort_held()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _text, _first, _spans) -> bytes, maximal removed spans and what is left."""
    for batch in batches:
        offsets, data = rows_bytes(batch.column(1))
        firsts = batch.column(2).to_pylist()
        lists = batch.column(3)
        counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(counts)))
        flat = lists.flatten()
        low_all, high_all = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        sizes, spans, digests = [], [], []
        for i, is_first in enumerate(firsts):
            own = data[offsets[i] : offsets[i + 1]]
            runs: list[tuple[int, int]] = []
            if not is_first and len(own) >= LENGTH:
                runs = [(0, len(own))]
            elif counts[i]:
                low, high = low_all[ends[i] : ends[i + 1]], high_all[ends[i] : ends[i + 1]]
                order = np.argsort(low, kind="stable")
                low, reach = low[order], np.maximum.accumulate(high[order])
                cut = np.flatnonzero(low[1:] > reach[:-1]) + 1
                runs = list(zip(low[np.concatenate(([0], cut))].tolist(), reach[np.concatenate((cut - 1, [len(low) - 1]))].tolist(), strict=True))
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(own[at:a].tobytes())
                at = b
            digest.update(own[at:].tobytes())
            sizes.append(len(own))
            spans.append([{"start": a, "end": b} for a, b in runs])
            digests.append(digest.hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(digests, pa.string())], names=["_id", "n_bytes", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_slices: int = HOT_SLICES) -> DataFrame:
    """For each document, the bytes covered by 100-byte strings that also start earlier.

    Texts are dealt out by id once; three steps read that exchange. Byte-identical
    documents are settled first (all but the smallest id go as a whole).

    1. Winnowing marks where strings could recur: string starts are split into
       segments by their least gram hash. Only hashes met twice go on.
    2. The slices of such segments are dealt out by hash. Equal slices are adjacent
       after a sort, and all but the first are settled. Different slices of one
       hash form a small text whose suffixes are sorted by difference-cover
       blockwise construction, bucket by bucket; neighbours that agree in 100
       bytes form a class, and all but its earliest string are removed. Slices of a
       hash that has very many are dealt out string by string and sorted by Spark, which
       spills; equal ones are neighbours there.
    3. Spans are merged by document and cut out.

    Returns ``doc_id, n_bytes, spans, kept_sha256``; spans are maximal removed byte
    runs. Null text is empty. Rows without id are compared with nothing and kept
    whole. Rows that repeat id and text get one verdict each. Hashes only bring together
    what may be equal; bytes decide. Sorting in step 2 holds SORT_BYTES of slices, or
    ``hot_slices`` of one hash, and a task one Arrow batch of texts, each read whole.
    Other columns aren't looked at; an empty table gives an empty result.
    """
    n = partitions(docs.sparkSession)
    every = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    texts = every.filter("_id is not null").repartition(n, "_id")
    firsts = texts.select("_id", F.unhex(F.sha2("_text", 256)).alias("_sha")).groupBy("_sha").agg(F.min("_id").alias("_id")).select("_id").distinct()
    marked = texts.join(firsts, "_id").select("_id", "_text").mapInArrow(_winnow, "_hash long, _id long, _at long")
    counted = marked.withColumn("_n", F.count("*").over(Window.partitionBy("_hash")))
    counted = counted.filter((F.col("_n") > 1) | (F.col("_at").bitwiseAND(F.lit(REPEATS | SETTLED)) > 0))
    by_doc = counted.groupBy("_id").agg(F.collect_list(F.struct("_hash", "_at", (F.col("_n") > hot_slices).alias("_hot"))).alias("_list"))
    slices = texts.join(by_doc, "_id").select("_id", "_text", "_list").mapInArrow(_cut, "_hash long, _id long, _at long, _slice binary")
    ordered = slices.repartition(n, "_hash").sortWithinPartitions("_hash", "_slice", "_id", "_at")
    found = ordered.mapInArrow(_resolve, "_id long, _from long, _to long")
    spans = found.groupBy("_id").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))
    whole = texts.join(firsts.withColumn("_first", F.lit(True)), "_id", "left").join(spans, "_id", "left")
    rows = whole.select("_id", "_text", F.coalesce("_first", F.lit(False)).alias("_first"), "_spans")
    none = every.filter("_id is null").select("_id", "_text", F.lit(True).alias("_first"), F.lit(None).cast("array<struct<_from:long,_to:long>>").alias("_spans"))
    result = rows.unionByName(none).mapInArrow(_remove, "_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    return result.withColumnRenamed("_id", id_col)
