"""Line dedup by an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, SPACE, blocks, gram_hashes, mix64, span_hashes, word_bounds
from .common import Stored, frugal, partitions

#: Lines are sets of words or of word pairs (of their only word, if one), alike from NUM / DEN on.
NUM, DEN, WORD, PAIR = 85, 100, 1, 2
#: Sets of fewer tokens are only like equal ones, as one token more or less is below NUM / DEN.
SMALLEST = -(-NUM // (DEN - NUM))
#: Slots of the table of word counts: one byte each is broadcast, whatever the input. They are summed in parts.
SLOTS, PARTS = 1 << 22, 64
#: Levels (see ``word_rarity``) of words that occur once, and of words that are keys only two by two.
ONCE, FREQUENT = 8, 80
#: Sets of so many tokens have two more words of parities, and columns of records.
LONG, COLUMNS = 64, 7
#: Bits of the table that tells which lines' texts are needed, whatever the input.
NEED_BITS = 1 << 26
#: Likest earlier lines of each line and key that are tried first; the rest is looked up only if they fail.
KEPT = 3
#: Records of a bucket that are looked for, and pairs held before they are cut to KEPT.
BUCKET, HELD = 1_500_000, 4_000_000
#: Pairs of lines in doubt that leave a task at once.
TOLD = 100_000
LOWER_TABLE = LOWER.tobytes()


def required(total: np.ndarray) -> np.ndarray:
    """What two sets must share at least, by the sum of their sizes."""
    return -(-NUM * total // (NUM + DEN))


def line_cuts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and first byte of each line of a block."""
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1))
    starts = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((starts, row))
    row, starts = row[order], starts[order]
    new = np.concatenate(([True], row[1:] != row[:-1]))
    return row, np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)), starts


def line_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block: row and line number of each line with words, its first words (n + 1), and all word hashes."""
    starts, ends, _ = word_bounds(offsets, data, SPACE)
    row, line, cuts = line_cuts(offsets, data)
    first = np.append(np.searchsorted(starts, cuts), len(starts))
    held = np.flatnonzero(np.diff(first))
    return row[held], line[held], np.append(first[held], len(starts)), span_hashes(data, starts, ends)


def line_tokens(words: np.ndarray, first: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their lines, and the place of the first word of each."""
    grams, gram_first = gram_hashes(words, first, gram) if gram > 1 else (words, first)
    which = np.repeat(np.arange(len(first) - 1), np.diff(gram_first))
    return grams, which, np.arange(len(grams)) - gram_first[which] + first[which]


def in_order(grams: np.ndarray, which: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Where the distinct tokens of each line stand, by line, level and hash."""
    if not len(grams):
        return np.zeros(0, np.int64)
    bits = int(which[-1]).bit_length()
    # one sort of a packed key; where unlike hashes are cut to the same key, a full one
    key = (which.astype(np.uint64) << np.uint64(63 - bits) << np.uint64(1)) if bits else np.zeros(len(which), np.uint64)
    key |= (level.astype(np.uint64) << np.uint64(56 - bits)) | (grams >> np.uint64(bits + 8))
    order = np.argsort(key)
    same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    own = grams[order]
    if (same[1:] & (own[1:] != own[:-1])).any():
        order = np.lexsort((grams, level, which))
        own, line = grams[order], which[order]
        same = np.concatenate(([False], (own[1:] == own[:-1]) & (line[1:] == line[:-1])))
    return order[~same]


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, any_words = np.zeros(SLOTS, np.int64), False
    for batch in batches:
        for _, _, offsets, data in blocks(batch.column(0)):
            starts, ends, _ = word_bounds(offsets, data, SPACE)
            np.add.at(counts, _slots(span_hashes(data, starts, ends)), 1)
            any_words = any_words or len(starts) > 0
    if any_words:
        parts = counts.reshape(PARTS, -1)
        blobs = [pack(p[None, :]) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int64()), pa.array(blobs, pa.binary())], names=["_part", "_blob"])


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the same part, summed; then eight times their binary logarithm in a byte."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = unpack(blob.as_buffer(), 1, SLOTS // PARTS)[0]
            sums[part] = sums[part] + counts if part in sums else counts
    if sums:
        levels = [np.minimum(np.round(np.log2(c + 1.0) * 8), 255).astype(np.uint8).tobytes() for c in sums.values()]
        totals = [int(c.sum()) for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(totals, pa.int64()), pa.array(levels, pa.binary())], names=["_part", "_total", "_levels"])


def word_rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Eight times the binary logarithm of the count of each slot's words, in a byte; and all words.

    Slots are shared by words, so a level is that of a word's count or above.
    """
    counts = docs.select("_text").mapInArrow(frugal(_count), "_part long, _blob binary")
    found = counts.repartition(PARTS, "_part").mapInArrow(_sum_parts, "_part long, _total long, _levels binary").toArrow()
    table = np.zeros((PARTS, SLOTS // PARTS), np.uint8)
    for part, levels in zip(found.column(0).to_pylist(), found.column(2).to_pylist(), strict=True):
        table[part] = np.frombuffer(levels, np.uint8)
    return table.reshape(-1), sum(found.column(1).to_pylist())


def pack(columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, byte by byte plane and compressed."""
    planes = np.ascontiguousarray(columns.astype(np.int64)).view(np.uint8).reshape(*columns.shape, 8).transpose(0, 2, 1)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob, columns: int, rows: int) -> np.ndarray:
    raw = pa.decompress(blob, decompressed_size=columns * rows * 8, codec="zstd")
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, rows)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def _line_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(mix64(doc.astype(np.uint64)) + line.astype(np.uint64))


def _needs(table: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    at = (_line_hash(doc, line) & np.uint64(NEED_BITS - 1)).astype(np.int64)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _records(grams: np.ndarray, which: np.ndarray, level: np.ndarray, sizes: np.ndarray, dig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, lines and places of what is dealt out of a block's lines: distinct tokens in order.

    A line's keys are the tokens of its prefix that occur more than once; frequent
    ones are keys two by two, of the prefix that is one longer: alike lines share two
    tokens of it, and one of those that aren't frequent is in both shorter prefixes,
    as it comes before the frequent ones.
    """
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(grams)) - begin[which]
    long = sizes[which] >= SMALLEST
    prefix = (sizes - -(-NUM * sizes // DEN) + 1)[which]
    single = np.flatnonzero(long & (place < prefix) & (level > ONCE) & (level < FREQUENT))
    found = [(mix64(grams[single]), which[single], place[single])]
    often = long & (place <= prefix) & (level >= FREQUENT)
    at, step = np.flatnonzero(often), 1
    while len(at):
        at = at[at + step < len(grams)]
        at = at[often[at + step] & (which[at + step] == which[at])]
        found.append((mix64(grams[at] * np.uint64(3) + mix64(grams[at + step])), which[at], place[at]))
        step += 1
    short = np.flatnonzero(sizes < SMALLEST)
    found.append((mix64(dig[short]), short, np.zeros(len(short), np.int64)))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _deal(shared, gram: int, buckets: int):
    """(_doc, _text) -> packed records of each bucket of keys: key, three words of parities, digest and
    line, document, size, place and whether it is the line's first. A line whose set an earlier one of the batch has
    is settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            parts, shift = [], 0
            for first_row, _, offsets, data in blocks(batch.column(1)):
                row, line, first, words = line_words(offsets, data)
                if not len(row):
                    continue
                grams, which, at = line_tokens(words, first, gram)
                level = rarity[_slots(words)]
                if gram == PAIR:
                    level = np.minimum(level, np.append(level[1:], level[-1:]))
                level = level[at]
                order = in_order(grams, which, level)
                grams, which, level = grams[order], which[order], level[order]
                sizes = np.bincount(which, minlength=len(row))
                begin = np.cumsum(sizes) - sizes
                hashed = mix64(grams ^ np.uint64(5))
                parity = np.zeros((3, len(sizes)), np.uint64)
                parity[0] = np.bitwise_xor.reduceat(np.uint64(1) << (hashed >> np.uint64(58)), begin)
                long = sizes >= LONG
                if long.any():
                    hashed, starts = hashed[long[which]], np.cumsum(sizes[long]) - sizes[long]
                    for i in (1, 2):
                        parity[i, long] = np.bitwise_xor.reduceat(np.uint64(1) << (hashed << np.uint64(6 * i) >> np.uint64(58)), starts)
                dig = np.add.reduceat(mix64(grams ^ np.uint64(17)), begin)
                key, owner, place = _records(grams, which, level, sizes, dig)
                parts.append((docs[row + first_row], line, sizes, dig, parity, key, owner + shift, place))
                shift += len(row)
            if not parts:
                continue
            doc, line, sizes, dig, parity, key, owner, place = (np.concatenate([p[i] for p in parts], axis=-1) for i in range(8))
            order = np.lexsort((line, doc, sizes, parity[0], dig))
            new = np.ones(len(order), bool)
            new[1:] = (dig[order][1:] != dig[order][:-1]) | (parity[0, order][1:] != parity[0, order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            live = np.zeros(len(order), bool)
            live[order[new]] = True
            gone = order[(doc[order] != doc[lead]) | (line[order] != line[lead])]
            kept = live[owner]
            key, owner, place = key[kept] >> np.uint64(16), owner[kept], place[kept]
            head = np.zeros(len(owner), np.int64)
            head[np.unique(owner, return_index=True)[1]] = 1
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, owner, place, head = key[order], owner[order], place[order], head[order]
            table = np.stack([key.view(np.int64), *parity[:, owner].view(np.int64), (dig[owner] >> np.uint64(32) << np.uint64(32)).view(np.int64) | line[owner], doc[owner], sizes[owner] << 32 | place << 1 | head])
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            rows = [(b, int(cuts[b + 1] - cuts[b]), pack(table[:, cuts[b] : cuts[b + 1]])) for b in used.tolist()]
            if len(gone):
                rows.append((int(gone[0]) % buckets, -len(gone), pack(np.stack([doc[gone], line[gone]]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["_bucket", "_n", "_blob"])

    return run


FOUND = "_doc long, _line long, _odoc long, _oline long, _more boolean, _n long, _blob binary"


def _found(doc=(), line=(), odoc=None, oline=None, more=None, records=None) -> pa.RecordBatch:
    """Settled lines, or pairs, with ``_more`` where there are more than are kept; or records of keys with such."""
    n = len(doc) if records is None else 1
    longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in ((doc, line, odoc, oline) if records is None else (None,) * 4)]
    more = pa.array(np.zeros(n, bool) if more is None else more)
    size, blob = ([None] * n, [None] * n) if records is None else ([records.shape[1]], [pack(records)])
    return pa.RecordBatch.from_arrays([*longs, more, pa.array(size, pa.int64()), pa.array(blob, pa.binary())], names=[c.split()[0] for c in FOUND.split(", ")])


def _likest(held: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """Of pairs (later, earlier, bits apart, key, more) the KEPT of each line and key with fewest
    bits apart; ``more`` of the first of them tells that others were left out."""
    if not held:
        return []
    late, early, apart, key, more = (np.concatenate([h[i] for h in held]) for i in range(5))
    order = np.lexsort((early, apart, key, late))
    late, early, apart, key, more = late[order], early[order], apart[order], key[order], more[order]
    begin = np.flatnonzero(np.concatenate(([True], (late[1:] != late[:-1]) | (key[1:] != key[:-1])))[: len(late)])
    at = np.arange(len(late)) - np.repeat(begin, np.diff(np.append(begin, len(late))))
    left_out = np.maximum.reduceat(more | (at >= KEPT), begin) if len(begin) else more
    more = np.zeros(len(late), bool)
    more[begin] = left_out
    kept = at < KEPT
    return [(late[kept], early[kept], apart[kept], key[kept], more[kept])]


def _once(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records of a key with equal sets the earliest, all in order of key and size; and the lines of the others."""
    key, parity, _, _, tail, doc, size = records
    # one sort by key and size; only where these are the same, one by all the rest
    both = (key << 16) + np.minimum(size >> 32, 0xFFFF)
    order = np.argsort(both)
    same = both[order][1:] == both[order][:-1]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    own = order[tied]
    order[tied] = own[np.lexsort((tail[own] & 0xFFFFFFFF, doc[own], tail[own] >> 32, parity[own], size[own] >> 32, both[own]))]
    records = records[:, order]
    key, parity, _, _, tail, doc, size = records
    same = np.zeros(len(order), bool)
    same[1:] = (key[1:] == key[:-1]) & (parity[1:] == parity[:-1]) & (tail[1:] >> 32 == tail[:-1] >> 32) & (size[1:] >> 32 == size[:-1] >> 32)
    line = tail & 0xFFFFFFFF
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    gone = np.flatnonzero(same & (size & 1 == 1) & ((doc != doc[lead]) | (line != line[lead])))
    return records[:, ~same], doc[gone], line[gone]


def _close(records: np.ndarray, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of pairs of records that may be alike, and how many bits they are apart.

    With the positional filter goes one of parities: each token that only one of two
    sets has turns one of 64 bits (of each of three words in LONG sets), so more bits
    than the sets may differ in tell them apart.
    """
    parity, doc, line = records[1:4].view(np.uint64), records[5], records[4] & 0xFFFFFFFF
    left, right = records[6, at], records[6, other]
    total = (left >> 32) + (right >> 32)
    need = required(total)
    fits = np.minimum((left >> 32) - ((left >> 1) & 0x7FFFFFFF), (right >> 32) - ((right >> 1) & 0x7FFFFFFF)) >= need
    a, b, limit = at[fits], other[fits], (total - 2 * need)[fits]
    apart = np.bitwise_count(parity[0, a] ^ parity[0, b]).astype(np.int64)
    close = apart <= limit
    a, b, limit, apart = a[close], b[close], limit[close], apart[close]
    long = np.flatnonzero(np.minimum(records[6, a], records[6, b]) >> 32 >= LONG)
    far = apart.copy()
    far[long] = np.bitwise_count(parity[:, a[long]] ^ parity[:, b[long]]).max(axis=0)
    close = (far <= limit) & ((doc[a] != doc[b]) | (line[a] != line[b]))
    return a[close], b[close], apart[close]


def _pairs(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of a line and an earlier one that may be alike, of a bucket's records as ``_once`` orders them.

    Records of a key are in order of size, so that the length filter ends the search.
    """
    key, doc, line, size = records[0], records[5], records[4] & 0xFFFFFFFF, records[6] >> 32
    at, step, held, n_held = np.arange(len(key)), 1, [], 0
    while len(at):
        at = at[at >= step]
        near = (key[at] == key[at - step]) & (size[at - step] * DEN >= size[at] * NUM)
        at = at[near]
        a, b, apart = _close(records, at, at - step)
        swap = (doc[a] < doc[b]) | ((doc[a] == doc[b]) & (line[a] < line[b]))
        late, early = np.where(swap, b, a), np.where(swap, a, b)
        step += 1
        if len(late):
            held.append((late, early, apart, key[late], np.zeros(len(late), bool)))
            n_held += len(late)
            if n_held > HELD:
                held = _likest(held)
                n_held = len(held[0][0]) if len(held[0][0]) < HELD // 2 else 0
    for late, early, _, own, more in _likest(held):
        yield _found(doc[late], line[late], doc[early], line[early], more)
        if more.any():
            yield _found(records=records[:, np.isin(key, own[more])])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (_bucket, _n, _blob) -> FOUND. Records of equal sets are folded as they come in."""
    open_bucket, held, n_held = None, [], 0

    def fold() -> tuple[list, list]:
        records, doc, line = _once(np.concatenate(held, axis=1))
        return [records], [_found(doc, line)] if len(doc) else []

    for batch in batches:
        for bucket, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if bucket != open_bucket:
                if held:
                    held, out = fold()
                    yield from out
                    yield from _pairs(held[0])
                open_bucket, held, n_held = bucket, [], 0
            if n < 0:
                yield _found(*unpack(blob.as_buffer(), 2, -n))
                continue
            held.append(unpack(blob.as_buffer(), COLUMNS, n))
            n_held += n
            if n_held > 2 * BUCKET:
                held, out = fold()
                yield from out
                n_held = min(held[0].shape[1], BUCKET)
    if held:
        held, out = fold()
        yield from out
        yield from _pairs(held[0])


def _pairs_of(records: np.ndarray, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the ``asking`` records with earlier lines: only these look about in their keys, either way from their size."""
    key, doc, line, size = records[0], records[5], records[4] & 0xFFFFFFFF, records[6] >> 32
    for way in (-1, 1):
        at, step = asking, 1
        while len(at):
            at = at[(at + way * step >= 0) & (at + way * step < len(key))]
            other = at + way * step
            small, large = (other, at) if way < 0 else (at, other)
            near = (key[at] == key[other]) & (size[small] * DEN >= size[large] * NUM)
            at, other = at[near], other[near]
            step += 1
            earlier = (doc[other] < doc[at]) | ((doc[other] == doc[at]) & (line[other] < line[at]))
            late, early, _ = _close(records, at[earlier], other[earlier])
            if len(late):
                yield late, early


def _all_pairs(exact):
    """(_n, _blob) of keys with more pairs -> FOUND, all pairs of the lines that ``exact`` tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                records = unpack(blob.as_buffer(), COLUMNS, n)
                doc, line = records[5], records[4] & 0xFFFFFFFF
                for late, early in _pairs_of(records, np.flatnonzero(_needs(exact.value, doc, line))):
                    held.append((doc[late], line[late], doc[early], line[early]))
                    n_held += len(late)
                    if n_held >= TOLD:
                        yield _found(*map(np.concatenate, zip(*held, strict=True)))
                        held, n_held = [], 0
        if held:
            yield _found(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _record_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            records = unpack(blob.as_buffer(), COLUMNS, n)
            yield pa.RecordBatch.from_arrays([pa.array(records[5]), pa.array(records[4] & 0xFFFFFFFF)], names=["_doc", "_line"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_doc, _line) -> words of the table of NEED_BITS bits, and their bits."""
    for batch in batches:
        doc, line = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        at = np.unique((_line_hash(doc, line) & np.uint64(NEED_BITS - 1)).astype(np.int64))
        word, first = np.unique(at >> 6, return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["_word", "_bits"])


def bit_table(lines: DataFrame) -> np.ndarray:
    """A table of NEED_BITS bits with one set for each (_doc, _line)."""
    found = lines.mapInArrow(_bits, "_word long, _bits long").groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).toArrow()
    table = np.zeros(NEED_BITS // 64, np.uint64)
    table[np.asarray(found.column(0), np.int64)] = np.asarray(found.column(1), np.int64).view(np.uint64)
    return table


def _lines(shared):
    """(_doc, _text) -> the lines whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, offsets, data in blocks(batch.column(1)):
                row, line, starts = line_cuts(offsets, data)
                ends = np.append(starts[1:] - 1, offsets[-1])
                ends = np.where(np.append(row[1:] != row[:-1], True), offsets[row + 1], ends)
                hit = np.flatnonzero(_needs(shared.value, docs[first + row], line))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[first + row[hit]], pa.int64()), pa.array(line[hit]), pa.array(texts, pa.binary())], names=["_doc", "_line", "_text"])

    return run


def token_set(line: bytes, gram: int) -> frozenset:
    words = line.translate(LOWER_TABLE).split()
    return frozenset(zip(words, words[1:], strict=False)) if gram == PAIR and len(words) > 1 else frozenset(words)


def _verify(gram: int):
    """(_doc, _line, _text, _otext) -> the lines whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = token_set(x, gram), token_set(y, gram)
                both = len(x & y)
                good.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["_doc", "_line"]).filter(pa.array(good, pa.bool_()))

    return run


def alike(lines: DataFrame, pairs: DataFrame, gram: int) -> DataFrame:
    """The (_doc, _line) of pairs that are like their partner, by the texts of lines."""
    other = lines.select(F.col("_doc").alias("_odoc"), F.col("_line").alias("_oline"), F.col("_text").alias("_otext"))
    rows = pairs.select("_doc", "_line", "_odoc", "_oline").distinct().join(lines, ["_doc", "_line"]).join(other, ["_odoc", "_oline"])
    return rows.select("_doc", "_line", "_text", "_otext").mapInArrow(frugal(_verify(gram)), "_doc long, _line long").distinct()


def _share(table: np.ndarray, df: DataFrame):
    return df.sparkSession.sparkContext.broadcast(table)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = PAIR) -> DataFrame:
    """Lines that are like an earlier one: Jaccard of their distinct tokens of at least NUM / DEN.

    Tokens are words (``gram`` is WORD), so that order and repeats don't count, or word pairs.

    Earlier means a smaller id, or the same id and a smaller line number; lines are
    judged on the input, not on what is left. Words are parted by white space and
    lower-cased A-Z.

    1. Word counts (a table of fixed size) order the tokens of a line by rarity.
    2. The keys of a line are the tokens of its prefix: as many of its rarest as two
       alike lines can't both miss. Tokens that occur once are no keys, frequent ones
       are keys only two by two. Records of keys are dealt to buckets as packed arrays;
       lines of equal sets (size, 32 bits of a sum and 64 of parities of hashes, beside
       the key) are settled there.
    3. Within a key, length, positional and parity filters leave pairs. Each line's
       KEPT likest earlier ones of a key are verified on the words of their texts; only
       lines that need it are read out of the documents. This spares the pairs of large
       groups of alike lines.
    4. Where a key had more for a line and none was like it, the line is held against
       all earlier ones of the key; records of such keys were kept aside.

    Returns ``doc_id, n_lines, removed`` for each row, the removed line numbers from
    0, sorted. Null text has one empty line. Lines without words stay. Rows without
    id are compared with nothing; rows that repeat an id share its removed lines.
    Of equal lines all but the earliest go. Texts are cut into lines within their
    Arrow batch, so the longest text bounds memory. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    every = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = every.filter("_doc is not null")
    rarity, n_words = word_rarity(texts)
    shared = _share(rarity, texts)
    buckets = max(4 * partitions(spark), n_words // (4 * BUCKET))

    dealt = texts.mapInArrow(frugal(_deal(shared, gram, buckets)), "_bucket long, _n long, _blob binary")
    dealt = dealt.repartition(max(partitions(spark), buckets // 4), "_bucket").sortWithinPartitions("_bucket")
    found = Stored(dealt.mapInArrow(frugal(_candidates), FOUND))
    both = ["_doc", "_line"]
    pairs, records = found.df.filter("_odoc is not null"), found.df.filter("_n is not null").select("_n", "_blob")
    needed = pairs.select(*both).union(pairs.select("_odoc", "_oline")).union(records.mapInArrow(_record_lines, "_doc long, _line long"))
    lines = Stored(texts.mapInArrow(frugal(_lines(_share(bit_table(needed), texts))), "_doc long, _line long, _text binary"))
    steps = [found, lines, Stored(alike(lines.df, pairs, gram))]
    gone = found.df.filter("_doc is not null and _odoc is null").select(*both).union(steps[-1].df)
    undecided = Stored(pairs.filter("_more").select(*both).distinct().join(gone, both, "left_anti"))
    steps.append(undecided)
    if not undecided.df.isEmpty():
        rest = records.mapInArrow(_all_pairs(_share(bit_table(undecided.df), texts)), FOUND).join(undecided.df, both, "left_semi")
        steps.append(Stored(alike(lines.df, rest, gram)))
        gone = gone.union(steps[-1].df)
    by_doc = gone.groupBy("_doc").agg(F.array_sort(F.collect_set("_line")).alias("removed"))
    result = Stored(by_doc)
    for step in steps:
        step.drop()
    counts = every.select("_doc", (F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    return counts.join(result.df, "_doc", "left").select(F.col("_doc").alias(id_col), "n_lines", F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))


def drop_lines(text: Column, removed: Column) -> Column:
    """A text without the lines of the given numbers."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed, i.cast("long"))), "\n")
