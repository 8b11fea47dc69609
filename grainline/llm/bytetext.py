"""Whole-batch work on UTF-8 bytes with numpy: words and hashes without a loop over words.

All separators here are ASCII, so words of UTF-8 text can be cut byte-wise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INVERSE = pow(_MULT, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes that part words: white space, and everything ASCII but letters and digits.
SPACE = byte_set(b" \t\n\x0b\x0c\r")
NOT_ALNUM = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUE = mix64(LOWER.astype(np.uint64) + np.uint64(1 << 32))
#: Values that tell all bytes apart, for work on exact bytes.
EXACT = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 << 33))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n, BLOCK) + 1
        for key, base in (("up", _MULT), ("down", _MULT_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def rows_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None:
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], found[offsets[0] : offsets[-1]]


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, offsets, bytes."""
    offsets, data = rows_bytes(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, offsets[first : end + 1] - offsets[first], data[offsets[first] : offsets[end]]
        first = end


def word_bounds(offsets: np.ndarray, data: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a block, and the first word of each row (n + 1)."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE_VALUE) -> np.ndarray:
    """64-bit hashes of byte spans, from one running sum; lower-cased (A-Z) but with EXACT."""
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words within rows, and the first n-gram of each row.

    A row of fewer words, but not none, gives its whole sequence as one n-gram.
    """
    counts = np.diff(first)
    per_row = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    gram_first = np.concatenate(([0], np.cumsum(per_row)))
    grams = np.empty(gram_first[-1], np.uint64)
    if not len(grams):
        return grams, gram_first
    factors = mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000)) | np.uint64(1)
    row = np.repeat(np.arange(len(counts)), per_row)
    at = np.arange(len(grams)) - gram_first[row] + first[row]
    total = np.zeros(len(grams), np.uint64)
    last = len(words) - 1
    room = first[row + 1] - at
    for k in range(n):
        here = words[np.minimum(at + k, last)] * factors[k]
        total += here if counts.min() >= n else np.where(k < room, here, np.uint64(0))
    total += np.where(room >= n, np.uint64(n), room.astype(np.uint64))
    return mix64(total), gram_first
