"""Sorting suffixes in blocks with difference-cover sample ranks, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: For any residues r, c modulo 7 some shift takes both into the cover.
PERIOD, COVER = 7, (1, 2, 4)
SHIFT = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (c + d) % PERIOD in COVER) for c in range(PERIOD)] for r in range(PERIOD)])
#: Bytes of a suffix that count for its place; suffixes in one bucket at most (or one tie group).
BUCKET = 1 << 18


def packed(text: np.ndarray) -> np.ndarray:
    """The next 8 bytes at each place, as one number in byte order."""
    wide = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(len(text), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wide[j : j + len(text)]
    return key


def dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    step = np.concatenate(([0], (keys[order][1:] != keys[order][:-1]).astype(np.int64)))
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def cover_ranks(key: np.ndarray, row_end: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes that start in the cover, by ``depth`` bytes at least.

    Their 7-byte names are ranked, then ranks of places 7, 14, 28, ... further on
    are joined on; those are in the cover too. What lies past the row's end is less
    than anything. Other places get -1.
    """
    places = np.flatnonzero(np.isin(np.arange(len(key)) % PERIOD, COVER))
    rank = np.full(len(key), -1, np.int64)
    rank[places] = dense(key[places] >> np.uint64(8))
    reach = PERIOD
    while reach < depth and len(places):
        after = places + reach
        beyond = after >= row_end[places]
        second = np.where(beyond, -1, rank[np.minimum(after, len(key) - 1)])
        top = int(rank[places].max()) + 2
        rank[places] = dense(rank[places] * top + second + 1)
        reach *= 2
    return rank


def buckets(text: np.ndarray, row_end: np.ndarray, starts: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """``starts`` in suffix order, one bucket of suffixes at a time.

    ``row_end`` has the end of its row for each place of ``text``; suffixes in
    ``starts`` have ``depth`` bytes within their row. The first 8 bytes deal the
    suffixes into tie groups. Within those, a suffix's place is the number of
    smaller ones, counted by residue class: both suffixes are shifted into the
    cover, where ranks are known. Suffixes alike in ``depth`` bytes stay adjacent.
    """
    key = packed(text)
    rank = cover_ranks(key, row_end, depth)
    top = int(rank.max(initial=0)) + 2
    order = starts[np.argsort(key[starts], kind="stable")]
    heads = key[order]
    group = np.cumsum(np.concatenate(([0], (heads[1:] != heads[:-1]).astype(np.int64))))
    cut = 0
    while cut < len(order):
        end = len(order) if cut + BUCKET >= len(order) else int(np.searchsorted(group, group[cut + BUCKET], "left"))
        if end <= cut:
            end = int(np.searchsorted(group, group[cut], "right"))
        yield _sort_bucket(order[cut:end], group[cut:end] - group[cut], rank, top)
        cut = end


def _sort_bucket(places: np.ndarray, group: np.ndarray, rank: np.ndarray, top: int) -> np.ndarray:
    size = np.bincount(group)
    tied = size[group] > 1
    smaller = np.zeros(len(places), np.int64)
    at, own_group = places[tied], group[tied]
    residue = at % PERIOD
    members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    count = np.zeros(len(at), np.int64)
    for c in range(PERIOD):
        if not len(members[c]):
            continue
        begin = np.searchsorted(own_group[members[c]], own_group)
        for shift in np.unique(SHIFT[:, c]):
            keys = np.sort(own_group[members[c]] * top + rank[at[members[c]] + shift])
            for r in np.flatnonzero(SHIFT[:, c] == shift):
                mine = members[r]
                count[mine] += np.searchsorted(keys, own_group[mine] * top + rank[at[mine] + shift]) - begin[mine]
    smaller[tied] = count
    return places[np.argsort(group * (len(places) + 1) + smaller, kind="stable")]


def same_prefix(key: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix of ``order`` agrees with the one before it in ``depth`` bytes."""
    equal = np.ones(len(order), bool)
    equal[:1] = False
    steps = [*range(0, depth - 7, 8), depth - 8]
    for step in steps:
        here = key[order + step]
        equal[1:] &= here[1:] == here[:-1]
    return equal
