"""Two readings of a page aligned: lines of one found in the text of the other, letter by letter or by like words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What counts as a word, dashes at line ends, how short a line is found letter by letter,
# how much of a line and how like it a window has to be, and how many words longer or shorter it may be.
WORD = re.compile(r"[\w@.+%-]+")
DASHES = "-‐‑‒–—"
SHORTEST, LIKE, SLACK = 4, 0.65, 2
#: Pages that are read at once.
PAGES = 256
SPAN = "line_no int, start int, end int, how string, ratio double"


class _Folded(dict):
    """What a character is as letters, by its number: case folded, and nothing if it is neither letter nor digit."""

    def __missing__(self, number: int) -> str:
        c = chr(number)
        self[number] = folded = c.casefold() if c.isalnum() else ""
        return folded


FOLDED = _Folded()


def letters(text: str) -> tuple[str, np.ndarray]:
    """Letters and digits, case folded, and where each stands in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known, which = np.unique(codes, return_inverse=True)
    size = np.array([len(FOLDED[c]) for c in known.tolist()], np.int64)
    return text.translate(FOLDED), np.repeat(np.arange(len(codes)), size[which])


def words(text: str) -> list[tuple[str, int, int]]:
    """Words of two characters or more with their bounds; glyph ids are none."""
    found = [(m[0].casefold(), *m.span()) for m in WORD.finditer(text)]
    return [w for w in found if w[2] - w[1] > 1 and not w[0].startswith("cid")]


def in_order(places: list[int]) -> bool:
    return all(a < b for a, b in zip(places[:-1], places[1:], strict=True))


class Page:
    """The text that lines are looked for in; each of its letters, and each of its words, answers to one line."""

    def __init__(self, text: str):
        self.text, self.words = text, words(text)
        self.letters, self.at = letters(text)
        self.taken_letters = np.zeros(len(self.letters), bool)
        self.taken = np.zeros(len(self.words), bool)
        self.folded = [w for w, _, _ in self.words]
        numbers: dict[str, int] = {}
        self.codes = np.array([numbers.setdefault(w, len(numbers)) for w, _, _ in self.words], np.int64)
        self.numbers = numbers

    def spelled(self, line: str) -> tuple[int, int] | None:
        """The first place with the line's letters, or the second if that is taken."""
        wanted = line.rstrip(DASHES).translate(FOLDED)
        if len(wanted) < SHORTEST:
            return None
        low = self.letters.find(wanted)
        if low >= 0 and self.taken_letters[low : low + len(wanted)].any():
            low = self.letters.find(wanted, low + 1)
        if low < 0 or self.taken_letters[low : low + len(wanted)].any():
            return None
        self.taken_letters[low : low + len(wanted)] = True
        return int(self.at[low]), int(self.at[low + len(wanted) - 1]) + 1

    def like(self, line: str) -> tuple[int, int, float] | None:
        """The free window of words most like the line: its bounds and their ratio.

        Seeds are the words that the line has too. A window can't match more words than
        it has seeds, so only windows with enough of them are compared,
        the most promising first, until none left can be better. Where no word occurs twice and seeds
        stand in the line's order, all of them match, and nothing has to be compared.
        """
        wanted = [w.casefold() for w in WORD.findall(line) if len(w) > 1]
        wanted = [w for w in wanted if not w.startswith("cid")]
        n = len(wanted)
        if n == 0:
            return None
        if n == 1:
            places = np.flatnonzero(self.codes == self.numbers.get(wanted[0], -1))
            return (int(places[0]), int(places[0]) + 1, 1.0) if len(places) == 1 and not self.taken[places[0]] else None
        own = {w: k for k, w in enumerate(wanted) if w in self.numbers}
        longest, least = min(len(self.words), n + SLACK), max(2, LIKE * n)
        place = [own.get(w, -1) for w in self.folded] if own else []
        seeds = [0, *accumulate(k >= 0 for k in place)]
        if longest < 2 or seeds[-1] < least:
            return None
        # any window lies in one of the longest
        wide = [s for s in range(len(place) - longest + 1) if seeds[s + longest] - seeds[s] >= least]
        taken, windows = self.taken.tobytes(), []
        for size in range(max(2, n - SLACK), longest + 1) if wide else ():
            for start in range(wide[0], wide[-1] + longest - size + 1):
                most = min(seeds[start + size] - seeds[start], n)
                if most >= least and 2 * most >= LIKE * (n + size) and taken.find(1, start, start + size) < 0:
                    windows.append((2 * most / (n + size), most, -abs(size - n), -start, size))
        best, once, compared = None, len(set(wanted)) == n, None
        for bound, most, far, start, size in sorted(windows, reverse=True):
            if best and (bound, most, far, start) <= best[0]:
                break
            matched = most
            if not once or not in_order([k for k in place[-start : size - start] if k >= 0]):
                compared = compared or SequenceMatcher(None, wanted, "", autojunk=False)
                compared.set_seq2(self.folded[-start : size - start])
                matched = sum(b.size for b in compared.get_matching_blocks())
            ratio = 2 * matched / (n + size)
            rank = (ratio, matched, far, start)
            if matched >= 2 and matched / n >= LIKE and ratio >= LIKE and (best is None or rank > best[0]):
                best = (rank, -start, size - start)
        return best and (best[1], best[2], best[0][0])

    def place(self, line: str) -> tuple[int, int, str, float] | None:
        found = self.spelled(line)
        if found:
            return *found, "letters", 1.0
        window = self.like(line)
        if not window:
            return None
        first, end, ratio = window
        self.taken[first:end] = True
        return self.words[first][1], self.words[end - 1][2], "words", ratio


def aligned(pages: DataFrame, by: list[str], read: Callable[[pa.RecordBatch], tuple[list, list]] | None = None) -> DataFrame:
    """For each page (``by``, text, lines in order): by, and where its lines stand in its text.

    ``line_no`` counts from 0; ``start`` and ``end`` bound characters of the text; ``how`` is
    'letters' for a line found whole, hyphens, marks and spaces apart, and 'words' for the
    window most like it, of which ``ratio`` tells how like. Lines that are nowhere have no
    row. Lines take their places for good, so equal lines find one each, in order; what is
    taken letter by letter and what by words is kept apart, so that a last equal line
    may still be like a place that another one spells. A text without words has no lines; null texts and lines are empty. ``read``
    makes texts and lists of lines of pages that come otherwise (``by`` and what it reads). A task holds
    the lines of PAGES pages.
    """
    kinds = [f"`{c}` {t}" for c, t in pages.select(*by).dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable((b.slice(low, PAGES) for low in range(0, b.num_rows, PAGES)) for b in batches):
            rows: list[tuple] = []
            for k, (text, lines) in enumerate(zip(*(read(batch) if read else (batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist())), strict=True)):
                page = Page(text or "")
                for no, line in enumerate(lines or () if page.words else ()):
                    found = page.place(line or "")
                    if found:
                        rows.append((k, no, *found))
            k, *columns = zip(*rows, strict=True) if rows else [[]] * 6
            own = [batch.column(i).take(pa.array(k, pa.int64())) for i in range(len(by))]
            kept = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(own + kept, names=[*by, "line_no", "start", "end", "how", "ratio"])

    given = pages if read else pages.select(*by, F.col("text").cast("string"), F.col("lines").cast("array<string>"))
    return given.mapInArrow(run, ", ".join([*kinds, SPAN]))
