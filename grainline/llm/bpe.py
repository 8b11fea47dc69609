"""BPE encoding and decoding: longest matches are proposed, pairs verified, failing words merged exactly."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bytetext import blocks
from .common import frugal

#: Bytes of text that a task works on at once (or one longer text), and characters of a text between two cuts.
SLICE_BYTES, PIECE = 1 << 20, 1 << 20
#: Words whose tokens a task remembers before it starts anew.
REMEMBERED = 400_000
NEVER = 1 << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE.

    Visible Latin-1 characters stand for themselves, the other bytes in order for U+0100 and on.
    """
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


@cache
def _newer() -> regex.Pattern:
    """Code points that Python's Unicode tables don't know yet."""
    known = np.array([unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(np.concatenate(([True], known, [True])).astype(np.int8)))
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist()) + "]")


_LATE = regex.compile("[\u0378-\U0010ffff]")


class Vocabulary:
    """A tokenizer file: how text becomes words, and which tokens and merges its words have."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        self._split(spec)
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec.get("decoder"):
            raise ValueError("only plain BPE over byte symbols is read")
        self.file, self.end = file, model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must stand for themselves")
        vocab = model["vocab"]
        self.names = {i: t for t, i in (vocab | added).items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        size = max(self.names) + 1
        #: for each token the place of its merge, and what was merged; -1 for single symbols
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {}
        for place, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] >= 0 or max(self.rank[x], self.rank[y]) >= place:
                raise ValueError("a token must have one merge, later than those of its parts")
            self.rank[z], self.left[z], self.right[z] = place, x, y
            self.merges[x, y] = place, z
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.places = size, keys[order], np.array([p for p, _ in self.merges.values()], np.int64)[order]
        self._tables(vocab)

    def _split(self, spec: dict) -> None:
        steps = [(s["type"], s.get("pattern"), s.get("content")) for s in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = spec["pre_tokenizer"].get("pretokenizers", [])
        # white space is in no word, so what it is replaced by doesn't matter
        if steps != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]:
            raise ValueError("only NFC, white space to a blank and lower case are read")
        kinds = [(p["type"], p.get("behavior"), p.get("invert"), p.get("add_prefix_space", False), p.get("use_regex", False)) for p in pre]
        if kinds != [("Split", "Removed", True, False, False), ("ByteLevel", None, None, False, False)]:
            raise ValueError("only words of a pattern over bytes are read")
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])

    def _tables(self, vocab: dict) -> None:
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(self.size, bool)
        sound[made] = self.fits(self.left[made], self.right[made], inner=True)
        for i in made[np.argsort(self.rank[made])].tolist():  # unsound parts make an unsound token
            sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        self.inside, self.last = {}, {}
        for token, i in vocab.items():
            ends = bool(self.end) and token.endswith(self.end)
            symbols = token[: len(token) - len(self.end)] if ends else token
            if sound[i] and all(c in byte_of for c in symbols):
                (self.last if ends else self.inside)[bytes(byte_of[c] for c in symbols)] = i
        if not self.end:
            self.last = self.inside
        self.longest = max(map(len, (*self.inside, *self.last)))

    def fits(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` stay two tokens side by side.

        Merges are applied from the lowest place up and, at one place, from the left.
        So the pairs that meet at the border at some time are those of ``a``'s last and
        ``b``'s first parts that exist at once. From the whole tokens back in time, the
        younger part is undone in each step. The border falls if any pair there has a
        merge before both of its parts are merged inward; at the same place, the merge
        further left comes first. With ``inner``, the pair (a, b) itself may merge.
        """
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        good, at, first = np.ones(len(a), bool), np.arange(len(a)), inner
        while len(at):
            keys = a * self.size + b
            spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            place = np.where(self.keys[spot] == keys, self.places[spot], NEVER)
            falls = (place < until_a) & (place <= until_b)
            if first:
                until_a, until_b, first = place.copy(), place.copy(), False
                # at its own place, an inner pair comes after merges further left only
                falls[:] = False
            good[at[falls]] = False
            back_a = self.rank[a] > self.rank[b]
            until_a, until_b = np.where(back_a, self.rank[a], until_a), np.where(back_a, until_b, self.rank[b])
            going = ~falls & (np.maximum(self.rank[a], self.rank[b]) >= 0)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
            a, b, until_a, until_b, at = a[going], b[going], until_a[going], until_b[going], at[going]
        return good

    def propose(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        found, at, n = [], 0, len(word)
        while at < n:
            room = n - at
            token = self.last.get(word[at:]) if room <= self.longest else None
            size = room
            if token is None:
                size = min(self.longest, room - 1 if self.end else room)
                while (token := self.inside.get(word[at : at + size])) is None:
                    size -= 1
            found.append(token)
            at += size
        return found

    def merged(self, word: bytes) -> list[int]:
        """The exact tokens of a word: merges applied in order, the leftmost first among equals."""
        tokens = [self.inside[word[i : i + 1]] for i in range(len(word) - 1)] + [self.last[word[-1:]]]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        queue = [(m[0], i, m[1], i + 1) for i in range(len(tokens) - 1) if (m := self.merges.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(queue)
        while queue:
            place, i, token, j = heapq.heappop(queue)
            # what was queued may be gone: its parts must still lie side by side
            if tokens[i] < 0 or after[i] != j or j >= len(tokens) or self.merges.get((tokens[i], tokens[j])) != (place, token):
                continue
            tokens[i], tokens[j], after[i] = token, -1, after[j]
            if after[j] < len(tokens):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < len(tokens) and (m := self.merges.get((tokens[x], tokens[y]))):
                    heapq.heappush(queue, (m[0], x, m[1], y))
        return [t for t in tokens if t >= 0]

    def tokens(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of distinct words: proposals whose adjacent pairs all fit, else exact merging."""
        found = [self.propose(w) for w in words]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.array([t for f in found for t in f], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self.fits(*np.divmod(pairs, self.size))[which]
        for w in np.unique(owner[inner[~fits]]).tolist():
            found[w] = self.merged(words[w])
        return found

    def words(self, text: str) -> list[str]:
        """A text's words in order, added tokens among them."""
        if not self.special_pattern:
            return self._words(text)
        parts = self.special_pattern.split(text)
        if len(parts) == 1:
            return self._words(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self._words(part))]

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if _LATE.search(text) and _newer().search(text):
                # the library's own tables are newer than Python's: they say what such characters are
                whole = self._library()
                plain = whole.normalizer.normalize_str(text)
                return [plain[a:b] for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(plain)]
            # lower case by single characters: no other form of sigma at the end of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def _library(self) -> Tokenizer:
        if not hasattr(self, "_whole"):
            self._whole = Tokenizer.from_str(self.file)
        return self._whole


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text, cut before white space: no word, normal form or added token lies across."""
    at, space = 0, regex.compile(r"\s")
    while len(text) - at > size:
        cut = space.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Encoder:
    """A vocabulary with the tokens of the words met so far, at most ``most`` beside those of the text in hand."""

    def __init__(self, vocabulary: Vocabulary, most: int = REMEMBERED):
        self.vocabulary, self.most = vocabulary, most
        self.known: dict[str, bytes] = dict(vocabulary.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        found: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        room = 0
        for i, text in enumerate(texts):
            for piece in pieces(text):
                held.append((i, self.vocabulary.words(piece)))
                room += len(piece)
                if room >= PIECE:
                    self._add(held, found)
                    held, room = [], 0
        self._add(held, found)
        return [b"".join(f) for f in found]

    def _add(self, held: list[tuple[int, list[str]]], found: list[list[bytes]]) -> None:
        if len(self.known) > self.most:
            self.known = dict(self.vocabulary.special)
        new = list(set().union(*(words for _, words in held)).difference(self.known))
        if new:
            tokens = self.vocabulary.tokens([w.encode() for w in new])
            self.known.update(zip(new, (np.array(t, "<u4").tobytes() for t in tokens), strict=True))
        for i, words in held:
            found[i].append(b"".join(map(self.known.__getitem__, words)))


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The encoder of a broadcast tokenizer file, made once in a worker."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(Vocabulary(shared.value))
    return _encoders[shared.id]


class _Shared:
    """A broadcast value with its number, which tells workers what they have already made of it."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _share(spark: SparkSession, path: str) -> _Shared:
    with open(path, encoding="utf-8") as f:
        file = f.read()
    Vocabulary(file)  # a file that can't be read fails here, not in tasks
    return _Shared(spark.sparkContext.broadcast(file))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: ``doc_id, n_tokens, ids``, ids as little-endian unsigned 32-bit integers.

    ``path`` is a tokenizer file on the driver, sent to the executors as it is. Words
    new to a task are encoded at once: the longest token at each place is proposed,
    every adjacent pair of tokens is checked with numpy whether it stays apart, and
    words with a pair that doesn't are merged exactly. No shuffle takes place.

    Null and empty texts have no tokens. Strings of added tokens in a text become
    those tokens. Texts of any length are encoded whole, piece by piece. Repeated
    rows are each encoded; ties don't arise; other columns aren't looked at.
    """
    shared = _share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for low, high, _, _ in blocks(batch.column(1), SLICE_BYTES):
                part = batch.slice(low, high - low)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, n_tokens long, ids binary")


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Rows with the text of their ``ids`` (as ``encode`` gives them), tokens joined by blanks, in place of the ids.

    Null and empty ids are the empty text. An id that the vocabulary hasn't is left out.
    Other columns are kept, whatever their names.
    """
    shared = _share(rows.sparkSession, path)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != ids_col]).alias("_row"), F.col(ids_col).cast("binary").alias("_ids"))
    kept = packed.schema["_row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _encoder(shared).vocabulary.names
        known = np.zeros(max(names) + 1, bool)
        known[list(names)] = True
        table = np.array([names.get(i, "") for i in range(len(known))], object)
        for batch in batches:
            for low, high, _, _ in blocks(batch.column(1), SLICE_BYTES):
                part = batch.slice(low, high - low)
                texts = []
                for ids in part.column(1).to_pylist():
                    number = np.frombuffer(ids or b"", "<u4")
                    number = number[number < len(known)]
                    texts.append(" ".join(table[number[known[number]]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["_row", "_text"])

    found = packed.mapInArrow(frugal(run), f"_row {kept.simpleString()}, _text string")
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns if c != ids_col], F.col("_text").alias(out_col))
