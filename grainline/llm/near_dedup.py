"""MinHash near-dedup by a multi-index Hamming join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACE, blocks, gram_hashes, mix64, span_hashes, word_bounds
from .common import Stored, frugal, settle
from .components import components

#: A signature is SYMBOLS minima of BITS bits each, cut into CHUNKS chunks. Within
#: a chunk ERRORS = 1 symbol may differ. By pigeonhole, two signatures that differ
#: in at most CHUNKS * (ERRORS + 1) - 1 = 23 of 48 symbols share a key.
SYMBOLS, BITS, CHUNKS, WORDS = 48, 20, 12, 5
#: Of a pair of Jaccard 0.75, 12 of 48 symbols differ on average; all are within 23 but for 1.7e-4, and those
#: share no key at all with a probability of about 1e-7 over all pairs. Pairs beyond FAR aren't verified in the
#: last step; a pair of Jaccard 0.75 exceeds it with 3e-11, far less often than it shares no key.
FAR = 33
PACKED = SYMBOLS // 3
#: Keys of more rows count as hot in the last step; slots of its table of shared shingles.
HOT, SLOTS = 16, 1 << 22
_MASK = sum(((1 << BITS) - 1) << (21 * i) for i in range(3))
_TOP = sum(1 << (21 * i + BITS) for i in range(3))

SIGNED = "_id long, _n long, _s1 long, _s2 long, _keys array<long>, _sig array<long>"


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 5-word shingles of each row, as 64-bit hashes."""
    for first, end, offsets, data in blocks(texts):
        starts, ends, first_word = word_bounds(offsets, data, SPACE)
        grams, first_gram = gram_hashes(span_hashes(data, starts, ends), first_word, WORDS)
        for i in range(end - first):
            yield np.unique(grams[first_gram[i] : first_gram[i + 1]])


_FACTORS = mix64(np.arange(SYMBOLS, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
_SALTS = mix64(np.arange(SYMBOLS, dtype=np.uint64) + np.uint64(7777))


def signature(members: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of SYMBOLS independent minima of a set of hashes."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 2048):
        part = members[at : at + 2048, None]
        np.minimum(least, ((part ^ _SALTS) * _FACTORS).min(axis=0), out=least)
    return mix64(least) & np.uint64((1 << BITS) - 1)


def multi_index_keys(signatures: np.ndarray) -> np.ndarray:
    """All keys of each signature: each chunk with each of its symbols left open."""
    per = SYMBOLS // CHUNKS
    chunks = signatures.reshape(-1, CHUNKS, per)
    keys = []
    for left_out in range(per):
        rest = [i for i in range(per) if i != left_out]
        key = np.zeros(chunks.shape[:2], np.uint64)
        for i in rest:
            key = (key << np.uint64(BITS)) | chunks[:, :, i]
        keys.append(mix64(mix64(key) + np.uint64(left_out * CHUNKS) + np.arange(CHUNKS, dtype=np.uint64)))
    return np.concatenate(keys, axis=1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sums, other, found = [], [], [], []
        for members in shingle_sets(batch.column(1)):
            sizes.append(len(members))
            sums.append(members.sum(dtype=np.uint64))
            other.append(mix64(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            found.append(signature(members))
        n = len(sizes)
        signatures = np.array(found, np.uint64).reshape(n, SYMBOLS)
        keys = multi_index_keys(signatures)
        lanes = signatures.reshape(n, PACKED, 3)
        packed = (lanes[:, :, 0] | (lanes[:, :, 1] << np.uint64(21)) | (lanes[:, :, 2] << np.uint64(42))).view(np.int64)

        def lists(x: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], pa.array(np.ascontiguousarray(x).ravel()))

        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(sums, np.uint64).view(np.int64)), pa.array(np.array(other, np.uint64).view(np.int64)), lists(keys), lists(packed)],
            names=["_id", "_n", "_s1", "_s2", "_keys", "_sig"],
        )


def distance(a: str, b: str) -> Column:
    """Differing symbols of two packed signatures, counted in 21-bit lanes."""
    total = F.lit(0)
    for i in range(PACKED):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        total = total + F.bit_count((x + F.lit(_MASK)).bitwiseAND(F.lit(_TOP)))
    return total


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True)):
                if len(x) and len(y):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _slots(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        used = [np.unique(_slots(members)) for members in shingle_sets(batch.column(1))]
        slots, counts = np.unique(np.concatenate(used) if used else np.empty(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts.astype(np.int64))], names=["_slot", "_docs"])


def rare_prefixes(texts: DataFrame, num: int, den: int) -> DataFrame:
    """``_token, _id, _n, _place``: the rarest shingles of each set that a linked partner must meet.

    A set of n has to share ``num / den`` of n, so it shares one of its
    n - that + 1 first shingles in any common order; here by how many documents
    hold them. Counts come from a table of SLOTS slots of one byte, which is what
    is broadcast whatever the input; shingles that meet in a slot only look more
    frequent. Shingles that no other set has are left out, but keep their place.
    """
    slots = texts.select("_id", "_text").mapInArrow(_count_slots, "_slot long, _docs long").groupBy("_slot").agg(F.sum("_docs").alias("_docs"))
    found = slots.filter("_docs > 1").select("_slot", F.least("_docs", F.lit(255)).cast("int").alias("_docs")).toArrow()
    counts = np.zeros(SLOTS, np.uint8)
    counts[np.asarray(found.column(0), np.int64)] = np.asarray(found.column(1), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            tokens, ids, sizes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for own, members in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                n = len(members)
                often = table[_slots(members)]
                order = np.lexsort((members, often))[: n - -(-num * n // den) + 1]
                kept = np.flatnonzero(often[order] > 0)
                tokens.append(members[order[kept]])
                places.append(kept)
                ids.append(np.full(len(kept), own))
                sizes.append(np.full(len(kept), n))
            columns = [np.concatenate(tokens).view(np.int64), *(np.concatenate(x) for x in (ids, sizes, places))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_token", "_id", "_n", "_place"])

    return texts.select("_id", "_text").mapInArrow(run, "_token long, _id long, _n long, _place long")


def confirm(texts: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets overlap enough. ``texts``: _id, _text."""
    left = texts.select(F.col("_id").alias("a"), F.col("_text").alias("_ta"))
    right = texts.select(F.col("_id").alias("b"), F.col("_text").alias("_tb"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "_ta", "_tb")
    return rows.mapInArrow(frugal(_confirm(num, den)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """Components of documents linked by ``den * |A & B| >= num * |A | B|``.

    1. Each distinct shingle set (documents with equal sets meet by two sums over
       the whole set) gives 48 keys: all chunks of its signature with every
       allowed chunk error. Documents under the signature threshold share a key.
    2. Each key's smallest document is paired with the others of the key, then,
       for keys that hold several components, the document that meets most
       others. Pairs are confirmed on full shingle sets. This takes as many pairs
       as rows, so a group of thousands of near copies costs no more.
    3. In keys that still hold several components, pairs of documents of different
       components are confirmed: in keys of at most HOT rows all those within the
       signature distance FAR; the documents of hotter keys are joined on their
       rarest shingles instead (``rare_prefixes``), with the positional filter. A
       heap of copies edited so much that they are no longer near each other
       shares no rare shingles, so it makes hardly any pair.
    4. Components come from star contraction on the confirmed links.

    Returns ``doc_id, n_shingles, component_id, kept`` for each row. Null and
    empty texts have no shingles and link with nothing. Rows that share an id
    are one node. A row without id joins the component of an equal set, else
    has a null component and is kept. Sets are of whole texts, in memory one at a
    time. Other columns aren't looked at.

    Links are exact as far as a pair shares a key; of pairs of Jaccard 0.75, 1e-7 share
    none, and fewer of nearer ones. Equal sets are told by size and two 64-bit sums.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    signed = settle(source.mapInArrow(frugal(_sign), SIGNED))
    same = ["_n", "_s1", "_s2"]
    sets = settle(signed.filter("_n > 0").groupBy(*same).agg(F.min("_id").alias("_rep")))
    reps = signed.join(sets.filter("_rep is not null").withColumnRenamed("_rep", "_id"), [*same, "_id"], "left_semi")
    keys = reps.select("_id", F.explode("_keys").alias("_key"))
    centres = keys.groupBy("_key").agg(F.min("_id").alias("_centre"), F.count("*").alias("_c")).filter("_c > 1")
    shared = settle(keys.join(centres, "_key"))
    stored = Stored(source.filter("_text is not null").join(shared.select("_id").distinct(), "_id", "left_semi"))
    texts = stored.df

    pairs = shared.filter("_id <> _centre").select(F.col("_centre").alias("a"), F.col("_id").alias("b")).distinct()
    links = settle(confirm(texts, pairs, num, den))
    groups = components(links)

    still = settle(_open_keys(shared.drop("_centre"), groups))
    if not still.isEmpty():
        score = still.groupBy("_id").agg(F.sum("_c").alias("_score"))
        scored = still.join(score, "_id")
        middle = scored.groupBy("_key").agg(F.max_by("_id", F.struct("_score", -F.col("_id"))).alias("_centre"), F.max_by("_group", F.struct("_score", -F.col("_id"))).alias("_cgroup"))
        pairs = still.join(middle, "_key").filter("_group <> _cgroup").select(F.least("_centre", "_id").alias("a"), F.greatest("_centre", "_id").alias("b")).distinct()
        more = settle(confirm(texts, pairs, num, den))
        links = settle(links.union(more))
        groups = components(links)
        still = settle(_open_keys(still.drop("_group"), groups))
    if not still.isEmpty():
        sizes = still.groupBy("_key").count()
        hot = still.join(sizes.filter(F.col("count") > HOT), "_key", "left_semi").select("_id", "_group").distinct()
        fewer = (F.col("_n_a") + F.col("_n_b")) * num
        ends = lambda rows, names: (rows.select(F.col(names[0]).alias("_on"), *[F.col(c).alias(c + x) for c in names[1:]]) for x in ("_a", "_b"))
        apart = F.col("_group_a") < F.col("_group_b")
        pair = (F.least("_id_a", "_id_b").alias("a"), F.greatest("_id_a", "_id_b").alias("b"))

        cold = still.join(sizes.filter(F.col("count") <= HOT), "_key", "left_semi").join(reps.select("_id", "_n", "_sig"), "_id")
        left, right = ends(settle(cold), ("_key", "_id", "_group", "_n", "_sig"))
        fits = (F.least("_n_a", "_n_b") * (num + den) >= fewer) & (distance("_sig_a", "_sig_b") <= FAR)
        pairs = left.join(right, (left["_on"] == right["_on"]) & apart & fits).select(*pair)

        prefixes = rare_prefixes(texts.join(hot, "_id", "left_semi"), num, den).join(hot, "_id")
        left, right = ends(settle(prefixes), ("_token", "_id", "_group", "_n", "_place"))
        rest = F.least(F.col("_n_a") - F.col("_place_a"), F.col("_n_b") - F.col("_place_b"))
        pairs = pairs.union(left.join(right, (left["_on"] == right["_on"]) & apart & (rest * (num + den) >= fewer)).select(*pair)).distinct()
        last = settle(confirm(texts, pairs, num, den))
        if not last.isEmpty():
            groups = components(links.union(last))
    stored.drop()
    named = sets.join(groups, F.col("_rep") == F.col("node"), "left").select(*same, F.coalesce("component", "_rep").alias("_component"))
    result = signed.select("_id", *same).join(named, same, "left")
    component = F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id"))
    return result.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _open_keys(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``_key, _id, _c`` -> the rows of keys that hold several components, with ``_group``."""
    named = rows.join(groups, F.col("_id") == F.col("node"), "left").withColumn("_group", F.coalesce("component", "_id")).drop("node", "component")
    several = named.groupBy("_key").agg(F.min("_group").alias("_lo"), F.max("_group").alias("_hi")).filter("_lo < _hi").select("_key")
    return named.join(several, "_key", "left_semi")
