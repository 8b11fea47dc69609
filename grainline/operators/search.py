"""Dense, lexical and hybrid top-k for many queries at once, and what is done with ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import settle

RRF_K, BM25_K1, BM25_B = 60, 1.5, 0.75
#: Queries of one block.
QUERY_BLOCK = 1024


def pool_size(k: int) -> int:
    """How deep each channel is read for the best ``k`` of a fusion."""
    return max(4 * k, 50)


#: Difference of scores that rounding may turn into a tie.
NEAR = 1e-8
#: Queries by text of one block, and terms that are laid out at once.
TEXT_BLOCK, LAID_OUT = 512, 256
#: Scores beyond a bar, for each of its places, from which on they aren't looked at one by one.
MANY = 4
#: Rows of one tile, which meets a block of queries; scores of vectors that a task holds at once.
TILE, SCORES = 4096, 1 << 19
#: Queries that a task holds at once, and words of chunks that it counts at once.
HELD, WORDS = 4096, 1 << 19
#: Terms of a chunk in its binary value: a hash and how often it occurs.
TERM = np.dtype([("t", "<i8"), ("n", "<i4")])


def numbers(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    found = flat.reshape(n, -1) if n else flat.reshape(0, 0)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def packed(rows: DataFrame, size: int, name: str, *order: str) -> DataFrame:
    """``_key`` and rows of that key of an Arrow batch, in ``order``, as tables of at most ``size`` rows in one binary value."""
    fields = [c for c in rows.columns if c != "_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                for at in range(low, high, size):
                    part, sink = batch.slice(at, min(size, high - at)).select(fields), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 1], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_key", name])

    return rows.select("_key", *fields).sortWithinPartitions("_key", *order).mapInArrow(run, f"_key long, {name} binary")


def opened(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks().to_batches()[0]


def best_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's best k, and of what is as good as the k-th as far as rounding tells."""
    n = scores.shape[1]
    if n <= k:
        return np.nonzero(np.isfinite(scores))
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    return np.nonzero((scores >= least[:, None] - NEAR) & np.isfinite(scores))


class Bar:
    """The k best scores so far of each query of a block, which what comes later has to reach."""

    def __init__(self, queries: int, k: int):
        self.best = np.full((queries, k), -np.inf)

    def places(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``best_places``, of all that was seen till now."""
        least = np.maximum(self.best.min(axis=1) - NEAR, np.finfo(np.float64).min)
        passing = scores >= least[:, None]
        k = self.best.shape[1]
        if np.count_nonzero(passing) > MANY * self.best.size:
            own = np.where(passing, scores, -np.inf)
            own.partition(scores.shape[1] - k, axis=1)
            self.best = np.partition(np.concatenate((self.best, own[:, -k:]), axis=1), k, axis=1)[:, k:]
            del own
            least = np.maximum(self.best.min(axis=1) - NEAR, np.finfo(np.float64).min)
            return np.nonzero(scores >= least[:, None])
        row, at = np.nonzero(passing)
        if not len(row):
            return row, at
        found, counts = scores[row, at], np.bincount(row, minlength=len(scores))
        new = np.full((len(scores), counts.max()), -np.inf)
        new[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = found
        every = np.concatenate((self.best, new), axis=1)
        self.best = np.partition(every, new.shape[1], axis=1)[:, new.shape[1] :]
        kept = found >= self.best.min(axis=1)[row] - NEAR
        return row[kept], at[kept]


def _meeting(k: int, score, may, at_once: int | None):
    """(_tile, _block) -> what may be among the best k, as ``_best`` says; a batch goes before the next is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict[bytes, Bar] = {}

        def meet(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                tile, block = opened(left), opened(right)
                chunk, allowed, scored = tile.column(0).to_numpy(zero_copy_only=False), may(tile, block), score(tile)
                step = block.num_rows if at_once is None else max(1, at_once // TILE)
                for low in range(0, block.num_rows, step):
                    asked = block.slice(low, step)
                    query, scores = asked.column(0).to_numpy(zero_copy_only=False), scored(asked)
                    if allowed is not True:
                        scores[~allowed[low : low + step]] = -np.inf
                    row, at = bars.setdefault(query.tobytes(), Bar(len(query), k)).places(scores)
                    yield pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array(chunk[at]), pa.array(scores[row, at])], names=["query_id", "chunk_id", "score"])

        return chain.from_iterable(map(meet, batches))

    return run


def _streamed(k: int, read, score, may, at_once: int | None):
    """(_key, _block, rows) -> what may be among the best k, as ``_best`` says. A key's blocks come before its rows."""

    def hold(blob: pa.Scalar) -> tuple[pa.RecordBatch, list]:
        block = pa.ipc.open_stream(blob.as_py()).read_all().combine_chunks().to_batches()[0]
        step = block.num_rows if at_once is None else max(1, at_once // TILE)
        parts = [block.slice(low, step) for low in range(0, block.num_rows, step)]
        parts = [(low * step, x.column(0).to_numpy(zero_copy_only=False).copy(), read(x), Bar(x.num_rows, k)) for low, x in enumerate(parts)]
        # what is read needn't stay as it came
        rest = pa.RecordBatch.from_arrays([block.column(0), pa.nulls(block.num_rows), *block.columns[2:]], names=block.schema.names)
        return rest.take(pa.array(range(block.num_rows), pa.int64())), parts

    def meet(tile: pa.RecordBatch, held: list) -> Iterator[pa.RecordBatch]:
        chunk, scored = tile.column(0).to_numpy(zero_copy_only=False), score(tile)
        for block, parts in held:
            allowed = may(tile, block)
            for low, query, asked, bar in parts:
                scores = scored(asked)
                if allowed is not True:
                    scores[~allowed[low : low + len(query)]] = -np.inf
                row, at = bar.places(scores)
                yield pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array(chunk[at]), pa.array(scores[row, at])], names=["query_id", "chunk_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal last
            keys, fields = batch.column(0).to_numpy(zero_copy_only=False), batch.schema.names[2:]
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low < high and keys[low] != last:
                    last = keys[low]
                    held.clear()
                first = high - batch.column(1).slice(low, high - low).null_count
                held.extend(hold(batch.column(1)[i]) for i in range(low, first))
                for at in range(first, high, TILE):
                    yield from meet(batch.slice(at, min(TILE, high - at)).select(fields), held)

        return chain.from_iterable(map(each, batches))

    return run


def _best(corpus: DataFrame, queries: DataFrame, k: int, score, may, block: int, key: Column | None = None, keys: Column | None = None, at_once: int | None = None, read=lambda block: block) -> DataFrame:
    """``query_id, chunk_id, score`` of what may be among a query's best k, by ``score(tile)(read(block))``, a
    matrix of queries and rows with -inf for what doesn't match.

    ``corpus`` begins with chunk_id, ``queries`` with query_id. Rows of one ``key`` meet
    queries that have it among their ``keys`` (arrays of hashes); without keys every query meets
    every row. Rows of a key are dealt out to many parts, each with the queries of the key. A task
    holds about HELD of these, in blocks that are read once, and its rows go past them tile by
    tile; no pair of a block and a tile is a value. More queries of a key make further groups, and its
    rows go to each. ``may(tile, block)`` tells what each query may see (True for all) before the best
    are chosen, and only those are shuffled; a task keeps a query's bar from tile to tile. A key only
    routes: what may be seen is for ``may`` to tell. With ``at_once``, a block is taken by as many
    queries as have so many scores with a tile.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    parts = 2 * cores
    asked = queries.withColumn("_route", F.lit(0).cast("long") if keys is None else F.explode(F.array_distinct(keys)))
    sizes = F.broadcast(asked.groupBy("_route").agg(F.ceil(F.count("*") / HELD).cast("int").alias("_groups")))
    own = F.xxhash64("_route", "_group")
    asked = asked.join(sizes, "_route").withColumn("_group", F.pmod(F.xxhash64("query_id"), F.col("_groups")).cast("int")).select(own.alias("_key"), *queries.columns)
    # blocks are filled from few partitions, so that there are no more of them than there have to be
    blocks = packed(asked.repartition(max(1, cores // 8), "_key"), block, "_block").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = corpus.withColumn("_route", F.lit(0).cast("long") if key is None else key).join(sizes, "_route")
    rows = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).select(own.alias("_key"), F.lit(None).cast("binary").alias("_block"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("_part"), *corpus.columns)
    # each task has one part of every key
    dealt = blocks.unionByName(rows, allowMissingColumns=True).repartitionById(parts, F.col("_part"))
    met = dealt.sortWithinPartitions("_key", F.col("_block").isNull()).select("_key", "_block", *corpus.columns)

    return met.mapInArrow(_streamed(k, read, score, may, at_once), "query_id long, chunk_id long, score double")


def _unit(block: pa.RecordBatch) -> np.ndarray:
    return numbers(block.column(1), block.num_rows)


def cosines(tile: pa.RecordBatch) -> Callable[[pa.RecordBatch | np.ndarray], np.ndarray]:
    """Of the rows of a tile with those of a block, or with these as ``_unit`` reads them."""
    rows = _unit(tile).T
    return lambda block: (block if isinstance(block, np.ndarray) else _unit(block)) @ rows


def nearest(corpus: DataFrame, queries: DataFrame, k: int, may, key: Column | None = None, keys: Column | None = None) -> DataFrame:
    """Exact cosine top-k: ``query_id, chunk_id, score, dense_rank``, ties by chunk id.

    ``corpus`` begins with chunk_id and vector, ``queries`` with query_id and qvec; what
    follows them is for ``may``; ``key`` and ``keys`` as in ``_best``.
    """

    found = _best(corpus, queries, k, cosines, may, QUERY_BLOCK, key, keys, SCORES, _unit)
    return top(found.withColumn("score", F.round("score", 12)), "score", k, "dense_rank")


def may_read(tile: pa.RecordBatch, block: pa.RecordBatch) -> np.ndarray:
    """Permissions of (tenant, owner, visibility, scope, acl) for (tenant, user, role), once for each kind of reader."""
    tenant, owner, visibility, scope = (tile.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
    acl = tile.column(6)
    rows, members = pc.list_parent_indices(acl).to_numpy(zero_copy_only=False), acl.flatten().to_numpy(zero_copy_only=False)
    everyone, open_here, shared = scope == "global", visibility == "tenant", visibility == "shared"
    kinds: dict[tuple, list[int]] = {}
    for j, reader in enumerate(zip(*(block.column(i).to_pylist() for i in range(2, 5)), strict=True)):
        kinds.setdefault(reader, []).append(j)
    allowed = np.empty((block.num_rows, tile.num_rows), bool)
    for (t, user, role), own in kinds.items():
        listed = np.zeros(tile.num_rows, bool)
        listed[rows[members == user]] = True
        allowed[own] = everyone | ((tenant == t) & (True if role == "admin" else (owner == user) | open_here | (shared & listed)))
    return allowed


def tenant_key() -> Column:
    """Routes a row to its tenant's readers, a global one to all; equal hashes of tenants only cost work."""
    return F.when(F.col("scope") == "global", F.xxhash64(F.lit(True))).otherwise(F.xxhash64(F.col("tenant").cast("string")))


def tenant_keys() -> Column:
    return F.array(F.xxhash64(F.lit(True)), F.xxhash64(F.col("q_tenant").cast("string")))


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, access: bool = True) -> DataFrame:
    """``nearest`` of vectors that each query's reader may see.

    ``corpus``: chunk_id, vector and, with ``access``, tenant, owner, visibility,
    scope, acl. ``queries``: query_id, qvec and q_tenant, q_user, q_role.
    """
    own = ["chunk_id", "vector", *(["tenant", "owner", "visibility", "scope", "acl"] if access else [])]
    fields = ["query_id", "qvec", *(["q_tenant", "q_user", "q_role"] if access else [])]
    if access:
        return nearest(corpus.select(*own), queries.select(*fields), k, may_read, tenant_key(), tenant_keys())
    return nearest(corpus.select(*own), queries.select(*fields), k, lambda tile, block: True)


def top(rows: DataFrame, score: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col("chunk_id"))
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def idf(df: Column, n: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _hashes(corpus: DataFrame, term: Callable[[Column], Column], *rest: str) -> DataFrame:
    return corpus.select(F.col("chunk_id").cast("long"), F.transform(tokenize(F.col("text")), lambda t: F.xxhash64(term(t))).alias("_h"), *rest)


def _by_words(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch of about WORDS words, these in one array, and which row of them each is in."""
    ends = batch.column(1).offsets.to_numpy()
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + WORDS, "right")) - 1)
        rows = batch.slice(low, high - low)
        yield rows, batch.column(1).values.slice(ends[low], ends[high] - ends[low]).to_numpy(zero_copy_only=False), np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
        low = high


def counted(corpus: DataFrame, term: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """``chunk_id, terms`` (TERMs in one binary value) and what else there is, without a shuffle.

    ``term`` maps a word to what it is looked up by.
    """
    rest = [f for f in corpus.schema if f.name not in ("chunk_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, row in _by_words(batch):
                order = np.lexsort((flat, row))
                flat, row = flat[order], row[order]
                first = np.flatnonzero(np.concatenate(([True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])))[: len(flat)])
                own = np.empty(len(first), TERM)
                own["t"], own["n"] = flat[first], np.diff(np.append(first, len(flat)))
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=rows.num_rows)))) * TERM.itemsize
                terms = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays([rows.column(0), terms, *rows.columns[2:]], names=["chunk_id", "terms", *rows.schema.names[2:]])

    return _hashes(corpus, term, *[f.name for f in rest]).mapInArrow(run, ", ".join(["chunk_id long, terms binary", *[f"`{f.name}` {f.dataType.simpleString()}" for f in rest]]))


#: Stands for a document among the hashes of its terms.
WHOLE = 0


def frequencies(corpus: DataFrame) -> DataFrame:
    """``t, df, tf``: how many chunks hold a term, and how often; WHOLE for all chunks and all their words. Terms are counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, flat, row in _by_words(batch):
                order = np.lexsort((row, flat))
                flat, row = flat[order], row[order]
                new = np.concatenate(([True], flat[1:] != flat[:-1]))[: len(flat)]
                first, once = np.flatnonzero(new), new.copy()
                once[1:] |= row[1:] != row[:-1]
                df = np.add.reduceat(once.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
                columns = [np.append(flat[first], WHOLE), np.append(df, rows.num_rows), np.append(np.diff(np.append(first, len(flat))), len(flat))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["t", "df", "tf"])

    return _hashes(corpus, lambda t: t).mapInArrow(run, "t long, df long, tf long").groupBy("t").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def by_terms(corpus: DataFrame, queries: DataFrame, k: int, access: bool, weight: Callable[[np.ndarray, np.ndarray], np.ndarray] = lambda n, dl: n) -> DataFrame:
    """``query_id, chunk_id, score`` of what may be among the best k, by the sum of products of the weights of shared terms.

    ``corpus``: as ``counted`` makes it, with ``access`` with the permissions, a term's ``weight`` being told by how often a chunk
    has it and how many words that has; ``queries``: query_id, terms (array of hash ``t`` and weight ``w``)
    and, with ``access``, the reader. No pair of a chunk and a query is a row before its best k are chosen.
    """
    own, asked = (["tenant", "owner", "visibility", "scope", "acl"], ["q_tenant", "q_user", "q_role"]) if access else ([], [])
    routes = (tenant_key(), tenant_keys()) if access else (None, None)

    def score(tile: pa.RecordBatch) -> Callable[[tuple], np.ndarray]:
        chunk, term, n = _held(tile.column(1))
        dl = np.bincount(chunk, n, minlength=tile.num_rows)
        held = chunk, term, weight(n.astype(np.float64), dl[chunk])
        return lambda asked: _products(held, tile.num_rows, asked)

    queries = settle(queries.select("query_id", "terms", *asked))
    return _best(corpus.select("chunk_id", "terms", *own), queries, k, score, may_read if access else lambda tile, block: True, TEXT_BLOCK, *routes, read=_asked)


def bm25(corpus: DataFrame, queries: DataFrame, k: int, access: bool = False) -> DataFrame:
    """``query_id, chunk_id, lex_score, lex_rank`` with corpus-wide statistics.

    One scan counts documents and terms; another makes tiles of chunks' terms, which meet
    blocks of queries' terms with their weights (``by_terms``); with ``access``, only chunks
    that a query's reader may see take part. Terms are told by 64-bit hashes.
    """
    own, asked = (["tenant", "owner", "visibility", "scope", "acl"], ["q_tenant", "q_user", "q_role"]) if access else ([], [])
    terms = queries.select("query_id", *asked, F.explode(F.transform(F.array_distinct(tokenize(F.col("qtext"))), lambda t: F.xxhash64(t))).alias("t"))
    wanted = terms.select("t").union(terms.sparkSession.range(1).select(F.lit(WHOLE).cast("long"))).distinct()
    sizes = settle(frequencies(corpus.select("chunk_id", "text")).join(wanted, "t"))
    whole = sizes.filter(F.col("t") == WHOLE).first()
    n, average = (whole["df"], whole["tf"] / whole["df"]) if whole else (0, 0.0)
    weighed = terms.join(sizes.filter(F.col("t") != WHOLE), "t").groupBy("query_id", *asked).agg(F.collect_list(F.struct("t", idf(F.col("df"), F.lit(n)).alias("w"))).alias("terms"))
    part = lambda n, dl: n * (BM25_K1 + 1) / (n + BM25_K1 * (1 - BM25_B + BM25_B * dl / average))
    found = by_terms(counted(corpus.select("chunk_id", "text", *own)), weighed, k, access, part)
    return top(found.select("query_id", "chunk_id", F.round("score", 9).alias("lex_score")).filter("lex_score > 0"), "lex_score", k, "lex_rank")


def _held(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes and counts of TERMs in binary values."""
    if not len(column):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]], TERM)
    return np.repeat(np.arange(len(column)), np.diff(ends) // TERM.itemsize), flat["t"], flat["n"]


def _weights(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = lists.flatten()
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), *(flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))


def _asked(block: pa.RecordBatch) -> tuple:
    """A block's terms in order, and the rows and weights that have them, one term after another; how many have each; how many rows."""
    query, asked, worth = _weights(block.column(1))
    terms, which = np.unique(asked, return_inverse=True)
    order = np.argsort(which, kind="stable")
    return terms, query[order].astype(np.int32), worth[order], np.bincount(which, minlength=len(terms)), block.num_rows


def _lexical(tile: pa.RecordBatch, block: pa.RecordBatch) -> np.ndarray:
    return _products(_weights(tile.column(1)), tile.num_rows, _asked(block))


def _products(tile: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, block: tuple) -> np.ndarray:
    """Sums of the products of the weights of the terms that a chunk and a query share; -inf where they share none.

    Terms that many chunks and queries have are multiplied as matrices, others are added
    where they occur.
    """
    chunk, own, weight = tile
    terms, query, worth, wanted, asking = block
    scores = np.zeros((asking, n))
    if len(terms):
        at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
        known = np.flatnonzero(terms[at] == own)
        at = at[known]
        order = np.argsort(at, kind="stable")
        chunk, weight, held = chunk[known[order]], weight[known[order]], np.bincount(at, minlength=len(terms))
        del known, order, at
        ends, lasts = np.cumsum(held), np.cumsum(wanted)
        # what a term costs where it occurs, against a row of the product, as measured
        common = wanted * (held + 1000) * 20 > scores.size
        often, product = np.flatnonzero(common & (held > 0)), None
        for low in range(0, len(often), LAID_OUT):
            part = often[low : low + LAID_OUT]
            wants, has = np.zeros((asking, len(part))), np.zeros((len(part), n))
            for i, t in enumerate(part.tolist()):
                wants[query[lasts[t] - wanted[t] : lasts[t]], i] = worth[lasts[t] - wanted[t] : lasts[t]]
                has[i, chunk[ends[t] - held[t] : ends[t]]] = weight[ends[t] - held[t] : ends[t]]
            product = np.matmul(wants, has, out=product)
            scores += product
        del product
        for t in np.flatnonzero(~common & (held > 0)).tolist():
            rows, columns = slice(lasts[t] - wanted[t], lasts[t]), slice(ends[t] - held[t], ends[t])
            scores[query[rows, None], chunk[None, columns]] += worth[rows, None] * weight[None, columns]
    scores[scores <= 0] = -np.inf
    return scores


def fuse(dense: DataFrame, lexical: DataFrame, k: int, w_dense: Column | float = 1.0, w_lex: Column | float = 1.0) -> DataFrame:
    """Reciprocal rank fusion: ties keep dense order, then lexical order."""
    w_dense, w_lex = (w if isinstance(w, Column) else F.lit(float(w)) for w in (w_dense, w_lex))
    both = dense.select("query_id", "chunk_id", "score", "dense_rank").join(lexical.select("query_id", "chunk_id", "lex_score", "lex_rank"), ["query_id", "chunk_id"], "full_outer")
    rrf = F.coalesce(w_dense / (RRF_K + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(w_lex / (RRF_K + F.col("lex_rank")), F.lit(0.0))
    both = both.withColumn("rrf", F.round(rrf, 12))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("dense_rank").asc_nulls_last(), F.col("lex_rank").asc_nulls_last(), "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merge_aspects(hits: DataFrame, k: int) -> DataFrame:
    """``query_id, aspect, chunk_id, rank`` of sub-questions -> fused by the sum of 1 / (60 + rank).

    The payload of the first aspect (then rank) that found a chunk stays.
    """
    merged = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("rrf"), F.min(F.struct("aspect", "rank")).alias("_first"))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("_first.aspect"), F.col("_first.rank"), "chunk_id")
    return merged.withColumn("merged_rank", F.row_number().over(order)).filter(F.col("merged_rank") <= k).select("query_id", "chunk_id", "rrf", F.col("_first.aspect").alias("aspect"), "merged_rank")


def round_robin(hits: DataFrame, k: int) -> DataFrame:
    """First of each aspect, then second, and so on; a chunk counts once."""
    once = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "aspect")
    kept = hits.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy("rank", "aspect", "chunk_id")
    return kept.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= k)


def rerank(hits: DataFrame, score: str, k: int, floor: float) -> DataFrame:
    """Order by an injected score, cut to k, and only then drop what is below the floor."""
    return top(hits, score, k, "rerank_rank").filter(F.col(score) >= floor)


def reserve(hits: DataFrame, flag: str, rank: str, k: int) -> DataFrame:
    """A third of k (one at least) for flagged rows, the rest by rank."""
    flagged = Window.partitionBy("query_id", flag).orderBy(rank)
    first = F.col(flag) & (F.row_number().over(flagged) <= max(1, k // 3))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("_first"), 0).otherwise(1), rank)
    return hits.withColumn("_first", first).withColumn("reserved_rank", F.row_number().over(order)).filter(F.col("reserved_rank") <= k).drop("_first")


def surrounding(anchors: DataFrame, chunks: DataFrame, radius: int = 1, limit: int = 50) -> DataFrame:
    """Chunks of the anchors' documents and generations within ``radius`` ordinals, nearest first."""
    near = chunks.alias("c").join(
        anchors.alias("a"),
        (F.col("c.doc_id") == F.col("a.doc_id")) & F.col("c.generation").eqNullSafe(F.col("a.generation")) & F.col("c.ordinal").between(F.col("a.ordinal") - radius, F.col("a.ordinal") + radius),
    )
    rows = near.groupBy("a.query_id", "c.chunk_id", "c.doc_id", "c.ordinal").agg(F.min(F.abs(F.col("c.ordinal") - F.col("a.ordinal"))).alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "ordinal", "chunk_id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)


def source_order(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("doc_id", F.coalesce("ordinal", F.lit(1_000_000_000)), "chunk_id")
    return rows.withColumn("position", F.row_number().over(order))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    size = min(max(size, 1), 200)
    return df.orderBy(*order).offset(max(number, 0) * size).limit(size)
