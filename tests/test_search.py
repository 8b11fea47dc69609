"""Tiles and blocks: how they are dealt out, sums over shared terms, and what is kept from tile to tile."""

import inspect

import numpy as np
import pytest

from grainline.operators import cover_density, search


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tiles_of_one_key_are_dealt_out(unbroadcast, monkeypatch):
    monkeypatch.setattr(search, "TILE", 16)
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(640, 4))
    corpus = unbroadcast.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, vector array<double>")
    queries = unbroadcast.createDataFrame([(i, vectors[i].tolist()) for i in range(30)], "query_id long, qvec array<double>")
    key = search.F.lit(7).cast("long")
    found = search._best(corpus, queries, 5, search.cosines, lambda tile, block: True, 8, key, search.F.array(key))
    assert found.select(search.F.spark_partition_id()).distinct().count() > 2
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    best = np.argsort(-(unit[:30] @ unit.T), axis=1)[:, :5]
    rows = search.nearest(corpus, queries, 5, lambda tile, block: True, key, search.F.array(key)).collect()
    assert sorted((r.query_id, r.dense_rank, r.chunk_id) for r in rows) == [(q, r + 1, int(c)) for q in range(30) for r, c in enumerate(best[q])]


def test_bar_keeps_the_best_of_all_tiles_and_ties():
    draw = np.random.default_rng(2)
    for k in (1, 3, 8):
        bar, kept, seen = search.Bar(4, k), [[] for _ in range(4)], []
        for n in (1, 2, 30, 7, 50):
            scores = draw.integers(0, 12, size=(4, n)).astype(float)
            scores[draw.random((4, n)) < 0.3] = -np.inf
            seen.append(scores.copy())
            for r, a in zip(*bar.places(scores), strict=True):
                kept[r].append(scores[r, a])
        for row, every in enumerate(np.concatenate(seen, axis=1)):
            every = sorted(every[np.isfinite(every)], reverse=True)
            assert sorted(kept[row], reverse=True)[:k] == every[:k]
            least = every[min(k, len(every)) - 1]
            assert kept[row].count(least) == every.count(least)


def test_lexical_sums_are_the_product():
    import pyarrow as pa

    draw = np.random.default_rng(3)
    kind = pa.list_(pa.struct([("t", pa.int64()), ("w", pa.float64())]))
    table = lambda n, terms: [[{"t": int(t), "w": float(draw.random() + 0.1)} for t in draw.permutation(terms)[: draw.integers(0, 9)]] for _ in range(n)]
    for terms in (3, 40, 4000):
        tile, block = table(300, terms), table(70, terms)
        whole = np.array([[sum(a["w"] * b["w"] for a in q for b in c if a["t"] == b["t"]) for c in tile] for q in block])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, kind)], names=["id", "terms"])
        scores = search._lexical(batch(tile), batch(block))
        assert np.allclose(np.where(np.isfinite(scores), scores, 0), whole) and (np.isfinite(scores) == (whole > 0)).all()


def test_bare_alternatives_need_no_places(spark, monkeypatch):
    asked = []
    whole = cover_density.positional_postings
    monkeypatch.setattr(cover_density, "positional_postings", lambda corpus, terms, term: asked.append([r.term for r in terms.collect()]) or whole(corpus, terms, term))
    corpus = spark.createDataFrame([(i, "red " * (i % 5) + "blue green") for i in range(40)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "red OR blue"), (2, '"blue green"')], "query_id long, qtext string")
    rows = [tuple(r) for r in cover_density.cover_density(corpus, queries, 3).orderBy("query_id", "lex_rank").collect()]
    assert sorted(asked[0]) == ["blue", "green"]
    assert rows == [(1, 4, 0.5, 1), (1, 9, 0.5, 2), (1, 14, 0.5, 3), (2, 0, 0.1, 1), (2, 1, 0.1, 2), (2, 2, 0.1, 3)]


def test_tables_of_a_query_do_not_grow_with_the_chunks(spark):
    from grainline.plans.registry import QUERIES

    composites = inspect.getmodule(inspect.unwrap(QUERIES["retrieve_chunks"]))

    asked = spark.range(0, 1200, 60).select(search.F.col("id").alias("query_id"), (search.F.col("id") % 100).alias("_class"))
    found = composites._lists(asked, spark.range(8000).select(search.F.col("id").alias("chunk_id"))).collect()
    most = composites.POOL + composites.K
    for q in range(0, 1200, 60):
        own = [r.chunk_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.position)]
        every = list(range(0, 8000, 20))
        best = sorted(every, key=lambda c: (-((c * 7919 + q) % 100), c))
        assert own == sorted({*every[:most], *best[:most]}) and len(own) <= 2 * most


def test_a_first_tile_is_cut_before_it_is_laid_out():
    import tracemalloc

    import numpy as np

    from grainline.operators import search

    scores = np.random.default_rng(1).normal(size=(200, 2000)).round(2)
    bar, want = search.Bar(200, 3), search.best_places(scores, 3)
    tracemalloc.start()
    row, at = bar.places(scores)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(row, at, strict=True)) == sorted(zip(*want, strict=True)) and peak < 4 * scores.nbytes


def test_a_block_meets_a_tile_by_parts_and_a_batch_goes_before_the_next():
    import weakref

    import numpy as np
    import pyarrow as pa

    from grainline.operators import search

    rng = np.random.default_rng(2)
    vectors, asked = rng.normal(size=(300, 8)), rng.normal(size=(100, 8))

    def blob(ids, rows):
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()

    sizes, earlier, kept = [], [], []

    def score(tile):
        scored = search.cosines(tile)
        return lambda block: sizes.append(block.num_rows) or scored(block)

    def batches():
        for low in range(0, 300, 100):
            kept.extend(w for w in earlier if w() is not None)
            batch = pa.RecordBatch.from_arrays([pa.array([blob(np.arange(low, low + 100), vectors[low : low + 100])]), pa.array([blob(np.arange(100), asked)])], names=["_tile", "_block"])
            earlier.append(weakref.ref(batch))
            yield batch
            del batch

    may = lambda tile, block: np.add.outer(np.arange(block.num_rows), tile.column(0).to_numpy()) % 3 > 0
    rows = [r for b in search._meeting(3, score, may, 16 * search.TILE)(batches()) for r in b.to_pylist()]
    assert max(sizes) == 16 and sum(sizes) == 300 and not kept
    exact = search.numbers(pa.array(asked.tolist()), 100) @ search.numbers(pa.array(vectors.tolist()), 300).T
    for q in range(100):
        seen = [c for c in range(300) if (q + c) % 3 > 0]
        best = sorted(seen, key=lambda c: -exact[q, c])[:3]
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: -r["score"])[:3]
        assert [r["chunk_id"] for r in own] == best


def test_queries_of_a_key_come_in_groups_and_rows_go_to_each(unbroadcast, monkeypatch):
    monkeypatch.setattr(search, "HELD", 7)
    monkeypatch.setattr(search, "TILE", 16)
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(300, 4))
    corpus = unbroadcast.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)], "chunk_id long, vector array<double>, kind long")
    queries = unbroadcast.createDataFrame([(i, vectors[i].tolist()) for i in range(40)], "query_id long, qvec array<double>")
    key = search.F.col("kind")
    rows = search.nearest(corpus, queries, 5, lambda tile, block: True, key, search.F.array(*[search.F.lit(i).cast("long") for i in (0, 2)])).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    seen = np.flatnonzero(np.arange(300) % 3 != 1)
    best = seen[np.argsort(-(unit[:40] @ unit[seen].T), axis=1)[:, :5]]
    assert sorted((r.query_id, r.dense_rank, r.chunk_id) for r in rows) == [(q, r + 1, int(c)) for q in range(40) for r, c in enumerate(best[q])]


def test_no_pair_of_a_tile_and_a_block_is_a_value(spark, sf):
    from grainline.plans.registry import QUERIES

    for name in ("hybrid_search", "channel_overlap", "hybrid_cover_density"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "_block" in plan and "_tile" not in plan


def test_terms_are_counted_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(search, "WORDS", 5)
    texts = ["red red blue", None, "", "blue green " * 4, "red"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    hashes = {w: spark.range(1).select(search.F.xxhash64(search.F.lit(w))).first()[0] for w in ("red", "blue", "green")}
    own = search.frequencies(corpus)
    assert {r.t: (r.df, r.tf) for r in own.collect()} == {hashes["red"]: (2, 3), hashes["blue"]: (2, 5), hashes["green"]: (1, 4), search.WHOLE: (5, 12)}
    assert "Generate" not in own._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.chunk_id: np.frombuffer(r.terms, search.TERM).tolist() for r in search.counted(corpus).collect()}
    assert rows == {i: sorted((hashes[w], (t or "").split().count(w)) for w in {*(t or "").split()}) for i, t in enumerate(texts)}
