"""The inverted index: recall under permissions, exact answers for few, odd rows."""

import math

import numpy as np
import pytest

from grainline.operators import ann, search

VECTORS = "chunk_id long, vector array<double>, tenant long, owner long, visibility string, scope string, acl array<long>"
ASKED = "query_id long, qvec array<double>, q_tenant long, q_user long, q_role string"


def circle(n, owner):
    return [(i, [math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n), 0.05], 0, owner(i), "private", "tenant", []) for i in range(n)]


def test_selective_readers_on_a_circle(spark):
    owner = lambda i: 0 if i % 400 == 0 else 1 if i % 10 == 0 else 2
    vectors = spark.createDataFrame(circle(4000, owner), VECTORS)
    asked = [(3 * q + u, [math.cos(q * 0.2 + 0.001), math.sin(q * 0.2 + 0.001), 0.05], 0, u, "member") for q in range(12) for u in range(3)]
    queries = spark.createDataFrame(asked, ASKED)
    found = ann.ann_topk(ann.build(vectors), queries, 10, exact_below=100).cache()
    rows = ann.recall(found, search.dense_topk(vectors, queries, 10), search.F.col("query_id") % 3).collect()
    assert {r.slice for r in rows} == {0, 1, 2} and all(r.recall >= 0.95 and r.relevant == 120 for r in rows)
    work = {r.query_id: (r.scored, r.probes) for r in found.select("query_id", "scored", "probes").distinct().collect()}
    # few readable ones aren't searched but joined; the others read a small part of the lists
    assert all(work[3 * q] == (10, 0) for q in range(12))
    assert max(work[3 * q + u][0] for q in range(12) for u in (1, 2)) < 2000


def test_all_lists_are_the_exact_search(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).tolist(), i % 2, i % 5, ["private", "tenant", "shared"][i % 3], "global" if i % 40 == 0 else "tenant", [i % 4]) for i in range(600)]
    vectors = spark.createDataFrame(rows, VECTORS)
    queries = spark.createDataFrame([(i, draw.normal(size=8).tolist(), i % 3, i % 5, "admin" if i % 7 == 0 else "member") for i in range(40)], ASKED)
    index = ann.build(vectors, lists=5)
    every = ann.Inverted(index.table, index.centroids, index.size, {})
    keep = ["query_id", "chunk_id", "score", "dense_rank"]
    truth = sorted(map(tuple, search.dense_topk(vectors, queries, 7).select(*keep).collect()))
    assert sorted(map(tuple, ann.ann_topk(every, queries, 7, exact_below=0).select(*keep).collect())) == truth
    assert sorted(map(tuple, ann.ann_topk(index, queries, 7, exact_below=10**6).select(*keep).collect())) == truth


def test_widening_goes_on_until_enough_is_readable(spark):
    vectors = spark.createDataFrame(circle(2000, lambda i: 0 if i == 1000 else 1), VECTORS)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.05], 0, 0, "member")], ASKED)
    found = ann.ann_topk(ann.build(vectors), queries, 10, exact_below=0).collect()
    # the one readable vector lies opposite: all lists are taken, and it is found
    assert [(r.chunk_id, r.scored, r.probes) for r in found] == [(1000, 2000, 45)]


def test_odd_rows(spark):
    rows = [*circle(50, lambda i: 1), (90, None, 0, 1, "private", "tenant", []), (91, [], 0, 1, "private", "tenant", []), (92, [0.0, 0.0, 0.0], 0, 1, "private", "tenant", []), (93, [1.0, 0.0], 0, 1, "private", "tenant", None)]
    vectors = spark.createDataFrame(rows, VECTORS)
    index = ann.build(vectors)
    assert sorted(r.chunk_id for r in index.table.collect()) == [*range(50), 92]
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.05], 0, 9, "member")], ASKED)
    assert ann.ann_topk(index, queries, 3).collect() == []
    empty = ann.build(vectors.limit(0))
    assert ann.ann_topk(empty, queries, 3).collect() == []


@pytest.mark.parametrize("same", [True, False])
def test_cached_answers_compare_whole_keys(same):
    import pyarrow as pa

    from grainline.operators.answers import _same

    block = lambda names: pa.RecordBatch.from_arrays([pa.array(range(len(names))), pa.array(range(len(names))), pa.array(names)], names=["a", "b", "c"])
    found = _same(block(["x", "y"]), block(["y", "z"] if same else ["q"]))
    assert found.tolist() == ([[False, True], [False, False]] if same else [[False, False]])


def test_a_query_goes_to_a_part_once_and_keeps_its_best_there(spark):
    draw = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, draw.normal(size=6).tolist(), 0, i % 2, "private", "tenant", []) for i in range(3000)], VECTORS)
    index = ann.build(vectors, lists=200)
    some = search.F.array(*[search.F.lit(i) for i in range(200) if i % 5])
    asked = spark.createDataFrame([(i, draw.normal(size=6).tolist(), 0, i % 2, "member") for i in range(30)], ASKED).withColumn("_now", some)
    rows = ann._met(index.table.select("chunk_id", "vector", *ann.PERMISSIONS, "list_no"), asked, 10, 3000).collect()
    probed = [r for r in index.table.filter("list_no % 5 <> 0").select("chunk_id", "owner").collect()]
    hits, counts = [r for r in rows if r.chunk_id is not None], [r for r in rows if r.chunk_id is None]
    parts = 4 * spark.sparkContext.defaultParallelism
    # ten of each part, not of each list
    assert len(hits) <= 30 * parts * 10 < 30 * 160 * 10 and len(counts) <= 30 * parts
    for q in range(30):
        assert sum(r.scored for r in counts if r.query_id == q) == len(probed)
        assert sum(r.readable for r in counts if r.query_id == q) == sum(r.owner == q % 2 for r in probed)
    truth = search.dense_topk(vectors.join(index.table.select("chunk_id", "list_no"), "chunk_id").filter("list_no % 5 <> 0"), asked, 10)
    found = search.top(spark.createDataFrame(hits).withColumn("score", search.F.round("score", 12)), "score", 10, "dense_rank")
    keep = ["query_id", "chunk_id", "score", "dense_rank"]
    assert sorted(map(tuple, found.select(*keep).collect())) == sorted(map(tuple, truth.select(*keep).collect()))
