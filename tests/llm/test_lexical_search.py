"""op13: MaxScore over shards against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from grainline.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 10 + (90 * bag.total() * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return rows


def tidy(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("shard,block", [(1 << 24, 1_000_000), (700, 9)])
def test_search_is_brute_force(spark, make, shard, block):
    draw = random.Random(5)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)] + ["Été", "ÉTÉ", "été", "日本語", "X1", "x1"]
    docs = [(i, " ".join(draw.choices(words, k=draw.choice([1, 5, 40, 200])))) for i in range(150)]
    docs += [(900, docs[3][1]), (901, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (902, None), (903, ""), (904, "... --- !"), (905, "w1 " * 30000 + "rare")]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([1, 3, 30])))) for i in range(25)] + [(7, "Rare w1"), (None, "w2 été"), (50, None), (51, "?!"), (52, "nowhere")]
    table = spark.createDataFrame(items, "item_id long, text string")
    index = S.build_index(make(docs).repartition(3), shard_bytes=shard)
    found = S.search(index, table, block_terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert tidy(found.collect()) == tidy(brute(docs, items))


def test_lists_are_skipped_and_nothing_is_lost():
    draw = random.Random(1)
    texts = [" ".join(["common"] * draw.randint(1, 3) + ["filler"] * draw.randint(1, 30)) for _ in range(500)]
    for i in range(0, 500, 25):
        texts[i] += " needle"
    row = S.shard_index(list(range(500)), [t.encode() for t in texts])
    block = S.Block([(1, [b"common", b"filler", b"needle"])], 0)
    index_df = {block.number[b"common"]: 500, block.number[b"filler"]: 500, block.number[b"needle"]: 20}
    block.weigh(index_df, 500, sum(len(t.split()) for t in texts))
    opened = S.Shard(row, block)
    read = []
    whole = opened.postings
    opened.postings = lambda t: read.append(t) or whole(t)
    for term in block.terms[0]:
        assert opened.bound[term] == whole(int(term))[1].max()
    places, scores = opened.best(block.terms[0], 10, 1)
    best = sorted(zip((-scores).tolist(), places.tolist(), strict=True))[:10]
    assert [(1, r, p, -s) for r, (s, p) in enumerate(best, 1)] == brute(list(enumerate(texts)), [(1, "common filler needle")])
    # the rare term's list alone is essential
    assert len(places) <= 20 and read[0] == block.number[b"needle"]


def test_empty_tables(spark, make):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.ranked(make([]), items).collect() == []
    assert S.ranked(make([(1, "a")]), items.limit(0)).collect() == []
    assert S.ranked(make([(1, None)]), items).collect() == []


def test_columns_of_any_name_and_text_ids(spark, make):
    items = spark.createDataFrame([("x", "alpha", 1)], "item_id string, text string, score int")
    found = S.ranked(make([(1, "alpha beta"), (2, "beta")]), items)
    assert [tuple(r)[:3] for r in found.collect()] == [("x", 1, 1)]


def test_a_stored_shard_is_a_file_of_its_own(spark, make):
    import glob

    docs = make([(i, f"word{i} " * 30) for i in range(40)]).coalesce(1)
    stored = S.Stored(S.build_index(docs, shard_bytes=500), most=1)
    shards = stored.df.count()
    assert shards > 5 and len(glob.glob(stored.path.removeprefix("file:") + "/part-*.parquet")) == shards
    items = spark.createDataFrame([(1, "word7")], "item_id long, text string")
    assert [r.doc_id for r in S.search(stored.df, items).collect()] == [7]
    stored.drop()
