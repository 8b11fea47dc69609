"""Exact, near, line and substring dedup against brute force, with odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from grainline.llm import decontaminate, exact_dedup, line_dedup, near_dedup, substring_dedup
from grainline.llm.queries import QUERIES

VOCABULARY = [f"w{i}" for i in range(300)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def near_copies(seed=1, n=60, length=120):
    rng = random.Random(seed)
    base = [rng.choice(VOCABULARY) for _ in range(length)]
    rows = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 60)))) for i in range(20)]
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 10)):
            words[rng.randrange(length)] = rng.choice(VOCABULARY)
        rows.append((100 + 3 * i, " ".join(words)))
    rng.shuffle(rows)
    return rows


ODD = [(1001, None), (1002, ""), (1003, " \n\t"), (1004, "one"), (1005, "ONE"), (1006, "two words"), (1007, "é É"), (1008, "É É"), (1004, "one"), (None, "one"), (None, "alone without an id"), (None, None)]


def test_exact_dedup(make):
    rows = ODD + near_copies()[:10]
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    for keep, pick in (("max", max), ("min", min)):
        found = exact_dedup.exact_dedup(make(rows), keep=keep).collect()
        expected = []
        for i, t in rows:
            own = groups[lower(t)]
            best = pick([x for x in own if x is not None], default=None)
            expected.append((i, best, len(own), i == best, hashlib.sha256(lower(t).encode()).hexdigest()))
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_exact_dedup_of_nothing_and_stage(make):
    assert exact_dedup.exact_dedup(make([])).count() == 0
    kept = exact_dedup.drop_copies(make(ODD), keep="max")
    assert kept.columns == make(ODD).columns
    texts = [lower(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lower(t) for _, t in ODD})


def components(rows):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if both and a < b and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("hot", [1, 16])
def test_near_dedup(make, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rows = near_copies() + ODD
    sets, expected = components([r for r in rows if r[0] is not None])
    found = near_dedup.near_duplicates(make(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    without = sorted((r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None and r.component_id is not None)
    assert without == [(1, 1004, False)]


def test_near_dedup_of_nothing(make):
    assert near_dedup.near_duplicates(make([])).count() == 0


def test_signature_distance_guarantee():
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << near_dedup.BITS, near_dedup.SYMBOLS).astype(np.uint64)
    limit = near_dedup.CHUNKS * 2 - 1
    for _ in range(200):
        b = a.copy()
        b[rng.choice(near_dedup.SYMBOLS, limit, replace=False)] ^= np.uint64(1)
        x, y = near_dedup.multi_index_keys(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())


def removed_bytes(rows):
    seen, result = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (t or "").encode()
        cover = bytearray(len(data))
        for s in range(len(data) - 99):
            if seen.setdefault(data[s : s + 100], (i, s)) != (i, s):
                cover[s : s + 100] = b"\1" * 100
        result[i] = data, cover
    return result


def test_substring_dedup(make):
    rng = random.Random(2)
    passage = " ".join(rng.choice(VOCABULARY) for _ in range(60))
    rows = near_copies(n=8) + [(5000 + i, f"{i} {passage[i:]} {rng.random()}") for i in range(12)]
    rows += [(6000, "abcab " * 100), (6001, "x" * 350), (6002, "é" * 80), (6003, "x" * 99), *[r for r in ODD if r[0] != 1004], (7000, passage), (7000, passage), (7001, passage)]
    expected = removed_bytes([r for r in rows if r != (7000, passage)] + [(7000, passage)])
    found = substring_dedup.repeated_spans(make(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert not r.spans
            continue
        data, cover = expected[r.doc_id]
        mine = bytearray(len(data))
        for s in r.spans:
            mine[s.start : s.end] = b"\1" * (s.end - s.start)
        assert bytes(mine) == bytes(cover), r.doc_id
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
        kept = bytes(c for c, x in zip(data, cover, strict=True) if not x)
        assert (r.n_bytes, r.kept_sha256) == (len(data), hashlib.sha256(kept).hexdigest())


def test_substring_dedup_of_nothing(make):
    assert substring_dedup.repeated_spans(make([])).count() == 0


def test_line_dedup(make):
    rng = random.Random(4)
    lines = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.choice((1, 2, 8, 30, 50)))) for _ in range(40)]

    def edited(line):
        words = line.split()
        if len(words) > 20 and rng.random() < 0.5:
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        return " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)

    rows = [(i * 7 % 101, "\n".join(edited(rng.choice(lines)) for _ in range(rng.randint(0, 6)))) for i in range(90)]
    rows += [(500, None), (501, "\n\n"), (None, lines[0])]
    sets, expected = [], {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        out = []
        for n, line in enumerate((t or "").split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", lower(line))
            if not words:
                continue
            own = set(zip(words, words[1:], strict=False)) or {tuple(words)}
            if any(100 * len(own & s) >= 85 * len(own | s) for s in sets):
                out.append(n)
            sets.append(own)
        expected[i] = out
    found = line_dedup.repeated_lines(make(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.removed == (expected[r.doc_id] if r.doc_id is not None else [])
    assert sum(map(len, expected.values())) > 50


def test_line_dedup_of_nothing(make):
    assert line_dedup.repeated_lines(make([])).count() == 0


def test_line_query_takes_single_words(spark, make, tmp_path):
    words = [f"k{i}" for i in range(14)]
    lines = [words, words[:6] + ["other"] + words[7:], words[::-1], words[:12] + ["a", "b"], ["x", "y", "z"], ["x", "y", "q"], ["Z", "y", "x", "x"]]
    rows = [(1, "\n".join(" ".join(w) for w in lines)), (2, " ".join(words[1:] + ["more"]))]
    rng = random.Random(6)
    base = [[rng.choice(VOCABULARY) for _ in range(rng.randint(5, 40))] for _ in range(25)]
    for i in range(60):
        own = list(rng.choice(base))
        own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        rows.append((10 + i, " ".join(rng.sample(own, len(own)) if rng.random() < 0.3 else own)))
    sets, expected = [], {}
    for i, t in rows:
        expected[i] = []
        for n, own in enumerate(set(lower(x).split()) for x in t.split("\n")):
            if any(100 * len(own & s) >= 85 * len(own | s) for s in sets):
                expected[i].append(n)
            sets.append(own)
    assert (expected[1], expected[2]) == ([1, 2, 6], [0])
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_removed, r.removed_sha256) for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert found == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in expected.items()}


class Table:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("frequent, tried, level", [(80, 4, 10), (80, 4, 90), (60, 1, None), (20, 1, None)])
def test_line_keys_miss_no_like_pair(monkeypatch, frequent, tried, level):
    """Frequent words, hot keys and few first tries: all like pairs are found in the end, equal lines at once."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(line_dedup, "KEPT", tried)
    monkeypatch.setattr(line_dedup, "HELD", 50)
    monkeypatch.setattr(line_dedup, "BUCKET", 40)
    rng = random.Random(9)
    base = [[rng.choice(VOCABULARY[:80]) for _ in range(rng.choice((1, 3, 6, 7, 14, 30, 60)))] for _ in range(20)]
    lines = []
    for _ in range(300):
        own = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            own[rng.randrange(len(own))] = rng.choice(VOCABULARY)
        lines.append(" ".join(own))
    rarity = np.full(line_dedup.SLOTS, level, np.uint8) if level else np.random.default_rng(3).integers(9, 100, line_dedup.SLOTS).astype(np.uint8)
    ids = list(range(300))
    rng.shuffle(ids)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 60]), pa.array(lines[k : k + 60])], names=["_doc", "_text"]) for k in range(0, 300, 60)]
    dealt = pa.Table.from_batches(list(line_dedup._deal(Table(rarity), line_dedup.WORD, 3)(iter(batches)))).sort_by("_bucket").combine_chunks().to_batches()

    found = [tuple(r.values()) for b in line_dedup._candidates(iter(dealt)) for r in b.to_pylist()]
    gone = {r[0] for r in found if r[0] is not None and r[2] is None}
    pairs, more = {(r[0], r[2]) for r in found if r[2] is not None}, {r[0] for r in found if r[4]}
    aside = pa.RecordBatch.from_arrays([pa.array([r[k] for r in found if r[5] is not None], t) for k, t in ((5, pa.int64()), (6, pa.binary()))], names=["_n", "_blob"])
    everything = Table(np.full(line_dedup.NEED_BITS // 64, ~np.uint64(0)))
    rest = {(r["_doc"], r["_odoc"]) for b in line_dedup._all_pairs(everything)(iter([aside])) for r in b.to_pylist()}
    sets = {i: frozenset(t.split()) for i, t in zip(ids, lines, strict=True)}
    firsts = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    like = {(a, b) for a in sets for b in sets if b < a and firsts[sets[a]] == a and firsts[sets[b]] == b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert gone == {i for i, s in sets.items() if firsts[s] != i}
    missed = {p for p in like - pairs if p[0] not in {a for a, _ in like & pairs}}
    assert {a for a, _ in missed} <= more
    assert like <= pairs | rest
    assert len(like) > 100


def test_only_lines_in_doubt_look_about_in_a_hot_key(monkeypatch):
    """Of a key that 400 lines share, the two in doubt meet the others: 400 pairs each are weighed, not 400 * 399 / 2."""
    import numpy as np
    import pyarrow as pa

    n, size, weighed = 400, 20, []
    doc, line, zero = np.arange(n)[::-1], np.zeros(n, np.int64), np.zeros(n, np.int64)
    records = np.stack([zero + 7, zero, zero, zero, (doc << 32) | line, doc, zero + (size << 32)])
    table = np.zeros(line_dedup.NEED_BITS // 64, np.uint64)
    for d in (399, 200):
        at = int(line_dedup._line_hash(np.array([d]), np.array([0]))[0] & np.uint64(line_dedup.NEED_BITS - 1))
        table[at >> 6] |= np.uint64(1) << np.uint64(at & 63)
    required = line_dedup.required
    monkeypatch.setattr(line_dedup, "required", lambda total: weighed.append(len(total)) or required(total))
    aside = pa.RecordBatch.from_arrays([pa.array([n]), pa.array([line_dedup.pack(records)])], names=["_n", "_blob"])
    found = list(line_dedup._all_pairs(Table(table))(iter([aside])))
    pairs = [(r["_doc"], r["_odoc"]) for b in found for r in b.to_pylist()]
    assert sorted(pairs) == sorted((late, early) for late in (399, 200) for early in range(late))
    assert sum(weighed) <= 2 * n
    assert len(found) == 1


def test_substring_dedup_of_hot_hashes(make):
    """String by string instead of slice by slice: the same result."""
    rng = random.Random(8)
    passage = " ".join(rng.choice(VOCABULARY) for _ in range(40))
    rows = [(i, f"{' '.join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 9)))} {passage} {rng.random()}") for i in range(40)] + [(100, "x" * 900), (101, "x" * 900 + "y"), (102, passage * 3)]
    keep = lambda df: sorted((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), r.kept_sha256) for r in df.collect())
    plain, hot = (keep(substring_dedup.repeated_spans(make(rows), hot_slices=n)) for n in (10**9, 0))
    assert plain == hot
    expected = removed_bytes(rows)
    for doc, n, spans, _ in hot:
        mine = bytearray(n)
        for a, b in spans:
            mine[a:b] = b"\1" * (b - a)
        assert bytes(mine) == bytes(expected[doc][1]), doc


LONG = " ".join(f"word{i % 977} {i}" for i in range(150_000))


def test_very_long_texts_ties_and_repeated_rows(make):
    """Texts beyond the blocks that numpy works on, as rows that repeat and tie."""
    rows = [(5, LONG), (5, LONG), (3, LONG.upper()), (9, LONG + " tail"), (1, "short"), (None, LONG)]
    assert len(LONG) > 1 << 21
    exact = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(make(rows), keep="max").collect()}
    assert exact == {(5, 5, 4, True), (3, 5, 4, False), (None, 5, 4, False), (9, 9, 1, True), (1, 1, 1, True)}
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(make(rows)).collect()) == [1, 5, 9]
    near = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert near == {(5, 3, False), (3, 3, True), (9, 3, False), (1, 1, True), (None, 3, False)}
    lines = {r.doc_id: r.removed for r in line_dedup.repeated_lines(make(rows), gram=line_dedup.WORD).collect()}
    assert lines == {5: [0], 3: [], 9: [0], 1: [], None: []}
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in substring_dedup.repeated_spans(make([r for r in rows if r[0] != 3])).collect()}
    assert spans == {5: [], 9: [(0, len(LONG))], 1: [], None: []}


def test_clashing_columns_pass_through(spark, make):
    """Columns of the names that operators use inside come out as they went in."""
    names = ("_row", "_no", "_key", "_dig", "_nth", "_own", "_kept", "_clean", "_vsha_own", "_vid", "_rid", "_sha", "_best", "_run", "_part")
    rows = make(near_copies(n=4)[:12] + ODD).withColumns({c: F.lit(c) for c in names})
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    pipeline = pytest.importorskip("corpus_pipeline")
    for kept in (exact_dedup.drop_copies(rows), decontaminate.drop_contaminated(rows, bench), pipeline.drop_near_copies(spark, rows, "")):
        assert kept.columns == rows.columns and kept.schema == rows.schema
        assert all(r[c] == c for r in kept.collect() for c in names)
    for found in (line_dedup.repeated_lines(rows), near_dedup.near_duplicates(rows), substring_dedup.repeated_spans(rows), exact_dedup.exact_dedup(rows)):
        assert found.count() == rows.count()
