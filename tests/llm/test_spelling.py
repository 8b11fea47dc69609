"""op11: the pigeonhole join against comparing all words, and forms against following them by hand."""

import random
import re
import zlib
from collections import Counter

import pytest

from grainline.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def edit(a, b):
    """Whether one inserted, deleted or replaced letter parts the words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(n):
    near = {w: [v for v in n if edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def tidy(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("hot", [1, 3, 32])
def test_variants_are_brute_force(spark, hot):
    draw = random.Random(hot)
    words = {"".join(draw.choices("abé", k=draw.randint(7, 10))) for _ in range(250)} | {"prefix" + "".join(draw.choices("xyzàÀ", k=draw.randint(1, 6))) for _ in range(150)}
    words |= {"a" * k for k in range(7, 13)} | {"ab" * 4, "ba" * 4, "ab" * 4 + "a", "z" * 3000, "z" * 2999 + "y", "z" * 3001}
    n = {w: draw.choice([2, 3, 20, 20, 30, 250, 4000, 50000]) for w in words}
    found = S.variants(spark.createDataFrame(list(n.items()), "word string, n long"), hot=hot)
    assert tidy(found) == brute(n)


def test_all_words_of_one_beginning(spark):
    """A key that all words share is refined, and nothing is lost."""
    draw = random.Random(4)
    words = {"common" + "".join(draw.choices("abcdefgh", k=4)) for _ in range(1500)}
    pairs = S.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), hot=8).collect()
    assert sorted(tuple(sorted((r.a, r.b))) for r in pairs) == sorted((a, b) for a in words for b in words if a < b and edit(a, b))


def test_chains_of_forms(spark):
    n = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20000, "aaabbbbb": 200000, "aabbbbbb": 2000000}
    found = {r.word: r.root for r in S.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert set(found.values()) == {"aabbbbbb"}


def test_documents_are_brute_force(spark, make):
    draw = random.Random(2)
    words = ["Testing", "testing", "TESTING", "restings", "Étéétéété", "étéétéété", "straße×÷x", "spelling", "speling's", "spellling", "short", "a1b2c3d", "naïveté-naïveté"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 60)))) for i in range(120)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[6][1]), (700, None), (701, ""), (702, "longword" * 20000 + " " + "longword" * 20000)]
    assert tidy(S.spelling_variants(make(docs))) == brute(counted(docs))


def test_empty(spark, make):
    assert S.spelling_variants(make([])).collect() == []
    assert S.spelling_variants(make([(1, None), (2, "once only here")])).collect() == []
