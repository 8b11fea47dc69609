"""Two readings aligned: every window compared, against seeds and bounds."""

import random
from difflib import SequenceMatcher

from grainline.operators import alignment as A


def every_window(page, line):
    """The best window by comparing all of them."""
    wanted = [w for w, _, _ in A.words(line)]
    own = [w for w, _, _ in page.words]
    if len(wanted) == 1:
        at = [i for i, w in enumerate(own) if w == wanted[0]]
        return (at[0], at[0] + 1) if len(at) == 1 and not page.taken[at[0]] else None
    found = []
    for size in range(max(2, len(wanted) - 2), len(wanted) + 3):
        for start in range(len(own) - size + 1):
            if not page.taken[start : start + size].any():
                m = SequenceMatcher(None, wanted, own[start : start + size], autojunk=False)
                matched = sum(b.size for b in m.get_matching_blocks())
                if matched >= 2 and matched / len(wanted) >= 0.65 and m.ratio() >= 0.65:
                    found.append((m.ratio(), matched, -abs(size - len(wanted)), -start, start + size))
    return (-max(found)[3], max(found)[4]) if found else None


def test_windows_are_the_best_of_all():
    draw = random.Random(6)
    for _ in range(400):
        page = A.Page(" ".join(draw.choices(["aa", "bb", "cc", "dd", "ee", "x", "cid1"], k=draw.randint(0, 30))))
        for _ in range(4):
            line = " ".join(draw.choices(["aa", "bb", "cc", "dd", "zz"], k=draw.randint(0, 7)))
            want = every_window(page, line) if A.words(line) else None
            got = page.like(line)
            assert (got and got[:2]) == want, (page.text, line)
            if got:
                page.taken[got[0] : got[1]] = True


def placed(spark, rows):
    pages = spark.createDataFrame(rows, "page long, text string, lines array<string>")
    return {(r.page, r.line_no): (r.start, r.end, r.how) for r in A.aligned(pages, ["page"]).collect()}


def test_lines_take_their_places(spark):
    text = "Total amount due\nNet price: 12.50 EUR\nTotal amount due\nThe quick brown fox jumps over a lazy dog"
    lines = ["TOTAL  amount-due", "Total amount due", "Total amount due", "Net price 12.50", "quick brwn fox jumps over the lazy", "unrelated words here", "a"]
    found = placed(spark, [(1, text, lines)])
    assert {no: text[a:b] for (_, no), (a, b, _) in found.items()} == {0: "Total amount due", 1: "Total amount due", 2: "Total amount due", 3: "Net price: 12.50", 4: "quick brown fox jumps over a lazy"}
    assert found[1, 0][0] == 0 and found[1, 1][0] == 38 and found[1, 2][2] == "words" and found[1, 4][2] == "words" and found[1, 3][2] == "letters"


def test_odd_pages(spark):
    rows = [(1, None, ["a b"]), (2, "", ["a"]), (3, "some words", None), (4, "some words", []), (5, "some words", [None, "", "!!", "some words"]), (6, "é " * 30000 + "straße mit", ["STRASSE mit"])]
    assert placed(spark, rows) == {(5, 3): (0, 10, "letters"), (6, 0): (60000, 60010, "letters")}
    assert placed(spark, [(1, "x", ["x"])][:0]) == {}


def test_edited_copies_of_documents_find_their_lines(spark, sf):
    from grainline.plans.registry import QUERIES

    rows = QUERIES["page_alignment"](spark, sf).collect()
    assert len({(r.doc_id, r.page, r.line_no) for r in rows}) == len(rows)
    assert {r.how for r in rows} == {"letters", "words"} and min(r.ratio for r in rows) >= A.LIKE
    # words at one place answer to one line of each kind of finding
    for how in ("letters", "words"):
        spans = sorted((r.doc_id, r.page, r.start, r.end) for r in rows if r.how == how)
        assert all(a[:2] != b[:2] or a[3] <= b[2] for a, b in zip(spans[:-1], spans[1:], strict=True))


def test_pages_are_shuffled_once_and_whole(spark, sf):
    from grainline.plans.registry import QUERIES

    plan = QUERIES["page_alignment"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # no row for a word, and nothing is gathered
    assert "posexplode" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1


def test_seeds_in_order_need_no_comparison(monkeypatch):
    asked = []
    matcher = A.SequenceMatcher
    monkeypatch.setattr(A, "SequenceMatcher", lambda *a, **k: asked.append(a) or matcher(*a, **k))
    page = A.Page("one two thre four five six seven eight nine")
    assert page.like("two three four five six") == (1, 6, 0.8) and not asked
    assert page.like("two four six five eight") and asked


def test_letters_fold_and_stand_where_they_were():
    for text in ("", "Straße-1 é", "\u0130x \U0001d400 \ufb03 a-b", "\ud800a"):
        kept = [(f, i) for i, c in enumerate(text) if c.isalnum() for f in c.casefold()]
        found, at = A.letters(text)
        assert (found, at.tolist()) == ("".join(f for f, _ in kept), [i for _, i in kept])
