"""Boxes on pages against counting points; sections on a small document."""

import random

from grainline.operators import geometry as G
from grainline.operators import layout

BOX = "page long, x0 double, y0 double, x1 double, y1 double"


def test_union_counts_cells_once(spark):
    draw = random.Random(2)
    boxes = [(p, float(x), float(y), float(x + draw.randint(0, 6)), float(y + draw.randint(0, 6))) for p in range(8) for x, y in ((draw.randint(0, 9), draw.randint(0, 9)) for _ in range(draw.randint(1, 8)))]
    want = {}
    for p, x0, y0, x1, y1 in boxes:
        want.setdefault(p, set()).update((x, y) for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1)))
    found = {r.page: r.area for r in G.union_area(spark.createDataFrame(boxes, BOX), "page").collect()}
    assert found == {p: len(c) for p, c in want.items() if c}


def test_words_on_borders_of_cells_and_boxes(spark):
    boxes = spark.createDataFrame([(1, 64.0, 0.0, 128.0, 64.0), (1, 300.0, 300.0, 200.0, 200.0), (2, -10.0, -10.0, -5.0, -5.0)], BOX)
    at = [(1, 64.0, 64.0), (1, 63.9, 10.0), (1, 128.0, 0.0), (1, 250.0, 250.0), (1, 200.0, 300.0), (1, 301.0, 250.0), (2, 64.0, 0.0), (2, -5.0, -10.0), (3, 64.0, 0.0)]
    words = spark.createDataFrame([(p, n, x - 1, y - 1, x + 1, y + 1) for n, (p, x, y) in enumerate(at)], "page long, n int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.n for r in G.outside(words, boxes, "page").collect()) == [1, 5, 6, 8]


def test_scans_behind_text(spark):
    images = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 10.0, 10.0, 0.0, 0.0), (1, 3, 0.0, 0.0, 10.0, 4.9), (1, 4, -50.0, -50.0, 8.0, 50.0), (2, 5, 0.0, 0.0, 10.0, 10.0), (3, 6, 0.0, 0.0, 10.0, 10.0)]
    pages = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 10.0), (3, 0.0, 10.0)], "page long, w double, h double")
    chars = spark.createDataFrame([(1, x - 0.5, 4.0, x + 0.5, 5.0) for x in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 7.5, 8.0, 9.0)] + [(3, 1.0, 1.0, 2.0, 2.0)], BOX)
    table = spark.createDataFrame(images, "page long, image_id int, x0 double, y0 double, x1 double, y1 double")
    found = {r.image_id: r.backs for r in G.page_backings(table, pages, chars, "page").collect()}
    assert found == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}


ELEMENT = "doc_id long, order_no long, text string, page int, x0 double, y0 double, x1 double, y1 double, page_width double, font_size double, font_bold boolean, extractor string, layout_label string, section_path string, omission boolean"


def test_headings_hold_over_pages_until_the_next(spark):
    body = "plain words of body text that go on for more than ten words here"
    rows = [
        ("Annual report", 0, 10, 12.0), ("for all readers", 0, 22, 12.0), ("May 2020", 0, 24, 9.0), (body, 0, 50, 10.0), (body, 1, 10, 10.0), ("Costs", 1, 40, 10.6), (body, 1, 60, 10.0), ("PART TWO", 2, 10, 14.0), ("Details", 2, 22, 12.0),
        (body, 2, 40, 10.0), ("Not a heading.", 2, 60, 12.0), ("Other: no", 2, 80, 12.0), ("Later", 2, 100, 12.0), (body, 2, 120, 10.0),
    ]
    elements = [
        (1, n, text, page, 400.0 if text.startswith("May") else 150.0 if text.isupper() else 20.0, float(y), 470.0, y + 10.0, 480.0, size, size == 10.6, "pdf_text", None, "Book", False)
        for n, (text, page, y, size) in enumerate(rows)
    ]
    elements += [(1, 99, "gone", 3, 1.0, 1.0, 2.0, 2.0, 480.0, 12.0, False, "pdf_text", None, "Book", True), (1, 100, body, 4, 1.0, 1.0, 2.0, 2.0, 480.0, 10.0, False, "pdf_text", None, "Next", False), (2, 0, None, None, None, None, None, None, None, None, None, "pdf_text", None, None, None)]
    found = {(r.doc_id, r.order_no): (r.block_type, r.section_path) for r in layout.visible_sections(spark.createDataFrame(elements, ELEMENT)).collect()}
    first, costs, two, later = "Book > Annual report > for all readers", "Book > Costs", "Book > PART TWO > Details", "Book > PART TWO > Later"
    assert found == {
        (1, 0): ("heading", first), (1, 1): ("heading", first), (1, 2): (None, first), (1, 3): (None, first), (1, 4): (None, first), (1, 5): ("heading", costs), (1, 6): (None, costs), (1, 7): ("heading", two), (1, 8): ("heading", two),
        (1, 9): (None, two), (1, 10): (None, two), (1, 11): (None, two), (1, 12): ("heading", later), (1, 13): (None, later), (1, 100): (None, "Next"), (2, 0): (None, None),
    }


def plain_sections(elements, bodies):
    """Sections of sorted rows of ELEMENT, one row after the other; every text with letters in capitals or a large size is a heading here."""
    found, where, above, section, lines, waiting = {}, None, "", "", [], []

    def tell(e, heads):
        found[(e[0], e[1])] = ("heading" if heads else None, " > ".join(p for p in (e[13], section) if p) or None, "pdf_visible_heading" if section else None)

    def close():
        nonlocal section
        if lines:
            section = " > ".join(dict.fromkeys(p for p in (above, *lines) if p))
        for e, heads in waiting:
            tell(e, heads)
        lines.clear(), waiting.clear()

    for e in elements:
        doc, _, text, page, x0, y0, _, y1, width, size, bold, _, label, outline, _ = e
        if (doc, outline) != where:
            close()
            where, above, section = (doc, outline), "", ""
        body = bodies.get(doc, 0.0)
        heads = len(text.split()) <= 18 and x0 < 0.65 * width and (label == "title" or 0 < body and (size or 0.0) >= body * (1.05 if bold else 1.08))
        last = waiting[-1][0] if waiting else None
        near = last is not None and page is not None and last[3] == page
        if heads:
            if near and y0 - last[7] > max(8.0, (y1 - y0) * 0.75):
                close()
            if text.isupper() and len(text) >= 4 and x0 > 0.25 * width:
                close()
                above, section = text, ""
            lines.append(text)
            waiting.append((e, True))
        elif near and x0 > 0.65 * width and y0 <= last[7]:
            waiting.append((e, False))
        else:
            close()
            tell(e, False)
    close()
    return found


def test_sections_over_batches_are_folded_in_one_shuffle(spark, sf):
    from statistics import median

    from grainline.plans.registry import QUERIES

    draw = random.Random(7)
    body, rows = "plain words of body text that go on for more than ten words here", []
    for doc in range(40):
        outline, y = None, 0.0
        for n in range(draw.choice([1, 30, 60])):
            if draw.random() < 0.1:
                outline = draw.choice([None, "Book", "Part"])
            y = draw.choice([y + 12, y + 12, y, 0.0, y + 40])
            text = draw.choice([body, f"Costs {n}", f"Gains {n % 5}", "MAJOR", "Some more words", body + " and on until it is too long a text"])
            rows.append((doc, n, text, draw.choice([n // 9] * 9 + [None]), draw.choice([20.0, 20.0, 150.0, 400.0]), y, 470.0, y + 10, 480.0, draw.choice([10.0, 10.0, 10.5, 10.6, 12.0, None]), draw.random() < 0.2, "pdf_text", draw.choice([None] * 9 + ["title"]), outline, draw.random() < 0.1))
    sizes: dict[int, list[float]] = {}
    for e in rows:
        if len(e[2].split()) >= 10 and e[9]:
            sizes.setdefault(e[0], []).append(e[9])
    want = plain_sections([e for e in rows if not e[14]], {d: median(s) for d, s in sizes.items()})
    assert len({p for _, p, _ in want.values()}) > 50 and len(sizes) > 20
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, ELEMENT)
    for most in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            found = layout.visible_sections(table).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(found) == len(want) and {(r.doc_id, r.order_no): (r.block_type, r.section_path, r.section_source) for r in found} == want
    plan = QUERIES["visible_sections"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression") == plan.count("parquet") == plan.count("regexp_extract_all") == 1


def test_words_of_whole_pages_need_no_join(spark, sf):
    from grainline.plans.registry import QUERIES

    boxes = [(64.0, 0.0, 128.0, 64.0), (300.0, 300.0, 200.0, 200.0), (-10.0, -10.0, -5.0, -5.0)]
    at = [(64.0, 64.0), (63.9, 10.0), (128.0, 0.0), (250.0, 250.0), (200.0, 300.0), (301.0, 250.0), (-5.0, -10.0), (-5.0, -4.0)]
    kinds = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    rows = spark.createDataFrame([([(x - 1, y - 1, x + 1, y + 1) for x, y in at], boxes), ([(0.0, 0.0, 2.0, 2.0)], []), ([(0.0, 0.0, 2.0, 2.0)], None)], f"words {kinds}, boxes {kinds}")
    free = [[(w.x0 + 1, w.y0 + 1) for w in r.f] for r in rows.select(G.free_of(rows.words, rows.boxes).alias("f")).collect()]
    assert free == [[at[1], at[5], at[7]], [(1.0, 1.0)], [(1.0, 1.0)]]
    plan = QUERIES["words_outside_tables"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
