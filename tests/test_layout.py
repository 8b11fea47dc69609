"""The order in which pages are read."""

from grainline.operators import layout


def box(name, x0, top, x1, words=3):
    return {"name": name, "x0": x0, "top": top, "x1": x1, "bottom": top + 10, "n_words": words}


def names(items, width=600):
    return "".join(x["name"] for x in layout.read_page(items, width))


def test_columns_are_read_one_after_the_other_between_what_spans_them():
    page = [box("t", 50, 0, 550), box("a", 50, 20, 250), box("b", 50, 200, 250), box("c", 350, 20, 550), box("d", 350, 200, 550), box("m", 50, 300, 550), box("e", 50, 320, 250), box("f", 350, 320, 550)]
    assert names(page) == "tabcdmef"


def test_labels_around_prose_are_rows():
    page = [box("t", 50, 0, 550, 40), box("a", 50, 20, 250), box("c", 350, 21, 550), box("b", 50, 40, 250), box("d", 350, 41, 550)]
    assert names(page) == "tacbd"
    assert names([{**x, "n_words": 3} for x in page]) == "tabcd"


def test_pages_without_columns_are_read_by_rows():
    page = [box("b", 300, 1, 500), box("a", 50, 3, 200), box("c", 50, 30, 200), box("d", 10, 33.5, 40)]
    assert names(page) == "abcd"
    assert layout.read_page([], 600) == []


def test_pages_over_batches_are_read_whole(spark):
    import random

    draw = random.Random(4)
    kinds = "page long, element_id long, x0 double, top double, x1 double, bottom double, n_words long, page_width double"
    rows = [(p, 100 * p + n, *(lambda x, y: (x, y, x + draw.choice([60.0, 400.0]), y + 10.0))(float(draw.randint(0, 500)), float(draw.randint(0, 300))), draw.randint(0, 19), 600.0) for p in range(40) for n in range(draw.randint(1, 12))]
    draw.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = layout.reading_order(spark.createDataFrame(rows, kinds))
        found = {(r.page, r.element_id): r.place for r in frame.collect()}
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = [k.split()[0] for k in kinds.split(", ")]
    want = {}
    for p in range(40):
        own = [dict(zip(names, r, strict=True)) for r in sorted(rows) if r[0] == p]
        want |= {(p, x["element_id"]): i for i, x in enumerate(layout.read_page(own, 600.0))}
    # no frame for each page
    assert found == want and "FlatMapGroups" not in plan
