"""Intervals and rectangles: overlaps, containment, unions, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_overlaps(spans: DataFrame, by: str) -> DataFrame:
    """Half-open [start, end) spans that overlap no other span of the same group.

    In order of start, a span is free if all earlier ones end at or before its
    start and the next starts at or after its end; two windows tell, no self join.
    """
    order = Window.partitionBy(by).orderBy("start", "end", "span_id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("start").over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = spans.withColumn("_b", before).withColumn("_a", after)
    return rows.filter((F.col("_b").isNull() | (F.col("_b") <= F.col("start"))) & (F.col("_a").isNull() | (F.col("_a") >= F.col("end")))).drop("_a", "_b")


def page_ranges(bookmarks: DataFrame, pages: Column) -> DataFrame:
    """A bookmark reaches to the page before the next one's start."""
    order = Window.partitionBy("doc_id").orderBy("start", "title")
    return bookmarks.withColumn("end", F.greatest(F.col("start"), F.coalesce(F.lead("start").over(order) - 1, pages)))


def bounding_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def smallest_container(points: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """For each point the smallest region of its page (``key``) that holds it."""
    area = F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 6)
    inside = points.join(regions, key).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return inside.groupBy(key, "point_id").agg(F.min_by("region_id", F.struct(area, F.col("region_id"))).alias("region_id"))


def coverage(boxes: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Share of a page that its boxes cover, their areas summed and capped at 1."""
    width = F.greatest(F.least("x1", "w") - F.greatest(F.col("x0"), F.lit(0.0)), F.lit(0.0))
    height = F.greatest(F.least("y1", "h") - F.greatest(F.col("y0"), F.lit(0.0)), F.lit(0.0))
    sums = boxes.join(pages, key).groupBy(key, "w", "h").agg(F.sum(width * height).alias("_s"))
    return sums.select(key, F.round(F.least(F.lit(1.0), F.col("_s") / (F.col("w") * F.col("h"))), 9).alias("coverage"))


def clip_spans(spans: Column, start: Column, end: Column) -> Column:
    """Parts of source spans (array of start, end) within [start, end)."""
    cut = F.transform(spans, lambda s: F.struct(F.greatest(s["start"], start).alias("start"), F.least(s["end"], end).alias("end")))
    return F.filter(cut, lambda s: s["start"] < s["end"])


def union_area(boxes: DataFrame, key: str) -> DataFrame:
    """``key, area`` that the boxes (x0, y0, x1, y1) of a page cover, overlaps counted once.

    A sweep over x: edges of boxes cut the page into slabs; in each the boxes that span
    it are merged along y by a running maximum. Boxes without an area cover nothing.
    """
    solid = boxes.select(key, "x0", "y0", "x1", "y1").filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    edges = solid.select(key, F.explode(F.array("x0", "x1")).alias("_low")).distinct()
    slabs = edges.withColumn("_high", F.lead("_low").over(Window.partitionBy(key).orderBy("_low"))).filter("_high IS NOT NULL")
    spans = slabs.join(solid, key).filter((F.col("x0") <= F.col("_low")) & (F.col("_high") <= F.col("x1")))
    before = Window.partitionBy(key, "_low").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("y1") - F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(before), F.col("y0"))), F.lit(0.0))
    return spans.withColumn("_new", new).groupBy(key).agg(F.sum(F.col("_new") * (F.col("_high") - F.col("_low"))).alias("area"))


def in_cells(boxes: DataFrame, cell: float) -> DataFrame:
    """Boxes once for each cell of a grid they touch, as ``_cx, _cy``."""
    run = lambda low, high: F.sequence(F.floor(F.least(low, high) / cell).cast("long"), F.floor(F.greatest(low, high) / cell).cast("long"))
    return boxes.withColumn("_cx", F.explode(run(F.col("x0"), F.col("x1")))).withColumn("_cy", F.explode(run(F.col("y0"), F.col("y1"))))


def outside(words: DataFrame, boxes: DataFrame, key: str, cell: float = 64.0) -> DataFrame:
    """Words (x0, y0, x1, y1) whose centre is in none of the page's boxes, borders included.

    Boxes are dealt to the cells of a grid, so a word meets those of its own cell only.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    placed = words.withColumns({"_x": x, "_y": y}).withColumns({"_cx": F.floor(F.col("_x") / cell), "_cy": F.floor(F.col("_y") / cell)})
    dealt = in_cells(boxes.select(key, "x0", "y0", "x1", "y1"), cell).select(key, "_cx", "_cy", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    within = F.col("w._x").between(F.least("b._x0", "b._x1"), F.greatest("b._x0", "b._x1")) & F.col("w._y").between(F.least("b._y0", "b._y1"), F.greatest("b._y0", "b._y1"))
    same = (F.col(f"w.{key}") == F.col(f"b.{key}")) & (F.col("w._cx") == F.col("b._cx")) & (F.col("w._cy") == F.col("b._cy"))
    return placed.alias("w").join(dealt.alias("b"), same & within, "left_anti").drop("_x", "_y", "_cx", "_cy")


def free_of(words: Column, boxes: Column) -> Column:
    """As ``outside``, for a page that is one row: of ``words`` (array of structs with x0, y0, x1, y1) those whose centre is
    in none of ``boxes`` (the same), borders included. Nothing is shuffled."""

    def within(w: Column, b: Column) -> Column:
        x, y = (w["x0"] + w["x1"]) / 2, (w["y0"] + w["y1"]) / 2
        return x.between(F.least(b["x0"], b["x1"]), F.greatest(b["x0"], b["x1"])) & y.between(F.least(b["y0"], b["y1"]), F.greatest(b["y0"], b["y1"]))

    # the boxes are bound to a name, so that they aren't worked out for each word again
    return F.transform(F.array(boxes), lambda bs: F.filter(words, lambda w: ~F.coalesce(F.exists(bs, lambda b: within(w, b)), F.lit(False))))[0]


# Share of a page that a scan behind its text covers, and of the characters that it holds.
BACKS_PAGE, BACKS_TEXT = 0.5, 0.9


def page_backings(images: DataFrame, pages: DataFrame, chars: DataFrame, key: str) -> DataFrame:
    """``key, image_id, backs``: whether an image is a scan of the page that its text already stands for.

    It covers half of the page or more, cut at its borders, and the centres of nine in ten
    of the page's characters. ``images``: key, image_id, x0, y0, x1, y1 (any order of corners);
    ``pages``: key, w, h; ``chars``: key, x0, y0, x1, y1. Pages without an area or characters back nothing.
    """
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    cut = images.join(pages, key).select(
        key, "image_id", "w", "h", F.greatest(low("x0", "x1"), F.lit(0.0)).alias("_l"), F.least(high("x0", "x1"), F.col("w")).alias("_r"), F.greatest(low("y0", "y1"), F.lit(0.0)).alias("_t"), F.least(high("y0", "y1"), F.col("h")).alias("_b")
    )
    large = (F.col("_r") > F.col("_l")) & (F.col("_b") > F.col("_t")) & ((F.col("_r") - F.col("_l")) * (F.col("_b") - F.col("_t")) >= BACKS_PAGE * F.col("w") * F.col("h")) & (F.col("w") > 0) & (F.col("h") > 0)
    wide = cut.filter(large)
    centres = chars.select(key, ((F.col("x0") + F.col("x1")) / 2).alias("_x"), ((F.col("y0") + F.col("y1")) / 2).alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    held = F.count_if(F.col("_x").between(F.col("_l"), F.col("_r")) & F.col("_y").between(F.col("_t"), F.col("_b")))
    counts = wide.join(centres, key).groupBy(key, "image_id").agg(held.alias("_held"), F.count("*").alias("_n"))
    told = counts.select(key, "image_id", (F.col("_held") >= BACKS_TEXT * F.col("_n")).alias("backs"))
    return images.select(key, "image_id").join(told, [key, "image_id"], "left").select(key, "image_id", F.coalesce("backs", F.lit(False)).alias("backs"))
