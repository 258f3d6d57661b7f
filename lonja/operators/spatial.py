"""Operators over text items placed on pages (file, page, x, y, text): bounds, gaps, nearest headers and anchors.

Nearest-above joins run as one ordered pass over a page's items and headers together, not as a range join. Range joins that end in
one row an item compare distinct places: items of one place have the same neighbours, so each pair of places is compared once however
many items stand there. An item is one row of its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.exprs import round2
from lonja.storage import stored

_PAGE = ["file", "page"]
#: Items of a place in a row of image_candidates at most.
ALIKE = 1024


def row_bounds(anchors: DataFrame, edge: float = 20.0) -> DataFrame:
    """Top and bottom of each anchor's row: half-way to the previous and the next anchor of the page."""
    w = Window.partitionBy(*_PAGE).orderBy("y", "item")
    up, down = F.lag("y").over(w), F.lead("y").over(w)
    return anchors.select(*_PAGE, "item", "y", F.coalesce((up + F.col("y")) / 2, F.col("y") - edge).alias("top"), F.coalesce((down + F.col("y")) / 2, F.col("y") + edge).alias("bottom"))


def row_heights(items: DataFrame, least: float = 5.0, most: float = 300.0) -> DataFrame:
    """Mean gap between neighbouring distinct y of a page, gaps outside the range left out."""
    ys = items.select(*_PAGE, "y").distinct().withColumn("gap", F.col("y") - F.lag("y").over(Window.partitionBy(*_PAGE).orderBy("y")))
    good = F.when((F.col("gap") > least) & (F.col("gap") < most), F.col("gap"))
    return ys.groupBy(*_PAGE).agg(F.count(good).alias("gaps"), round2(F.avg(good)).alias("height"))


def nearest_above(items: DataFrame, headers: DataFrame, reach: float = 260.0) -> DataFrame:
    """For each item the lowest header of its page that is not below it and at most ``reach`` above, else null."""
    both = items.select(*_PAGE, "item", "y", F.lit(1).alias("kind")).unionByName(headers.select(*_PAGE, "item", "y", F.lit(0).alias("kind")))
    w = Window.partitionBy(*_PAGE).orderBy("y", "kind", "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("h", F.last(F.when(F.col("kind") == 0, F.struct("item", "y")), ignorenulls=True).over(w)).where("kind = 1")
    near = F.col("y") - F.col("h.y") <= reach
    return seen.select(*_PAGE, "item", F.when(near, F.col("h.item")).alias("header"), F.when(near, F.col("y") - F.col("h.y")).alias("distance"))


def grounded(rows: DataFrame, anchors: DataFrame, column: float = 40.0, tolerance: float = 30.0) -> DataFrame:
    """Rows whose price stands in an anchor of the same page within the column and row tolerance: the nearest one."""
    place = [*_PAGE, "x", "y", "fob"]
    given = anchors.groupBy(*_PAGE, "x", "y", "price").agg(F.min("item").alias("item"))
    pairs = near_pairs(rows.select(*place).distinct(), given, column, tolerance, tolerance).where(F.abs(F.col("l.fob") - F.col("r.price")) < 0.01)
    best = _by_place(pairs, ["x", "y", "fob"]).agg(F.min(F.struct(_apart().alias("distance"), F.col("r.item").alias("anchor"))).alias("b"))
    return rows.join(stored(best, "nearest"), place, "left").select("item", F.col("b.anchor").alias("anchor"), round2(F.col("b.distance")).alias("distance"), F.col("b").isNotNull().alias("grounded"))


def _apart() -> Column:
    """The sum of the axes' distances of a pair."""
    return F.abs(F.col("r.y") - F.col("l.y")) + F.abs(F.col("r.x") - F.col("l.x"))


def _by_place(pairs: DataFrame, place: list[str]):
    """Pairs by the place of their left side."""
    return pairs.groupBy(*_PAGE, *(F.col(f"l.{c}").alias(c) for c in place))


def near_pairs(left: DataFrame, right: DataFrame, dx: float, above: float, below: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs (l, r) of one page, |r.x - l.x| <= dx and -above <= r.y - l.y <= below: an equi-join on page and y cell, the
    left side given to the cells in reach, so that a page's pairs are never all made."""
    keys, cell = list(keys or _PAGE), max(above + below, 1.0)
    cells = F.explode(F.array_distinct(F.array(F.floor((F.col("y") - above) / cell), F.floor((F.col("y") + below) / cell))))
    a = left.select(*keys, F.struct(*left.columns).alias("l"), cells.alias("cell"))
    b = right.select(*keys, F.struct(*right.columns).alias("r"), F.floor(F.col("y") / cell).alias("cell"))
    return a.join(b, [*keys, "cell"]).where((F.abs(F.col("r.x") - F.col("l.x")) <= dx) & (F.col("r.y") - F.col("l.y")).between(-above, below)).drop("cell")


def image_candidates(products: DataFrame, images: DataFrame, dx: float = 200.0, above: float = 100.0, below: float = 250.0) -> DataFrame:
    """Candidate images of products on their page, with the distance. Products and images of one place (ALIKE at most in a row)
    are paired once; the pairs of their items are unfolded last."""
    pairs = near_pairs(stored(_alike(products), "products"), stored(_alike(images), "images"), dx, above, below)
    distance = round2(F.hypot(F.col("r.x") - F.col("l.x"), F.col("r.y") - F.col("l.y")))
    each = pairs.select(F.col("r.items").alias("images"), distance.alias("distance"), F.explode("l.items").alias("item"))
    return each.select("item", F.explode("images").alias("image"), "distance")


def _alike(items: DataFrame) -> DataFrame:
    """The items of each place of each page, ALIKE at most in a row."""
    place = [*_PAGE, "x", "y"]
    part = F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("item")) - 1) / ALIKE)
    return items.select(*place, "item", part.alias("part")).groupBy(*place, "part").agg(F.collect_list("item").alias("items")).drop("part")


def siblings(items: DataFrame, dy: float = 30.0) -> DataFrame:
    """(item, n): other items of its row, on the same page within dy."""
    lines = items.groupBy(*_PAGE, "y").agg(F.count("*").alias("n")).withColumn("x", F.lit(0.0))
    n = _by_place(near_pairs(lines, lines, 0.0, dy, dy), ["y"]).agg((F.sum("r.n") - 1).alias("n"))
    return items.join(stored(n, "siblings"), [*_PAGE, "y"], "left").select("item", F.coalesce("n", F.lit(0)).alias("n"))


def cell_texts(anchors: DataFrame, items: DataFrame, width: float = 70.0, above: float = 60.0, below: float = 15.0) -> DataFrame:
    """Text items in the box of each price anchor: how many, and the first in reading order; an anchor is no text of its own box.

    Places have their number of items and the least two: an anchor that is the first of its own place leaves the second."""
    place = [*_PAGE, "x", "y"]
    least = items.groupBy(*place).agg(F.count("*").alias("n"), F.min("item").alias("item"))
    second = items.join(least.withColumnRenamed("item", "least"), place).where("item > least").groupBy(*place).agg(F.min("item").alias("second"))
    given = stored(least.join(second, place, "left"), "places")
    here = (F.col("r.x") == F.col("l.x")) & (F.col("r.y") == F.col("l.y"))
    text = F.struct(F.col("r.y").alias("y"), F.col("r.x").alias("x"), F.col("r.item").alias("item"))
    boxes = _by_place(near_pairs(anchors.select(*place).distinct(), given, width, above, below), ["x", "y"]).agg(
        F.sum("r.n").alias("all"), F.min(F.when(~here, text)).alias("other"), F.max(F.when(here, F.col("r.item"))).alias("least"), F.max(F.when(here, F.col("r.second"))).alias("second")
    )
    own = items.groupBy(*place, "item").agg(F.count("*").alias("own"))
    found = anchors.select(*place, "item").join(stored(boxes, "boxes"), place).join(own, [*place, "item"], "left")
    at_place = F.when(F.col("least") != F.col("item"), F.col("least")).otherwise(F.col("second"))
    first = F.least("other", F.when(at_place.isNotNull(), F.struct("y", "x", at_place.alias("item"))))
    n = F.col("all") - F.coalesce("own", F.lit(0))
    return found.select(F.col("item").alias("anchor"), n.alias("n"), first["item"].alias("first")).where("n > 0")


def matched_truth(truth: DataFrame, extracted: DataFrame, reach: float = 60.0) -> DataFrame:
    """The nearest extracted item (sum of the axes' distances) of each true one on its page within reach."""
    place = [*_PAGE, "x", "y"]
    pairs = near_pairs(truth.select(*place).distinct(), extracted.groupBy(*place).agg(F.min("item").alias("item")), reach, reach, reach)
    best = _by_place(pairs, ["x", "y"]).agg(F.min(F.struct(_apart().alias("d"), F.col("r.item").alias("m"))).alias("b"))
    return truth.join(stored(best, "nearest"), place, "left").select("item", F.col("b.m").alias("match"), F.col("b.d").alias("distance"))


def recovered_models(items: DataFrame, generic: Column, reach: float = 250.0) -> DataFrame:
    """Items with a generic model (a bare colour or status) take the model of a parent of their brand and category: one of
    the same price on the same page or the one before (500 farther), the nearest; else the nearest above within reach.

    An equi-join on file, brand, category and page; a parent is given to its own and the next page."""
    keys = ["file", "marca", "cat"]
    rows = items.where(generic)
    parents = items.where(~generic & (F.trim("modelo") != ""))
    given = parents.select(*keys, F.struct("item", "modelo", "fob", "y", "page").alias("q"), F.explode(F.array(F.col("page"), F.col("page") + 1)).alias("page"))
    pairs = rows.select(*keys, "page", "item", "y", "fob").join(given, [*keys, "page"])
    before = F.col("q.page") != F.col("page")
    same = F.abs(F.col("fob") - F.col("q.fob")) <= 0.01
    over = ~same & ~before & (F.col("q.y") < F.col("y")) & (F.col("y") - F.col("q.y") <= reach)
    distance = F.abs(F.col("y") - F.col("q.y")) + F.when(before, 500.0).otherwise(0.0)
    best = pairs.where(same | over).groupBy("item").agg(F.min(F.struct(F.when(same, 0).otherwise(1).alias("tier"), distance.alias("d"), F.col("q.item").alias("parent"), F.col("q.modelo").alias("modelo"))).alias("b"))
    return rows.select("item").join(best, "item", "left").select("item", F.col("b.parent").alias("parent"), F.col("b.modelo").alias("modelo"))


def median_y(items: DataFrame) -> DataFrame:
    """The middle y of each page, the mean of the two middle ones where their number is even."""
    return items.groupBy(*_PAGE).agg(F.median("y").alias("median_y"))


def _with_levels(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows with ``ys``: the distinct y of their page in order (as many as the page has lines)."""
    return rows.join(items.groupBy(*_PAGE).agg(F.sort_array(F.collect_set("y")).alias("ys")), _PAGE)


def text_rows(items: DataFrame, text: str, step: float = 6.0) -> DataFrame:
    """Lines of each page: reading down, an item more than ``step`` below a line's first item begins the next line. Gives
    the line's y, the x of its first item, and its texts from left to right."""

    def further(starts: Column, y: Column) -> Column:
        last = F.try_element_at(starts, F.lit(-1))
        return F.when(last.isNull() | (y - last > step), F.concat(starts, F.array(y))).otherwise(starts)

    starts = F.aggregate("ys", F.array().cast("array<double>"), further)
    placed = _with_levels(items, items).withColumn("starts", starts)
    placed = placed.withColumn("row_y", F.array_max(F.filter("starts", lambda s: s <= F.col("y"))))
    across = F.array_sort(F.collect_list(F.struct("x", "y", "item", F.col(text).alias("text"))))
    rows = placed.groupBy(*_PAGE, "row_y").agg(F.min(F.struct("y", "x")).alias("first"), across.alias("texts"))
    return rows.select(*_PAGE, "row_y", F.col("first.x").alias("row_x"), F.array_join(F.transform("texts", lambda t: t["text"]), " ").alias("text"))


def cell_bounds(anchors: DataFrame, band: float = 30.0, edge: float = 140.0) -> DataFrame:
    """The box of each price anchor's cell: across to half-way between the anchors of its row (at the ends half a column,
    alone ``edge``), up to the row before (40 to 240; 160 where there is none) less 5, down 12.

    Anchors of one place stand in the order of their items: all but the first have another at their own x before, all but the last one after."""
    place = [*_PAGE, "x", "y"]
    places = stored(anchors.groupBy(*place).agg(F.count("*").alias("n"), F.min("item").alias("least"), F.max("item").alias("most")), "places")
    own, other = F.struct("l.x", "l.y"), F.struct("r.x", "r.y")
    sides = _by_place(near_pairs(places, places, float("1e12"), band, band), ["x", "y"]).agg(
        F.max(F.when(other < own, F.col("r.x"))).alias("before"), F.min(F.when(other > own, F.col("r.x"))).alias("after"), F.min("r.x").alias("lo"), F.max("r.x").alias("hi"), F.sum("r.n").alias("n")
    )
    x, y = F.col("x"), F.col("y")
    levels = places.select(*_PAGE, "y").distinct()
    above = _with_levels(levels, levels).select(*_PAGE, "y", F.array_max(F.filter("ys", lambda v: v < y - 10)).alias("above"))
    rows = stored(sides.join(places.select(*place, "least", "most"), place).join(above, [*_PAGE, "y"]), "cells")
    height = F.when(F.col("above").isNull(), 160.0).otherwise(F.least(F.lit(240.0), F.greatest(F.lit(40.0), y - F.col("above"))))
    before = F.when(F.col("item") > F.col("least"), x).otherwise(F.col("before"))
    after = F.when(F.col("item") < F.col("most"), x).otherwise(F.col("after"))
    left = F.when(before.isNotNull(), (before + x) / 2).otherwise(F.greatest(F.lit(0.0), x - F.when(F.col("n") > 1, (after - x) / 2).otherwise(edge)))
    right = F.when(after.isNotNull(), (after + x) / 2).otherwise(x + F.when(F.col("n") > 1, (F.col("hi") - F.col("lo")) / (F.col("n") - 1) / 2).otherwise(edge))
    return anchors.select(*place, "item").join(rows, place).select("item", left.alias("min_x"), right.alias("max_x"), (y - height + 5).alias("min_y"), (y + 12).alias("max_y"))
