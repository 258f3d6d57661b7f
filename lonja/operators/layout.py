"""The layout of pages from their text items (file, page, item, x, y, text): tables or grids, table headers, columns.

``item`` is the order of extraction. Nothing but the distinct places of one page is ever together: sums and firsts come before.
Items without a place are left out; pages without anchors have no layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["file", "page"]
#: Pixels between columns, of a row of anchors, of a header's row, before the price column, and beyond the last column.
APART, ROW, BAND, BEFORE, BEYOND = 40.0, 30, 6.0, 10.0, 60.0
# Roles of header words.
ROLES = {"model": r"model|product|item", "color": r"color|colour", "switch": r"axis|switch(es)?|key\s*switch(es)?", "image": r"image|picture|photo", "cny": r"cny|rmb|price", "usd": r"usd|fob"}
PRODUCT_ROLES = ["model", "color", "switch"]


def layouts(anchors: DataFrame) -> DataFrame:
    """(file, page, columns, same_row, layout): price anchors of a page fall into columns, in order of extraction: one at
    least APART from all columns so far opens the next. A page is a table with one column, or two if no two anchors of a row
    are APART; else a grid. The fold runs over the distinct x of a page in order of their first item."""
    anchors = anchors.where("x IS NOT NULL AND y IS NOT NULL")
    places = anchors.groupBy(*PAGE, "x").agg(F.min("item").alias("item")).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("item", "x"))).alias("xs"))

    def opened(columns: Column, p: Column) -> Column:
        return F.when(F.exists(columns, lambda c: F.abs(c - p["x"]) < APART), columns).otherwise(F.concat(columns, F.array(p["x"])))

    columns = F.size(F.aggregate("xs", F.array().cast("array<double>"), opened))
    above = Window.partitionBy(*PAGE).orderBy("y").rangeBetween(-ROW, 0)
    wide = anchors.select(*PAGE, (F.greatest(F.max("x").over(above) - F.col("x"), F.col("x") - F.min("x").over(above)) >= APART).alias("wide"))
    rows = wide.groupBy(*PAGE).agg(F.bool_or("wide").alias("same_row"))
    out = places.select(*PAGE, columns.alias("columns")).join(rows, PAGE)
    table = (F.col("columns") == 1) | ((F.col("columns") <= 2) & ~F.col("same_row"))
    return out.withColumn("layout", F.when(table, "table").otherwise("grid"))


def role_of(text: Column) -> Column:
    """Role of a header word, null for any other text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(t.rlike(rf"(?i)^(?:{p})$"), role) for role, p in ROLES.items()))


def headers(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file, page, band, item, y, columns): rows of header words left of the page's first price column: two roles at least, one
    of them of a product, and APART from the first to the last. columns: array of struct x, item, role from left to right, the first item
    of each role. One aggregate by page and band of y."""
    first = anchors.groupBy(*PAGE).agg(F.min("x").alias("price_x"))
    words = items.where("x IS NOT NULL AND y IS NOT NULL").withColumn("role", role_of(F.col("text"))).where("role IS NOT NULL").join(first, PAGE).where(F.col("x") < F.col("price_x") - BEFORE)
    rows = words.groupBy(*PAGE, F.floor(F.col("y") / BAND + 0.5).alias("band")).agg(
        F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("spread"), F.min(F.struct("item", "y")).alias("first"), *(F.min(F.when(F.col("role") == r, F.struct("item", "x"))).alias(r) for r in ROLES)
    )
    columns = F.array_sort(F.array_compact(F.array(*(F.when(F.col(r).isNotNull(), F.struct(F.col(f"{r}.x").alias("x"), F.col(f"{r}.item").alias("item"), F.lit(r).alias("role"))) for r in ROLES))))
    product = F.coalesce(*PRODUCT_ROLES).isNotNull()
    return rows.where((F.col("n") >= 2) & (F.col("spread") >= APART) & product).withColumn("columns", columns).where(F.size("columns") >= 2).select(*PAGE, "band", "first.item", "first.y", "columns")


def column_of(columns: Column, x: Column) -> Column:
    """Column of a place: model, color, switch, or skip (another column, or BEYOND the last): the column between the middles to its
    neighbours."""
    passed = F.size(F.filter(F.sequence(F.lit(1), F.size(columns) - 1), lambda i: (F.get(columns, i - 1)["x"] + F.get(columns, i)["x"]) / 2 <= x))
    role = F.get(columns, passed)["role"]
    return F.when(x >= F.element_at(columns, -1)["x"] + BEYOND, "skip").when(role.isin(PRODUCT_ROLES), role).otherwise("skip")


def classified(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file, page, item, header, role) of every item: the column it stands in under the lowest header above it, null without one.
    One ordered pass over a page's items and headers; of headers at one height the first extracted counts."""
    found = headers(items, anchors).select(*PAGE, "y", F.lit(1).alias("kind"), (-F.col("item")).alias("turn"), F.struct("item", "columns").alias("h"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("bigint").alias("item"))
    own = items.where("x IS NOT NULL AND y IS NOT NULL").select(*PAGE, "y", F.lit(0).alias("kind"), F.col("item").alias("turn"), F.lit(None).cast(found.schema["h"].dataType).alias("h"), "x", F.col("item").cast("bigint").alias("item"))
    down = Window.partitionBy(*PAGE).orderBy("y", "kind", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = own.unionByName(found).withColumn("h", F.last("h", ignorenulls=True).over(down)).where("kind = 0")
    return seen.select(*PAGE, "item", F.col("h.item").alias("header"), F.when(F.col("h").isNotNull(), column_of(F.col("h.columns"), F.col("x"))).alias("role"))
