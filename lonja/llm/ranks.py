"""Ranks in a total order of any number of rows: places in stored ranges of the order plus the sizes of the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lonja.llm.common import materialize


def ranked(rows: DataFrame, groups: list[str], order: list[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    """``rows`` with the rank (long, from 1) of each within its groups, or overall without groups, by ``order``, which leaves no ties.
    With ``most``, only ranks up to it. The ranges are stored, so a lost executor gives no other ranks; a group of any
    size is spread over ranges, and only range sizes are summed up in one place."""
    ranges = materialize(rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range", *groups).count()
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", *groups, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    if most is not None:
        offsets = offsets.where(F.col("_before") < most)
    place = F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order)) + F.col("_before")
    out = ranges.join(offsets, ["_range", *groups]).withColumn(name, place).drop("_range", "_before")
    return out if most is None else out.where(F.col(name) <= most)
