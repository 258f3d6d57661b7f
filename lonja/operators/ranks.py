"""Ranks of any number of rows, safe against lost executors: places in stored ranges of the order plus the sizes before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.storage import stored


def ranked(rows: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their rank (from 1) in their group, or overall without groups, by an order that leaves no ties. Groups of any
    size are spread over ranges; the ranges are stored, since a range drawn again may be cut elsewhere."""
    ranges = stored(rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range", *groups).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", *(F.col(g).alias(f"_{g}") for g in groups), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = ranges["_range"] == offsets["_range"]
    for g in groups:
        same = same & ranges[g].eqNullSafe(offsets[f"_{g}"])
    place = F.row_number().over(Window.partitionBy(ranges["_range"], *(ranges[g] for g in groups)).orderBy(*order)) + F.col("_before")
    return ranges.join(offsets, same).select(*(ranges[c] for c in rows.columns), place.alias(name))
