"""Audits: skus across tables, violations by code, confusion counts, status by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sku_audit(catalog: DataFrame, cart: DataFrame, history: DataFrame) -> DataFrame:
    """One row per finding and sku: in the cart or in the history but not in the catalog, malformed, or repeated."""
    known = catalog.select("sku").distinct()
    parts = [
        cart.select("sku").distinct().join(known, "sku", "left_anti").select("sku", F.lit("cart_orphan").alias("finding")),
        history.select("sku").distinct().join(known, "sku", "left_anti").select("sku", F.lit("history_orphan").alias("finding")),
        known.where(~F.col("sku").rlike("^[A-Z0-9-]+$")).select("sku", F.lit("malformed").alias("finding")),
        catalog.groupBy("sku").agg(F.count("*").alias("n")).where("n > 1").select("sku", F.lit("repeated").alias("finding")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def violations(checked: DataFrame, codes: list[str], issues: str = "issues") -> DataFrame:
    """Rows of each code in a comma-separated issue column, zero for codes that none has."""
    counted = checked.agg(*(F.count_if(F.array_contains(F.split(issues, ","), c)).alias(c) for c in codes))
    return counted.unpivot([], codes, "code", "n")


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def status_by(rows: DataFrame, group: str) -> DataFrame:
    """Counts of the three statuses for each group, by a pivot with fixed values."""
    table = rows.groupBy(group).pivot("status", ["GREEN", "YELLOW", "RED"]).count()
    return table.select(group, *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("GREEN", "YELLOW", "RED")))


def calibration(rows: DataFrame, truth: str, before: str, after: str) -> DataFrame:
    """False positives and negatives before and after a change of a gate; it is rejected if either rises."""
    t, b, a = F.col(truth) == 1, F.col(before) == 1, F.col(after) == 1
    counts = rows.agg(F.count_if(~t & b).alias("fp_before"), F.count_if(~t & a).alias("fp_after"), F.count_if(t & ~b).alias("fn_before"), F.count_if(t & ~a).alias("fn_after"))
    return counts.withColumn("rejected", (F.col("fp_after") > F.col("fp_before")) | (F.col("fn_after") > F.col("fn_before")))


def badges(catalog: DataFrame, cart: DataFrame, records: DataFrame) -> DataFrame:
    """One row of the counts that the navigation shows."""
    parts = [catalog.agg(F.count("*").alias("products")), cart.agg(F.count_if(F.col("qty") > 0).alias("cart_lines"), F.sum("qty").alias("units")), records.agg(F.count_if(~F.col("status").isin("delivered", "cancelled")).alias("active_imports"))]
    return parts[0].join(parts[1]).join(parts[2])  # one row each
