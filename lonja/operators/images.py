"""Image assignment: shared images, integrity gates and audit. The image key is any string, null for no image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions.exprs import squeezed


def _facts(catalog: DataFrame) -> DataFrame:
    """One row per image: rows, categories, brands, models, its first row, and the model it is kept for across brands
    (the one with most rows, the earlier on ties). Partial sums by image and model come first."""
    imaged = catalog.where("img IS NOT NULL").withColumn("model_cat", F.concat_ws("|", squeezed(F.col("modelo")), F.upper("cat")))
    by_model = imaged.groupBy("img", "model_cat").agg(F.count("*").alias("n"), F.min("row_seq").alias("first"), F.collect_set(F.upper("cat")).alias("cats"), F.collect_set(squeezed(F.col("marca"))).alias("brands"))
    return by_model.groupBy("img").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.count("*").alias("models"), F.max_by("model_cat", F.struct("n", -F.col("first"))).alias("kept_model"),
        F.size(F.array_distinct(F.flatten(F.collect_set("cats")))).alias("n_cats"), F.size(F.array_distinct(F.flatten(F.collect_set("brands")))).alias("n_brands"),
    )


def integrity_gates(catalog: DataFrame) -> DataFrame:
    """Status and image of each row after the gates: an image shared across categories degrades all its rows and stays
    with the first; across brands with different models it stays with the largest model; rows without are never GREEN."""
    rows = catalog.join(_facts(catalog), "img", "left").withColumn("model_cat", F.concat_ws("|", squeezed(F.col("modelo")), F.upper("cat")))
    across = F.coalesce(F.col("n_cats") > 1, F.lit(False))
    brands = F.coalesce((F.col("n_brands") > 1) & (F.col("models") > 1), F.lit(False))
    lost = (across & (F.col("row_seq") != F.col("first"))) | (brands & (F.col("model_cat") != F.col("kept_model")))
    img = F.when(~lost, F.col("img"))
    status = F.when((F.col("status") == "GREEN") & (across | img.isNull()), "YELLOW").otherwise(F.col("status"))
    reasons = F.array_compact(F.array(F.when(across, "cross-category"), F.when(brands & (F.col("model_cat") != F.col("kept_model")), "cross-brand"), F.when(img.isNull(), "no-image")))
    return rows.select("sku", "row_seq", img.alias("img"), status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


def assignment_metrics(catalog: DataFrame) -> DataFrame:
    """Image counts of a catalog in one row."""
    facts = _facts(catalog).agg(F.count("*").alias("unique_images"), F.count_if(F.col("n") > 1).alias("shared_images"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("shared_rows"), F.count_if(F.col("n_cats") > 1).alias("cross_category"), F.count_if((F.col("n_brands") > 1) & (F.col("models") > 1)).alias("cross_brand"))
    rows = catalog.agg(F.count("*").alias("total"), F.count("img").alias("with_image"))
    return rows.join(F.broadcast(facts))  # one row each


def image_audit(catalog: DataFrame) -> DataFrame:
    """Rows by image state: missing, duplicate (not the first sku with that content), inline."""
    first = catalog.where("img IS NOT NULL").groupBy("img").agg(F.min("row_seq").alias("first"))
    state = F.when(F.col("img").isNull(), "missing").when(F.col("row_seq") != F.col("first"), "duplicate").otherwise("inline")
    return catalog.join(first, "img", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
