"""Quality gate of catalog rows: price plausibility, outlier fences, minority categories, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions import rules
from lonja.functions.exprs import nearest_rank, ratio, round2, worst


def price_checks(catalog: DataFrame) -> DataFrame:
    """Status of each row by its category's range: RED outside it or without a positive price, YELLOW from the warning
    price, GREEN otherwise; categories without a range are GREEN."""
    rows = catalog.join(F.broadcast(rules.price_ranges(catalog.sparkSession)), "cat", "left")
    fob = F.col("fob")
    issues = F.array_compact(
        F.array(
            F.when(fob.isNull() | (fob <= 0), "NO_PRICE"),
            F.when((fob > 0) & ((fob < F.col("least")) | (fob > F.col("most"))), "PRICE_RANGE"),
            F.when((fob >= F.col("warn")) & (fob <= F.col("most")), "PRICE_HIGH"),
            F.when(F.coalesce(F.trim("modelo"), F.lit("")) == "", "NO_MODEL"),
        )
    )
    rows = rows.withColumn("issues", issues)
    severe = F.arrays_overlap("issues", F.array(F.lit("NO_PRICE"), F.lit("PRICE_RANGE"), F.lit("NO_MODEL")))
    status = F.when(severe, "RED").when(F.size("issues") > 0, "YELLOW").otherwise("GREEN")
    return rows.select("sku", "cat", "fob", F.array_join("issues", ",").alias("issues"), status.alias("status"))


def outliers(catalog: DataFrame, inner: float = 1.5, outer: float = 3.0, least: int = 4) -> DataFrame:
    """Prices outside the fences of their category: nearest-rank quartiles at floor(n q); categories with fewer than
    ``least`` prices are not judged.

    Prices are counted by value before they meet, so that a category's group holds its distinct prices only."""
    priced = catalog.where("fob > 0")
    by_value = priced.groupBy("cat", "fob").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cat")
    running = by_value.withColumns({"upto": F.sum("n").over(w.orderBy("fob").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("n").over(w)})

    def at(q: float):
        place = F.floor(F.col("total") * F.lit(q))
        return F.min(F.when(F.col("upto") > place, F.col("fob")))

    fences = running.groupBy("cat").agg(F.max("total").alias("total"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3")).where(F.col("total") >= least)
    fences = fences.withColumn("iqr", F.col("q3") - F.col("q1"))
    rows = priced.join(fences, "cat")
    over = F.greatest(F.col("fob") - F.col("q3"), F.col("q1") - F.col("fob"))
    return rows.where(over > F.col("iqr") * inner).select("sku", "cat", "fob", "median", round2(F.col("iqr")).alias("iqr"), round2(over / F.when(F.col("iqr") == 0, 1.0).otherwise(F.col("iqr"))).alias("factor"), F.when(over > F.col("iqr") * outer, "RED").otherwise("YELLOW").alias("status"))


def minority_categories(catalog: DataFrame, share: float = 0.02, most: int = 3) -> DataFrame:
    """Categories with few rows and a small share of all, OTRO apart."""
    by_cat = catalog.groupBy("cat").agg(F.count("*").alias("n"))
    total = by_cat.agg(F.sum("n").alias("total"))
    return by_cat.join(F.broadcast(total)).where((F.col("n") <= most) & (F.col("n") < F.col("total") * share) & (F.col("cat") != "OTRO")).select("cat", "n")


def integrity(catalog: DataFrame) -> DataFrame:
    """One row per issue: missing or repeated sku, price that is no positive number, missing model."""
    first = catalog.where("sku IS NOT NULL AND sku != ''").groupBy("sku").agg(F.min("row_seq").alias("first"), F.count("*").alias("n"))
    rows = catalog.join(first.where("n > 1").select("sku", "first"), "sku", "left")
    issues = F.array_compact(
        F.array(
            F.when(F.coalesce("sku", F.lit("")) == "", "MISSING_SKU"),
            F.when(F.col("first").isNotNull() & (F.col("first") != F.col("row_seq")), "DUPLICATE_SKU"),
            F.when(F.col("fob").isNull() | F.isnan("fob") | (F.col("fob") < 0), "INVALID_FOB"),
            F.when(F.coalesce(F.trim("modelo"), F.lit("")) == "", "MISSING_MODEL"),
        )
    )
    return rows.select("row_seq", "sku", F.explode(issues).alias("issue"))


def graded(catalog: DataFrame) -> DataFrame:
    """Price checks and outlier fences together: the worst status of both stays."""
    checks, far = price_checks(catalog), outliers(catalog).select("sku", F.col("status").alias("far_status"))
    return checks.join(far, "sku", "left").select("sku", "cat", "fob", "issues", worst(F.col("status"), F.coalesce("far_status", F.lit("GREEN"))).alias("status"))


def status_summary(rows: DataFrame) -> DataFrame:
    by = rows.groupBy("status").agg(F.count("*").alias("n"))
    return by.join(F.broadcast(by.agg(F.sum("n").alias("total")))).select("status", "n", round2(ratio(F.col("n") * 100.0, F.col("total"))).alias("pct"))


def sorted_quantile(values, q: float):
    """Nearest-rank quantile of an array column."""
    return nearest_rank(F.array_sort(values), q)


def item_rules(catalog: DataFrame) -> DataFrame:
    """The rules R1-R10 of each row as one array ``rules`` of (code, severity), and the status of the worst of them and
    of the sku's format. Severity: PASS, WARNING (YELLOW) or CRITICAL (RED); R3's warning is a hint and leaves GREEN.

    img and grounded may be absent, as null: no image is a WARNING, no grounding evidence CRITICAL. The model-quality
    level and the score, which counts it, are not part of this."""
    for name, kind in (("img", "string"), ("grounded", "boolean")):
        if name not in catalog.columns:
            catalog = catalog.withColumn(name, F.lit(None).cast(kind))
    rows = catalog.withColumn("_cat", F.upper(F.trim(F.coalesce("cat", F.lit("")))))
    rows = rows.join(F.broadcast(rules.price_ranges(catalog.sparkSession).withColumnRenamed("cat", "_cat")), "_cat", "left")
    sku, modelo, variante, marca = (F.trim(F.coalesce(c, F.lit(""))) for c in ("sku", "modelo", "variante", "marca"))
    cat, fob, price = F.col("_cat"), F.col("fob"), r"^[$]?[0-9]+([.,][0-9]+)?$"
    noise = r"(?i)^(producto\s*item|item|\.|-|n/a|undefined|null|none|list|earphones?|co\.?,?|ltd\.?|electronic|technology|shenzhen)$"
    good_fob = F.coalesce(~F.isnan(fob) & (fob > 0) & (fob < float("inf")), F.lit(False))
    locked = F.lit(False)
    for brand, cats in rules.BRAND_LOCK.items():
        locked = locked | ((marca == brand) & ~cat.isin("OTRO", *cats))
    image = F.coalesce(F.trim("img").rlike(r"(?i)^data:image/(?:png|jpe?g|webp|gif);(?:base64,[a-z0-9+/=\s]+|[^\s]+)$"), F.lit(False))
    found = {
        "R1": F.when(~good_fob, "CRITICAL"),
        "R2": F.when((F.length(modelo) < 2) | modelo.rlike(noise) | modelo.rlike(price), "CRITICAL"),
        "R3": F.when((fob > 0) & ((fob < F.col("least")) | (fob > F.col("most"))), "CRITICAL").when(fob > F.col("warn"), "WARNING"),
        "R4": F.when(locked, "CRITICAL"),
        "R5": F.when(cat.isin("", "OTRO"), "CRITICAL"),
        "R6": F.when(marca.isin("", "OTRO"), "CRITICAL"),
        "R7": F.when(variante.rlike(price), "WARNING"),
        "R8": F.when((modelo != "") & (F.lower(modelo) == F.lower(variante)), "WARNING"),
        "R9": F.when(~image, "WARNING"),
        "R10": F.when(F.col("grounded").isNull(), "CRITICAL").when(~F.col("grounded"), "WARNING"),
    }
    each = F.array(*(F.struct(F.lit(k).alias("code"), F.coalesce(v, F.lit("PASS")).alias("severity")) for k, v in found.items()))
    rows = rows.select("sku", "cat", "fob", each.alias("rules"), sku.rlike(r"(?i)^[A-Z0-9][A-Z0-9-]{2,49}$").alias("_sku"))
    red = ~F.col("_sku") | F.exists("rules", lambda r: r["severity"] == "CRITICAL")
    yellow = F.exists("rules", lambda r: (r["severity"] == "WARNING") & (r["code"] != "R3"))
    return rows.select("sku", "cat", "fob", "rules", F.when(red, "RED").when(yellow, "YELLOW").otherwise("GREEN").alias("status"))
