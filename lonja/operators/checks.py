"""Validation of catalog rows and orders: rules R1-R10, the ten-part contract, field rules, selections and summaries.

Rows have sku, marca, modelo, variante, cat, fob, img, grounded (may be null), source_status, raw, row_seq. All rules
are native expressions over one row; sums and repeats are aggregates and windows by their own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions import rules, text, vocabulary
from lonja.functions.exprs import round0, round2, worst
from lonja.operators import quality

CODES = [f"R{k}" for k in range(1, 11)]
_NOISE = r"(?i)^(producto\s*item|item|\.|-|n/a|undefined|null|none|list|earphones?|co\.?,?|ltd\.?|electronic|technology|shenzhen)$"
_PRICE = r"^[$]?[0-9]+([.,][0-9]+)?$"
_SKU = r"(?i)^[A-Z0-9][A-Z0-9-]{2,49}$"


def severities(rows: DataFrame, into: str = "r") -> DataFrame:
    """rows with a struct of one severity for each rule: PASS, WARNING or CRITICAL; a row of nulls fails every rule."""
    ranges = rules.price_ranges(rows.sparkSession).withColumnRenamed("cat", "range_of")
    rows = rows.join(F.broadcast(ranges), F.upper(F.trim(F.coalesce("cat", F.lit("")))) == F.col("range_of"), "left")
    modelo, variante, marca = (F.trim(F.coalesce(c, F.lit(""))) for c in ("modelo", "variante", "marca"))
    cat, fob = F.upper(F.trim(F.coalesce("cat", F.lit("")))), F.col("fob")
    locked = F.lit(False)
    for brand, cats in rules.BRAND_LOCK.items():
        locked = locked | ((marca == brand) & ~cat.isin("OTRO", *cats))
    found = {
        "R1": F.when(~F.coalesce(~F.isnan(fob) & (fob > 0) & (fob < float("inf")), F.lit(False)), "CRITICAL"),
        "R2": F.when((F.length(modelo) < 2) | modelo.rlike(_NOISE) | modelo.rlike(_PRICE), "CRITICAL"),
        "R3": F.when((fob > 0) & ((fob < F.col("least")) | (fob > F.col("most"))), "CRITICAL").when(fob > F.col("warn"), "WARNING"),
        "R4": F.when(locked, "CRITICAL"),
        "R5": F.when(cat.isin("", "OTRO"), "CRITICAL"),
        "R6": F.when(marca.isin("", "OTRO"), "CRITICAL"),
        "R7": F.when(variante.rlike(_PRICE), "WARNING"),
        "R8": F.when((modelo != "") & (F.lower(modelo) == F.lower(variante)), "WARNING"),
        "R9": F.when(text.image_state(F.col("img")) != "valid", "WARNING"),
        "R10": F.when(F.col("grounded").isNull(), "CRITICAL").when(~F.col("grounded"), "WARNING"),
    }
    nothing = F.coalesce("sku", "marca", "modelo", "cat", F.col("fob").cast("string")).isNull()
    return rows.withColumn(into, F.struct(*(F.when(nothing, "CRITICAL").otherwise(F.coalesce(x, F.lit("PASS"))).alias(k) for k, x in found.items()))).drop("range_of", "least", "most", "warn")


def item_validation(rows: DataFrame) -> DataFrame:
    """rows with critical and violations (arrays of codes and model-quality reasons), status and score.

    Critical: the sku's format, a CRITICAL rule, a model of level RED. Violations: a WARNING but R3's, a model of level
    YELLOW. Score: share of the 11 checks that hold, in percent, not below 0."""
    judged = severities(rows).withColumn("q", text.model_quality(F.col("modelo"), F.col("cat"), F.col("raw")))
    sku = F.trim(F.coalesce("sku", F.lit("")))
    none = F.array().cast("array<string>")
    critical = F.concat(F.array_compact(F.array(F.when(~sku.rlike(_SKU), "SKU"), *(F.when(F.col("r")[k] == "CRITICAL", k) for k in CODES))), F.when(F.col("q.level") == "RED", F.col("q.reasons")).otherwise(none))
    violations = F.concat(F.array_compact(F.array(*(F.when(F.col("r")[k] == "WARNING", k) for k in CODES if k != "R3"))), F.when(F.col("q.level") == "YELLOW", F.col("q.reasons")).otherwise(none))
    judged = judged.withColumn("critical", critical).withColumn("violations", violations)
    failed = F.size("critical") + F.size("violations")
    status = F.when(F.size("critical") > 0, "RED").when(F.size("violations") > 0, "YELLOW").otherwise("GREEN")
    return judged.withColumn("status", status).withColumn("score", F.greatest(F.lit(0.0), round0((11 - failed) / 11 * 100)))


def contract(rows: DataFrame) -> DataFrame:
    """Ten rows for each row: code, severity, status, importability. A RED or YELLOW source takes GREEN codes but R9 with
    it; a RED one rejects them."""
    source = F.upper(F.trim(F.coalesce("source_status", F.lit(""))))

    def evaluation(code: str) -> Column:
        severity = F.col("r")[code]
        taken = (severity == "PASS") & source.isin("RED", "YELLOW") if code != "R9" else F.lit(False)
        return F.struct(
            F.lit(code).alias("code"), F.when(taken & (source == "RED"), "WARNING").otherwise(severity).alias("severity"),
            F.when(taken, source).when(severity == "CRITICAL", "RED").when(severity == "WARNING", "YELLOW").otherwise("GREEN").alias("status"),
            F.when((taken & (source == "RED")) | (severity == "CRITICAL"), "REJECTED").otherwise("IMPORTABLE").alias("importability"),
        )

    return severities(rows).select("row_seq", "sku", F.explode(F.array(*map(evaluation, CODES))).alias("e")).select("row_seq", "sku", "e.*")


def violations_by_code(evaluations: DataFrame) -> DataFrame:
    """Exactly ten rows: how many evaluations of each code are not GREEN, zero included."""
    counts = evaluations.agg(*(F.count_if((F.col("code") == k) & (F.col("status") != "GREEN")).alias(k) for k in CODES))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("code"), F.col(k).alias("n")) for k in CODES))).alias("x")).select("x.*")


def full_validation(rows: DataFrame) -> DataFrame:
    """Status of each row: the worst of its validation, its source's and the price fences of its category; a row of a
    minority category is not GREEN. Distinct warnings are counted."""
    judged = item_validation(rows)
    far = quality.outliers(rows.select("row_seq", F.col("row_seq").alias("sku"), "cat", "fob")).select(F.col("sku").alias("row_seq"), F.col("status").alias("far"))
    few = quality.minority_categories(rows).select("cat", F.lit("YELLOW").alias("few"))
    source = F.when(F.upper(F.trim("source_status")).isin("RED", "YELLOW", "GREEN"), F.upper(F.trim("source_status"))).otherwise("GREEN")
    out = judged.join(far, "row_seq", "left").join(few, "cat", "left")
    status = worst(F.col("status"), source, F.coalesce("far", F.lit("GREEN")), F.coalesce("few", F.lit("GREEN")))
    return out.select("row_seq", "sku", "cat", "img", "file", status.alias("status"), F.array_distinct(F.concat("critical", "violations")).alias("warnings"))


def split_summary(validated: DataFrame, *by: str) -> DataFrame:
    """Accepted, review and rejected rows with their share, of all or for each ``by``."""
    t = validated.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("GREEN", "accepted"), ("YELLOW", "review"), ("RED", "rejected"))))
    return t.select(*by, "total", "accepted", "review", "rejected", round2(F.col("accepted") * 100 / F.col("total")).alias("accepted_pct"))


def importable(evaluations: DataFrame) -> DataFrame:
    """(row_seq, importable): no evaluation of the row is REJECTED."""
    return evaluations.groupBy("row_seq").agg((~F.bool_or(F.col("importability") == "REJECTED")).alias("importable"))


def selection(validated: DataFrame) -> DataFrame:
    """Default selection of a preview: GREEN, and YELLOW whose only fault is the missing photo; RED never."""
    photo_only = (F.col("status") == "YELLOW") & (text.image_state(F.col("img")) != "valid") & F.forall("warnings", lambda w: w == "R9")
    return validated.select("row_seq", "status", photo_only.alias("photo_only"), ((F.col("status") == "GREEN") | photo_only).alias("selected"))


def field_error(field: str, value: Column) -> Column:
    """The first rule that a value breaks: required, too_long, pattern, no_number, least, most, whole; null if none."""
    required, longest, pattern, least, most, whole = vocabulary.FIELD_RULES[field]
    t = F.trim(value.cast("string"))
    empty = value.isNull() | (value.cast("string") == "")
    tests = [F.when(F.length(t) > longest, "too_long")] if longest else []
    tests += [F.when(F.length(t) < 1, "too_short")] if field in ("marca", "modelo") else []
    tests += [F.when(~t.rlike(pattern), "pattern")] if pattern else []
    if least is not None:
        n = F.regexp_replace(t, ",", ".").try_cast("double")
        tests += [F.when(n.isNull(), "no_number"), F.when(n < least, "least"), F.when(n > most, "most")]
        tests += [F.when(n != F.floor(n), "whole")] if whole else []
    return F.when(empty, F.lit("required") if required else F.lit(None).cast("string")).otherwise(F.coalesce(*tests, F.lit(None).cast("string")))


def product_errors(rows: DataFrame) -> DataFrame:
    """rows with errors (field:rule) and warnings (fob_low, fob_high)."""
    errors = F.array_compact(F.array(*(F.concat(F.lit(f + ":"), field_error(f, F.col(f))) for f in ("sku", "marca", "modelo", "cat", "fob"))))
    good = field_error("fob", F.col("fob")).isNull()
    warnings = F.array_compact(F.array(F.when(good & (F.col("fob") < 1), "fob_low"), F.when(good & (F.col("fob") > 500), "fob_high")))
    return rows.withColumn("errors", errors).withColumn("warnings", warnings)


def category_vocabulary(rows: DataFrame) -> DataFrame:
    """The known categories and those that valid rows add, upper-cased."""
    known = rows.sparkSession.createDataFrame([(c,) for c in vocabulary.CATEGORIES], "cat string")
    return known.union(rows.where(field_error("cat", F.col("cat")).isNull()).select(F.upper(F.trim("cat")).alias("cat"))).where("cat != ''").distinct()


def order_errors(lines: DataFrame) -> DataFrame:
    """One row per order: errors and warnings of its lines, repeated skus, bad quantities, and the total's checks."""
    again = F.row_number().over(Window.partitionBy("order_id", "sku").orderBy("line", "qty")) > 1
    rows = product_errors(lines).withColumn("again", again).withColumn("bad_qty", field_error("qty", F.col("qty")).isNotNull())
    t = rows.groupBy("order_id").agg(F.sum(F.size("errors")).alias("n"), F.count_if("again").alias("repeats"), F.count_if("bad_qty").alias("bad_qty"), F.sum(F.size("warnings")).alias("w"), round2(F.sum(F.coalesce(F.col("fob") * F.col("qty"), F.lit(0.0)))).alias("total"))
    errors = F.col("n") + F.col("repeats") + F.col("bad_qty") + F.when(F.col("total") <= 0, 1).otherwise(0)
    return t.select("order_id", errors.alias("errors"), "repeats", "bad_qty", (F.col("w") + F.when(F.col("total") > 100_000, 1).otherwise(0)).alias("warnings"), (errors == 0).alias("valid"))


def refused_orders(lines: DataFrame, validated: DataFrame) -> DataFrame:
    """(order_id, refused): an order with a RED line is refused."""
    red = validated.select(F.col("row_seq"), (F.col("status") == "RED").alias("red"))
    return lines.join(red, "row_seq", "left").groupBy("order_id").agg(F.bool_or(F.coalesce("red", F.lit(False))).alias("refused"))


def import_summary(validated: DataFrame, by: str = "file") -> DataFrame:
    """EMPTY, ALL_FAILED or OK of each file: GREEN rows are imported, YELLOW skipped, RED failed."""
    t = split_summary(validated, by).withColumnsRenamed({"accepted": "imported", "review": "skipped", "rejected": "failed"})
    status = F.when(F.col("total") == 0, "EMPTY").when((F.col("failed") > 0) & (F.col("imported") == 0), "ALL_FAILED").when(F.col("imported") > 0, "OK").otherwise("EMPTY")
    return t.select(by, "total", "imported", "skipped", "failed", status.alias("status"))


def reasons(validated: DataFrame) -> DataFrame:
    """(status, reason, n) over all warnings, for top lists and comparisons of two passes."""
    return validated.select("status", F.explode("warnings").alias("reason")).groupBy("status", "reason").agg(F.count("*").alias("n"))


def status_deltas(validated: DataFrame, baseline: DataFrame, by: str = "file") -> DataFrame:
    """Counts of each status in a pass and its baseline, and their difference; groups of one side included."""

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(by, "status").agg(F.count("*").alias(name))

    both = counts(validated, "now").join(counts(baseline, "before"), [by, "status"], "full").na.fill(0, ["now", "before"])
    return both.select(by, "status", "now", "before", (F.col("now") - F.col("before")).alias("delta"))


def pass_criteria(validated: DataFrame) -> DataFrame:
    """One row: no RED, no GREEN without image, no repeated sku, at least 90 percent GREEN."""
    t = validated.agg(F.count_if(F.col("status") == "RED").alias("red"), F.count_if((F.col("status") == "GREEN") & (text.image_state(F.col("img")) != "valid")).alias("bare"), F.count_if(F.col("status") == "GREEN").alias("green"), F.count("*").alias("total"), F.count_distinct("sku").alias("skus"))
    return t.select((F.col("red") == 0).alias("no_red"), (F.col("bare") == 0).alias("no_green_without_image"), (F.col("skus") == F.col("total")).alias("no_duplicates"), (F.col("green") * 100 >= F.col("total") * 90).alias("mostly_green"))


def extraction_counts(rows: DataFrame) -> DataFrame:
    """What an extraction of each file missed: model, price, brand, category, prices as models, short models."""
    m = F.trim(F.coalesce("modelo", F.lit("")))
    conditions = {"no_model": m == "", "no_price": F.coalesce(F.col("fob") <= 0, F.lit(True)), "no_brand": F.coalesce("marca", F.lit("")).isin("", "OTRO"), "no_category": F.coalesce("cat", F.lit("")).isin("", "OTRO"), "price_as_model": m.rlike(_PRICE), "short_model": F.length(m) < 3}
    return rows.groupBy("file").agg(F.count("*").alias("total"), *(F.count_if(x).alias(k) for k, x in conditions.items()))


def page_stats(validated: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows, mean price and status counts of each page of each file."""
    rows = validated.join(pages.select("row_seq", "page", "fob"), "row_seq")
    return rows.groupBy("file", "page").agg(F.count("*").alias("n"), round2(F.avg("fob")).alias("mean_fob"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("GREEN", "YELLOW", "RED")))
