"""Confidence of extracted rows and the reason why a row is not green, as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions import reasons as v
from lonja.functions import rules


def _lookup(table: dict, key: Column) -> Column:
    """The table's value for a key, null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _first(values: Column) -> Column:
    """The first value of an array that is not null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _codes(*tests: tuple[Column, str]) -> Column:
    """The codes of the tests that hold, in order."""
    return F.filter(F.array(*(F.when(test, code) for test, code in tests)), lambda x: x.isNotNull())


def evidence_gap(model: Column, brand: Column, cell: Column) -> Column:
    """Codes in a row's own text where the model's first word is not in it (the model was taken from elsewhere), else
    empty. A word is there if its first three letters are."""
    cell, model = F.trim(F.coalesce(cell, F.lit(""))), F.coalesce(model, F.lit(""))
    word = F.lower(F.regexp_replace(F.regexp_extract(model, r"[A-Za-z0-9][A-Za-z0-9.-]*", 0), "-", ""))
    there = F.contains(F.lower(F.regexp_replace(cell, r"\s+", "")), F.substring(word, 1, 3))
    plain = F.regexp_replace(F.regexp_replace(cell, rf"(?i)\b({v.CELL_NOISE})\b", " "), r"[^0-9A-Za-z_À-ɏ]+", " ")
    brands = F.split(F.lower(F.coalesce(brand, F.lit(""))), r"\s+")
    found = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~w.rlike(rf"(?i)^\d+([.,]\d+)?({v.UNITS})\b") & ~F.array_contains(brands, F.lower(w)))
    return F.when((cell != "") & (F.length(word) >= 4) & ~there, found).otherwise(F.array().cast("array<string>"))


def confidence(rows: DataFrame, image_ok: Column) -> DataFrame:
    """rows with a struct ``eval``: confidence (100 less 15 for the price, 15 for the image, 20 for a model without
    evidence, 25 for an ungrounded price, 30 for each critical code; 0 at least), status, and the codes, critical first.

    rows: marca, cat, modelo, fob, raw, grounded."""
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("marca", "cat", "modelo")}
    fob = F.col("fob")
    bad = F.coalesce(F.isnan(fob) | (fob <= 0) | (F.abs(fob) == float("inf")), F.lit(True))
    least = F.coalesce(F.greatest(F.lit(0.01), _lookup({c: low * 0.5 for c, low, *_ in rules.PRICE_RANGES}, text["cat"])), F.lit(0.5))
    most = F.coalesce(_lookup({c: high for c, _, high, *_ in rules.PRICE_RANGES}, text["cat"]), F.lit(350.0))
    critical = _codes(
        (text["marca"].isin("", "OTRO"), "BRAND_MISSING"), (text["cat"].isin("", "OTRO"), "CATEGORY_UNCLASSIFIED"), (F.length(text["modelo"]) < 2, "MODEL_EMPTY"), (bad, "FOB_INVALID"), (F.col("grounded").isNull(), "FOB_UNGROUNDED")
    )
    lost = {"PRICE_RANGE": (~bad & ((fob < least) | (fob > most)), 15), "IMAGE_MISSING": (~F.coalesce(image_ok, F.lit(False)), 15), "MODEL_WITHOUT_EVIDENCE": (F.size(evidence_gap(F.col("modelo"), F.col("marca"), F.col("raw"))) > 0, 20), "FOB_NO_LITERAL_EVIDENCE": (~F.col("grounded"), 25)}
    warnings = _codes(*((test, code) for code, (test, _) in lost.items()))
    points = reduce(lambda a, b: a + b, (F.when(test, n).otherwise(0) for test, n in lost.values()))
    status = F.when(F.size("_critical") > 0, "RED").when(F.size("_warnings") > 0, "YELLOW").otherwise("GREEN")
    found = F.struct(F.greatest(F.lit(0), 100 - F.col("_points") - 30 * F.size("_critical")).alias("confidence"), status.alias("status"), F.concat("_critical", "_warnings").alias("warnings"))
    return rows.withColumns({"_critical": critical, "_warnings": warnings, "_points": points}).withColumn("eval", found).drop("_critical", "_warnings", "_points")


def merged(rows: DataFrame) -> DataFrame:
    """rows with confidence (the smaller of the source's and the evaluated), status, warnings (the source's, the
    evaluated, the image's, each once) and quality_reason, from source_confidence, source_warnings, image_warnings, eval."""
    none = F.array().cast("array<string>")
    warnings = F.array_distinct(F.concat(F.coalesce("source_warnings", none), "eval.warnings", F.coalesce("image_warnings", none)))
    return rows.withColumns({"confidence": F.least("eval.confidence", "source_confidence"), "status": F.col("eval.status"), "warnings": warnings}).withColumn("quality_reason", F.coalesce(F.get("warnings", F.lit(0)), F.lit(v.NO_REMARK)))


def warning_reason(warning: Column) -> Column:
    """The reason that a warning text stands for, or null."""
    return F.coalesce(*(F.when(warning.rlike(f"(?iu){pattern}"), code) for pattern, code in v.WARNING_REASONS))


def atomic_reason() -> Column:
    """The one reason of a row, from structured evidence first and warning texts last.

    Reads cat, modelo, marketing (class), gates (array of findings), outlier, grounded, grounding, warnings and
    source_status."""
    of_switch = F.coalesce(F.trim("cat").rlike("(?i)^(switch|interruptor)$"), F.lit(False))
    model = F.coalesce(F.col("modelo"), F.lit(""))
    truncated = model.rlike(r"[({\[]") & ~model.rlike(r"[)}\]]")

    def counted(w: Column) -> Column:
        code = warning_reason(w)
        stale = ((code == "SWITCH_IN_MODEL") & of_switch) | ((code == "MODEL_TRUNCATED") & ~truncated)
        return F.when(~stale, code)

    reason = F.coalesce(F.col("grounding"), F.lit(""))
    ungrounded = F.when(reason.rlike("(?i)vecina|neighbor"), "FOB_NEIGHBOR_ANCHOR").when(reason.rlike("(?i)alinead|misalign"), "FOB_UNALIGNED").otherwise("FOB_NO_LITERAL_EVIDENCE")
    return F.coalesce(
        F.when((F.col("marketing") == "switch-axis") & ~of_switch, "SWITCH_IN_MODEL").when(F.col("marketing").isin("puffery", "marketing-only"), "MODEL_MARKETING"),
        _first(F.transform("gates", lambda g: _lookup(v.GATE_REASONS, g))),
        F.when(F.col("outlier"), "OUTLIER_PRICE"),
        F.when(~F.col("grounded"), ungrounded),
        _first(F.transform("warnings", counted)),
        F.when(F.col("source_status") == "GREEN", "LEGACY_ONLY_CLEAN"),
        F.when(F.array_contains("gates", "color-ambiguous"), "COLOR_AMBIGUOUS"),
        F.lit("UNCLASSIFIED_YELLOW"),
    )


def instrumented(rows: DataFrame) -> DataFrame:
    """rows with reason (null for green ones), status, warnings and quality_reason: a row without a reason is a defect,
    yellow, and says so first."""
    rows = rows.withColumn("reason", F.when(F.col("status") != "GREEN", atomic_reason()))
    defect = F.coalesce(F.col("reason") == "UNCLASSIFIED_YELLOW", F.lit(False))
    said = F.when(defect & ~F.array_contains("warnings", v.NO_REASON), F.concat(F.array(F.lit(v.NO_REASON)), "warnings")).otherwise(F.col("warnings"))
    rows = rows.withColumns({"status": F.when(defect, "YELLOW").otherwise(F.col("status")), "warnings": said})
    return rows.withColumn("quality_reason", F.coalesce(F.get("warnings", F.lit(0)), F.lit(v.NO_REMARK)))


def reasons_hold(rows: DataFrame) -> DataFrame:
    """One row: rows that are not green, and those of them without a reason or a remark (none, if all is well)."""
    bad = F.col("reason").isNull() | F.lower("quality_reason").contains(v.NO_REMARK.lower())
    return rows.where("status != 'GREEN'").agg(F.count("*").alias("rows"), F.count_if(bad).alias("broken"))


def review(rows: DataFrame) -> DataFrame:
    """Rows that are not green with the repair to try (null: none), the report's label and the class of what is left."""
    label = F.coalesce(_lookup(v.LABELS, F.col("reason")), F.get("warnings", F.lit(0)), F.col("reason"), F.lit(v.NO_REMARK))
    left = F.when((F.col("reason") == "MODEL_MARKETING") & (F.col("marketing") == "puffery"), "model-marketing-puffery").otherwise(F.coalesce(_lookup(v.LEFT_CLASSES, F.col("reason")), F.lower("reason")))
    return rows.where("status != 'GREEN'").withColumns({"strategy": _lookup(v.STRATEGIES, F.col("reason")), "label": label, "left_class": left})
