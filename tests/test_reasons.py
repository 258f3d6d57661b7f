"""Confidence, reasons and page rows on hand-made rows."""

from pyspark.sql import functions as F

from lonja.operators import reasons, spatial

ITEM = "cat string, modelo string, marketing string, gates array<string>, outlier boolean, grounded boolean, grounding string, warnings array<string>, source_status string, status string"


def test_reasons(spark):
    rows = [
        ("MOUSE", "A", "switch-axis", [], False, True, "", [], "", "YELLOW"),
        (" switch ", "A", "switch-axis", ["odd", "cross-brand"], True, False, "", [], "", "YELLOW"),
        ("MOUSE", "A", None, ["color-ambiguous"], True, False, "", [], "", "RED"),
        ("MOUSE", "A", None, [], False, False, "Ancla de fila VECINA", [], "", "YELLOW"),
        ("MOUSE", "A (b", None, [], None, None, None, ["ya", "modelo truncado"], "", "YELLOW"),
        ("MOUSE", "A (b)", None, ["color-ambiguous"], False, True, "", ["modelo truncado"], "", "YELLOW"),
        ("MOUSE", "A (b)", None, [], False, True, "", ["modelo truncado"], "GREEN", "YELLOW"),
        (None, None, None, None, None, None, None, [], None, "RED"),
        ("MOUSE", "A", "puffery", [], False, True, "", [], "", "GREEN"),
    ]
    found = reasons.instrumented(spark.createDataFrame(rows, ITEM)).select("reason", "status", "quality_reason").collect()
    expected = ["SWITCH_IN_MODEL", "SHARED_IMAGE", "OUTLIER_PRICE", "FOB_NEIGHBOR_ANCHOR", "MODEL_TRUNCATED", "COLOR_AMBIGUOUS", "LEGACY_ONLY_CLEAN", "UNCLASSIFIED_YELLOW", None]
    assert [x["reason"] for x in found] == expected
    assert (found[7]["status"], found[7]["quality_reason"]) == ("YELLOW", "Degradación sin razón atómica")


def test_evidence_gap(spark):
    rows = [("Mars75", "IYX", "Mar 75 black"), ("Glacier", "MChose", "MChose Red"), ("Glacier", "X", "Viper V3 5mm 12 usb"), ("GL", "X", "Viper"), (None, None, None), ("Glacier", None, "")]
    df = spark.createDataFrame(rows, "modelo string, marca string, raw string")
    assert [x[0] for x in df.select(reasons.evidence_gap(F.col("modelo"), F.col("marca"), F.col("raw"))).collect()] == [[], [], ["Viper", "V3"], [], [], []]


def test_page_rows_and_cells(spark):
    items = spark.createDataFrame([(0, 0, 1, 50.0, 10.0), (0, 0, 2, 20.0, 15.0), (0, 0, 3, 5.0, 17.0), (0, 0, 4, 9.0, 100.0)], "file int, page int, item int, x double, y double")
    rows = spatial.text_rows(items.withColumn("t", F.concat(F.lit("w"), "item")), "t").orderBy("row_y").collect()
    assert [(x["row_y"], x["row_x"], x["text"]) for x in rows] == [(10.0, 50.0, "w2 w1"), (17.0, 5.0, "w3"), (100.0, 9.0, "w4")]
    cells = {x["item"]: tuple(x)[1:] for x in spatial.cell_bounds(items.where("item != 3")).collect()}
    assert cells == {1: (35.0, 65.0, -145.0, 22.0), 2: (5.0, 35.0, -140.0, 27.0), 4: (0.0, 149.0, 20.0, 112.0)}
