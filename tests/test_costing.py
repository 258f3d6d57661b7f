"""Golden values of order costing and profitability."""

from pyspark.sql import functions as F

from lonja.functions.exprs import csv_cell, fnv1a, html_escaped, leading_number, locale_number, round0, worst
from lonja.operators import costing, tracker

ZERO = {"freight_pct": 0.0, "insurance_pct": 0.0, "fee_pct": 0.0, "perception_pct": 0.0, "courier_usd": 0.0}


def _lines(spark, rows, cat="TECLADO"):
    return spark.createDataFrame([(1, i, f"S{i}", "m", "v", cat, float(f), float(q)) for i, (f, q) in enumerate(rows)], "order_id int, line int, sku string, modelo string, variante string, cat string, fob double, qty double")


def test_markup_and_margins(spark):
    row = costing.order_costing(_lines(spark, [(100, 1)]), ZERO).first()
    assert (row["unit_cost"], row["price"], row["margin_pct"], row["roi_pct"]) == (100, 250, 60, 150)


def test_vat_is_split_by_value(spark):
    rows = costing.order_costing(_lines(spark, [(100, 1), (300, 1)]), ZERO).orderBy("line").collect()
    assert [r["line_vat"] for r in rows] == [21, 63]


def test_courier_fee_and_broker(spark):
    assert costing.order_costing(_lines(spark, [(10, 10), (10, 20)]), ZERO | {"courier_usd": 8.0}).first()["order_net"] == 540
    assert costing.order_costing(_lines(spark, [(100, 5)]), ZERO | {"mode": "importer"}).first()["order_net"] == 1000


def test_freight(spark):
    row = costing.order_costing(_lines(spark, [(100, 10), (50, 20)]), ZERO | {"freight_pct": 10.0, "markup": 2.0}).orderBy("line").first()
    assert (row["order_fob"], row["order_net"], row["unit_cost"], row["price"]) == (2000, 2200, 110, 220)


def test_door_to_door(spark):
    row = costing.door_to_door(_lines(spark, [(100, 100)], "HEADSET"), 0.15, 0.01, 0.0).first()
    assert row["cif"] == 11600 and row["duty_usd"] == 2320 and row["fee_usd"] == 348


def test_courier_regime(spark):
    row = costing.courier_regime(_lines(spark, [(1000, 1)]), 0.10, 0.01).first()
    assert (row["cif"], row["vat_usd"], row["duty_usd"]) == (1110, 233.1, 355)


def test_verdicts(spark):
    df = spark.createDataFrame([(100.0, 150.0), (100.0, 100.0), (200.0, 150.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(costing.landed_verdict(F.col("a"), F.col("b"))).collect()] == ["cheaper", "break_even", "more_expensive", "unavailable"]


def test_numbers_and_text(spark):
    df = spark.createDataFrame([("1234,56",), ("1.234,56",), ("1,234.56",), ("12.5",), ("abc",)], "t string")
    assert [r[0] for r in df.select(locale_number(F.col("t"), 5.0)).collect()] == [1234.56, 1234.56, 1234.56, 12.5, 5]
    one = spark.range(1)
    assert one.select(leading_number(F.lit("31,75")), leading_number(F.lit("$31")), round0(F.lit(-2.5))).first()[:] == (31.0, None, -2.0)
    assert one.select(fnv1a(F.lit("a")), fnv1a(F.lit("foobar")), fnv1a(F.lit(""))).first()[:] == ("e40c292c", "bf9cf968", "811c9dc5")
    assert one.select(worst(F.lit("GREEN"), F.lit("RED")), html_escaped(F.lit("<a&'>")), csv_cell(F.lit('a"b'))).first()[:] == ("RED", "&lt;a&amp;&#39;&gt;", '"a""b"')


def test_status_machine(spark):
    events = [(1, 1, "in_transit"), (1, 2, "delivered"), (1, 3, "in_customs"), (2, 1, "cancelled"), (2, 2, "in_transit")]
    rows = {r["record"]: r[1:] for r in tracker.replay(spark.createDataFrame(events, "record int, seq int, target string")).collect()}
    assert rows == {1: ("in_customs", 2, 1), 2: ("cancelled", 1, 1)}
