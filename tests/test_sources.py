"""Product lists from files, and exports."""

from pyspark.sql import functions as F

from lonja.operators import catalog, costing, quality, spatial, tracker
from lonja.sources import files, sinks


def test_csv_list(spark, tmp_path):
    (tmp_path / "list.csv").write_text('Código,Marca,Modelo,Categoría,FOB\nA1,KZ,"Ed ""X""",auricular,"31,75"\nA2,KZ,,x,3\nA3,KZ,Y,,$31\nA4,KZ,Z,,2.5\n', encoding="utf-8")
    raw = files.read_csv(spark, str(tmp_path / "list.csv"))
    rows = files.products(raw).orderBy("sku").collect()
    assert [(r["sku"], r["modelo"], r["fob"], r["cat"]) for r in rows] == [("A1", 'Ed "X"', 31.0, "AURICULAR"), ("A4", "Z", 2.5, "OTRO")]
    assert files.skipped(raw).first()[:] == (1, 1)
    assert files.missing_fields(["Brand", "Name"]) == {"required": ["modelo", "fob"], "recommended": ["categoria", "sku"]}
    one = spark.createDataFrame([("Pedido 1.XLSX", bytearray(b"\xff\xfea\x00"))], "n string, b binary")
    assert one.select(files.extension(F.col("n")), files.route(F.col("n")), files.encoding(F.col("b"))).first()[:] == ("xlsx", "order", "utf-16le")


def test_exports(spark):
    lines = spark.createDataFrame([(1, 1, "A", "m", "v", "OTRO", 10.0, 2.0), (1, 2, "B", "m", "v", "OTRO", 5.0, 1.0)], "order_id int, line int, sku string, modelo string, variante string, cat string, fob double, qty double")
    priced = costing.priced_lines(lines.withColumn("marca", F.lit('K"Z')))
    rows = sinks.packing_list(priced).orderBy("number").collect()
    assert [(r["item"], r["sku"], r["qty"], r["kg"], r["fob_total"]) for r in rows] == [("1", "A", "2", "0.00", "20.00"), ("2", "B", "1", "0.00", "5.00"), ("", "", "", "", ""), ("TOTALES", "", "3", "0.00", "25.00")]
    assert [r["kg"] for r in sinks.packing_list(priced, weight_kg=6.0).orderBy("number").collect()] == ["4.00", "2.00", "", "6.00"]
    text = [r["text"] for r in sinks.order_csv(priced).orderBy("number").collect()]
    assert text[0].startswith('\ufeff"SKU","Categoría"') and text[1].startswith('"A","OTRO","K""Z","m","v","10","2",') and len(text) == 3
    assert [r["text"] for r in sinks.quote_csv(priced).orderBy("number").collect()][-2:][0] == "" and sinks.executive_kpis(priced).count() == 6
    assert {r["number"] for r in tracker.numbered(spark.range(1000).withColumnRenamed("id", "record"), "record", 7).collect()} == {f"IMP-{k:04}" for k in range(8, 1008)}


def test_upsert_and_empty_tables(spark):
    schema = "sku string, marca string, modelo string, variante string, cat string, fob double, row_seq long"
    held = spark.createDataFrame([("1", "KZ", "Ed X", "red", "A", 1.0, 1), ("2", "KZ", "Zs", "", "A", 2.0, 2)], schema)
    new = spark.createDataFrame([("9", " kz", "ED  x", "Red", "a", 1.5, 1), ("8", "KZ", "zs", "", "A", 2.005, 2), ("7", "KZ", "New", "", "A", 3.0, 3), ("6", "KZ", None, "", "A", 4.0, 4)], schema)
    got = {(r["sku"], r["fob"], r["action"]) for r in catalog.upsert(held, new).collect()}
    assert got == {("1", 1.5, "update"), ("2", 2.0, "skip"), ("7", 3.0, "insert"), ("6", 4.0, "insert")}
    none = held.where("false")
    assert catalog.kpis(none).first()[:] == (0, 0, 0.0, 0.0, 0.0) and quality.outliers(none).count() == 0 and catalog.supplier_comparison(none).count() == 0


def test_nearest_above(spark):
    schema = "file int, page int, item int, x double, y double"
    items = spark.createDataFrame([(1, 1, 10, 0.0, 50.0), (1, 1, 11, 0.0, 400.0), (1, 2, 12, 0.0, 50.0)], schema)
    heads = spark.createDataFrame([(1, 1, 1, 0.0, 20.0), (1, 1, 2, 0.0, 50.0)], schema)
    assert {r["item"]: r["header"] for r in spatial.nearest_above(items, heads).collect()} == {10: 2, 11: None, 12: None}


def test_item_rules(spark):
    good = dict(sku="MOU-001", marca="Acme", modelo="Viper 8", variante="black", cat="MOUSE", fob=20.0, img="data:image/png;base64,AAAA", grounded=True)
    wrong = [("R1", "fob", -5.0, "RED"), ("R2", "modelo", "item", "RED"), ("R3", "fob", 999.0, "RED"), ("R4", "marca", "KZ", "RED"), ("R5", "cat", "OTRO", "RED"), ("R6", "marca", None, "RED"), ("R7", "variante", "$12,5", "YELLOW"), ("R8", "variante", "VIPER 8", "YELLOW"), ("R9", "img", None, "YELLOW"), ("R10", "grounded", False, "YELLOW"), ("R10", "grounded", None, "RED"), ("", "sku", "a b", "RED"), ("R3", "fob", 250.0, "GREEN"), ("", "cat", " mouse ", "GREEN")]
    schema = "sku string, marca string, modelo string, variante string, cat string, fob double, img string, grounded boolean"
    rows = spark.createDataFrame([tuple((good | {k: v}).values()) for _, k, v, _ in wrong], schema).coalesce(1)
    got = [("".join(x["code"] for x in r["rules"] if x["severity"] != "PASS"), len(r["rules"]), r["status"]) for r in quality.item_rules(rows).collect()]
    assert got == [(code, 10, status) for code, _, _, status in wrong]
