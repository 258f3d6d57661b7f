"""Page layouts: order of extraction decides columns, headers need a product's role, odd rows do no harm."""

from lonja.operators import layout

ITEM = "file string, page long, item long, x double, y double, text string"


def _items(spark, rows):
    return spark.createDataFrame([("f", p, i, x, y, t) for p, i, x, y, t in rows], ITEM)


def test_layouts(spark):
    anchors = _items(spark, [(1, 1, 100.0, 10.0, ""), (1, 2, 130.0, 50.0, ""), (1, 3, 165.0, 90.0, ""), (2, 1, 100.0, 10.0, ""), (2, 2, 200.0, 35.0, ""), (3, 1, 0.0, 0.0, ""), (3, 2, 60.0, 99.0, ""), (4, 1, None, 5.0, ""), (5, 3, 100.0, 0.0, ""), (5, 1, 130.0, 400.0, ""), (5, 2, 165.0, 800.0, "")])
    got = {r["page"]: (r["columns"], r["same_row"], r["layout"]) for r in layout.layouts(anchors).collect()}
    assert got == {1: (2, False, "table"), 2: (2, True, "grid"), 3: (2, False, "table"), 5: (1, False, "table")}
    assert layout.layouts(anchors.limit(0)).isEmpty()


def test_headers_and_columns(spark):
    items = _items(spark, [(1, 1, 10.0, 21.0, " MODEL "), (1, 2, 90.0, 22.0, "Colour"), (1, 3, 150.0, 21.0, "picture"), (1, 4, 12.0, 23.0, "item"), (1, 5, 300.0, 20.0, "USD"), (1, 6, 20.0, 60.0, "K1"), (1, 7, 95.0, 60.0, "red"), (1, 8, 150.0, 60.0, "-"), (1, 9, 260.0, 60.0, "x"), (1, 10, 20.0, 20.0, None), (1, 11, None, 60.0, "lost"), (2, 1, 10.0, 20.0, "image"), (2, 2, 90.0, 20.0, "usd"), (2, 3, 10.0, 60.0, "K2")])
    anchors = _items(spark, [(1, 20, 280.0, 60.0, "$1"), (2, 20, 280.0, 60.0, "$1")])
    (head,) = layout.headers(items, anchors).collect()
    assert (head["page"], head["item"], head["y"], [(c["role"], c["x"]) for c in head["columns"]]) == (1, 1, 21.0, [("model", 10.0), ("color", 90.0), ("image", 150.0)])
    got = {(r["page"], r["item"]): (r["header"], r["role"]) for r in layout.classified(items, anchors).collect()}
    assert [got[1, i] for i in (6, 7, 8, 9)] == [(1, "model"), (1, "color"), (1, "skip"), (1, "skip")]
    assert got[1, 1] == (None, None) and got[2, 3] == (None, None) and (1, 11) not in got
