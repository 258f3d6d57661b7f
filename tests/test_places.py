"""Range joins on pages against loops over all pairs; pairs of places are made once, however many items stand at a place."""

import random

import pytest

from lonja.operators import spatial

ITEMS = "item long, file string, page long, x double, y double, fob double, price double"


def _rows(n=240):
    """Few places, many items; rows without a place or a price, an item alone on its page."""
    r = random.Random(4)
    rows = [(k, r.choice("ab"), r.randrange(2), r.choice([0.0, 35.0, 90.0]), r.choice([0.0, 15.0, 45.0, 46.5, 130.0]), float(k % 3), float(k % 3) if k % 2 else None) for k in range(n)]
    return [*rows, (n, "c", 0, 5.0, 5.0, 1.0, 1.0), (n + 1, "a", 0, None, 15.0, 1.0, None), (n + 2, "a", 0, 35.0, None, 1.0, 2.0), (n + 3, None, 0, 0.0, 0.0, 1.0, 1.0)]


@pytest.fixture
def pairs(monkeypatch):
    """The numbers of pairs that queries make."""
    made, near_pairs = [], spatial.near_pairs

    def counted(*args, **kwargs):
        found = near_pairs(*args, **kwargs)
        made.append(found.count())
        return found

    monkeypatch.setattr(spatial, "near_pairs", counted)
    return made


def _beside(a, b):
    return None not in (a[1], b[1], a[3], b[3], a[4], b[4]) and a[1:3] == b[1:3]


def _few(made):
    """60 places: 15 on each of 4 pages, and one page of one."""
    assert made and sum(made) <= 4 * 15 * 15 * 3 + 1


def test_texts_of_a_box(spark, pairs):
    rows = _rows()
    anchors = [a for a in rows if a[6] is not None]
    want = {}
    for a in anchors:
        box = [b for b in rows if _beside(a, b) and b[0] != a[0] and abs(b[3] - a[3]) <= 70 and -60 <= b[4] - a[4] <= 15]
        if box:
            want[a[0]] = (len(box), min((b[4], b[3], b[0]) for b in box)[2])
    t = spark.createDataFrame(rows, ITEMS)
    assert {x["anchor"]: (x["n"], x["first"]) for x in spatial.cell_texts(t.where("price IS NOT NULL"), t).collect()} == want
    _few(pairs)
    apart = t.where("item % 5 != 0")
    kept = {x["anchor"]: x["n"] for x in spatial.cell_texts(t.where("item % 5 = 0"), apart).collect()}
    loop = {a[0]: sum(_beside(a, b) and b[0] % 5 != 0 and abs(b[3] - a[3]) <= 70 and -60 <= b[4] - a[4] <= 15 for b in rows) for a in rows if a[0] % 5 == 0}
    assert kept == {k: n for k, n in loop.items() if n}


def test_siblings_of_a_line(spark, pairs):
    rows = _rows()
    want = {a[0]: sum(b[0] != a[0] and None not in (a[1], b[1], a[4], b[4]) and a[1:3] == b[1:3] and abs(b[4] - a[4]) <= 30 for b in rows) for a in rows}
    assert {x["item"]: x["n"] for x in spatial.siblings(spark.createDataFrame(rows, ITEMS)).collect()} == want
    _few(pairs)


def test_nearest_extracted_item(spark, pairs):
    rows = _rows()
    want = {}
    for a in rows:
        near = [(abs(b[3] - a[3]) + abs(b[4] - a[4]), b[0]) for b in rows if b[0] % 2 == 0 and _beside(a, b) and abs(b[3] - a[3]) <= 60 and abs(b[4] - a[4]) <= 60]
        want[a[0]] = min(near)[::-1] if near else (None, None)
    t = spark.createDataFrame(rows, ITEMS)
    assert {x["item"]: (x["match"], x["distance"]) for x in spatial.matched_truth(t, t.where("item % 2 = 0")).collect()} == want
    _few(pairs)


def test_nearest_anchor_of_a_price(spark, pairs):
    rows = _rows()
    want = {}
    for a in rows:
        near = [(abs(b[4] - a[4]) + abs(b[3] - a[3]), b[0]) for b in rows if b[6] is not None and _beside(a, b) and abs(b[3] - a[3]) <= 40 and abs(b[4] - a[4]) <= 30 and abs(a[5] - b[6]) < 0.01]
        if a[6] is None:
            want[a[0]] = (*min(near)[::-1], True) if near else (None, None, False)
    t = spark.createDataFrame(rows, ITEMS)
    assert {x["item"]: tuple(x)[1:] for x in spatial.grounded(t.where("price IS NULL"), t.where("price IS NOT NULL")).collect()} == want
    _few([n / 3 for n in pairs])  # prices are part of a place


def test_bounds_of_cells(spark, pairs):
    rows = _rows()
    want = {}
    for a in rows:
        band = [b for b in rows if _beside(a, b) and abs(b[4] - a[4]) <= 30]
        if not band:
            continue
        own = (a[3], a[4], a[0])
        before = max((b[3] for b in band if (b[3], b[4], b[0]) < own), default=None)
        after = min((b[3] for b in band if (b[3], b[4], b[0]) > own), default=None)
        xs = [b[3] for b in band]
        above = max((b[4] for b in rows if _beside(a, b) and b[4] < a[4] - 10), default=None)
        left = (before + a[3]) / 2 if before is not None else max(0.0, a[3] - ((after - a[3]) / 2 if len(band) > 1 else 140))
        right = (after + a[3]) / 2 if after is not None else a[3] + ((max(xs) - min(xs)) / (len(band) - 1) / 2 if len(band) > 1 else 140)
        want[a[0]] = (left, right, a[4] - (160 if above is None else min(240.0, max(40.0, a[4] - above))) + 5, a[4] + 12)
    assert {x["item"]: tuple(x)[1:] for x in spatial.cell_bounds(spark.createDataFrame(rows, ITEMS)).collect()} == want
    _few(pairs)


def test_images_near_products(spark, pairs, monkeypatch):
    rows = _rows(900)
    want = sorted((a[0], b[0], round(((b[3] - a[3]) ** 2 + (b[4] - a[4]) ** 2) ** 0.5, 2)) for a in rows for b in rows if a[0] % 3 == 0 and b[0] % 7 == 0 and _beside(a, b) and abs(b[3] - a[3]) <= 200 and -100 <= b[4] - a[4] <= 250)
    t = spark.createDataFrame(rows, ITEMS)
    found = spatial.image_candidates(t.where("item % 3 = 0"), t.where("item % 7 = 0"))
    assert sorted(map(tuple, found.collect())) == want
    _few(pairs)
    monkeypatch.setattr(spatial, "ALIKE", 1)
    assert sorted(map(tuple, spatial.image_candidates(t.where("item % 3 = 0"), t.where("item % 7 = 0")).collect())) == want
