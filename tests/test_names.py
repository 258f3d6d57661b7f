"""Tidied names against plain loops, with nulls, long texts and second passes; codes of blocks against all pairs."""

import random
import re

from pyspark.sql import functions as F

from lonja.functions import names
from lonja.operators import inheritance as op


def _kind(model, variant):
    m, v = (model or "").strip(" "), (variant or "").strip(" ")
    for _ in range(names.ROUNDS):
        w = m.split()
        if len(w) < 2:
            break
        if re.search(rf"(?i)\b({names.KINDS})$|^({names.STATES})$", w[-1]):
            if len(w) == 2 and re.fullmatch(names.NO_NAME, w[0], re.I):
                break
            m, v = " ".join(w[:-1]), " ".join(f"{v} {w[-1]}".split())
        elif w[0].lower() == "combo":
            m, v = " ".join(w[1:]), " ".join(f"{w[0]} {v}".split())
        else:
            break
    return m, v


def test_trailing_kinds(spark):
    r = random.Random(1)
    words = ["Combo", "mouse", "Keyboard", "new", "K1", "wireless", "2.4g", "game-hub", "Dock", "pro"]
    rows = [(" ".join(r.choices(words, k=r.choice([0, 1, 2, 3, 9]))), r.choice(["", None, "red  x"])) for _ in range(300)] + [(None, None), ("mouse " * 3000, "v")]
    got = spark.createDataFrame(rows, "m string, v string").select("m", "v", names.trailing_kind(F.col("m"), F.col("v")).alias("n")).collect()
    assert all((x["n"]["modelo"], x["n"]["variante"]) == _kind(x["m"], x["v"]) for x in got) and len(got) == 302


def test_colours_and_titles(spark):
    rows = [("Black wireless black RED", "Razer Viper viper V2 V2 12 12 (White) end", "Razer"), (None, None, None), ("", "a a a", "OTRO"), ("tri mode mouse", "A.B x A.B x", "A.B"), ("hall effect " * 500 + "pink", "word " * 4000, "")]
    df = spark.createDataFrame(rows, "c string, t string, b string").select("c", names.colour_field(F.col("c")).alias("f"), names.title(F.col("t"), F.col("b")).alias("n"))
    got = [(x["f"]["color"], len(x["f"]["moved"]), x["n"]["modelo"], x["n"]["variante"]) for x in df.collect()]
    assert got == [("Black RED", 1, "Viper V2 V2 12 12  end", "White"), ("", 0, "", ""), ("", 0, "a a a", ""), ("", 2, "x A.B x", ""), ("pink", 500, "word", "")]
    again = df.select(names.colour_field(F.col("f.color")).alias("g"), "f.color").collect()
    assert all(x["g"]["color"] == x["color"] and x["g"]["moved"] == [] for x in again)


def test_codes_above(spark):
    r = random.Random(5)
    texts = ["V8", "PAW3950MAX", "Model X1", "8KHz", "Tri mode", "G3 Berry", "black", "paw3395 K70", None, ""]
    rows = [(f, i % 3 if i % 17 else None, i + (1000 if f else 0), r.choice([0.0, 50.0, 200.0, -5.0, None]), r.choice([None, *(20.0 * n for n in range(30))]), r.choice(texts), r.choice(texts)) for f in ("f", None) for i in range(200)]
    items = spark.createDataFrame(rows, "file string, page long, item long, x double, y double, text string, modelo string").withColumn("code", F.lit(1))
    anchors = items.where("item % 5 = 0").withColumn("x", F.lit(300.0))
    got = {x["item"]: (x["modelo"], x["code"]) for x in op.codes_above(items, items, anchors).collect()}
    spec, want = {"PAW3950MAX", "8KHz", "Tri mode"}, {}
    for f, p, item, x, y, _, modelo in rows:
        above = [(c[4], -c[2], c[5]) for c in rows if c[:2] == (f, p) and c[5] in ("V8", "G3 Berry", "paw3395 K70") and c[3] is not None and 0 <= c[3] <= 105 and c[4] is not None and y is not None and c[4] < y and y - c[4] <= 250]
        code = max(above)[2] if above and modelo in spec else None
        want[item] = (code or modelo, code)
    assert got == want and sum(c is not None for _, c in want.values()) > 20
    assert op.codes_above(items.limit(0), items, anchors).isEmpty()
