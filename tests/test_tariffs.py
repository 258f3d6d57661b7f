"""Tariff codes against a loop over all rows of the table; of rows that are alike for all texts one is searched."""

import re

from pyspark.sql import functions as F

from lonja.operators import search


def _words(t):
    return [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if len(w) >= 3]


def test_alike_rows_are_searched_once(spark, monkeypatch):
    goods = ["cable largo rojo", "cable corto azul", "silla azul", None, "mesa larga", "cable rojo largo"]
    tariffs = [(900 - k, f"{k:04d}.{k % 9:02d}.00", goods[k % 6], k / 100) for k in range(300)]
    texts = ["cable rojo", "rojo cable", "silla azul 0007", "azul", "nada aqui", "", None, "cable rojo", "mesa mesa larga alta y muy pesada", "0040 0041", "Cable   Rojo"]
    seen, whole = [], search.search

    def counted(queries, index, *args, **kwargs):
        seen.append(index.select("id").distinct().count())
        return whole(queries, index, *args, **kwargs)

    monkeypatch.setattr(search, "search", counted)
    got = search.classified(spark.createDataFrame(list(enumerate(texts)), "item long, text string"), "item", F.col("text"), spark.createDataFrame(tariffs, "line long, ncm string, desc string, duty double"))
    want = {}
    for item, text in enumerate(texts):
        ws = _words(text)
        hits = []
        for line, ncm, desc, duty in tariffs:
            held = set(_words(f"{desc or ''} {ncm}"))
            if n := sum(w in held for w in ws):
                hits.append((-n, min(i for i, w in enumerate(ws) if w in held), line, ncm, desc, duty))
        score = -min(hits)[0] if hits else 0
        confidence = min(1.0, score / max(2, len(ws)))
        ok = bool(hits) and score >= 2 and confidence >= 0.4
        want[item] = (*(min(hits)[3:] if ok else (None, None, None)), score, confidence, bool(hits) and not ok)
    assert {x["item"]: tuple(x)[1:] for x in got.collect()} == want
    assert seen and max(seen) <= 12
