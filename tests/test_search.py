"""Threshold search and tariff codes against a full comparison, with hot words, ties, nulls and no rows."""

import random

from pyspark.sql import functions as F

from lonja.functions.text import expanded
from lonja.operators import search


def _full(queries, docs, k, first_hit):
    want = set()
    for q, text in queries:
        words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split() if len(w) > 2]
        scores = []
        for i, held in docs.items():
            met = [n for n, w in enumerate(words) if w in held]
            if met:
                scores.append((-len(met), met[0] if first_hit else 0, i))
        want |= {(q, i, -s, n + 1) for n, (s, _, i) in enumerate(sorted(scores)[:k])}
    return want


def _tables(spark, seed):
    r = random.Random(seed)
    words = ["the", "and", "with"] * 40 + [f"word{i}" for i in range(60)] + ["xy"]
    docs = {i: " ".join(r.choices(words, k=r.choice([0, 3, 12]))) for i in range(400)} | {400: "the " * 20_000, 401: None}
    queries = [(q, " ".join(r.choices(words, k=r.choice([1, 2, 8, 20])))) for q in range(40)] + [(40, ""), (41, None), (42, "the"), (43, "word1 word1 the"), (44, "nowhere")]
    index = search.inverted_index(spark.createDataFrame(list(docs.items()), "id long, text string"), "id", "text")
    return queries, {i: set((t or "").split()) for i, t in docs.items()}, spark.createDataFrame(queries, "query long, text string"), index


def test_search_equals_full_comparison(spark, monkeypatch):
    for seeds in (0, 5, 64):
        monkeypatch.setattr(search, "SEEDS", seeds)
        queries, docs, asked, index = _tables(spark, seeds)
        for first_hit in (False, True):
            got = {(x["query"], x["id"], x["score"], x["place"]) for x in search.search(asked, index, 3, first_hit).collect()}
            assert got == _full(queries, docs, 3, first_hit)
    assert search.search(asked.limit(0), index).isEmpty() and search.search(asked, index.limit(0)).isEmpty()


def test_tariff_codes(spark):
    table = spark.createDataFrame([(1, "8471.60.52", "Teclado mecanico", 0.2), (2, "8471.60.53", "Teclado mecanico", 0.1), (3, "8518.30.00", None, 0.0), (4, "8443.32.00", "Impresora laser color", 0.3)], "line long, ncm string, desc string, duty double")
    rows = spark.createDataFrame([(1, "Teclado mecanico"), (2, "laser unknown words here now impresora"), (3, ""), (4, None), (5, "Teclado mecanico"), (6, "Zzz"), (7, "teclado algo"), (8, "partida 8518")], "item long, text string").withColumn("ncm", F.lit("x"))
    got = {x["item"]: (x["ncm"], x["score"], round(x["confidence"], 3), x["pending"]) for x in search.classified(rows, "item", F.col("text"), table).collect()}
    assert got == {1: ("8471.60.52", 2, 1.0, False), 2: (None, 2, 0.333, True), 3: (None, 0, 0.0, False), 4: (None, 0, 0.0, False), 5: ("8471.60.52", 2, 1.0, False), 6: (None, 0, 0.0, False), 7: (None, 1, 0.5, True), 8: (None, 1, 0.5, True)}
    (t,) = spark.range(1).select(expanded(F.lit("keyboard")).alias("t")).collect()
    assert t["t"].split() == ["teclado"]
