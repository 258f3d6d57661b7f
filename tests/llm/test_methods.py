"""Single methods against their plain definitions, and names that clash with the operators' own."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lonja.llm import common, html_text, mixing, quality, toxicity, warc

WORDS = ["alpha", "beta", "gamma", "delta", "idiot", "moron"]


def test_viterbi_is_the_best_of_all_labellings():
    r = np.random.default_rng(3)
    for n in range(1, 8):
        scores, moves = r.normal(size=(n, 2)), r.normal(size=(2, 2))

        def total(y, scores=scores, moves=moves):
            return sum(scores[k, a] for k, a in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert list(html_text.viterbi(scores, moves)) == list(best)


def test_hidden_elements_end():
    pages = {
        '<div><p>a<svg><path d="x">b</p><p>c</p></div>': ["a", "c"],
        "<p>one<svg><g><p>two</p>three": ["one", "two", "three"],
        "<div>x<noscript><p>h</p>i</noscript>y</div>": ["x y"],
        "<div><object><p>h</div><p>after</p>": ["after"],
        "<p>a <noscript><p>h</p></noscript> b</p>c": ["a b", "c"],
        "<svg><title>t</title><foreignObject><div>h</div></foreignObject></svg>end": ["end"],
        "<p>a<template><li>q<template>r</template>s</template>b": ["a b"],
        "a<iframe>x</iframe >b<svg/>c<math>1<math>2</math>3</math>d<script>x": ["a b c d"],
    }
    assert {p: [b.text for b in html_text.leaf_blocks(p)] for p in pages} == pages


def _plain_buckets(text):
    text = " " + " ".join((text or "").lower().split()) + " "
    found = set()
    for n in toxicity.ORDERS:
        for i in range(len(text) - n + 1):
            h = sum(ord(text[i + k]) * toxicity._MIX[k] for k in range(n)) % 2**64
            found.add(((h ^ (h >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n) % 2**64) >> (64 - toxicity.BITS))
    return found


def test_toxicity_score_is_the_plain_sum(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(WORDS[: 6 if i % 3 == 0 else 4]) for _ in range(r.choice([3, 30, 90])))) for i in range(300)] + [(900, None), (901, ""), (902, "É  ü\n" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    assert np.count_nonzero(model["weights"]) > 10
    for row in toxicity.score(docs, model).collect():
        z = sum(float(model["weights"][b]) for b in _plain_buckets(row["text"])) + model["bias"]
        assert math.isclose(row["_toxicity"], 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_broken_archives_are_counted():
    one = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(r["type"], r["payload_bytes"]) for r in warc.parse_records(one + b"junk\nmore")] == [("resource", None), ("broken", 9)]
    assert [r["type"] for r in warc.parse_records(one + one[:-6])] == ["resource", "broken"]


def test_clashing_names_and_repeated_rows(spark):
    r = random.Random(8)
    own = ["row", "words", "ranges", "row_key", "tie", "pass", "_text", "_key", "_lang", "_quality", "limits", "size", "a b"]
    rows = [(i, " ".join(f"{r.choice(WORDS)}{r.randrange(999)}" for _ in range(90)), "en", "s", 0, *(f"{c}{i}" for c in own)) for i in range(20)]
    rows += [rows[0], (3, rows[3][1], "de", *rows[3][3:]), (None, None, None, None, None, *own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in own))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[:-1], key=str)
    mixed = mixing.mixed_documents(docs)
    out = mixed.collect()
    assert mixed.columns == docs.columns and all(x["row"] == f"row{x['doc_id']}" and x["n_chars"] == len(x["text"]) for x in out)
    assert {x["lang"] for x in out if x["doc_id"] == 3} == {"en", "de"}
    taken = mixing.mix_report(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(x["text"].split()) for x in out) == taken > 0
    assert mixing.mixed_documents(docs.where("false")).count() == 0 and quality.kept_documents(docs.where("false")).count() == 0


def test_stored_tables_are_deleted(spark):
    df = common.materialize(spark.range(3), "three")
    path = common._STORED[id(df)].removeprefix("file:")
    import os

    assert os.path.isdir(path) and df.count() == 3
    common.discard(df)
    assert not os.path.exists(path)
