"""Collocations: tiles, counts and scores against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonja.llm import collocations
from lonja.llm.ranks import ranked


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _plain(rows, least, top, within):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in counts.items():
        if len(p) == 1 or a < least:
            continue
        if any(len(q) == 3 and g == lang and p in (q[:2], q[1:]) and b >= least and 100 * b >= within * a for (g, q), b in counts.items() if len(p) == 2):
            continue
        score, _, left, right = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, got = Counter(), []
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= top:
            got.append((r[0], ranks[r[0]], *r[1:]))
    return got


def _rows(seed, size):
    r = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "é", "É", "中", "a-b", "\x1cx", "rare"]
    out = [(None, "en"), ("", "en"), ("...", None), (" \t ", "fr"), ("one", "de"), ("x" * 3000, "en")]
    for _ in range(size):
        w = r.choices(words, [5, 5, 5, 9, 9, 2, 2, 2, 1, 1, 1], k=r.randrange(1, 40))
        out.append(("".join(x + r.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for x in w), r.choice(["en", "en", "en", "fr", None, "und"])))
    return out + out[-5:]


@pytest.mark.parametrize("chunk, least, top, within", [(1 << 20, 10, 2000, 50), (300, 3, 7, 50), (1, 2, 2000, 30)])
def test_collocations_equal_plain_counting(spark, chunk, least, top, within):
    rows = _rows(least, 150)
    docs = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(3)
    got = collocations.collocations(docs, least=least, top=top, within=within, chunk_bytes=chunk)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(_plain(rows, least, top, within))


def test_long_text_of_many_segments(spark):
    rows = [("to be or not to be " * 60_000, "en"), ("q" * (3 << 20) + " to be", "en")]
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(map(tuple, got.collect())) == sorted(_plain(rows, 10, 2000, 50))


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("lone words only", "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_tiles():
    rng = np.random.default_rng(1)
    for size in (0, 1, 1000, 400_000):
        left = np.minimum(rng.geometric(0.002, size), 90_000).astype(np.int64) * rng.choice([1, 1, 1, 7], size)
        right = rng.integers(0, 1200, size)
        got = {(a, b): n for a, b, n in zip(*(x.tolist() for x in collocations.tile_counts(left, right)))}
        assert got == dict(Counter(zip(left.tolist(), right.tolist())))
    far = np.full(70_000, 2**31 - 1)
    assert [x.tolist() for x in collocations.tile_counts(far, far)] == [[2**31 - 1], [2**31 - 1], [70_000]]


def test_ranks(spark):
    rows = [("ab"[i % 9 == 0], i * 7 % 1000) for i in range(1000)]
    got = ranked(spark.createDataFrame(rows, "g string, v long"), ["g"], [F.desc("v")])
    for g in "ab":
        assert [r["v"] for r in sorted(got.where(f"g = '{g}'").collect(), key=lambda r: r["rank"])] == sorted((v for h, v in rows if h == g), reverse=True)
