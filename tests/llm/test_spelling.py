"""Spelling variants: trie numbers, near pairs, forms and roots against brute force over all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from lonja.llm import spelling


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts, ratio=5):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def _counts(seed, alphabet, size, longest=9):
    r = random.Random(seed)
    out = {}
    while len(out) < size:
        word = "".join(r.choice(alphabet) for _ in range(r.randrange(1, longest)))
        out.setdefault(word, r.choice([5, 6, 25, 30, 125, 130, 700, 4000]))
    return out


@pytest.mark.parametrize("alphabet, size", [("ab", 200), ("aéÿ÷z", 400), ("abcdefgh", 500)])
def test_variants_equal_brute_force(spark, alphabet, size):
    counts = _counts(size, alphabet, size)
    counts |= {"x" * 400: 9, "x" * 401: 90, "x" * 399 + "y": 900}
    words = spark.createDataFrame([(w, n, "clash") for w, n in counts.items()], "word string, n long, number string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in spelling.spelling_variants(words).collect()]
        nodes = spelling.numbered_words(words)
        pairs = [tuple(r) for r in spelling.near_pairs(nodes).collect()]
        number = {r["number"]: r["word"] for r in nodes.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(counts) and set(got) == _variants(counts)
    want = {(a, b) for a, b in itertools.permutations(counts, 2) if _near(a, b)}
    assert len(pairs) == len(want) and {(number[a], number[b]) for a, b in pairs} == want


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_nodes_are_prefixes(spark, parts):
    """Equal numbers for equal prefixes, unlike ones for unlike ones, wherever the order is cut."""
    words = [*_counts(7, "ab", 120), "b" * 30 + "a", "b" * 30 + "b", "b" * 31 + "a"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    prefix = {}
    for row in rows:
        assert len(row["nodes"]) == len(row["word"]) + 1
        for d, node in enumerate(row["nodes"]):
            assert prefix.setdefault(node, row["word"][:d]) == row["word"][:d]
    assert len(prefix) == len({w[:d] for w in words for d in range(len(w) + 1)})
    assert [r["word"] for r in sorted(rows, key=lambda r: r["number"])] == sorted(words)


def test_word_counts_and_slips(spark):
    r = random.Random(2)
    texts = [None, "", "12 ab", "ÀÿÉ×÷äé ÀÿÉ×÷äé", "Word" * 2000]
    texts += [" ".join(r.choice(["Letters", "letterS", "wörterbuch", "tableau", "ÉCOLES", "sixsix", "x-rays"]) for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    want = Counter()
    for i, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i % 7 and h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs, slips=3).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5} and got


def test_chain_of_forms_and_empty_table(spark):
    counts = {"a" * (6 + k): 5 ** (k + 1) for k in range(7)}
    rows = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["root"] for r in rows} == {"a" * 12} and sum(r["form"] is None for r in rows) == 1
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([("lonely", 8)], "word string, n long")).collect()[0][:4] == ("lonely", None, "lonely", 8)
