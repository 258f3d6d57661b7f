"""License notices: phrases against a scan of all places, notices against all windows of words by edit distance."""

import random
import re

from lonja.llm import licenses
from lonja.llm.licenses import ERROR_SPAN, NOTICES, PHRASES


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _base(text):
    w = _words(text)
    return [(i, n.label) for n in PHRASES for i in range(len(w)) if w[i : i + len(n.text.split())] == n.text.split()]


def _fuzzy(text):
    """Labels of notices with a window of whole words within the allowed edits, and the best similarity."""
    w, labels, best = _words(text), set(), 0.0
    for n in NOTICES:
        k, size, tail = len(n.text) // ERROR_SPAN, len(n.text.split()), n.tail.split()
        for a in range(len(w)):
            for b in range(max(a + 1, a + size - k), min(len(w), a + size + k) + 1):
                if w[b : b + len(tail)] == tail and (d := _distance(n.text, " ".join(w[a:b]))) <= k:
                    labels.add(n.label)
                    best = max(best, 1 - d / len(n.text))
    return labels, best


def _damaged(text, edits, r):
    for _ in range(edits):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + r.choice("abxé ") + text[i:], text[:i] + r.choice("abxé") + text[i + 1 :]])
    return text


def _texts():
    r = random.Random(5)
    out = [None, "", " \t\n", "é Ж 中 ٣", "under the MIT\x00license", "Under the\nMIT   License, cc-by-nc; CC BY NC 4.0", "under the mit licenses", "sunder the mit license",
           "Apache License, Version 2.0", "apache license version 20", "under the mit under the mit license", "x" * 3000, "MIT", "É under the mit license"]
    for n in NOTICES:
        for edits in (1, len(n.text) // ERROR_SPAN, len(n.text) // ERROR_SPAN + 3):
            around = [" ".join(r.choice(["la", "open", "licence", "the", "2", "under"]) for _ in range(r.randrange(6))) for _ in range(2)]
            out.append(f"{around[0]}. {_damaged(n.text, edits, r)} {n.tail} {around[1]}")
    return out


def test_spans_equal_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate([*texts, *texts[:6]])], "doc_id long, text string, _licenses string, n_words int")
    got = {row["doc_id"]: row for row in licenses.license_report(docs).collect()}
    assert len(got) == len(texts) + 6
    for i, text in enumerate([*texts, *texts[:6]]):
        row, base, (labels, best) = got[i], _base(text), _fuzzy(text)
        assert (row["n_words"], row["n_base"]) == (len(_words(text)), len(base)), text
        assert (row["first_word"], row["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None)), text
        assert row["base_labels"] == ",".join(sorted({x for _, x in base})), text
        assert row["labels"] == ",".join(sorted(labels | {x for _, x in base})), text
        assert abs(row["score"] - (1.0 if base else best)) < 1e-12, text


def test_long_texts_and_pieces(monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 16)
    for text in _texts():
        assert licenses.normalized(text).split() == _words(text) and "  " not in licenses.normalized(text)
    words, spans = licenses.scan("la " * 50_000 + "Released under the MIT Licence. " * 3)
    assert words == 50_015 and [s["first_word"] for s in spans] == [50_001, 50_006, 50_011]
    assert {(s["label"], s["edits"], s["text"]) for s in spans} == {("mit", 1, "under the mit licence")}


def test_empty_table_nulls_and_own_notices(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, spans int")
    assert licenses.license_report(docs).count() == 0
    docs = spark.createDataFrame([(None, None), (None, "use it as you lika"), (1, "use it as you like")], "doc_id long, text string")
    rows = licenses.license_scan(docs, notices=[licenses.Notice("own", "use it as you like")], phrases=[]).select("doc_id", "_licenses.*").collect()
    assert sorted((r["n_words"], [s["edits"] for s in r["spans"]]) for r in rows) == [(0, []), (5, [0]), (5, [1])]
    assert all(not r["spans"] for r in licenses.license_scan(docs, notices=[], phrases=[]).select("_licenses.spans").collect())
