"""License notices in texts: fuzzy search for short notices by exact seeds and bounded-error verification.

A text is read as its words (a-z, 0-9 and everything beyond ASCII, A-Z lower-cased), joined by one space. A notice of m
characters may differ by k = m // ERROR_SPAN edits. Cut into k + 1 pieces, at least one piece of it stands unchanged in
any such place (pigeonhole), so one Aho-Corasick automaton over the pieces of all notices locates every candidate, and the
regex library's bounded-error matching decides candidates and reports spans. Phrases are notices of no edits.

Cases: null texts count as empty; empty texts and texts without words have no words, no spans and score 0. Texts are
read whole, in pieces of PIECE bytes while words are cut, so a very long text costs its own size and no more. Repeated rows and
rows with equal ids are judged one by one. Extra columns stay as they are; the result is one column, ``_licenses``,
which replaces a column of that name. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import bounded_batches

#: One edit is allowed for so many characters of a notice.
ERROR_SPAN = 10
#: Bytes of a text whose words are cut at a time.
PIECE = 1 << 20


class Notice(NamedTuple):
    """Words that may be damaged, then words that must follow as they are (versions, for the most part)."""

    label: str
    text: str
    tail: str = ""


#: Phrases that must stand as they are (fixed values).
PHRASES = (
    Notice("mit", "under the mit license"),
    Notice("apache-2", "apache license version 2"),
    Notice("cc-by-nc", "cc by nc"),
)
#: Short notices of common licenses (fixed values).
NOTICES = (
    Notice("mit", "under the mit license"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("apache-2", "apache license version", "2"),
    Notice("gpl-2", "gnu general public license version", "2"),
    Notice("gpl-3", "gnu general public license version", "3"),
    Notice("lgpl-2", "gnu lesser general public license version", "2"),
    Notice("lgpl-3", "gnu lesser general public license version", "3"),
    Notice("agpl-3", "gnu affero general public license version", "3"),
    Notice("mpl-2", "mozilla public license version", "2"),
    Notice("bsd", "under the bsd license"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Notice("cc-by", "licensed under", "cc by 4"),
    Notice("cc-by", "creative commons attribution", "4"),
    Notice("cc-by-nc", "licensed under", "cc by nc"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc-by-sa", "licensed under", "cc by sa"),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("cc0", "creative commons zero public domain dedication"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
    Notice("all-rights-reserved", "all rights reserved"),
)

SPAN = "struct<label:string,phrase:boolean,first_word:bigint,n_words:bigint,edits:int,similarity:double,text:string>"
RESULT = f"n_words bigint, spans array<{SPAN}>"

#: A-Z to a-z; ASCII characters that are no word characters to a space.
_CLEAN = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def normalized(text: str | None) -> str:
    """The words of a text, with a space before, between and after them; one space for a text without words."""
    data, at, parts = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN), 0, []
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.rfind(b" ", at, at + PIECE)
        if end <= at:  # a word longer than a piece
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
        if part := b" ".join(data[at:end].split()):
            parts.append(part)
        at = end + 1
    return f" {b' '.join(parts).decode('utf-8', 'surrogatepass')} " if parts else " "


def seeds(text: str, edits: int) -> Iterator[tuple[int, str]]:
    """(offset, piece) of ``edits`` + 1 pieces of nearly equal length; a place within so many edits has one unchanged."""
    cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
    yield from ((a, text[a:b]) for a, b in zip(cuts, cuts[1:]))


class Finder:
    """The automaton and the patterns of a list of notices; one for a Python worker."""

    def __init__(self, phrases: Sequence[Notice], notices: Sequence[Notice], error_span: int):
        import ahocorasick
        import regex

        # (notice, is a phrase, characters that may be damaged, the words that must follow, edits, pattern, best pattern)
        self.kinds, found = [], {}
        for notice, phrase in [*((n, True) for n in phrases), *((n, False) for n in notices)]:
            tail = f" {notice.tail}" if notice.tail else ""
            text, edits = (f" {notice.text}{tail} ", 0) if phrase else (notice.text, len(notice.text) // error_span)
            pattern = rf"(?<= )(?:{regex.escape(notice.text, literal_spaces=True)}){{e<={edits}}}{regex.escape(tail, literal_spaces=True)}(?= )"
            for offset, piece in seeds(text, edits):
                found.setdefault(piece, []).append((len(self.kinds), offset))
            self.kinds.append((notice, phrase, text, tail, edits, regex.compile(pattern, regex.ENHANCEMATCH), regex.compile(pattern, regex.BESTMATCH)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def spans(self, hay: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of a normalised text: every place of a phrase, and for each notice its places that
        do not overlap, from left to right."""
        out, regions = [], {}
        if not len(self.automaton):
            return out
        for last, (length, uses) in self.automaton.iter(hay):
            for kind, offset in uses:
                _, phrase, text, tail, edits, _, _ = self.kinds[kind]
                at = last + 1 - length - offset
                if phrase:
                    out.append((at + 1, last, kind, 0))
                    continue
                lo, hi = max(0, at - edits - 1), min(len(hay), at + len(text) + edits + len(tail) + 1)
                own = regions.setdefault(kind, [])
                own.append((lo, hi))
        for kind, own in regions.items():
            own.sort()
            lo, hi = own[0]
            for a, b in [*own[1:], (len(hay) + 1, 0)]:
                if a <= hi:
                    hi = max(hi, b)
                    continue
                out.extend(self._verified(hay, lo, hi, kind))
                lo, hi = a, b
        return sorted(out)

    def _verified(self, hay: str, lo: int, hi: int, kind: int) -> Iterator[tuple[int, int, int, int]]:
        *_, edits, first, best = self.kinds[kind]
        region = hay[lo:hi]
        for match in first.finditer(region):
            a, b = max(0, match.start() - edits - 1), min(len(region), match.end() + edits + 1)
            near = best.search(region[a:b]) or match  # the fewest edits around the place found first
            shift = lo if near is match else lo + a
            yield shift + near.start(), shift + near.end(), kind, sum(near.fuzzy_counts)


@lru_cache(2)
def _finder(phrases: tuple[Notice, ...], notices: tuple[Notice, ...], error_span: int) -> Finder:
    return Finder(phrases, notices, error_span)


def scan(text: str | None, phrases: tuple[Notice, ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES, error_span: int = ERROR_SPAN) -> tuple[int, list[dict]]:
    """Number of words of a text and its spans in order of place."""
    hay, finder = normalized(text), _finder(phrases, notices, error_span)
    spans, at, words = [], 0, 0
    for start, end, kind, edits in finder.spans(hay):
        words, at = words + hay.count(" ", at, start), start
        notice, phrase = finder.kinds[kind][:2]
        spans.append({"label": notice.label, "phrase": phrase, "first_word": words - 1, "n_words": hay.count(" ", start, end) + 1, "edits": edits, "similarity": 1 - edits / len(notice.text), "text": hay[start:end]})
    return hay.count(" ") - 1, spans


def license_scan(docs: DataFrame, text_col: str = "text", phrases: Sequence[Notice] = PHRASES, notices: Sequence[Notice] = NOTICES, error_span: int = ERROR_SPAN) -> DataFrame:
    """``docs`` with ``_licenses``, a struct of n_words and spans: label, whether it is a phrase, first word (from 0), number of
    words, edits, similarity (1 - edits / characters of the notice) and the words found.

    One pass over the texts without a shuffle; only texts go to Python, in batches bounded by bytes."""
    bounded_batches(docs.sparkSession)
    phrases, notices = tuple(phrases), tuple(notices)

    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan(text, phrases, notices, error_span) for text in texts], columns=["n_words", "spans"])

    return docs.withColumn("_licenses", F.pandas_udf(found, RESULT)(F.col(f"`{text_col}`").cast("string")))


def _labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of phrases), first_word and last_word of them, base_labels,
    labels (notices too), score (similarity of the best span, 0 without one) and n_spans (all places, notices too)."""
    base = F.filter("_licenses.spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["first_word"])
    return license_scan(docs, text_col).select(
        F.col(f"`{id_col}`").alias("doc_id"), "_licenses.n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), _labels(base).alias("base_labels"), _labels(F.col("_licenses.spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_licenses.spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"), F.size("_licenses.spans").cast("long").alias("n_spans"),
    )
