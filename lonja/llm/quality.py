"""Quality rules with adaptive thresholds, in DataFrame functions only.

One pass computes the features of every whole text. Quantile sketches (KLL) of the features are built for each language
and source; sketches of small groups are replaced by the merged sketch of their language, and those of small languages
by the merged sketch of all. Symbols are judged first, by a fence around the middle half of the texts that pass the
base rules: junk is in the tail there. The other limits are tail quantiles of the texts within that fence, moved out by
the tail's distance from the median. The thresholds are joined back. No text is read twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import materialize, only_word_chars, words

SYMBOLS = "#*$%&|<>"
#: Base rules: fewest words, largest share of words in repeated windows (percent).
LEAST_WORDS, MOST_REPEAT = 50, 50
#: Sketch size, rows below which a group uses its language's sketch, width of the fence in interquartile ranges.
SKETCH_K, LEAST_GROUP, FENCE = 4096, 50, 4.0
#: Tail quantile, rows that a sketch needs for it, and the margin beyond it in distances from the median.
TAIL, LEAST_TAIL, MARGIN = 0.99, 100, 1.0
#: Noise allowance, for groups whose sketch is flat: symbols a word and shares up to this are never held against a text.
NOISE = 0.05
_TAILS = ("dup_lines", "repeats", "length")


def _repeat_words(w: Column) -> Column:
    """Words that stand in a window of three words found twice or more. Windows are compared by a 64-bit hash; in a
    text whose windows are all distinct (the usual case) nothing is sorted."""
    windows = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    return windows


def _covered(windows: Column) -> Column:
    """Words covered by the windows that occur more than once: sort (hash, place), keep those with an equal
    neighbour, and add up the lengths of the overlapping runs."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    last = F.size(windows) - 1

    def kept(p: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(pairs_ref, i - 1)["h"] == p["h"])
        after = F.when(i < last, F.get(pairs_ref, i + 1)["h"] == p["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    pairs_ref = F.col("pairs")
    return pairs, kept


def features(docs: DataFrame, text_col: str = "text", into: str = "_quality") -> DataFrame:
    """docs with a struct column ``into``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines. Columns
    of docs may have any names but ``into``. The features are costly: store the result before using it more than once."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    names = docs.columns
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), text.alias("text")).withColumn("words", words(F.col("text")))
    d = d.withColumn("windows", _repeat_words(F.col("words")))
    distinct = F.size(F.array_distinct("windows")) == F.size("windows")
    pairs, kept = _covered(F.col("windows"))
    d = d.withColumn("pairs", F.when(distinct, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(pairs))
    places = F.array_sort(F.transform(F.filter("pairs", kept), lambda p: p["i"]))
    d = d.withColumn("places", places)
    covered = F.aggregate("places", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: only_word_chars(x) != ""))
    found = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(only_word_chars(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    return d.select(*(F.col("row")[c].alias(c) for c in names), found.alias(into))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEAT * q["n_words"])


def _ratios(q: Column) -> dict[str, Column]:
    n = F.greatest(q["n_words"], F.lit(1))
    return {"symbols": q["n_symbols"] / n, "dup_lines": q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)), "repeats": q["n_repeat_words"] / n, "length": q["word_chars"] / n}


def sketches(measured: DataFrame, lang_col: str, source_col: str, ratios: tuple[str, ...], into: str = "_quality") -> DataFrame:
    """Mergeable quantile sketches of the ratios for each language and source, from texts that pass the base rules."""
    good = measured.where(~base_failed(F.col(into)))
    keys = [F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    found = _ratios(F.col(into))
    rows = good.select(*keys, *(found[k].alias(k) for k in ratios))
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(k, SKETCH_K).alias(k) for k in ratios))


def _used(sketch: DataFrame, ratios: tuple[str, ...], least: int) -> DataFrame:
    """(lang, source, s): the group's own sketches from ``least`` rows, else its language's, else those of all."""
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(k).alias(k) for k in ratios)]
    by_lang = sketch.groupBy("lang").agg(*merged).select(F.col("lang").alias("l"), F.struct("n", *ratios).alias("of_lang"))
    of_all = sketch.agg(*merged).select(F.struct("n", *ratios).alias("of_all"))
    own = sketch.select("lang", "source", F.struct("n", *ratios).alias("own"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l"))).join(F.broadcast(of_all))  # one row
    used = F.when(F.col("own.n") >= least, F.col("own")).when(F.col("of_lang.n") >= least, F.col("of_lang")).otherwise(F.col("of_all"))
    return joined.select("lang", "source", used.alias("s"))


def _at(k: str, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col("s")[k], F.lit(rank))


def symbol_limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, most_symbols) from sketches of symbols."""
    low, mid, high = (_at("symbols", r) for r in (0.25, 0.5, 0.75))
    fence = F.ceil((mid + FENCE * (high - low)) * 100) / 100
    return _used(sketch, ("symbols",), LEAST_GROUP).select("lang", "source", F.greatest(F.lit(NOISE), fence).alias("most_symbols"))


def tail_limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, most_dup_lines, most_repeats, shortest, longest) from sketches of texts within the symbol limits."""

    def beyond(k: str, rank: float) -> Column:
        return _at(k, rank) + MARGIN * (_at(k, rank) - _at(k, 0.5))

    def above(k: str) -> Column:
        return F.ceil(beyond(k, TAIL) * 100) / 100

    most = [F.greatest(F.lit(NOISE), above(k)).alias(f"most_{k}") for k in ("dup_lines", "repeats")]
    shortest = F.floor(beyond("length", 1 - TAIL) * 100) / 100
    return _used(sketch, _TAILS, LEAST_TAIL).select("lang", "source", *most, shortest.alias("shortest"), above("length").alias("longest"))


def _with(rows: DataFrame, limits: DataFrame, lang_col: str, source_col: str, into: str) -> DataFrame:
    """rows with a struct column ``into``: the limits of their language and source, null where there are none."""
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*limits.columns[2:]).alias(into))
    return rows.join(limits, F.col(f"`{lang_col}`").eqNullSafe(F.col("_lang")) & F.col(f"`{source_col}`").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


def thresholds(measured: DataFrame, lang_col: str, source_col: str, into: str = "_quality") -> DataFrame:
    """(lang, source, most_symbols, most_dup_lines, most_repeats, shortest, longest), one row per language and source
    with texts that pass the base rules; the last four are null where none of them is within the symbol limit.
    measured is read more than once and should be stored."""
    first = materialize(symbol_limits(sketches(measured, lang_col, source_col, ("symbols",), into)), "quality-symbols")
    core = _with(measured, first, lang_col, source_col, "_first").where(_ratios(F.col(into))["symbols"] <= F.col("_first.most_symbols"))
    tails = tail_limits(sketches(core, lang_col, source_col, _TAILS, into)).withColumnsRenamed({"lang": "l", "source": "s"})
    joined = first.join(tails, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    return materialize(joined, "quality-thresholds")


def decided(limits: DataFrame) -> DataFrame:
    """One row: groups, and those whose limit of each ratio comes from a sketch and not from the noise allowance."""
    return limits.agg(F.count("*").alias("groups"), *(F.count_if(F.col(f"most_{k}") > NOISE).alias(k) for k in ("symbols", "dup_lines", "repeats")), F.count("longest").alias("length"))


def judged(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", into: str = "_quality") -> DataFrame:
    """The columns ``keep`` of every row of docs, whatever these are called, and a struct column ``into`` with the
    features, base_failed and kept.

    Null texts are empty (base_failed). Null languages and sources are groups of their own. A group without texts that
    pass the base rules has no threshold: its rows are judged by the base rules alone. Repeated rows are judged alike.
    An empty table: no rows. Other columns are ignored. Sketches of up to about SKETCH_K rows are exact; larger ones
    drop rows at random, so that limits of larger groups, rounded to hundredths, may differ by one step between runs."""
    held = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)
    rows = docs.select(held.alias("row"), *(F.col(f"`{c}`").cast("string").alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    measured = materialize(features(rows).select("row", "lang", "source", "_quality"), "quality-features")
    joined = _with(measured, thresholds(measured, "lang", "source"), "lang", "source", "limits")
    q, t, r = F.col("_quality"), F.col("limits"), _ratios(F.col("_quality"))
    fine = (r["symbols"] <= t["most_symbols"]) & (r["dup_lines"] <= t["most_dup_lines"]) & (r["repeats"] <= t["most_repeats"]) & r["length"].between(t["shortest"], t["longest"])
    verdict = F.struct("_quality.*", base_failed(q).alias("base_failed"), (~base_failed(q) & F.coalesce(fine, F.lit(True))).alias("kept"))
    return joined.select(*(F.col("row")[c].alias(c) for c in keep), verdict.alias(into))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their columns, whatever these are called. Cases as in judged: null, empty and
    very short texts go, rows with null languages, sources or ids are judged like others, repeated rows alike."""
    own = f"quality_{uuid.uuid4().hex}"
    return judged(docs, docs.columns, into=own).where(F.col(own)["kept"]).drop(own)
