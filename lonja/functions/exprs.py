"""Column functions with the numeric and text semantics of the catalog domain.

Money is DOUBLE and rounds half up (towards plus infinity), which Spark's ``round`` does not do for negatives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and their plain forms (fixed values).
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuunc"


def round0(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("double")


def round2(x: Column) -> Column:
    """Half up to cents."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, or the default where b is zero or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def or_else(x: Column, default) -> Column:
    """x, or the default where x is null, NaN or zero (what a falsy number means)."""
    return F.coalesce(F.when((x != 0) & ~F.isnan(x), x), F.lit(default) if not isinstance(default, Column) else default)


def leading_number(text: Column) -> Column:
    """The number a text begins with ("31,75" gives 31), null if it begins with none."""
    return F.regexp_extract(F.trim(text), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def locale_number(text: Column, default: float = 0.0) -> Column:
    """A number with either separator: with both, the last one is the decimal mark; a lone comma is one."""
    t = F.trim(text)
    dot, comma = F.length(t) - F.locate(".", F.reverse(t)), F.length(t) - F.locate(",", F.reverse(t))
    both = F.contains(t, F.lit(".")) & F.contains(t, F.lit(","))
    decimal_comma = F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")
    plain = F.when(both & (comma > dot), decimal_comma).when(both, F.regexp_replace(t, ",", "")).otherwise(F.regexp_replace(t, "^([^,]*),", "$1."))
    return F.coalesce(leading_number(plain), F.lit(default))


def folded(text: Column) -> Column:
    """Lower case, without marks on letters, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), r"\s+", " "))


def squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def identity_key(brand: Column, model: Column, variant: Column, category: Column) -> Column:
    """Brand, model, variant and category, squeezed and joined: two rows with the same key are one product."""
    return F.concat_ws("|", *(squeezed(c) for c in (brand, model, variant, category)))


def slug(text: Column, length: int = 12) -> Column:
    """Upper-case letters and digits only, at most so many."""
    return F.substring(F.regexp_replace(F.translate(F.upper(F.coalesce(text, F.lit(""))), ACCENTED.upper(), PLAIN.upper()), "[^A-Z0-9]", ""), 1, length)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text as eight hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def tokens(text: Column, shortest: int = 3) -> Column:
    """Lower-case ASCII letter and digit runs of at least ``shortest`` characters, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= shortest)


def status_rank(status: Column) -> Column:
    return F.when(status == "RED", 3).when(status == "YELLOW", 2).when(status == "GREEN", 1).otherwise(0)


def status_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("", "GREEN", "YELLOW", "RED"))), rank + 1)


def worst(*statuses: Column) -> Column:
    """The worst of several statuses; a status never gets better."""
    return status_name(F.greatest(*map(status_rank, statuses)))


def nearest_rank(values: Column, q: float) -> Column:
    """Quantile of a sorted array: the element at floor(n * q), from 0."""
    return F.get(values, F.floor(F.size(values) * F.lit(q)).cast("int"))


def html_escaped(text: Column) -> Column:
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def csv_cell(value: Column) -> Column:
    """A quoted cell, quotes doubled, null empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def number_text(x: Column) -> Column:
    """A number as plain text, without a fraction where it is whole."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def money_text(x: Column, digits: int = 2) -> Column:
    """Fixed digits, null as zero."""
    return F.format_string(f"%.{digits}f", F.coalesce(x, F.lit(0.0)))


def currency_text(x: Column, symbol: str = "US$", digits: int = 2) -> Column:
    """An amount as Argentines write it: symbol, no-break space, points for thousands, a comma for the fraction."""
    plain = F.translate(F.format_number(F.abs(F.coalesce(x, F.lit(0.0))), digits), ",.", ".,")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(symbol + "\u00a0"), plain)


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *map(csv_cell, cells))
