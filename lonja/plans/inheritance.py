"""Queries of names inherited down pages and files, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.operators import inheritance as op
from lonja.operators import spatial
from lonja.plans import domain as d

_NAMES = ["", "K70 Pro", "", "black", "", "", "M750", "wireless charging", "", "new items ceased", "", "", "(extra keycap)", "V8", "Cobra 99", "", "", "item", "white", "Rapid Trigger", "", "  ", "G3 Berry"]
_VARIANTS = ["red", "", "black edition", "", "silver", "M750 blue", "  white  "]
_LINES = ["AJ139 Pro Mouse", "Red $12.50", "USD", "机械键盘", "6941234567890", "¥85", "RZ01-0401-R", "Damulin", "Keyboard F75 -", "x", "Gasket  mount", "$ 3.2", "12.5, 30", "Wired", "Silent ¥90 $14 -", "", "Blue tactile", "K $9.99", "long " * 30]
_FAMILY = ["Viper Ultimate Cyberpunk Red", "Black", "white", "Orochi V2 Roblox Edition", "dark blue", "Pink -", "Ornata V3 X low profile", "matte", "K1", "Hyperspeed wl", "Purple", "", "Silver Basilisk", "Coral", "Green Black Quartz 12"]


def _rows(s, sf):
    k = F.col("item")
    name, variant = d._pick(_NAMES, k * 7), d._pick(_VARIANTS, F.floor(k / 5).cast("long"))
    return d.page_items(s, sf).withColumns({"page": F.floor(k / 64).cast("long"), "y": (F.col("y") % 240), "modelo": F.when(k % 41 != 0, name), "variante": F.when(k % 43 != 0, variant), "fob": F.when(k % 47 != 0, F.floor(k / 2) % 3 * 0.005 + 1)})


def _lines(s, sf):
    k = F.col("item")
    return d.page_items(s, sf).select("file", "page", "y", "item", F.when(k % 53 != 0, d._pick(_LINES, F.floor(k * 5 / 3).cast("long"))).alias("text"))


def _families(s, sf):
    k = F.col("item")
    return d.page_items(s, sf).withColumns({"marca": d._pick(d.BRANDS, F.floor(k / 300).cast("long")), "cat": F.when(k % 3 == 0, "TECLADO").otherwise("MOUSE"), "modelo": F.when(k % 59 != 0, d._pick(_FAMILY, F.floor(k * 7 / 2).cast("long"))), "variante": d._pick(["", None, "3-Mode"], k)})


def _fused(s, sf):
    rows = _rows(s, sf)
    return op.fused(op.filled(op.carried(rows)), spatial.row_heights(rows))


QUERIES = {
    "w6_row_context": lambda s, sf: op.row_context(_lines(s, sf)),
    "w7_carried_models": lambda s, sf: op.carried(_rows(s, sf)).select("item", "kind", "blank", "modelo", "variante", "from_fob"),
    "w8_filled_models": lambda s, sf: op.filled(op.carried(_rows(s, sf))).select("item", "modelo", "variante", "filled"),
    "w9_fused_models": lambda s, sf: _fused(s, sf).select("item", "kind", "modelo", "variante", "filled", "fused"),
    "w10_families": lambda s, sf: op.families(_families(s, sf)).select("item", "modelo", "variante", "base"),
}


def _is(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


_NOISY = lambda t: f"(length({t}) < 2 OR length({t}) > {op.LONGEST_LINE} OR " + " OR ".join(_is(t, p) for p in op.NOISE) + ")"
_PRICE = r"try_cast(replace(nullif(regexp_extract(regexp_replace(text, '[¥￥0-9]\$', '', 'g'), '\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)', 1), ''), ',', '') AS DOUBLE) BETWEEN 0.10 AND 500"
_SQL_LINES = f"""{d.SQL_ITEMS}, l AS (SELECT file, page, y, item, coalesce(CASE WHEN item % 53 <> 0 THEN {d._sql_pick(_LINES, '(item * 5 // 3)')} END, '') AS text FROM items), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page, y, item) AS n, coalesce({_PRICE}, false) AS price, {_NOISY('text')} AS noise FROM l)"""
_W6 = rf"""WITH {_SQL_LINES}, stop AS (SELECT i.file, i.n, max(CASE WHEN j.price THEN j.n END) AS s FROM n i LEFT JOIN n j ON j.file = i.file AND j.n BETWEEN i.n - {op.BACK} AND i.n - 1 WHERE i.price GROUP BY i.file, i.n),
b AS (SELECT s.file, s.n, j.n AS place, j.text, row_number() OVER (PARTITION BY s.file, s.n ORDER BY j.n DESC) AS k FROM stop s JOIN n j ON j.file = s.file AND j.n BETWEEN s.n - {op.BACK} AND s.n - 1 AND j.n > coalesce(s.s, 0) AND NOT j.noise),
g AS (SELECT file, n, arg_min(text, place) AS first, list_slice(list(text ORDER BY place), 2, 99) AS rest FROM b WHERE k <= {op.KEPT} GROUP BY file, n),
c AS (SELECT n.*, trim(regexp_replace(regexp_replace(text, '[¥￥]\s*[\d,]+\.?\d*', '', 'g'), '\$\s*[\d,]+\.?\d*', '', 'g')) AS bare FROM n WHERE price), e AS (SELECT *, CASE WHEN {_NOISY('bare')} THEN '' ELSE trim(regexp_replace(bare, '[-\s]+$', '')) END AS inl FROM c)
SELECT e.file, page, item, trim(substr(coalesce(first, inl), 1, {op.CHARS})) AS modelo, CASE WHEN first IS NULL THEN '' ELSE substr(trim(regexp_replace(array_to_string(list_filter(list_append(rest, inl), lambda t: t <> ''), ' '), '\s+', ' ', 'g')), 1, {op.CHARS}) END AS variante
FROM e LEFT JOIN g ON g.file = e.file AND g.n = e.n WHERE coalesce(first, inl) <> ''"""

_RAW = f"""{d.SQL_ITEMS}, r AS (SELECT file, item // 64 AS page, item, x, y % 240 AS y, CASE WHEN item % 47 <> 0 THEN item // 2 % 3 * 0.005::DOUBLE + 1 END AS fob, coalesce(trim(CASE WHEN item % 41 <> 0 THEN {d._sql_pick(_NAMES, '(item * 7)')} END), '') AS raw, coalesce(trim(CASE WHEN item % 43 <> 0 THEN {d._sql_pick(_VARIANTS, '(item // 5)')} END), '') AS v FROM items),
t AS (SELECT *, CASE WHEN raw[1] = '(' THEN '' ELSE raw END AS m, list_filter(regexp_split_to_array(lower(raw), '[\\s+/-]+'), lambda w: w <> '') AS words FROM r),
f AS (SELECT * EXCLUDE (words), raw[1] = '(' OR raw = '' OR {_is('raw', f'(?i)^({op.COLOURS})$')} OR (len(words) > 0 AND NOT (regexp_matches(raw, '(?i)(^|[\\s-])[a-z]{{1,6}}\\d{{1,4}}') AND NOT regexp_matches(raw, '(?i)^paw\\d')) AND len(list_filter(words, lambda w: NOT regexp_full_match(w, '{op.SPEC}'))) = 0) AS bare,
  length(m) > 2 AND lower(m) NOT IN ('item', 'producto') AS valid, row_number() OVER (PARTITION BY file, page ORDER BY y NULLS FIRST, x NULLS FIRST, item) AS n FROM t)"""
_HOLDS = rf"(c <> '' AND NOT regexp_matches(c, '(?i)\b({op.LOUD})\b'))"
_STEP = f"""f.file, f.page, f.n, f.item, f.y, f.x, f.fob, f.raw = '' AS blank, f.v,
  CASE WHEN NOT f.bare THEN 'own' WHEN {_HOLDS} THEN 'inherited' WHEN f.v <> '' THEN 'swap' WHEN f.m <> '' THEN 'own' ELSE 'none' END AS kind,
  CASE WHEN NOT f.bare THEN f.m WHEN {_HOLDS} THEN c WHEN f.v <> '' THEN f.v ELSE f.m END AS modelo, CASE WHEN f.bare AND {_HOLDS} THEN p END AS from_fob,
  CASE WHEN f.bare AND {_HOLDS} THEN c WHEN f.valid AND (NOT f.bare OR f.v = '') THEN f.m ELSE c END AS c, CASE WHEN (f.bare AND {_HOLDS}) OR (f.valid AND (NOT f.bare OR f.v = '')) THEN f.fob ELSE p END AS p"""
#: The rows of a page one after the other, with the name that holds and its price.
_W7 = f"""{_RAW}, seq AS (SELECT {_STEP} FROM f, (SELECT '' AS c, NULL::DOUBLE AS p) WHERE f.n = 1 UNION ALL SELECT {_STEP} FROM seq JOIN f ON f.file = seq.file AND f.page = seq.page AND f.n = seq.n + 1)"""
_W8 = f"""{_W7}, s AS (SELECT *, kind = 'swap' AND blank AS waits, NOT blank AND kind <> 'swap' AS gives, row_number() OVER (PARTITION BY file, page ORDER BY n) AS k FROM seq WHERE kind <> 'none'),
z AS (SELECT s.file, s.page, s.k, min(o.k) AS e FROM s JOIN s o ON o.file = s.file AND o.page = s.page AND o.k > s.k AND NOT o.waits WHERE s.waits GROUP BY s.file, s.page, s.k),
w8 AS (SELECT s.* EXCLUDE (modelo, v), CASE WHEN o.gives THEN o.modelo END AS filled, CASE WHEN o.gives THEN o.modelo ELSE s.modelo END AS modelo,
  CASE WHEN s.waits THEN array_to_string(list_filter(regexp_split_to_array(s.v, '\\s+'), lambda w: NOT list_contains(regexp_split_to_array(lower(s.modelo), '\\s+'), lower(w))), ' ') ELSE s.v END AS variante
  FROM s LEFT JOIN z ON z.file = s.file AND z.page = s.page AND z.k = s.k LEFT JOIN s o ON o.file = z.file AND o.page = z.page AND o.k = z.e)"""
_W9 = f"""{_W8}, gaps AS (SELECT file, page, y - lag(y) OVER (PARTITION BY file, page ORDER BY y) AS gap FROM (SELECT DISTINCT file, page, y FROM f)),
h AS (SELECT file, page, coalesce(floor(avg(gap) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE, {op.HEIGHT}) AS h FROM (SELECT file, page, CASE WHEN gap > 5 AND gap < 300 THEN gap END AS gap FROM gaps) GROUP BY file, page),
u AS (SELECT a.item, arg_min(b.modelo, b.k) AS name, min(b.y) - any_value(a.y) <= any_value(h.h) * {op.REACH} AS near FROM w8 a JOIN h ON h.file = a.file AND h.page = a.page JOIN w8 b ON b.file = a.file AND b.page = a.page AND b.k > a.k AND b.kind <> 'inherited' AND abs(b.fob - a.fob) <= {op.CENT}
  WHERE a.kind = 'inherited' AND abs(a.fob - a.from_fob) >= {op.CENT} GROUP BY a.item)"""
_ALONE = rf"(?i)^({op.FAMILY_ALONE})[\s\-.]*$"
_BASES = f"""{d.SQL_ITEMS}, r AS (SELECT file, page, y, x, item, {d._sql_pick(d.BRANDS, '(item // 300)')} AS marca, CASE WHEN item % 3 = 0 THEN 'TECLADO' ELSE 'MOUSE' END AS cat, coalesce(CASE WHEN item % 59 <> 0 THEN {d._sql_pick(_FAMILY, '(item * 7 // 2)')} END, '') AS m, coalesce({d._sql_pick(['', None, '3-Mode'], 'item')}, '') AS v FROM items),
f AS (SELECT *, length(trim(m)) <= {op.SHORT} AND (regexp_matches(trim(m), '{_ALONE}') OR regexp_matches(trim(m), '(?i)^[a-z\\s-]+$')) AS asks, row_number() OVER (PARTITION BY file, marca, cat ORDER BY page, y, x, item) AS n FROM r)"""
_LONG = lambda t: f"(length({t}) > {op.BASE} AND NOT regexp_matches(trim({t}), '{_ALONE}'))"
_CORE = rf"trim(regexp_replace(regexp_replace(CASE WHEN {_LONG('o1')} THEN o1 WHEN {_LONG('o2')} THEN o2 WHEN {_LONG('o3')} THEN o3 ELSE '' END, '(?i)\b({op.FAMILY_COLOURS})\b', '', 'g'), '\s+', ' ', 'g'))"
_OUT = f"CASE WHEN f.asks AND length({_CORE}) > {op.CORE} THEN {_CORE} END"
_W10 = f"""WITH RECURSIVE {_BASES}, seq AS (SELECT file, marca, cat, n, item, trim(m) AS own, v, NULL::VARCHAR AS base, m AS o1, '' AS o2, '' AS o3 FROM f WHERE n = 1
UNION ALL SELECT f.file, f.marca, f.cat, f.n, f.item, trim(f.m), f.v, {_OUT}, coalesce({_OUT}, f.m), o1, o2 FROM seq JOIN f ON f.file = seq.file AND f.marca = seq.marca AND f.cat = seq.cat AND f.n = seq.n + 1)
SELECT item, o1 AS modelo, CASE WHEN base IS NULL THEN v ELSE trim(own || CASE WHEN v <> '' THEN ' ' || v ELSE '' END) END AS variante, base FROM seq"""

ORACLE_SQL = {
    "w6_row_context": _W6,
    "w7_carried_models": f"WITH RECURSIVE {_W7} SELECT item, kind, blank, modelo, v AS variante, from_fob FROM seq",
    "w8_filled_models": f"WITH RECURSIVE {_W8} SELECT item, modelo, variante, filled FROM w8",
    "w9_fused_models": f"WITH RECURSIVE {_W9} SELECT w8.item, kind, CASE WHEN near AND name <> '' THEN name ELSE modelo END AS modelo, variante, filled, CASE WHEN near AND name <> '' AND name <> modelo THEN name END AS fused FROM w8 LEFT JOIN u ON u.item = w8.item",
    "w10_families": _W10,
}
