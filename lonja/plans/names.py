"""Queries of tidied names, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions import names
from lonja.operators import inheritance as op
from lonja.plans import domain as d

_FIELDS = ["Black wireless", "red/Red tri-mode Mouse", "USB-C sakura pink", "Hall Effect magnetic switch", "teclado negro", "", None, "2.4GHz BLUE blue", "nothing here", "rgb"]
_TITLES = ["Combo MK120 Mouse", "Charging Dock Mouse", "Wireless Keyboard", "K1 released new", "AJ139 V2 MC (white) AJ139 V2 MC", "mouse", "Razer Viper Viper V3", "combo  combo Pad hub", "A A 12 12 1,5 1,5", "Gaming-mouse X stand new camera desk hub", None, "  Pro   cable ", "combo"]
_TEXTS = ["V8", "PAW3950MAX", "Model X1", "8KHz", "Tri mode", "Magnetic Charging Dock", "G3 Berry", "black", "paw3395 K70", "99G Air PRO"]


def _rows(s, sf):
    k = F.col("row_seq")
    return d.catalog(s, sf).select("row_seq", d._pick(_FIELDS, k).alias("field"), F.when(k % 5 == 0, F.concat("marca", F.lit(" "), "modelo", F.lit(" "), "modelo")).otherwise(d._pick(_TITLES, k)).alias("title"), F.when(k % 3 == 0, d._pick(["Razer", "OTRO", "", None], F.floor(k / 3).cast("long"))).otherwise(F.col("marca")).alias("brand"))


def _specs(s, sf):
    k = F.col("item")
    return d.page_items(s, sf).withColumns({"page": F.floor(k / 64).cast("long"), "y": F.col("y") % 480, "modelo": d._pick(_TEXTS, k * 3), "text": F.when(k % 31 != 0, d._pick(_TEXTS, k))})


QUERIES = {
    "t14_colour_field": lambda s, sf: _rows(s, sf).select("row_seq", names.colour_field(F.col("field")).alias("c")).select("row_seq", "c.color", F.array_join("c.moved", ",").alias("moved")),
    "t16_trailing_kind": lambda s, sf: _rows(s, sf).select("row_seq", names.trailing_kind(F.col("title"), F.col("field")).alias("n")).select("row_seq", "n.*"),
    "t17_codes_above": lambda s, sf: op.codes_above(_specs(s, sf).where("item % 2 = 0"), _specs(s, sf), _specs(s, sf).where("price IS NOT NULL").withColumn("x", F.col("x") + 400)).select("item", "modelo", "code"),
    "t18_title": lambda s, sf: _rows(s, sf).select("row_seq", names.title(F.col("title"), F.col("brand")).alias("n")).select("row_seq", "n.*"),
}

_SQL_ROWS = f"""{d.SQL_CATALOG}, r AS (SELECT row_seq, {d._sql_pick(_FIELDS, 'row_seq')} AS field, CASE WHEN row_seq % 5 = 0 THEN marca || ' ' || modelo || ' ' || modelo ELSE {d._sql_pick(_TITLES, 'row_seq')} END AS title, CASE WHEN row_seq % 3 = 0 THEN {d._sql_pick(['Razer', 'OTRO', '', None], 'row_seq // 3')} ELSE marca END AS brand FROM catalog)"""
_GONE = rf"(?i)\b(?:{names.MOVED_WORDS})\b"
_SPEC = rf"(len(regexp_extract_all(modelo, '[^\s+/-]+')) > 0 AND (NOT regexp_matches(modelo, '(?i)(^|[\s-])[a-z]{{1,6}}\d{{1,4}}') OR regexp_matches(modelo, '(?i)^paw\d')) AND NOT regexp_matches(modelo, '(?i)\sk\d') AND (len(list_filter(regexp_extract_all(lower(modelo), '[^\s+/-]+'), lambda w: NOT regexp_full_match(w, '{op.SPEC}'))) = 0 OR regexp_matches(modelo, '(?i)^paw\d\w*$')))"
ORACLE_SQL = {
    "t14_colour_field": f"""WITH {_SQL_ROWS}, k AS (SELECT row_seq, unnest(regexp_extract_all(regexp_replace(coalesce(field, ''), '{_GONE}', ' ', 'g'), '(?i)\\b({names.KEPT_COLOURS})\\b')) AS w, generate_subscripts(regexp_extract_all(regexp_replace(coalesce(field, ''), '{_GONE}', ' ', 'g'), '(?i)\\b({names.KEPT_COLOURS})\\b'), 1) AS i FROM r),
u AS (SELECT row_seq, arg_min(w, i) AS w, min(i) AS i FROM k GROUP BY row_seq, lower(w)), g AS (SELECT row_seq, string_agg(w, ' ' ORDER BY i) AS color FROM u GROUP BY row_seq)
SELECT r.row_seq, coalesce(color, '') AS color, array_to_string(regexp_extract_all(coalesce(field, ''), '{_GONE}'), ',') AS moved FROM r LEFT JOIN g ON g.row_seq = r.row_seq""",
    "t16_trailing_kind": rf"""WITH RECURSIVE {_SQL_ROWS}, s AS (SELECT row_seq, trim(coalesce(title, '')) AS m, trim(coalesce(field, '')) AS v, 0 AS n FROM r UNION ALL SELECT row_seq,
  CASE WHEN e THEN regexp_replace(array_to_string(w[:-2], ' '), '\s+', ' ', 'g') ELSE array_to_string(w[2:], ' ') END, trim(regexp_replace(CASE WHEN e THEN v || ' ' || w[-1] ELSE w[1] || ' ' || v END, '\s+', ' ', 'g')), n + 1
  FROM (SELECT *, regexp_matches(w[-1], '(?i)(\b({names.KINDS})|^({names.STATES}))$') AS e FROM (SELECT *, regexp_split_to_array(m, '\s+') AS w FROM s WHERE n < {names.ROUNDS})) WHERE len(w) > 1 AND CASE WHEN e THEN NOT (len(w) = 2 AND regexp_full_match(w[1], '(?i)({names.NO_NAME})')) ELSE lower(w[1]) = 'combo' END)
SELECT row_seq, arg_max(m, n) AS modelo, arg_max(v, n) AS variante FROM s GROUP BY row_seq""",
    "t17_codes_above": rf"""WITH {d.SQL_ITEMS}, r AS (SELECT file, item // 64 AS page, item, x, y % 480 AS y, price, {d._sql_pick(_TEXTS, '(item * 3)')} AS modelo, CASE WHEN item % 31 <> 0 THEN {d._sql_pick(_TEXTS, 'item')} END AS text FROM items), p AS (SELECT file, page, avg(x + 400) AS px FROM r WHERE price IS NOT NULL GROUP BY file, page),
c AS (SELECT r.* FROM r JOIN p ON p.file = r.file AND p.page = r.page AND x >= 0 AND x <= px * 0.35::DOUBLE WHERE (regexp_matches(text, '(?i)^[a-z]{{1,6}}\d') AND NOT regexp_matches(text, '(?i)^paw\d') OR regexp_matches(text, '(?i)\s[a-z]{{1,6}}\d')) AND NOT regexp_matches(text, '(?i)^({op.BLOCK_TITLES})\b')),
b AS (SELECT a.item, max({{'y': c.y, 'i': -c.item, 't': c.text}}).t AS t, max(a.y - c.y) AS d FROM r a JOIN c ON c.file = a.file AND c.page = a.page AND c.y < a.y AND a.y - c.y <= 250 WHERE a.item % 2 = 0 GROUP BY a.item)
SELECT r.item, CASE WHEN ok THEN t ELSE modelo END AS modelo, CASE WHEN ok THEN t END AS code FROM (SELECT r.item, modelo, t, coalesce({_SPEC} AND NOT contains(lower(modelo), lower(split_part(t, ' ', 1))), false) AS ok FROM r LEFT JOIN b ON b.item = r.item WHERE r.item % 2 = 0) r""",
    "t18_title": rf"""WITH {_SQL_ROWS}, a AS (SELECT row_seq, coalesce(brand NOT IN ('', 'OTRO'), false) AS known, '(?i)^\Q' || coalesce(brand, '') || '\E' AS front, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS t FROM r), b AS (SELECT *, CASE WHEN known THEN trim(regexp_replace(t, front || '\s+', '')) ELSE t END AS u FROM a),
w AS (SELECT row_seq, unnest(string_split(u, ' ')) AS w, generate_subscripts(string_split(u, ' '), 1) AS i FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY row_seq, lower(w) ORDER BY i) AS k FROM w), o AS (SELECT row_seq, string_agg(w, ' ' ORDER BY i) AS o FROM f WHERE k = 1 OR length(w) <= 2 OR regexp_full_match(w, '[\d.,$/-]+') GROUP BY row_seq),
z AS (SELECT b.row_seq, trim(CASE WHEN known THEN regexp_replace(coalesce(o, ''), front || '\s*', '') ELSE coalesce(o, '') END) AS m FROM b LEFT JOIN o ON o.row_seq = b.row_seq)
SELECT row_seq, CASE WHEN regexp_matches(m, '\([^)]+\)') THEN trim(regexp_replace(m, '\([^)]+\)', '')) ELSE m END AS modelo, trim(regexp_extract(m, '\(([^)]+)\)', 1)) AS variante FROM z""",
}
