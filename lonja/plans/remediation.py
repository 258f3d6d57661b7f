"""Queries of the gates, of remediation and of the image store, each beside its SQL. Their rows are parts with one damage or two each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions import colours, vocabulary
from lonja.functions import reasons as v
from lonja.operators import gates, remediation
from lonja.plans import domain as d
from lonja.plans.checks import _FULL, _MARKS, _NOUN, _ONE, _RANK, _SEVERE, _SWITCH, _m, _n, _q
from lonja.plans.checks import _CODE as _HAS_CODE
from lonja.plans.gates import _CODE, _case
from lonja.plans.registry import _FACTS, _IDENT
from lonja.sources import image_store
from lonja.storage import scratch

_COLOURS = ["", "Black", None, "Pink/White", "matte", "Purple White Blue RGB", "rojo", "Silver", "gris oscuro"]
_SHOWN = ["BLACK", "WHITE", None, "UNKNOWN", "PINK", "MULTICOLOR", "BLUE", "SILVER", "GOLD", "RED", ""]
_TOPS = [None, ["WHITE", "PINK"], ["BLUE"], [], ["PURPLE", "SILVER", "BLUE"]]
_MODELS = ["Standard", "Keyboard F75", "Ice Silver Switch PA12", "(Light AF82 screen", "(Extra keycap need be", "F87 (light", "Technical Parameters", "Black", "lilac", "Receiver", "Mouse G102 v2", "3.0 Switch 44 55", "Viper", None, ""]


def _cells(values: list, k: str, shift: int = 0, kind: str = "VARCHAR") -> str:
    """A pick in DuckDB from values that may be lists, doubles or null."""

    def cell(x):
        return "NULL" if x is None else f"[{', '.join(_q(y) for y in x)}]::VARCHAR[]" if isinstance(x, list) else _q(x) if isinstance(x, str) else f"{x}::DOUBLE"

    return f"list_extract([{', '.join(map(cell, values))}]::{kind}[], (({k} + {shift}) % {len(values)} + 1)::INT)"


def _list(values: list, k, shift: int = 0):
    cells = [F.lit(None).cast("array<string>") if x is None else F.array(*map(F.lit, x)).cast("array<string>") for x in values]
    return F.element_at(F.array(*cells), (F.pmod(k + shift, F.lit(len(values))) + 1).cast("int"))


def _photographed(s, sf):
    """The extracted rows with what their photos show."""
    k = F.col("row_seq")
    interior = F.struct(d._pick(_SHOWN, k, 1).alias("name"), (k * 7 % 101).cast("double").alias("confidence"), F.when(k % 3 != 0, (k * 11 % 101).cast("double")).alias("occupancy"), _list(_TOPS, k).alias("tops"))
    aspect = F.when(k % 5 != 0, (k % 40) / 16)
    calibrated = F.when(k % 7 == 0, F.struct((F.floor(aspect * 100 + 0.5) / 100).alias("aspect"), F.when(k % 2 == 0, "MOUSE").otherwise("TECLADO").alias("cat")))
    rows = d.items(s, sf).withColumns({"color": d._pick(_COLOURS, k), "interior": F.when(k % 4 != 1, interior), "aspect": aspect, "calibrated": calibrated})
    return rows.withColumns({"modelo": F.when(k % 2 == 0, d._pick(_MODELS, F.floor(k / 2).cast("long"))).otherwise(F.col("modelo")), "status": F.when(k % 6 == 0, "YELLOW").when(k % 13 == 0, "RED").otherwise("GREEN")})


_PHOTOGRAPHED = f"""{d.SQL_ROWS.replace("rows AS (", "rows0 AS (")}, rows AS (SELECT * REPLACE (CASE WHEN row_seq % 2 = 0 THEN {_cells(_MODELS, 'row_seq // 2')} ELSE modelo END AS modelo), {_cells(_COLOURS, 'row_seq')} AS color,
CASE WHEN row_seq % 4 <> 1 THEN {{'name': {_cells(_SHOWN, 'row_seq', 1)}, 'confidence': (row_seq * 7 % 101)::DOUBLE, 'occupancy': CASE WHEN row_seq % 3 <> 0 THEN (row_seq * 11 % 101)::DOUBLE END, 'tops': {_cells(_TOPS, 'row_seq', 0, 'VARCHAR[]')}}} END AS interior,
CASE WHEN row_seq % 5 <> 0 THEN (row_seq % 40)::DOUBLE / 16 END AS aspect, CASE WHEN row_seq % 7 = 0 THEN {{'aspect': floor(CASE WHEN row_seq % 5 <> 0 THEN (row_seq % 40)::DOUBLE / 16 END * 100 + 0.5::DOUBLE) / 100, 'cat': CASE WHEN row_seq % 2 = 0 THEN 'MOUSE' ELSE 'TECLADO' END}} END AS calibrated,
CASE WHEN row_seq % 6 = 0 THEN 'YELLOW' WHEN row_seq % 13 = 0 THEN 'RED' ELSE 'GREEN' END AS status FROM rows0)"""


def _names(values: list) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


_WORDS = _q(colours.PATTERN)
_FAMILY = "CASE lower(w) " + " ".join(f"WHEN {_q(k)} THEN {_q(x)}" for k, x in colours.FAMILY.items()) + " END"
_GROUP = "CASE {} " + " ".join(f"WHEN {_q(k)} THEN [{', '.join(map(_q, x))}]" for k, x in colours.COMPATIBLE.items()) + " ELSE []::VARCHAR[] END"


def _fits(declared: str, shown: str) -> str:
    return f"coalesce(upper({declared}) = upper({shown}) OR list_contains({_GROUP.format(f'upper({declared})')}, upper({shown})), false)"


def _declares(*texts: str) -> str:
    found = " || ".join(f"regexp_extract_all(coalesce({t}, ''), {_WORDS})" for t in texts)
    return f"list_filter(list_transform({found}, lambda w: {_FAMILY}), lambda x: x IS NOT NULL)"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def _shown(declared: str, tops: str) -> str:
    missing = f"len(list_filter({declared}, lambda f: len(list_filter({tops}, lambda t: {_fits('f', 't')})) = 0)) = 0"
    return f"coalesce(len({declared}) > 0 AND len({tops}) > 0 AND {missing}, false)"


def _unfit(cat: str, aspect: str) -> str:
    return f"coalesce((upper({cat}) IN {_names(colours.COMPACT)} AND {aspect} > 1.9::DOUBLE) OR (upper({cat}) IN {_names(colours.WIDE)} AND {aspect} < 0.65::DOUBLE), false)"


def _image_gate(source: str) -> str:
    """CTEs ig0 to ig over rows with the gate's columns: findings, intended and the status after it."""
    return f"""ig0 AS (SELECT *, {_declares('color', 'variante', 'modelo')} AS fam0, coalesce(interior.name <> '', false) AS sampled, floor(aspect * 100 + 0.5::DOUBLE) / 100 AS ratio FROM {source}),
ig1 AS (SELECT * EXCLUDE (fam0), {_distinct('fam0')} AS fam FROM ig0),
ig2 AS (SELECT *, coalesce(interior.name IN ('UNKNOWN', 'MULTICOLOR') OR interior.confidence < {colours.READABLE}, false) AS blind, sampled AND len(fam) > 1 AND {_shown('fam', 'interior.tops')} AS intended0 FROM ig1),
ig3 AS (SELECT *, sampled AND (len(fam) = 0 OR (NOT intended0 AND (blind OR len(fam) > 1))) AS noted FROM ig2),
ig4 AS (SELECT *, sampled AND NOT noted AND NOT intended0 AND NOT {_fits('fam[1]', 'interior.name')} AS off, {_unfit("coalesce(cat, '')", 'ratio')} AND NOT coalesce(calibrated.aspect = ratio AND calibrated.cat = upper(coalesce(cat, '')), false) AS bent FROM ig3),
ig AS (SELECT * EXCLUDE (sampled, ratio, blind) REPLACE (CASE WHEN status = 'GREEN' AND (off OR bent) THEN 'YELLOW' ELSE status END AS status), list_filter([CASE WHEN noted THEN 'color-ambiguous' END, CASE WHEN off THEN 'color-mismatch' END, CASE WHEN bent THEN 'category-aspect' END], lambda x: x IS NOT NULL) AS image_findings FROM ig4)"""


_HEAD = "array_to_string(list_reverse(list_reverse(regexp_split_to_array(m, '\\s+'))[2:]), ' ')"
_INSIDE = r"\b[A-Za-z][A-Za-z0-9]*\s?\d{1,4}[A-Za-z0-9-]*\b"


def _model_gate(source: str) -> str:
    """CTEs mg0 to mg over rows with modelo, variante, cat and status."""
    return f"""mg00 AS (SELECT *, trim(coalesce(modelo, '')) AS m, coalesce(modelo, '') AS raw_m, coalesce(variante, '') AS v0, upper(coalesce(cat, '')) AS uc0 FROM {source}), mg0 AS (SELECT *, {_ONE} AS one, {_HEAD} AS head, instr(raw_m, '(') AS pos, trim(substr(raw_m, 2)) AS inner_m FROM mg00),
mg1 AS (SELECT *, one <> '' AND NOT contains(one, ' ') AS single, {_m('head', '(?i)' + vocabulary.TYPE_WORDS)} AND {_m('raw_m', chr(92) + 'd')} AS glued, {_n('m', chr(92) + '(')} > {_n('m', chr(92) + ')')} AS cut, regexp_extract(inner_m, {_q(_INSIDE)}) AS inside FROM mg0),
mg2 AS (SELECT *, CASE WHEN {_m('m', '(?i)' + vocabulary.TEMPLATES)} THEN 'template-model' WHEN single AND one IN {_names(vocabulary.BARE_WORDS)} THEN 'generic-model' WHEN single AND one IN {_names(vocabulary.AMBIGUOUS_WORDS)} THEN 'ambiguous-model'
WHEN glued AND {_m('raw_m', '(?i)switch')} AND uc0 = 'SWITCH' AND NOT {_m('raw_m', '^' + chr(92) + 's*' + chr(92) + 'd')} THEN 'watch-model' WHEN glued THEN 'mid-model-type-keyword' WHEN single AND {_m('one', vocabulary.TYPE_WORDS)} THEN 'bare-type-word-model' WHEN single AND one IN {_names(vocabulary.WATCH_WORDS)} THEN 'watch-model'
WHEN cut AND (pos > 1 OR inside <> '') THEN 'truncated-model-repaired' WHEN cut THEN 'truncated-model' END AS rule FROM mg1),
mg3 AS (SELECT * REPLACE (CASE WHEN rule = 'template-model' AND status <> 'RED' THEN 'RED' WHEN status = 'GREEN' AND rule NOT IN ('watch-model', 'truncated-model-repaired') THEN 'YELLOW' ELSE status END AS status) FROM mg2),
mg4 AS (SELECT *, (rule IS NULL OR rule = 'truncated-model-repaired') AND status = 'GREEN' AND uc0 = 'OTRO' AS doubtful, coalesce(rule = 'truncated-model-repaired', false) AS mended FROM mg3),
mg AS (SELECT * EXCLUDE (m, raw_m, v0, uc0, one, head, pos, inner_m, single, glued, cut, inside, rule, doubtful, mended) REPLACE (CASE WHEN doubtful THEN 'YELLOW' ELSE status END AS status, CASE WHEN NOT mended THEN modelo WHEN pos > 1 THEN trim(substr(raw_m, 1, pos - 1)) ELSE inside END AS modelo,
CASE WHEN NOT mended THEN variante ELSE trim(regexp_replace(CASE WHEN pos > 1 THEN trim(substr(raw_m, pos)) ELSE trim(regexp_replace(replace(inner_m, inside, ''), '\\s+', ' ', 'g')) END || ' ' || v0, '\\s+', ' ', 'g')) END AS variante), list_filter([rule, CASE WHEN doubtful THEN 'doubtful-category' END], lambda x: x IS NOT NULL) AS model_findings FROM mg4)"""


# Damaged rows -----------------------------------------------------------------------------------------------------------


def damaged(s, sf):
    """Parts in runs of sixteen on a page, each with its own damage; the last of a run is sound. Four in a row share an image."""
    k = F.col("row_seq")
    j, g = k % 16, F.floor(k / 16).cast("long")
    base = F.concat(F.lit("K"), F.floor(k / 4).cast("string"), d._pick(["", " Pro", " Max", " Pro"], k))

    def by(values: dict, other):
        out = other
        for n, x in values.items():
            out = F.when(j == n, x).otherwise(out)
        return out

    fob = 10 + k % 80 + 0.5
    x, y = (k % 10 * 50).cast("double"), (j * 12).cast("double")
    price = F.when(g % 4 == 1, "$1.00").otherwise(F.concat(F.lit("$"), fob.cast("string")))

    def at(text, dx, dy):
        return F.struct(text.alias("str"), (x + dx).alias("x"), (y + dy).alias("y"), g.alias("page"))

    priced = at(price, F.when(g % 5 == 2, 60.0).otherwise(0.0), F.when(g % 5 == 3, 50.0).otherwise(10.0))
    texts = F.array_compact(F.array(F.when(j.isin(2, 14) | ((j == 3) & (g % 3 != 0)), priced), F.when(j.isin(4, 14), at(d._pick([")", " ) more", "x"], g), 0.0, 5.0)), F.when(j == 7, at(d._pick(["F75 keys", "none"], g), 0.0, 0.0))))
    none = F.lit(None)
    c = d.catalog(s, sf).select(
        "row_seq", "sku", F.concat(F.lit("Maker"), (F.floor(k / 8) % 5).cast("string")).alias("marca"),
        by({4: F.concat(F.lit("Cobra "), k.cast("string"), F.lit(" (Black")), 5: d._pick(["M720 Gateron Red Switch", "Gateron Red Switch", "S98 Glacier Axis"], g), 6: F.lit("Standard"), 7: d._pick(["PBT keycaps", "Travel backpack"], g), 8: F.lit("Ultra Crystalblade Gleam"), 14: F.concat(F.lit("Viper "), k.cast("string"), F.lit(" (White"))}, base).alias("modelo"),
        by({0: d._pick(["Black", "Black White", ""], g), 1: d._pick(["Pink/White", "Red/Green", ""], g), 6: d._pick(["AJ139 wired", "plain", "PAW3395"], g), 7: d._pick(["X11", "plain", "plain"], g)}, F.lit("wired")).alias("variante"),
        by({0: d._pick([None, "Black", "matte"], g)}, none.cast("string")).alias("color"), by({9: F.lit("MOUSE"), 11: F.lit("MOUSE")}, d._pick(["TECLADO", "MOUSE", "HEADSET", "TECLADO"], k)).alias("cat"), fob.cast("double").alias("fob"),
        F.concat(F.lit("data:image/png;base64,i"), F.floor(k / 4).cast("string")).alias("img"), F.when(j.isin(3, 13, 14), False).otherwise(True).alias("grounded"), F.when(k % 9 == 0, "YELLOW").otherwise("GREEN").alias("source_status"), F.lit("").alias("raw"), F.lit("list").alias("file"),
        F.when(j == 15, "GREEN").when(k % 31 == 0, "RED").otherwise("YELLOW").alias("status"), by({3: d._pick(["", "ancla no alineada"], g), 13: F.lit("ancla de fila vecina")}, F.lit("")).alias("grounding"), (j == 2).alias("outlier"),
        by({5: F.lit("switch-axis"), 8: F.lit("puffery")}, none.cast("string")).alias("marketing"), F.array_compact(F.array(by({0: F.lit("color-mismatch"), 1: F.lit("color-ambiguous"), 9: F.lit("category-aspect"), 10: F.lit("category-aspect"), 11: F.lit("cross-brand")}, none.cast("string")))).alias("gates"),
        F.array_compact(F.array(by({4: F.lit("Modelo truncado"), 14: F.lit("Modelo truncado"), 6: F.lit("palabra genérica"), 7: F.lit("categoría/fragmento de especificación sin código real"), 12: F.lit("Modelo truncado: falta cierre")}, none.cast("string")), F.when(j == 12, "x"))).alias("warnings"),
        F.when(j == 0, F.struct(d._pick(["WHITE", "UNKNOWN", "BLUE", "FUCHSIA"], g).alias("name"), d._pick([80.0, 60.0, 90.0], g).alias("confidence"), d._pick([50.0, None, 20.0, 70.0, 90.0], g).alias("occupancy"), none.cast("array<string>").alias("tops")))
        .when(j == 1, F.struct(F.lit("MULTICOLOR").alias("name"), F.lit(90.0).alias("confidence"), none.cast("double").alias("occupancy"), _list([["PINK", "WHITE"], ["BLUE"]], g).alias("tops"))).cast(gates.INTERIOR).alias("interior"),
        by({9: F.lit(2.1), 10: F.lit(2.5), 11: F.lit(2.2)}, none.cast("double")).alias("aspect"), by({9: d._pick(["teclado", None, "HEADSET"], g)}, none.cast("string")).alias("correction"),
        F.when((j == 10) & (g % 4 != 3), F.struct(d._pick([2.5, 2.4], g).alias("aspect"), F.lit("HEADSET").alias("cat"))).alias("calibrated"), x.alias("x"), y.alias("y"), g.alias("page"), texts.alias("texts"),
        F.when((j == 3) & (g % 3 == 0), F.array(priced)).alias("anchors"), (y + F.when(g % 7 == 6, 45.0).otherwise(0.0)).alias("text_y"),
    )
    return c.withColumns({"literal": none.cast(remediation.LITERAL), "anchor": none.cast(remediation.LITERAL), "intended": F.lit(False), "evidence": none.cast(remediation.EVIDENCE_TYPE)})


def _by(values: dict, other: str = "NULL") -> str:
    return "CASE j " + " ".join(f"WHEN {n} THEN {x}" for n, x in values.items()) + f" ELSE {other} END"


_PRICED = "{'str': CASE WHEN g % 4 = 1 THEN '$1.00' ELSE '$' || fob END, 'x': x + CASE WHEN g % 5 = 2 THEN 60 ELSE 0 END, 'y': y + CASE WHEN g % 5 = 3 THEN 50 ELSE 10 END, 'page': g}"
_EMPTY = "NULL::STRUCT(" + ", ".join(f"{k} {dict(string='VARCHAR', double='DOUBLE', bigint='BIGINT', boolean='BOOLEAN').get(t, 'VARCHAR[]')}" for k, t in remediation.EVIDENCE.items()) + ")"
_TEXT_TYPE = "STRUCT(str VARCHAR, x DOUBLE, y DOUBLE, page BIGINT)"
_DAMAGED = f"""{d.SQL_CATALOG}, dm0 AS (SELECT row_seq, sku, row_seq % 16 AS j, row_seq // 16 AS g, (10 + row_seq % 80 + 0.5)::DOUBLE AS fob, (row_seq % 10 * 50)::DOUBLE AS x, (row_seq % 16 * 12)::DOUBLE AS y, 'K' || row_seq // 4 || {_cells(['', ' Pro', ' Max', ' Pro'], 'row_seq')} AS base FROM catalog),
dm AS (SELECT row_seq, sku, 'Maker' || row_seq // 8 % 5 AS marca, {_by({4: "'Cobra ' || row_seq || ' (Black'", 5: _cells(['M720 Gateron Red Switch', 'Gateron Red Switch', 'S98 Glacier Axis'], 'g'), 6: "'Standard'", 7: _cells(['PBT keycaps', 'Travel backpack'], 'g'), 8: "'Ultra Crystalblade Gleam'", 14: "'Viper ' || row_seq || ' (White'"}, 'base')} AS modelo,
{_by({0: _cells(['Black', 'Black White', ''], 'g'), 1: _cells(['Pink/White', 'Red/Green', ''], 'g'), 6: _cells(['AJ139 wired', 'plain', 'PAW3395'], 'g'), 7: _cells(['X11', 'plain', 'plain'], 'g')}, "'wired'")} AS variante, {_by({0: _cells([None, 'Black', 'matte'], 'g')})} AS color, {_by({9: "'MOUSE'", 11: "'MOUSE'"}, _cells(['TECLADO', 'MOUSE', 'HEADSET', 'TECLADO'], 'row_seq'))} AS cat, fob,
'data:image/png;base64,i' || row_seq // 4 AS img, j NOT IN (3, 13, 14) AS grounded, CASE WHEN row_seq % 9 = 0 THEN 'YELLOW' ELSE 'GREEN' END AS source_status, '' AS raw, 'list' AS file, CASE WHEN j = 15 THEN 'GREEN' WHEN row_seq % 31 = 0 THEN 'RED' ELSE 'YELLOW' END AS status, {_by({3: _cells(['', 'ancla no alineada'], 'g'), 13: "'ancla de fila vecina'"}, "''")} AS grounding, j = 2 AS outlier,
{_by({5: "'switch-axis'", 8: "'puffery'"})} AS marketing, {_by({0: "['color-mismatch']", 1: "['color-ambiguous']", 9: "['category-aspect']", 10: "['category-aspect']", 11: "['cross-brand']"}, '[]::VARCHAR[]')} AS gates,
{_by({4: "['Modelo truncado']", 14: "['Modelo truncado']", 6: "['palabra genérica']", 7: "['categoría/fragmento de especificación sin código real']", 12: "['Modelo truncado: falta cierre', 'x']"}, '[]::VARCHAR[]')} AS warnings,
CASE j WHEN 0 THEN {{'name': {_cells(['WHITE', 'UNKNOWN', 'BLUE', 'FUCHSIA'], 'g')}, 'confidence': {_cells([80.0, 60.0, 90.0], 'g', 0, 'DOUBLE')}, 'occupancy': {_cells([50.0, None, 20.0, 70.0, 90.0], 'g', 0, 'DOUBLE')}, 'tops': NULL::VARCHAR[]}} WHEN 1 THEN {{'name': 'MULTICOLOR', 'confidence': 90::DOUBLE, 'occupancy': NULL::DOUBLE, 'tops': {_cells([['PINK', 'WHITE'], ['BLUE']], 'g', 0, 'VARCHAR[]')}}} END AS interior,
{_by({9: '2.1::DOUBLE', 10: '2.5::DOUBLE', 11: '2.2::DOUBLE'})} AS aspect, {_by({9: _cells(['teclado', None, 'HEADSET'], 'g')})} AS correction, CASE WHEN j = 10 AND g % 4 <> 3 THEN {{'aspect': {_cells([2.5, 2.4], 'g', 0, 'DOUBLE')}, 'cat': 'HEADSET'}} END AS calibrated, x, y, g AS page,
list_filter([CASE WHEN j IN (2, 14) OR (j = 3 AND g % 3 <> 0) THEN {_PRICED} END, CASE WHEN j IN (4, 14) THEN {{'str': {_cells([')', ' ) more', 'x'], 'g')}, 'x': x, 'y': y + 5, 'page': g}} END, CASE WHEN j = 7 THEN {{'str': {_cells(['F75 keys', 'none'], 'g')}, 'x': x, 'y': y, 'page': g}} END], lambda t: t IS NOT NULL)::{_TEXT_TYPE}[] AS texts,
CASE WHEN j = 3 AND g % 3 = 0 THEN [{_PRICED}] END::{_TEXT_TYPE}[] AS anchors, y + CASE WHEN g % 7 = 6 THEN 45 ELSE 0 END AS text_y, NULL::STRUCT(text VARCHAR, page BIGINT) AS literal, NULL::STRUCT(text VARCHAR, page BIGINT) AS anchor, false AS intended, {_EMPTY} AS evidence FROM dm0)"""


# The SQL of a pass ------------------------------------------------------------------------------------------------------

_BRACKETS = "(regexp_matches(coalesce(modelo, ''), '[({\\[]') AND NOT regexp_matches(coalesce(modelo, ''), '[)}\\]]'))"


def _code_in(x: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce({x}, ''), '(?i)(?:^|[\\s/-])([A-Za-z]{{1,6}}\\d{{1,4}}[\\w+]?)', 1), lambda z: NOT regexp_matches(z, '(?i)^paw\\d'))[1]"


def _price(x: str) -> str:
    c = f"regexp_replace(trim({x}), '[$€£¥\\s]', '', 'g')"
    good = f"regexp_matches(trim({x}), '^[$€£¥]?\\s?[\\d.,]+$') AND regexp_matches({c}, '^\\d{{1,3}}(?:[.,]\\d{{3}})*(?:[.,]\\d{{1,2}})?$')"
    return f"CASE WHEN {good} THEN try_cast(regexp_replace(regexp_replace({c}, '(\\d)[.,](\\d{{3}})(\\D|$)', '\\1\\2\\3'), '^([^,]*),', '\\1.') AS DOUBLE) END"


_REASON = f"""CASE WHEN status = 'GREEN' THEN NULL WHEN marketing = 'switch-axis' AND NOT sw THEN 'SWITCH_IN_MODEL' WHEN marketing IN ('puffery', 'marketing-only') THEN 'MODEL_MARKETING'
WHEN len(list_filter(gates, lambda u: {_case(v.GATE_REASONS, 'u')} IS NOT NULL)) > 0 THEN list_filter(list_transform(gates, lambda u: {_case(v.GATE_REASONS, 'u')}), lambda z: z IS NOT NULL)[1] WHEN outlier THEN 'OUTLIER_PRICE'
WHEN NOT grounded THEN CASE WHEN regexp_matches(coalesce(grounding, ''), '(?i)vecina|neighbor') THEN 'FOB_NEIGHBOR_ANCHOR' WHEN regexp_matches(coalesce(grounding, ''), '(?i)alinead|misalign') THEN 'FOB_UNALIGNED' ELSE 'FOB_NO_LITERAL_EVIDENCE' END
WHEN len(told) > 0 THEN told[1] WHEN source_status = 'GREEN' THEN 'LEGACY_ONLY_CLEAN' WHEN list_contains(gates, 'color-ambiguous') THEN 'COLOR_AMBIGUOUS' ELSE 'UNCLASSIFIED_YELLOW' END"""
_TEXT_FIELDS = ["remediated", "mode", "actual", "declared", "text", "before", "after", "moved", "source", "sibling"]


def _attempt(source: str) -> str:
    """CTEs at0 to tried over a table of damaged rows: reason, strategy, done, new values (n_) and evidence (e_) of rows not GREEN."""
    already = " OR ".join(f"(strategy0 = '{k}' AND (coalesce(evidence.remediated IN {_names(kinds)}, false){left}))" for (k, kinds), left in zip(remediation._KINDS.items(), [
        "", " OR intended", " OR literal IS NOT NULL", " OR anchor IS NOT NULL", "", " OR (vtoken IS NOT NULL AND token IS NULL)", "", "", "", "", ""]))
    fits = f"coalesce(abs({_price('t.str')} - fob) < 0.01::DOUBLE, false) AND (coalesce(abs(t.y - text_y), 0) <= 30 OR coalesce(abs(t.y - y), 0) <= 30) AND coalesce(abs(t.x - x), 0) <= 40"
    join = "array_to_string(list_filter([trim(coalesce(variante, '')), {0}], lambda z, i: z <> '' AND (i = 1 OR z <> trim(coalesce(variante, '')))), ' ')"
    declared = "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce({c}, ''), {_WORDS}), '')" for c in ("color", "variante", "modelo")) + ")"
    closing = "CASE WHEN contains(m, '(') AND NOT contains(m, ')') THEN ')' WHEN contains(m, '{{') AND NOT contains(m, '}}') THEN '}}' WHEN contains(m, '[') AND NOT contains(m, ']') THEN ']' END".replace("{{", "{").replace("}}", "}")
    kinds = {
        "colorFromImage": ("interior.name NOT IN ('UNKNOWN', 'MULTICOLOR') AND NOT coalesce(occ < 35, false) AND NOT coalesce(interior.confidence < 65, false) AND lower(interior.name) IN " + _names(colours.WORDS) + " AND declared IS NOT NULL", {"color": "interior.name", "variante": join.format("declared")}, {"remediated": "'color-from-image'", "mode": "'center-60%'", "actual": "interior.name", "declared": "declared", "occupancy": "occ"}),
        "varianteColorAdoption": (_shown("vfam", "tops"), {}, {"remediated": "'variante-color-adoption'", "colours": f"list_filter(vwords, lambda z, i: list_position(list_transform(vwords, lambda w: lower(w)), lower(z)) = i)", "tops": "tops"}),
        "literalPriceRegrounding": ("price IS NOT NULL", {"literal": "{'text': price.str, 'page': price.page}"}, {"remediated": "'literal-price-regrounding'", "mode": "'literal'", "text": "price.str", "page": "price.page", "dy": "coalesce(price.y - text_y, 0)"}),
        "literalAnchorSearch": ("price IS NOT NULL", {"grounded": "true", "anchor": "{'text': price.str, 'page': price.page}"}, {"remediated": "'literal-anchor-search'", "mode": "'literal'", "text": "price.str", "page": "price.page", "dx": "coalesce(price.x - x, 0)", "dy": "coalesce(price.y - text_y, 0)"}),
        "truncationRepair": ("len(list_filter(texts, lambda t: starts_with(trim(t.str), closing) AND coalesce(abs(t.y - text_y), 0) <= 30)) > 0", {"modelo": "m || closing"}, {"remediated": "'truncation-repaired'", "before": "m", "after": "m || closing"}),
        "switchToVariante": (f"token IS NOT NULL AND ({_m('rest', chr(92) + 'd')} OR {_m('rest', '(?i)' + chr(92) + 'b(?:' + vocabulary.NOUNS + ')' + chr(92) + 'b')} OR {_code_in('rest')} IS NOT NULL)", {"modelo": "rest", "variante": join.format("token")}, {"remediated": "'switch-to-variante'", "moved": "token", "after": "'variante'"}),
        "rowContextDisambiguation": ("coalesce(codes[1].c, neighbour_code) IS NOT NULL", {"modelo": "coalesce(codes[1].c, neighbour_code)"}, {"remediated": "'row-context-disambiguation'", "after": "coalesce(codes[1].c, neighbour_code)", "source": "coalesce(codes[1].s, 'sibling-row')"}),
        "codeAdoption": ("coalesce(codes[1].c, text_code, neighbour_code) IS NOT NULL", {"modelo": "coalesce(codes[1].c, text_code, neighbour_code)"}, {"remediated": "'code-adoption'", "after": "coalesce(codes[1].c, text_code, neighbour_code)", "source": "coalesce(codes[1].s, CASE WHEN text_code IS NOT NULL THEN 'row-text' END, 'sibling-row')"}),
        "sharedImageReassign": ("sibling_sku IS NOT NULL", {"cat": "sibling_cat"}, {"remediated": "'shared-image-reassign'", "after": "sibling_cat", "sibling": "sibling_sku", "image": "md5(img)"}),
        "legacyOnlyClean": (f"source_status = 'GREEN' AND NOT coalesce(outlier, false) AND coalesce(grounded, true) AND len(gates) = 0 AND coalesce(marketing, '') NOT IN ('puffery', 'marketing-only') AND NOT {_BRACKETS} AND len(stale) > 0", {"warnings": "list_filter(warnings, lambda z: NOT regexp_matches(z, '(?i)truncad'))"}, {"remediated": "'legacy-only-clean'", "source": "'GREEN'", "before": "stale[1]", "after": "modelo"}),
        "categoryCorrection": ("calibrated IS NOT NULL OR corrected OR shares", {"cat": "CASE WHEN calibrated IS NOT NULL THEN cat WHEN corrected THEN upper(correction) ELSE sibling_cat END"}, {
            "remediated": "CASE WHEN calibrated IS NOT NULL THEN 'aspect-calibrated' WHEN corrected THEN 'category-correction' ELSE 'shared-image-reassign' END", "aspect": "CASE WHEN calibrated IS NOT NULL THEN calibrated.aspect WHEN corrected THEN aspect END", "before": "CASE WHEN calibrated IS NULL AND corrected THEN upper(coalesce(cat, '')) END",
            "after": "CASE WHEN calibrated IS NOT NULL THEN calibrated.cat WHEN corrected THEN upper(correction) ELSE sibling_cat END", "sibling": "CASE WHEN calibrated IS NULL AND NOT corrected THEN sibling_sku END", "image": "CASE WHEN calibrated IS NULL AND NOT corrected THEN md5(img) END"}),
    }

    def per(field: str, part: int, other: str) -> str:
        cells = [f"WHEN '{k}' THEN {x[part][field]}" for k, x in kinds.items() if field in x[part]]
        return f"CASE WHEN done THEN CASE strategy {' '.join(cells)} ELSE {other} END ELSE {other} END" if cells else other

    types = dict(string="VARCHAR", double="DOUBLE", bigint="BIGINT", boolean="BOOLEAN")
    new = ", ".join(f"{per(c, 1, c)} AS n_{c}" for c in remediation.MUTABLE)
    facts = ", ".join(f"({per(k, 2, 'NULL')})::{types.get(t, 'VARCHAR[]')} AS e_{k}" for k, t in remediation.EVIDENCE.items() if k not in ("partial", "resolved"))
    codes = ", ".join(f"{{'c': {_code_in(c)}, 's': '{c}'}}" for c in ("sku", "modelo", "variante", "marca", "cat"))
    return f"""at0 AS (SELECT *, lower(trim(coalesce(cat, ''))) IN ('switch', 'interruptor') AS sw, trim(coalesce(modelo, '')) AS m FROM {source}),
at1 AS (SELECT *, {_SWITCH} AS token, list_filter(list_transform(warnings, lambda u: CASE WHEN ({_CODE}) = 'SWITCH_IN_MODEL' AND sw OR ({_CODE}) = 'MODEL_TRUNCATED' AND NOT {_BRACKETS} THEN NULL ELSE {_CODE} END), lambda z: z IS NOT NULL) AS told FROM at0),
at2 AS (SELECT * EXCLUDE (m), {_SWITCH} AS vtoken FROM (SELECT * EXCLUDE (m), m AS m_own, trim(coalesce(variante, '')) AS m FROM at1)), at3 AS (SELECT * EXCLUDE (m_own), m_own AS m, {_REASON} AS reason FROM at2 WHERE status <> 'GREEN'),
at4 AS (SELECT *, {_case(v.STRATEGIES, 'reason')} AS strategy0 FROM at3), at5 AS (SELECT *, CASE WHEN NOT coalesce({already}, false) THEN strategy0 END AS strategy FROM at4),
nb AS (SELECT a.row_seq, arg_min({_code_in('b.modelo')}, b.row_seq) AS neighbour_code FROM at5 a JOIN {source} b ON b.page = a.page AND abs(coalesce(b.y, 0) - coalesce(a.y, 0)) <= 30 AND b.sku <> a.sku AND {_code_in('b.modelo')} IS NOT NULL GROUP BY a.row_seq),
sb AS (SELECT a.row_seq, arg_min(b.sku, b.row_seq) AS sibling_sku, arg_min(upper(coalesce(b.cat, '')), b.row_seq) AS sibling_cat FROM at5 a JOIN {source} b ON b.img = a.img AND upper(b.marca) = upper(a.marca) AND b.sku <> a.sku AND trim(a.modelo) <> '' AND trim(b.modelo) <> ''
AND (contains(lower(trim(a.modelo)), lower(trim(b.modelo))) OR contains(lower(trim(b.modelo)), lower(trim(a.modelo)))) WHERE a.aspect IS NOT NULL AND a.strategy IN ('sharedImageReassign', 'categoryCorrection') AND NOT {_unfit("coalesce(b.cat, '')", 'a.aspect')} GROUP BY a.row_seq),
at6 AS (SELECT at5.*, neighbour_code, sibling_sku, sibling_cat, coalesce(interior.occupancy, interior.confidence) AS occ, {declared} AS declared, {_distinct("list_filter(interior.tops, lambda z: z <> '')")} AS tops, regexp_extract_all(coalesce(variante, ''), {_WORDS}) AS vwords, {_distinct(_declares('variante'))} AS vfam,
list_filter(list_concat(texts, coalesce(anchors, [])), lambda t: {fits})[1] AS price, {closing} AS closing, trim(regexp_replace(regexp_replace(m, '(?i)\\b' || regexp_escape(coalesce(token, '')) || '\\b', ''), '\\s+', ' ', 'g')) AS rest, list_filter([{codes}], lambda z: z.c IS NOT NULL) AS codes,
list_filter(list_transform(texts, lambda t: {_code_in('t.str')}), lambda z: z IS NOT NULL)[1] AS text_code, list_filter(warnings, lambda z: regexp_matches(z, '(?i)truncad')) AS stale, coalesce(correction <> '' AND upper(correction) <> upper(coalesce(cat, '')) AND aspect IS NOT NULL AND NOT {_unfit('correction', 'aspect')}, false) AS corrected,
sibling_sku IS NOT NULL AND coalesce(evidence.remediated, '') <> 'shared-image-reassign' AS shares FROM at5 LEFT JOIN nb ON nb.row_seq = at5.row_seq LEFT JOIN sb ON sb.row_seq = at5.row_seq),
at7 AS (SELECT *, coalesce(CASE strategy {' '.join(f"WHEN '{k}' THEN ({x[0]})" for k, x in kinds.items())} ELSE false END, false) AS done FROM at6), tried AS (SELECT *, {new}, {facts} FROM at7)"""


def _said(prefix: str) -> str:
    cells = [f"coalesce({prefix}{k}, '')" for k in _TEXT_FIELDS] + [f"coalesce({prefix}{k}::VARCHAR, '')" for k in ("occupancy", "page", "dx", "dy", "aspect")] + [f"coalesce(array_to_string({prefix}{k}, '+'), '')" for k in ("colours", "tops")]
    return f"concat_ws('|', {', '.join(cells)})"


_MUTABLE_SQL = "n_color AS color, n_variante AS variante, n_modelo AS modelo, n_cat AS cat, n_grounded AS grounded"


def _fixed(s, sf):
    rows = damaged(s, sf)
    return remediation.attempted(rows, rows)


def _shown_fix(tried):
    e = "fix.evidence."
    cells = [F.coalesce(F.col(e + k), F.lit("")) for k in _TEXT_FIELDS] + [F.coalesce(F.col(e + k).cast("string"), F.lit("")) for k in ("occupancy", "page", "dx", "dy", "aspect")] + [F.coalesce(F.array_join(e + k, "+"), F.lit("")) for k in ("colours", "tops")]
    new = [F.coalesce(F.col(f"fix.{c}"), F.col(c)).alias(c) for c in ("color", "variante", "modelo", "cat", "grounded")]
    return tried.select("row_seq", "strategy", F.col("fix").isNotNull().alias("done"), *new, F.concat_ws("|", *cells).alias("evidence"))


def _strategy(key):
    return lambda s, sf: _shown_fix(_fixed(s, sf).where(F.col("strategy") == key)).drop("strategy")


def _strategy_sql(key: str) -> str:
    return f"WITH {_DAMAGED}, {_attempt('dm')} SELECT row_seq, done, {_MUTABLE_SQL}, {_said('e_')} AS evidence FROM tried WHERE strategy = '{key}'"


def _traced() -> str:
    """Whether a GREEN row's evidence is borne out by the row."""
    e = "evidence"
    top = "array_to_string(list_filter(interior.tops, lambda z: z <> ''), '|')"
    proof = {
        "color-from-image": f"upper({e}.actual) = upper(interior.name) AND {e}.occupancy = coalesce(interior.occupancy, interior.confidence) AND {e}.mode = 'center-60%' AND {e}.declared <> ''",
        "variante-color-adoption": f"len({e}.tops) > 0 AND array_to_string({e}.tops, '|') = {top} AND len({e}.colours) > 0",
        "literal-price-regrounding": f"literal.text <> '' AND {e}.mode = 'literal' AND {e}.text = literal.text AND {e}.page IS NOT DISTINCT FROM literal.page", "literal-anchor-search": f"anchor.text <> '' AND {e}.mode = 'literal' AND {e}.text = anchor.text AND {e}.page IS NOT DISTINCT FROM anchor.page",
        "truncation-repaired": f"{e}.before <> '' AND {e}.after = modelo", "switch-to-variante": f"{e}.moved <> '' AND contains(lower(variante), lower({e}.moved)) AND NOT contains(lower(modelo), lower({e}.moved))",
        "row-context-disambiguation": f"{e}.after <> '' AND contains(lower(modelo), lower({e}.after))", "code-adoption": f"{e}.after <> '' AND contains(lower(modelo), lower({e}.after))", "shared-image-reassign": f"upper(cat) = upper({e}.after) AND {e}.sibling <> ''",
        "legacy-only-clean": f"{e}.source = 'GREEN' AND source_status = 'GREEN' AND {e}.after = modelo AND {e}.before IS NOT NULL AND NOT {_BRACKETS}", "category-correction": f"upper(cat) = upper({e}.after) AND {e}.aspect IS NOT NULL AND NOT {_unfit(e + '.after', e + '.aspect')}", "aspect-calibrated": f"{e}.aspect = calibrated.aspect AND upper({e}.after) = upper(cat)",
    }
    return f"coalesce(CASE evidence.remediated {' '.join(f'WHEN {_q(k)} THEN ({x})' for k, x in proof.items())} ELSE false END, false)"


def _pass_sql(source: str) -> str:
    """One pass as a subquery: repaired rows with all their columns, outcome, for_reason and strategy."""
    facts = ", ".join(f"'{k}': e_{k}" for k in remediation.EVIDENCE if k not in ("partial", "resolved"))
    kept = "row_seq, sku, marca, fob, img, source_status, raw, file, grounding, interior, aspect, correction, calibrated, x, y, page, texts, anchors, text_y, outlier AND n_literal IS NULL AS outlier, reason, strategy"
    own = ", ".join(f"n_{c} AS {c}" for c in remediation.MUTABLE if c != "warnings")
    severe = _SEVERE.replace(d.SQL_ROWS, f"rows AS (SELECT {kept}, {own}, {{{facts}, 'partial': NULL::BOOLEAN, 'resolved': NULL::VARCHAR}} AS evidence FROM tried WHERE done)")
    judged = f"jd AS (SELECT rows.*, CASE greatest({_RANK.format('v1.status0')}, {_RANK.format('upper(trim(rows.source_status))')}) WHEN 3 THEN 'RED' WHEN 2 THEN 'YELLOW' ELSE 'GREEN' END AS status, {_distinct('list_concat(v1.critical, v1.violations)')} AS warnings FROM rows JOIN v1 USING (row_seq))"
    holds = _traced()
    partly = ", ".join(f"'{k}': evidence.{k}" for k in remediation.EVIDENCE if k not in ("partial", "resolved"))
    kind = "CASE WHEN m2 = '' THEN 'plain' WHEN token IS NOT NULL AND NOT is_switch AND noun IS NULL THEN 'switch-axis' WHEN code THEN 'code' WHEN noun IS NOT NULL AND marks <= 1 AND lower(noun) <> lower(trim(coalesce(cat, ''))) THEN 'noun-phrase' WHEN marks >= 2 AND noun IS NULL THEN 'puffery' WHEN marks >= 1 THEN 'marketing-only' ELSE 'plain' END"
    return f"""(WITH {_attempt(source)}, {severe}, {judged}, {_image_gate('jd')}, {_model_gate('ig')},
ck AS (SELECT *, m AS m2, {_HAS_CODE} AS code, {_NOUN} AS noun, {_SWITCH} AS token, {_MARKS} AS marks, lower(trim(coalesce(cat, ''))) IN ('switch', 'interruptor') AS is_switch FROM (SELECT *, trim(coalesce(modelo, '')) AS m FROM mg)),
oc AS (SELECT * EXCLUDE (m, m2, code, noun, token, marks, is_switch, reason), {kind} AS marketing, reason AS for_reason, intended0 AS intended, list_concat(image_findings, list_filter(model_findings, lambda z: z NOT IN ('watch-model', 'truncated-model-repaired'))) AS gates, CASE WHEN status <> 'GREEN' THEN 'partial' WHEN {holds} THEN 'promoted' ELSE 'stayed' END AS outcome FROM ck)
SELECT {', '.join(_COLUMNS)}, outcome, for_reason, strategy FROM (SELECT * REPLACE (CASE WHEN status = 'GREEN' THEN evidence ELSE {{{partly}, 'partial': true, 'resolved': for_reason}} END AS evidence) FROM oc))"""


_COLUMNS = "row_seq sku marca modelo variante color cat fob img grounded source_status raw file status grounding outlier marketing gates warnings interior aspect correction calibrated x y page texts anchors text_y literal anchor intended evidence".split()


def _passes_sql(most: int) -> str:
    """CTEs s0 (damaged rows), r1 (repairs of the first pass), s1, r2 and so on: every pass over all rows, on only while the pass
    before promoted some and changed the numbers of statuses and labels."""
    out = [_DAMAGED, f"s0 AS (SELECT {', '.join(_COLUMNS)} FROM dm)"]
    for n in range(1, most + 1):
        go = "true" if n == 1 else f"(SELECT count(*) FILTER (outcome = 'promoted') > 0 FROM r{n - 1})"
        out.append(f"r{n} AS MATERIALIZED (SELECT * FROM {_pass_sql(f's{n - 1}')} WHERE {go})")
        out.append(f"s{n} AS MATERIALIZED (SELECT {', '.join(_COLUMNS)} FROM s{n - 1} WHERE row_seq NOT IN (SELECT row_seq FROM r{n} WHERE outcome <> 'stayed') UNION ALL SELECT {', '.join(_COLUMNS)} FROM r{n} WHERE outcome <> 'stayed')")
    return ", ".join(out)


def _one_pass(s, sf):
    rows = damaged(s, sf)
    return remediation.remediation_pass(rows, rows)


def _outcomes(done):
    return done.select("row_seq", F.col("for_reason").alias("reason"), "strategy", "outcome", "status", "modelo", "variante", "cat", F.array_join("warnings", ",").alias("warnings"), F.array_join("gates", ",").alias("gates"), F.col("evidence.remediated").alias("remediated"), F.col("evidence.resolved").alias("resolved"))


def _forged(s, sf):
    """Repaired rows of a pass, GREEN ones; the evidence of every third says something else."""
    done = _one_pass(s, sf).where("status = 'GREEN'")
    k = F.col("row_seq") % 3 == 0
    forged = F.col("evidence").withField("after", F.when(k, "other").otherwise(F.col("evidence.after"))).withField("actual", F.when(k, "other").otherwise(F.col("evidence.actual"))).withField("text", F.when(k, "$0").otherwise(F.col("evidence.text"))).withField("remediated", F.when(F.col("row_seq") % 11 == 0, "by-hand").otherwise(F.col("evidence.remediated")))
    return done.withColumn("evidence", forged)


def _token(s, sf):
    rows = damaged(s, sf).withColumn("t", remediation.literal_price()).where("t IS NOT NULL")
    return rows.select("row_seq", "t.str", "t.x", "t.y", "t.page")


def _verified_images(s, sf):
    return gates.image_text(_photographed(s, sf)).select("row_seq", "status", F.array_join("image_findings", ",").alias("findings"), F.array_join("declared", ",").alias("declared"), "intended")


def _with_images(s, sf):
    """Four rows share an image; some have a mark or nothing in its place."""
    img = F.when(F.col("row_seq") % 7 == 0, "-").when(F.col("row_seq") % 9 != 0, F.col("img"))
    return damaged(s, sf).select("row_seq", img.alias("img"))


def _unreferenced(s, sf):
    path = scratch(s, "images")
    saved = image_store.save(_with_images(s, sf), path)
    return image_store.unreferenced(saved.where("row_seq % 3 = 0"), path)


def _round_trip(s, sf):
    """Saved twice, collected against a third of the rows, loaded for all."""
    path, rows = scratch(s, "images"), _with_images(s, sf)
    saved = image_store.save(rows, path)
    image_store.save(rows, path)
    image_store.collect(saved.where("row_seq % 3 = 0"), path)
    return image_store.loaded(saved, path)


_STRATEGY_IDS = {
    "rs1_colour_from_image": "colorFromImage", "rs2_variant_colours": "varianteColorAdoption", "rs3_price_regrounding": "literalPriceRegrounding", "rs4_anchor_search": "literalAnchorSearch", "rs5_truncation": "truncationRepair", "rs6_switch_to_variant": "switchToVariante",
    "rs7_row_context": "rowContextDisambiguation", "rs8_code_adoption": "codeAdoption", "rs9_shared_image": "sharedImageReassign", "rs10_legacy_clean": "legacyOnlyClean", "rs11_category": "categoryCorrection",
}

QUERIES = {
    "v10_image_text": _verified_images,
    "v12_model_gate": lambda s, sf: gates.model_gate(_photographed(s, sf)).select("row_seq", "status", "modelo", "variante", F.array_join("model_findings", ",").alias("findings")),
    "v13_import_verification": lambda s, sf: gates.import_verification(_photographed(s, sf)),
    "rs14_literal_price": _token,
    "rs16_reverified": lambda s, sf: remediation.reverified(_fixed(s, sf)).select("row_seq", "status", F.array_join("warnings", ",").alias("warnings"), "marketing", "outlier"),
    "rs13_traced": lambda s, sf: _forged(s, sf).select("row_seq", remediation.traced().alias("traced")),
    "rs17_pass": lambda s, sf: _outcomes(_one_pass(s, sf)),
    "v21_promotion_audit": lambda s, sf: gates.promotion_audit(_one_pass(s, sf)),
    "st5_ledger": lambda s, sf: remediation.remediate(damaged(s, sf))[1],
    "st5_rows": lambda s, sf: remediation.remediate(damaged(s, sf))[0].select("row_seq", "status", "modelo", "variante", "color", "cat", F.col("evidence.remediated").alias("remediated")),
    **{name: _strategy(key) for name, key in _STRATEGY_IDS.items()},
    "k12_image_refs": lambda s, sf: image_store.save(_with_images(s, sf), scratch(s, "images")),
    "k12_unreferenced": _unreferenced,
    "k12_round_trip": _round_trip,
}

_IMAGES = f"{_DAMAGED}, wi AS (SELECT row_seq, CASE WHEN row_seq % 7 = 0 THEN '-' WHEN row_seq % 9 <> 0 THEN img END AS img FROM dm)"
_AUDITED = _SEVERE.replace(d.SQL_ROWS, "rows AS (SELECT * EXCLUDE (status, warnings) FROM p WHERE status = 'GREEN')")
_BASE = "row_seq, sku, marca, modelo, variante, cat, fob, img, grounded, source_status, raw, file, page, color, interior, aspect, calibrated, status, warnings"
_KIND = "CASE WHEN m = '' THEN 'plain' WHEN token IS NOT NULL AND NOT sw AND noun IS NULL THEN 'switch-axis' WHEN code THEN 'code' WHEN noun IS NOT NULL AND marks <= 1 AND lower(noun) <> lower(trim(coalesce(cat, ''))) THEN 'noun-phrase' WHEN marks >= 2 AND noun IS NULL THEN 'puffery' WHEN marks >= 1 THEN 'marketing-only' ELSE 'plain' END"
_VERIFIED = f"""WITH {_FULL.replace(d.SQL_ROWS, _PHOTOGRAPHED.replace(", rows AS (", ", rows1 AS (") + ", rows AS (SELECT * EXCLUDE (status) FROM rows1)")}, jd AS (SELECT {_BASE} FROM valid), {_image_gate('jd')},
{_FACTS.replace(d.SQL_IMAGED, "imaged AS (SELECT row_seq, marca, modelo, cat, status, CASE WHEN starts_with(lower(img), 'data:image/') THEN img END AS img FROM ig)")},
sh0 AS (SELECT i.row_seq, i.img, i.status, coalesce(n_cats > 1, false) AS across, coalesce(n_brands > 1 AND models > 1 AND {_IDENT.format('modelo')} || '|' || upper(cat) <> kept_model, false) AS brands, first FROM imaged i LEFT JOIN facts f ON f.img = i.img),
sh AS (SELECT row_seq, across, brands, CASE WHEN NOT ((across AND row_seq <> first) OR brands) THEN img END IS NULL AS bare FROM sh0),
sg AS (SELECT ig.* REPLACE (CASE WHEN status = 'GREEN' AND (across OR bare) THEN 'YELLOW' ELSE status END AS status), list_filter([CASE WHEN across THEN 'cross-category' END, CASE WHEN brands THEN 'cross-brand' END, CASE WHEN bare THEN 'placeholder-image' END], lambda z: z IS NOT NULL) AS sharing FROM ig JOIN sh USING (row_seq)), {_model_gate('sg')},
w0 AS (SELECT *, trim(coalesce(modelo, '')) AS m, lower(trim(coalesce(cat, ''))) IN ('switch', 'interruptor') AS sw, '' AS grounding, false AS outlier, list_concat(list_concat(image_findings, sharing), list_filter(model_findings, lambda z: z NOT IN ('watch-model', 'truncated-model-repaired'))) AS gates FROM mg),
w1 AS (SELECT *, {_HAS_CODE} AS code, {_NOUN} AS noun, {_SWITCH} AS token, {_MARKS} AS marks, list_filter(list_transform(warnings, lambda u: CASE WHEN ({_CODE}) = 'SWITCH_IN_MODEL' AND sw OR ({_CODE}) = 'MODEL_TRUNCATED' AND NOT {_BRACKETS} THEN NULL ELSE {_CODE} END), lambda z: z IS NOT NULL) AS told FROM w0),
w2 AS (SELECT *, {_KIND} AS marketing FROM w1), w3 AS (SELECT *, {_REASON} AS reason FROM w2)"""
_PASS = f"WITH {_DAMAGED}, p AS {_pass_sql('dm')}"
ORACLE_SQL = {
    "v10_image_text": f"WITH {_PHOTOGRAPHED}, {_image_gate('rows')} SELECT row_seq, status, array_to_string(image_findings, ',') AS findings, array_to_string(fam, ',') AS declared, intended0 AS intended FROM ig",
    "v12_model_gate": f"WITH {_PHOTOGRAPHED}, {_model_gate('rows')} SELECT row_seq, status, modelo, variante, array_to_string(model_findings, ',') AS findings FROM mg",
    "v13_import_verification": f"{_VERIFIED} SELECT row_seq, sku, CASE WHEN reason = 'UNCLASSIFIED_YELLOW' THEN 'YELLOW' ELSE status END AS status, reason, array_to_string(gates, ',') AS gates, modelo, variante, CASE WHEN reason = 'UNCLASSIFIED_YELLOW' THEN true ELSE status <> 'RED' END AS importable FROM w3",
    "rs14_literal_price": f"WITH {_DAMAGED}, {_attempt('(SELECT * REPLACE (CASE WHEN status = $$GREEN$$ THEN $$YELLOW$$ ELSE status END AS status) FROM dm)')} SELECT row_seq, price.str AS str, price.x AS x, price.y AS y, price.page AS page FROM at6 WHERE price IS NOT NULL",
    "rs16_reverified": f"{_PASS} SELECT row_seq, status, array_to_string(warnings, ',') AS warnings, marketing, outlier FROM p",
    "rs17_pass": f"{_PASS} SELECT row_seq, for_reason AS reason, strategy, outcome, status, modelo, variante, cat, array_to_string(warnings, ',') AS warnings, array_to_string(gates, ',') AS gates, evidence.remediated AS remediated, evidence.resolved AS resolved FROM p",
    "rs13_traced": f"{_PASS}, fg AS (SELECT * REPLACE (struct_update(evidence, after := CASE WHEN row_seq % 3 = 0 THEN 'other' ELSE evidence.after END, actual := CASE WHEN row_seq % 3 = 0 THEN 'other' ELSE evidence.actual END, text := CASE WHEN row_seq % 3 = 0 THEN '$0' ELSE evidence.text END, remediated := CASE WHEN row_seq % 11 = 0 THEN 'by-hand' ELSE evidence.remediated END) AS evidence) FROM p WHERE status = 'GREEN') SELECT row_seq, {_traced()} AS traced FROM fg",
    "v21_promotion_audit": f"{_PASS}, q AS (WITH {_AUDITED} SELECT evidence.remediated AS remediated, status0 FROM v1) SELECT remediated, count(*) AS promoted, count(*) FILTER (status0 <> 'GREEN') AS false_promotions FROM q GROUP BY remediated",
    "st5_ledger": f"WITH {_passes_sql(5)} " + " UNION ALL ".join(f"SELECT row_seq, {n}::INT AS pass, for_reason AS reason, strategy, outcome FROM r{n}" for n in range(1, 6)),
    "st5_rows": f"WITH {_passes_sql(5)} SELECT row_seq, status, modelo, variante, color, cat, evidence.remediated AS remediated FROM s5",
    **{name: _strategy_sql(key) for name, key in _STRATEGY_IDS.items()},
    "k12_image_refs": f"WITH {_IMAGES} SELECT row_seq, CASE WHEN img LIKE 'data:%' THEN 'image:' || sha256(img) ELSE img END AS img FROM wi",
    "k12_unreferenced": f"WITH {_IMAGES} SELECT sha256(img) AS digest FROM wi WHERE img LIKE 'data:%' GROUP BY img HAVING count(*) FILTER (row_seq % 3 = 0) = 0",
    "k12_round_trip": f"WITH {_IMAGES} SELECT row_seq, CASE WHEN img NOT LIKE 'data:%' OR img IN (SELECT img FROM wi WHERE row_seq % 3 = 0) THEN img END AS img FROM wi",
}
