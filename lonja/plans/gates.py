"""Queries of confidence, atomic reasons and page rows, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions import reasons as v
from lonja.functions import rules
from lonja.operators import reasons, spatial
from lonja.plans import domain as d
from lonja.plans.checks import _STRICT

_MARKETING = [None, None, "switch-axis", None, "puffery", None, None, "marketing-only", "code", None, None]
_GATES = [None, "color-ambiguous", None, None, "cross-brand", None, "template-model", None, "odd", None, "color-mismatch", None, None]
_TEXTS = [
    None, "Modelo truncado: falta cierre", None, "El modelo incluye el tipo de SWITCH/axis", "Precio $12 fuera de rango", None, "CATEGORÍA DUDOSA", "x", "Imagen angosta", "Marca no detectada", None, "Modelo = specs técnicas", "SKU inválido",
    "Evidencia de grounding insuficiente", "Categoría minoritaria", "Modelo es ruido corporativo", "FOB inválido", None, "ya", "Modelo vacío", "Modelo es un precio numérico",
]
_WHERE = ["", "ancla de fila vecina", "ancla no alineada", None]


def _evaluated(s, sf):
    return reasons.confidence(d.items(s, sf), F.trim("img").rlike(_STRICT))


def _merged(s, sf):
    k = F.col("row_seq")
    told = F.array_compact(F.array(d._pick(_TEXTS, k), F.when(k % 3 == 0, "IMAGE_MISSING")))
    return reasons.merged(_evaluated(s, sf).withColumns({"source_confidence": F.when(k % 2 == 0, (k % 101).cast("int")), "source_warnings": F.when(k % 7 != 0, told), "image_warnings": F.when(k % 5 == 0, F.array(F.lit("shape")))}))


def _reasoned(s, sf):
    k = F.col("row_seq")
    none = F.array_compact(F.array(d._pick(_TEXTS, k, 5), d._pick(_TEXTS, k, 9)))
    rows = d.items(s, sf).withColumns({
        "marketing": d._pick(_MARKETING, k), "gates": F.array_compact(F.array(d._pick(_GATES, k), d._pick(_GATES, k, 3))), "outlier": k % 37 == 0, "grounding": d._pick(_WHERE, k), "warnings": none,
        "status": F.when(k % 9 == 0, "GREEN").when(k % 4 == 0, "RED").otherwise("YELLOW"), "cat": F.when(k % 6 == 0, " Switch ").otherwise(F.col("cat")),
    })
    return reasons.instrumented(rows)


def _fine_items(s, sf):
    return d.page_items(s, sf).withColumn("y", F.col("y") * 0.25)


def _anchors(s, sf):
    return d.page_items(s, sf).where("price IS NOT NULL").select("file", "page", "item", "x", "y")


QUERIES = {
    "t19_evidence_gap": lambda s, sf: d.items(s, sf).select("row_seq", F.array_join(reasons.evidence_gap(F.col("modelo"), F.col("marca"), F.col("raw")), ",").alias("codes")),
    "v8_confidence": lambda s, sf: _evaluated(s, sf).select("row_seq", "eval.confidence", "eval.status", F.array_join("eval.warnings", ",").alias("warnings")),
    "v9_merged": lambda s, sf: _merged(s, sf).select("row_seq", "confidence", "status", F.array_join("warnings", ",").alias("warnings"), "quality_reason"),
    "v14_atomic_reason": lambda s, sf: _reasoned(s, sf).select("row_seq", "reason"),
    "v15_instrumented": lambda s, sf: _reasoned(s, sf).select("row_seq", "status", F.array_join("warnings", ",").alias("warnings"), "quality_reason"),
    "v15_invariant": lambda s, sf: reasons.reasons_hold(_reasoned(s, sf)),
    "rs0_strategies": lambda s, sf: reasons.review(_reasoned(s, sf)).select("row_seq", "reason", "strategy"),
    "rs15_left_classes": lambda s, sf: reasons.review(_reasoned(s, sf)).groupBy("left_class").agg(F.count("*").alias("n")),
    "rs18_labels": lambda s, sf: reasons.review(_reasoned(s, sf)).select("row_seq", "label"),
    "w3_text_rows": lambda s, sf: spatial.text_rows(_fine_items(s, sf).withColumn("text", F.col("item").cast("string")), "text"),
    "w5_cell_bounds": lambda s, sf: spatial.cell_bounds(_anchors(s, sf)),
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {x if isinstance(x, float) else _q(x)}" for k, x in table.items()) + " END"


_NOISE = _q(rf"(?i)\b({v.CELL_NOISE})\b")
_GAP = f"""gap AS (SELECT row_seq, word, cell, CASE WHEN cell <> '' AND length(word) >= 4 AND NOT contains(lower(regexp_replace(cell, '\\s+', '', 'g')), left(word, 3)) THEN
list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(cell, {_NOISE}, ' ', 'g'), '[^0-9A-Za-z_À-ɏ]+', ' ', 'g')), '\\s+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '\\d+') AND NOT regexp_matches(w, '(?i)^\\d+([.,]\\d+)?({v.UNITS})\\b') AND NOT list_contains(string_split(lower(marca), ' '), lower(w))) ELSE [] END AS codes
FROM (SELECT row_seq, marca, trim(raw) AS cell, lower(replace(regexp_extract(modelo, '[A-Za-z0-9][A-Za-z0-9.-]*'), '-', '')) AS word FROM rows))"""
_EVAL = f"""{d.SQL_ROWS}, {_GAP}, t AS (SELECT row_seq, list_filter([CASE WHEN marca IN ('', 'OTRO') THEN 'BRAND_MISSING' END, CASE WHEN cat = 'OTRO' THEN 'CATEGORY_UNCLASSIFIED' END, CASE WHEN length(modelo) < 2 THEN 'MODEL_EMPTY' END, CASE WHEN fob <= 0 THEN 'FOB_INVALID' END, CASE WHEN grounded IS NULL THEN 'FOB_UNGROUNDED' END], lambda x: x IS NOT NULL) AS c,
list_filter([CASE WHEN fob > 0 AND (fob < coalesce(greatest(0.01, {_case({c: low * 0.5 for c, low, *_ in rules.PRICE_RANGES}, 'cat')}), 0.5) OR fob > coalesce({_case({c: high for c, _, high, *_ in rules.PRICE_RANGES}, 'cat')}, 350)) THEN 'PRICE_RANGE' END,
CASE WHEN NOT coalesce(regexp_matches(trim(img), {_q(_STRICT)}), false) THEN 'IMAGE_MISSING' END, CASE WHEN len(codes) > 0 THEN 'MODEL_WITHOUT_EVIDENCE' END, CASE WHEN NOT grounded THEN 'FOB_NO_LITERAL_EVIDENCE' END], lambda x: x IS NOT NULL) AS w FROM rows JOIN gap USING (row_seq)),
ev AS (SELECT row_seq, greatest(0, 100 - 15 * (list_contains(w, 'PRICE_RANGE')::INT + list_contains(w, 'IMAGE_MISSING')::INT) - 20 * list_contains(w, 'MODEL_WITHOUT_EVIDENCE')::INT - 25 * list_contains(w, 'FOB_NO_LITERAL_EVIDENCE')::INT - 30 * len(c)) AS confidence,
CASE WHEN len(c) > 0 THEN 'RED' WHEN len(w) > 0 THEN 'YELLOW' ELSE 'GREEN' END AS status, list_concat(c, w) AS warnings FROM t)"""
_TOLD = f"list_filter([{d._sql_pick(_TEXTS, 'row_seq')}, CASE WHEN row_seq % 3 = 0 THEN 'IMAGE_MISSING' END], lambda x: x IS NOT NULL)"
_CODE = "CASE " + " ".join(f"WHEN regexp_matches(u, {_q('(?i)' + p)}) THEN {_q(c)}" for p, c in v.WARNING_REASONS) + " END"
_REASON = f"""{d.SQL_ROWS}, g AS (SELECT row_seq, modelo, grounded, source_status, CASE WHEN row_seq % 6 = 0 THEN 'Switch' ELSE cat END = 'Switch' OR cat = 'SWITCH' AND row_seq % 6 <> 0 AS sw, {d._sql_pick(_MARKETING, 'row_seq')} AS marketing, list_filter([{d._sql_pick(_GATES, 'row_seq')}, {d._sql_pick(_GATES, 'row_seq', 3)}], lambda x: x IS NOT NULL) AS gates,
row_seq % 37 = 0 AS outlier, coalesce({d._sql_pick(_WHERE, 'row_seq')}, '') AS place, list_filter([{d._sql_pick(_TEXTS, 'row_seq', 5)}, {d._sql_pick(_TEXTS, 'row_seq', 9)}], lambda x: x IS NOT NULL) AS told, CASE WHEN row_seq % 9 = 0 THEN 'GREEN' WHEN row_seq % 4 = 0 THEN 'RED' ELSE 'YELLOW' END AS status FROM rows),
cl AS (SELECT row_seq, i, {_CODE} AS code FROM (SELECT row_seq, unnest(told) AS u, unnest(range(len(told))) AS i FROM g)), ok AS (SELECT row_seq, min_by(code, i) AS code FROM cl JOIN g USING (row_seq) WHERE code IS NOT NULL AND NOT (code = 'SWITCH_IN_MODEL' AND sw) AND NOT (code = 'MODEL_TRUNCATED' AND NOT (regexp_matches(modelo, '[({{\\[]') AND NOT regexp_matches(modelo, '[)}}\\]]'))) GROUP BY row_seq),
gt AS (SELECT row_seq, min_by(code, i) AS code FROM (SELECT row_seq, i, {_case(v.GATE_REASONS, 'u')} AS code FROM (SELECT row_seq, unnest(gates) AS u, unnest(range(len(gates))) AS i FROM g)) WHERE code IS NOT NULL GROUP BY row_seq),
rs AS (SELECT g.row_seq, marketing, status, told, CASE WHEN status = 'GREEN' THEN NULL WHEN marketing = 'switch-axis' AND NOT sw THEN 'SWITCH_IN_MODEL' WHEN marketing IN ('puffery', 'marketing-only') THEN 'MODEL_MARKETING' WHEN gt.code IS NOT NULL THEN gt.code WHEN outlier THEN 'OUTLIER_PRICE'
WHEN NOT grounded THEN CASE WHEN contains(place, 'vecina') THEN 'FOB_NEIGHBOR_ANCHOR' WHEN contains(place, 'alinead') THEN 'FOB_UNALIGNED' ELSE 'FOB_NO_LITERAL_EVIDENCE' END WHEN ok.code IS NOT NULL THEN ok.code WHEN source_status = 'GREEN' THEN 'LEGACY_ONLY_CLEAN' WHEN list_contains(gates, 'color-ambiguous') THEN 'COLOR_AMBIGUOUS' ELSE 'UNCLASSIFIED_YELLOW' END AS reason
FROM g LEFT JOIN ok ON ok.row_seq = g.row_seq LEFT JOIN gt ON gt.row_seq = g.row_seq), ins AS (SELECT row_seq, marketing, reason, CASE WHEN reason = 'UNCLASSIFIED_YELLOW' THEN 'YELLOW' ELSE status END AS status, CASE WHEN reason = 'UNCLASSIFIED_YELLOW' THEN list_concat([{_q(v.NO_REASON)}], told) ELSE told END AS warnings FROM rs)"""
_ANCHORS = f"{d.SQL_ITEMS}, a AS (SELECT file, page, item, x, y FROM items WHERE price IS NOT NULL)"

ORACLE_SQL = {
    "t19_evidence_gap": f"WITH {d.SQL_ROWS}, {_GAP} SELECT row_seq, array_to_string(codes, ',') AS codes FROM gap",
    "v8_confidence": f"WITH {_EVAL} SELECT row_seq, confidence::INT AS confidence, status, array_to_string(warnings, ',') AS warnings FROM ev",
    "v9_merged": f"""WITH {_EVAL}, m AS (SELECT row_seq, CASE WHEN row_seq % 2 = 0 THEN least(confidence, row_seq % 101) ELSE confidence END::INT AS confidence, status, list_concat(CASE WHEN row_seq % 7 <> 0 THEN {_TOLD} ELSE [] END, warnings, CASE WHEN row_seq % 5 = 0 THEN ['shape'] ELSE [] END) AS l FROM ev),
n AS (SELECT * REPLACE (list_filter(l, lambda x, i: list_position(l, x) = i) AS l) FROM m) SELECT row_seq, confidence, status, array_to_string(l, ',') AS warnings, coalesce(l[1], {_q(v.NO_REMARK)}) AS quality_reason FROM n""",
    "v14_atomic_reason": f"WITH {_REASON} SELECT row_seq, reason FROM rs",
    "v15_instrumented": f"WITH {_REASON} SELECT row_seq, status, array_to_string(warnings, ',') AS warnings, coalesce(warnings[1], {_q(v.NO_REMARK)}) AS quality_reason FROM ins",
    "v15_invariant": f"WITH {_REASON} SELECT count(*) AS rows, count(*) FILTER (reason IS NULL OR len(warnings) = 0) AS broken FROM ins WHERE status <> 'GREEN'",
    "rs0_strategies": f"WITH {_REASON} SELECT row_seq, reason, {_case(v.STRATEGIES, 'reason')} AS strategy FROM ins WHERE status <> 'GREEN'",
    "rs15_left_classes": f"WITH {_REASON} SELECT CASE WHEN reason = 'MODEL_MARKETING' AND marketing = 'puffery' THEN 'model-marketing-puffery' ELSE coalesce({_case(v.LEFT_CLASSES, 'reason')}, lower(reason)) END AS left_class, count(*) AS n FROM ins WHERE status <> 'GREEN' GROUP BY 1",
    "rs18_labels": f"WITH {_REASON} SELECT row_seq, coalesce({_case(v.LABELS, 'reason')}, warnings[1], reason, {_q(v.NO_REMARK)}) AS label FROM ins WHERE status <> 'GREEN'",
    "w3_text_rows": f"""WITH RECURSIVE {d.SQL_ITEMS}, f AS (SELECT file, page, item, x, y * 0.25::DOUBLE AS y FROM items), ys AS (SELECT DISTINCT file, page, y FROM f), st(file, page, y) AS (SELECT file, page, min(y) FROM ys GROUP BY file, page UNION ALL SELECT st.file, st.page, min(ys.y) FROM st JOIN ys ON ys.file = st.file AND ys.page = st.page AND ys.y > st.y + 6 GROUP BY st.file, st.page, st.y),
b AS (SELECT f.*, st.y AS row_y FROM f ASOF JOIN st ON f.file = st.file AND f.page = st.page AND f.y >= st.y) SELECT file, page, row_y, min({{'y': y, 'x': x}}).x AS row_x, string_agg(item::VARCHAR, ' ' ORDER BY x, y, item) AS text FROM b GROUP BY file, page, row_y""",
    "w5_cell_bounds": f"""WITH {_ANCHORS}, s AS (SELECT l.item, max(CASE WHEN (r.x, r.y, r.item) < (l.x, l.y, l.item) THEN r.x END) AS b, min(CASE WHEN (r.x, r.y, r.item) > (l.x, l.y, l.item) THEN r.x END) AS n, min(r.x) AS lo, max(r.x) AS hi, count(*) AS k FROM a l JOIN a r ON r.file = l.file AND r.page = l.page AND abs(r.y - l.y) <= 30 GROUP BY l.item),
u AS (SELECT l.item, max(r.y) AS up FROM a l JOIN a r ON r.file = l.file AND r.page = l.page AND r.y < l.y - 10 GROUP BY l.item) SELECT a.item, CASE WHEN b IS NOT NULL THEN (b + x) / 2 ELSE greatest(0, x - CASE WHEN k > 1 THEN (n - x) / 2 ELSE 140 END) END AS min_x, CASE WHEN n IS NOT NULL THEN (n + x) / 2 ELSE x + CASE WHEN k > 1 THEN (hi - lo) / (k - 1) / 2 ELSE 140 END END AS max_x,
y - CASE WHEN up IS NULL THEN 160 ELSE least(240, greatest(40, y - up)) END + 5 AS min_y, y + 12 AS max_y FROM a JOIN s USING (item) LEFT JOIN u ON u.item = a.item""",
}
