"""Queries of validation and text rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions import rules, text, vocabulary as v
from lonja.operators import checks
from lonja.plans import domain as d
from lonja.plans.registry import _RANGES, _r0, _r2
from lonja.sources import sinks


def _valid(s, sf):
    return checks.full_validation(d.items(s, sf))


def _of_rows(build):
    """One text function over the rows: (row_seq, its column or the fields of its struct)."""

    def run(s, sf):
        rows = d.items(s, sf).select("row_seq", build().alias("x"))
        return rows.select("row_seq", "x.*") if rows.schema["x"].dataType.typeName() == "struct" else rows.withColumnRenamed("x", "value")

    return run


def _issues(s, sf):
    rows = _valid(s, sf).select("row_seq", "sku", "cat", "status", F.explode("warnings").alias("issue"))
    return rows.join(d.items(s, sf).select("row_seq", "marca", "modelo", "variante", "fob"), "row_seq").withColumns({"field": F.lit("row"), "detail": F.concat(F.lit('"'), "issue", F.lit('"'))})


def _orders(s, sf):
    """Orders of extracted rows, some with bad quantities."""
    rows = d.items(s, sf)
    lines = s.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("row_seq"), (F.col("l_quantity") + F.when(F.col("l_linenumber") == 5, 0.5).otherwise(0)).alias("qty"))
    return lines.join(rows, "row_seq")


def _before(s, sf):
    return _valid(s, sf).withColumn("status", F.when(F.col("row_seq") % 9 == 0, "GREEN").otherwise(F.col("status"))).where("row_seq % 10 != 0")


_CUSTOM = [("House", r"no\s+brand"), ("Any", r"generic$")]


def _pixel():
    return tuple(F.pmod(F.col("row_seq") * k, F.lit(256)).cast("double") for k in (37, 91, 53))


QUERIES = {
    "v1_item_validation": lambda s, sf: checks.item_validation(d.items(s, sf)).select("row_seq", "status", "score", F.array_join("critical", ",").alias("critical"), F.array_join("violations", ",").alias("violations")),
    "v2_contract": lambda s, sf: checks.contract(d.items(s, sf)),
    "v3_null_item": lambda s, sf: checks.contract(d.items(s, sf).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "row_seq" else F.col("row_seq") for f in d.items(s, sf).schema.fields))).groupBy("code").agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count("*").alias("n")),
    "v4_full_validation": lambda s, sf: _valid(s, sf).select("row_seq", "status", F.size("warnings").alias("n_warnings")),
    "v17_pass_criteria": lambda s, sf: checks.pass_criteria(_valid(s, sf)),
    "f3_importable": lambda s, sf: checks.importable(checks.contract(d.items(s, sf))),
    "f4_split": lambda s, sf: checks.split_summary(_valid(s, sf)),
    "f5_preview_filter": lambda s, sf: _valid(s, sf).where((F.col("status") == "YELLOW") & F.lower("sku").contains("1")).select("row_seq"),
    "f7_selection": lambda s, sf: checks.selection(_valid(s, sf)),
    "f9_product_errors": lambda s, sf: checks.product_errors(d.items(s, sf)).select("row_seq", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings")),
    "f9_categories": lambda s, sf: checks.category_vocabulary(d.items(s, sf).withColumn("cat", F.when(F.col("row_seq") % 7 == 0, F.concat(F.lower("cat"), F.lit(" x"))).otherwise(F.col("cat")))),
    "f10_order_errors": lambda s, sf: checks.order_errors(_orders(s, sf)),
    "f13_image_states": _of_rows(lambda: text.image_state(F.col("img"))),
    "f14_eligible": lambda s, sf: _valid(s, sf).where("status != 'RED'").select("row_seq"),
    "f15_refused_orders": lambda s, sf: checks.refused_orders(_orders(s, sf), _valid(s, sf)),
    "a10_ten_codes": lambda s, sf: checks.violations_by_code(checks.contract(d.items(s, sf))),
    "a11_top_issues": lambda s, sf: checks.reasons(_valid(s, sf)).groupBy("reason").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "reason").limit(5),
    "a15_import_summary": lambda s, sf: checks.import_summary(_valid(s, sf)),
    "a16_pass_stats": lambda s, sf: checks.reasons(_valid(s, sf)),
    "a17_deltas": lambda s, sf: checks.status_deltas(_valid(s, sf), _before(s, sf)),
    "a18_page_stats": lambda s, sf: checks.page_stats(_valid(s, sf), d.items(s, sf)),
    "a26_extraction_counts": lambda s, sf: checks.extraction_counts(d.items(s, sf)),
    "k15_audit_csv": lambda s, sf: sinks.audit_csv(_issues(s, sf)),
    "t2_usd_price": _of_rows(lambda: text.usd_price(F.col("raw"))),
    "t3_price_token": _of_rows(lambda: text.price_token(F.col("raw"))),
    "t5_price_category": _of_rows(lambda: text.price_category(F.col("cat"), F.col("fob") / 10)),
    "t8_model_variant": _of_rows(lambda: text.model_and_variant(F.col("modelo"))),
    "t10_model_quality": lambda s, sf: d.items(s, sf).select("row_seq", text.model_quality(F.col("modelo"), F.col("cat"), F.col("raw")).alias("q")).select("row_seq", "q.level", F.array_join("q.reasons", "; ").alias("reasons")),
    "t11_marketing_class": _of_rows(lambda: text.marketing_class(F.col("modelo"), F.col("cat"))),
    "t12_switch_token": _of_rows(lambda: text.switch_token(F.col("modelo"))),
    "t13_product_noun": _of_rows(lambda: text.product_noun(F.col("modelo"))),
    "t21_expanded": _of_rows(lambda: text.expanded(F.concat_ws(" ", "modelo", "raw"))),
    "t28_model_classes": _of_rows(lambda: text.model_classes(F.col("modelo"))),
    "x1_brand_of_line": _of_rows(lambda: F.coalesce(text.brand_of_line(F.col("raw"), _CUSTOM), F.lit("-"))),
    "x2_brand_of_content": lambda s, sf: d.items(s, sf).select("row_seq", F.coalesce(text.brand_of_content(F.concat(F.repeat(F.lit("."), (F.col("row_seq") % 2 * 2990).cast("int")), "raw")), F.lit("-")).alias("value")),
    "x3_brand_of_file": _of_rows(lambda: text.brand_of_file(F.col("file"))),
    "x4_category": _of_rows(lambda: text.category(F.concat_ws(" ", "modelo", "raw"), F.col("marca"))),
    "x9_colour": _of_rows(lambda: text.colour_name(*_pixel())),
}


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _m(x: str, p: str) -> str:
    return f"regexp_matches({x}, {_q(p)})"


def _n(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(p)}))"


def _some(*cells: str) -> str:
    return f"list_filter([{', '.join(cells)}]::VARCHAR[], lambda x: x IS NOT NULL)"


_CODE = f"regexp_matches(regexp_replace(m, '(?i)(^|[\\s-])paw\\d', '\\1#', 'g'), {_q('(?i)' + v.CODE.replace('(?!paw' + chr(92) + 'd)', ''))})"
_SWITCH = f"""CASE WHEN regexp_extract(m, '(?i)\\bswitch(?:es)?\\b') <> '' THEN array_to_string(list_append(list_reverse(list_reverse(list_filter(regexp_split_to_array(trim(regexp_extract(m, '(?is)^(.*?)\\bswitch(?:es)?\\b', 1)), '\\s+'), lambda x: x <> ''))[1:2]), regexp_extract(m, '(?i)\\bswitch(?:es)?\\b')), ' ')
WHEN {_m('m', '(?i)' + chr(92) + 'bmagnetic' + chr(92) + 'b')} THEN 'Magnetic' WHEN regexp_extract(m, '(?i)\\bhall\\s*effect\\b') <> '' THEN regexp_extract(m, '(?i)\\bhall\\s*effect\\b') WHEN regexp_extract(m, '(?i)\\b[\\w.-]*axis(?:es)?\\b') <> '' THEN regexp_extract(m, '(?i)\\b[\\w.-]*axis(?:es)?\\b') END"""
_NOUN = f"nullif(regexp_extract(m, {_q('(?i)' + chr(92) + 'b(?:' + v.NOUNS + ')' + chr(92) + 'b')}), '')"
_MARKS = _n("m", rf"(?i)\b(?:{v.MARKETING})\b")
#: Names and their parts; then the classes, the level and the rules of every row.
_TEXT = f"""{d.SQL_ROWS}, t0 AS (SELECT *, trim(coalesce(modelo, '')) AS m, trim(coalesce(cat, '')) AS c FROM rows),
t1 AS (SELECT *, {_CODE} AS code, {_m('m', chr(92) + 'd')} AS digit, {_NOUN} AS noun, {_SWITCH} AS token, {_MARKS} AS marks, lower(c) IN ('switch', 'interruptor') AS is_switch FROM t0),
t2 AS (SELECT *, CASE WHEN m = '' THEN 'plain' WHEN token IS NOT NULL AND NOT is_switch AND noun IS NULL THEN 'switch-axis' WHEN code THEN 'code' WHEN noun IS NOT NULL AND marks <= 1 AND lower(noun) <> lower(c) THEN 'noun-phrase' WHEN marks >= 2 AND noun IS NULL THEN 'puffery' WHEN marks >= 1 THEN 'marketing-only' ELSE 'plain' END AS kind FROM t1),
t3 AS (SELECT *, {_some(
    f"CASE WHEN NOT is_switch AND ({_m('m', r'(?i)\baxis\b|\bswitch\b')} OR ({_m('m', r'(?i)\bhall\s*effect\b')} AND NOT {_m('m', r'(?i)^hall\s*effect$')})) THEN {_q(v.REASONS['switch'])} END",
    f"CASE WHEN {_m('m', r'[({\[]')} AND NOT {_m('m', r'[)}\]]')} THEN {_q(v.REASONS['truncated'])} END",
    f"CASE WHEN NOT digit AND ({_m('raw', r'\b\d{12,}\b')} OR {_m('raw', r'\b[A-Z]{1,4}\d{2,}')}) THEN {_q(v.REASONS['lost_code'])} END",
    f"CASE WHEN NOT code AND {_m('m', '(?i)' + v.GENERIC)} THEN {_q(v.REASONS['generic'])} END",
    f"CASE WHEN kind NOT IN ('noun-phrase', 'switch-axis') AND (marks >= 2 OR (NOT code AND NOT digit AND marks >= 1)) THEN {_q(v.REASONS['marketing'])} END",
    f"CASE WHEN code AND {_m('m', '(?i)' + v.CONNECTIONS)} AND {_m('m', r'(?i)\bmouse\b')} THEN {_q(v.REASONS['connection'])} END",
    f"CASE WHEN NOT code AND {_m('m', r'(?i)\b(keycaps|backpack)\b|\d+(\.\d+)?\s*(\"|inch|pulg)|\bpowder\b|^\d+\s*Keys\b')} THEN {_q(v.REASONS['fragment'])} END")} AS yellow,
  CASE WHEN m = '' THEN [{_q(v.REASONS['empty'])}] WHEN {_m('m', r'(?i)^total\b')} OR {_m('m', '(?i)' + v.SPECS)} THEN [{_q(v.REASONS['specs'])}] END AS red FROM t2),
quality AS (SELECT *, CASE WHEN red IS NOT NULL THEN 'RED' WHEN len(yellow) > 0 THEN 'YELLOW' ELSE 'GREEN' END AS level, coalesce(red, yellow) AS mq FROM t3)"""
_LOCKS = " OR ".join(f"(trim(coalesce(marca, '')) = '{b}' AND uc NOT IN ('OTRO', {', '.join(_q(x) for x in cats)}))" for b, cats in rules.BRAND_LOCK.items())
_STRICT = r"(?i)^data:image/(?:png|jpe?g|webp|gif);(?:base64,[a-z0-9+/=\s]+|[^\s]+)$"
_SEVERE = f"""{_TEXT}, rg AS {_RANGES}, s0 AS (SELECT q.*, upper(c) AS uc, rg.least, rg.most, rg.warn FROM quality q LEFT JOIN rg ON rg.cat = upper(q.c)),
sev AS (SELECT *, CASE WHEN coalesce(fob > 0, false) THEN 'PASS' ELSE 'CRITICAL' END AS R1, CASE WHEN length(m) < 2 OR {_m('m', checks._NOISE)} OR {_m('m', checks._PRICE)} THEN 'CRITICAL' ELSE 'PASS' END AS R2,
  CASE WHEN fob > 0 AND (fob < least OR fob > most) THEN 'CRITICAL' WHEN fob > warn THEN 'WARNING' ELSE 'PASS' END AS R3, CASE WHEN {_LOCKS} THEN 'CRITICAL' ELSE 'PASS' END AS R4, CASE WHEN uc IN ('', 'OTRO') THEN 'CRITICAL' ELSE 'PASS' END AS R5,
  CASE WHEN trim(coalesce(marca, '')) IN ('', 'OTRO') THEN 'CRITICAL' ELSE 'PASS' END AS R6, CASE WHEN {_m('trim(variante)', checks._PRICE)} THEN 'WARNING' ELSE 'PASS' END AS R7, CASE WHEN m <> '' AND lower(m) = lower(trim(variante)) THEN 'WARNING' ELSE 'PASS' END AS R8,
  CASE WHEN coalesce({_m('trim(img)', _STRICT)}, false) THEN 'PASS' ELSE 'WARNING' END AS R9, CASE WHEN grounded IS NULL THEN 'CRITICAL' WHEN NOT grounded THEN 'WARNING' ELSE 'PASS' END AS R10 FROM s0),
items AS (SELECT *, list_concat({_some(f"CASE WHEN NOT {_m('trim(sku)', checks._SKU)} THEN 'SKU' END", *(f"CASE WHEN {k} = 'CRITICAL' THEN '{k}' END" for k in checks.CODES))}, CASE WHEN level = 'RED' THEN mq ELSE [] END) AS critical,
  list_concat({_some(*(f"CASE WHEN {k} = 'WARNING' THEN '{k}' END" for k in checks.CODES if k != 'R3'))}, CASE WHEN level = 'YELLOW' THEN mq ELSE [] END) AS violations FROM sev),
v1 AS (SELECT *, CASE WHEN len(critical) > 0 THEN 'RED' WHEN len(violations) > 0 THEN 'YELLOW' ELSE 'GREEN' END AS status0, greatest(0, {_r0('(11 - len(critical) - len(violations))::DOUBLE / 11 * 100')}) AS score FROM items)"""
_CONTRACT = f"""{_SEVERE}, long AS (SELECT row_seq, sku, upper(trim(source_status)) AS src, unnest({checks.CODES}) AS code, unnest([{', '.join(checks.CODES)}]) AS sev FROM sev),
l2 AS (SELECT *, sev = 'PASS' AND src IN ('RED', 'YELLOW') AND code <> 'R9' AS taken FROM long),
contract AS (SELECT row_seq, sku, code, CASE WHEN taken AND src = 'RED' THEN 'WARNING' ELSE sev END AS severity, CASE WHEN taken THEN src WHEN sev = 'CRITICAL' THEN 'RED' WHEN sev = 'WARNING' THEN 'YELLOW' ELSE 'GREEN' END AS status, CASE WHEN (taken AND src = 'RED') OR sev = 'CRITICAL' THEN 'REJECTED' ELSE 'IMPORTABLE' END AS importability FROM l2)"""
_RANK = "CASE {} WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'GREEN' THEN 1 ELSE 1 END"
_FULL = f"""{_SEVERE}, ff AS (SELECT cat, count(*) AS total, list_sort(list(fob)) AS w FROM v1 WHERE fob > 0 GROUP BY cat HAVING count(*) >= 4),
fq AS (SELECT cat, w[floor(total * 0.25::DOUBLE)::INT + 1] AS q1, w[floor(total * 0.75::DOUBLE)::INT + 1] AS q3 FROM ff),
few AS (SELECT cat FROM v1 GROUP BY cat HAVING count(*) <= 3 AND count(*) < (SELECT count(*) FROM v1) * 0.02::DOUBLE AND cat <> 'OTRO'),
o1 AS (SELECT v1.*, greatest(fob - q3, q1 - fob) AS over, q3 - q1 AS iqr, few.cat IS NOT NULL AS is_few FROM v1 LEFT JOIN fq ON fq.cat = v1.cat AND fob > 0 LEFT JOIN few ON few.cat = v1.cat),
valid AS (SELECT *, CASE greatest({_RANK.format('status0')}, {_RANK.format('upper(trim(source_status))')}, CASE WHEN over > iqr * 3 THEN 3 WHEN over > iqr * 1.5::DOUBLE THEN 2 ELSE 1 END, CASE WHEN is_few THEN 2 ELSE 1 END) WHEN 3 THEN 'RED' WHEN 2 THEN 'YELLOW' ELSE 'GREEN' END AS status, list_concat(critical, violations) AS warnings FROM o1)"""
_SPLIT = f"count(*) AS total, {{}}"
_COUNTS = "count(*) FILTER (status = 'GREEN') AS {}, count(*) FILTER (status = 'YELLOW') AS {}, count(*) FILTER (status = 'RED') AS {}"
_REASONS = f"{_FULL}, why AS (SELECT status, unnest(warnings) AS reason FROM valid)"
_PHOTO = f"status = 'YELLOW' AND R9 <> 'PASS' AND len(list_filter(warnings, lambda x: x <> 'R9')) = 0"


def _field(f: str, x: str) -> str:
    required, longest, pattern, least, most, _ = v.FIELD_RULES[f]
    n = f"try_cast(replace(trim({x}::VARCHAR), ',', '.') AS DOUBLE)"
    tests = ([f"WHEN length(trim({x}::VARCHAR)) > {longest} THEN 'too_long'"] if longest else []) + ([f"WHEN length(trim({x}::VARCHAR)) < 1 THEN 'too_short'"] if f in ("marca", "modelo") else []) + ([f"WHEN NOT {_m(f'trim({x}::VARCHAR)', pattern)} THEN 'pattern'"] if pattern else [])
    tests += [f"WHEN {n} IS NULL THEN 'no_number' WHEN {n} < {least} THEN 'least' WHEN {n} > {most} THEN 'most'"] if least is not None else []
    tests += [f"WHEN {n} <> floor({n}) THEN 'whole'"] if f == "qty" else []
    return f"CASE WHEN {x} IS NULL OR {x}::VARCHAR = '' THEN 'required' {' '.join(tests)} END"


_ERRORS = _some(*(f"'{f}:' || {_field(f, f)}" for f in ("sku", "marca", "modelo", "cat", "fob")))
_WARNS = _some(f"CASE WHEN {_field('fob', 'fob')} IS NULL AND fob < 1 THEN 'fob_low' END", f"CASE WHEN {_field('fob', 'fob')} IS NULL AND fob > 500 THEN 'fob_high' END")
_ORDERS = "orders2 AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity + CASE WHEN l_linenumber = 5 THEN 0.5::DOUBLE ELSE 0 END AS qty, l_partkey AS row_seq FROM lineitem)"
_MAP = "map_extract(MAP {{{}}}, {})[1]"


def _map(table: dict, x: str) -> str:
    return f"CASE {x} {' '.join(f'WHEN {_q(k)} THEN {_q(w)}' for k, w in table.items())} END"


_LOW = "lower(coalesce(raw, ''))"
_BOTH = "lower(modelo || ' ' || raw)"
_TIERS = " ".join(f"WHEN {_m('t', rf'\b({w})\b')} THEN {{'category': '{c}', 'confidence': CASE WHEN trim(regexp_extract(t, {_q(rf'\b({w})\b')})) IN ({', '.join(map(_q, v.AMBIGUOUS_TOKENS))}) THEN {min(n, 40)} ELSE {n} END, 'source': CASE WHEN trim(regexp_extract(t, {_q(rf'\b({w})\b')})) IN ({', '.join(map(_q, v.AMBIGUOUS_TOKENS))}) THEN 'text-keyword-ambiguous' ELSE 'text-keyword' END, 'matched': regexp_extract(t, {_q(rf'\b({w})\b')})}}" for c, w, n in v.CATEGORY_PATTERNS)
_BRAND = "CASE " + " ".join(f"WHEN {_m('{x}', p)} THEN {_q(b)}".replace("{x}", "@") for b, p in v.BRAND_PATTERNS) + " END"
_EXPANDED = "' ' || lower(modelo || ' ' || raw) || ' '"
for _w, _s in v.SYNONYMS.items():
    _EXPANDED = f"regexp_replace({_EXPANDED}, {_q(rf'\b{_w}\b')}, {_q(f' {_s} ')}, 'g')"
_ONE = "trim(regexp_replace(regexp_replace(lower(m), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_P1 = "CASE WHEN cat = 'SWITCH' AND fob / 10 > 12 THEN 'TECLADO' ELSE cat END"
_PRICE_AT = r"(?:^|[^¥￥0-9])\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)"

ORACLE_SQL = {
    "v1_item_validation": f"WITH {_SEVERE} SELECT row_seq, status0 AS status, score, array_to_string(critical, ',') AS critical, array_to_string(violations, ',') AS violations FROM v1",
    "v2_contract": f"WITH {_CONTRACT} SELECT * FROM contract",
    "v3_null_item": f"SELECT unnest({checks.CODES}) AS code, (SELECT count(*) FROM part) AS critical, (SELECT count(*) FROM part) AS n",
    "v4_full_validation": f"WITH {_FULL} SELECT row_seq, status, len(warnings)::INT AS n_warnings FROM valid",
    "v17_pass_criteria": f"WITH {_FULL} SELECT count(*) FILTER (status = 'RED') = 0 AS no_red, count(*) FILTER (status = 'GREEN' AND R9 <> 'PASS') = 0 AS no_green_without_image, count(DISTINCT sku) = count(*) AS no_duplicates, count(*) FILTER (status = 'GREEN') * 100 >= count(*) * 90 AS mostly_green FROM valid",
    "f3_importable": f"WITH {_CONTRACT} SELECT row_seq, NOT bool_or(importability = 'REJECTED') AS importable FROM contract GROUP BY row_seq",
    "f4_split": f"WITH {_FULL} SELECT count(*) AS total, {_COUNTS.format('accepted', 'review', 'rejected')}, {_r2('''count(*) FILTER (status = 'GREEN') * 100::DOUBLE / count(*)''')} AS accepted_pct FROM valid",
    "f5_preview_filter": f"WITH {_FULL} SELECT row_seq FROM valid WHERE status = 'YELLOW' AND contains(lower(sku), '1')",
    "f7_selection": f"WITH {_FULL} SELECT row_seq, status, {_PHOTO} AS photo_only, status = 'GREEN' OR ({_PHOTO}) AS selected FROM valid",
    "f9_product_errors": f"WITH {d.SQL_ROWS} SELECT row_seq, array_to_string({_ERRORS}, ',') AS errors, array_to_string({_WARNS}, ',') AS warnings FROM rows",
    "f9_categories": f"WITH {d.SQL_CATALOG} SELECT DISTINCT cat FROM (SELECT unnest({v.CATEGORIES}) AS cat UNION ALL SELECT upper(CASE WHEN row_seq % 7 = 0 THEN cat || ' x' ELSE cat END) FROM catalog)",
    "f10_order_errors": f"WITH {d.SQL_ROWS}, {_ORDERS}, o AS (SELECT l.order_id, l.qty, rows.*, row_number() OVER (PARTITION BY l.order_id, sku ORDER BY l.line, l.qty) > 1 AS again FROM orders2 l JOIN rows USING (row_seq)), t AS (SELECT order_id, sum(len({_ERRORS})) AS n, count(*) FILTER (again) AS repeats, count(*) FILTER (({_field('qty', 'qty')}) IS NOT NULL) AS bad_qty, sum(len({_WARNS})) AS w, {_r2('sum(coalesce(fob * qty, 0))')} AS total FROM o GROUP BY order_id) SELECT order_id, (n + repeats + bad_qty + CASE WHEN total <= 0 THEN 1 ELSE 0 END)::BIGINT AS errors, repeats, bad_qty, (w + CASE WHEN total > 100000 THEN 1 ELSE 0 END)::BIGINT AS warnings, n + repeats + bad_qty + CASE WHEN total <= 0 THEN 1 ELSE 0 END = 0 AS valid FROM t",
    "f13_image_states": f"WITH {d.SQL_ROWS} SELECT row_seq, CASE WHEN {_m('trim(img)', _STRICT)} THEN 'valid' WHEN starts_with(lower(trim(img)), 'data:image/') THEN 'loose' ELSE 'none' END AS value FROM rows",
    "f14_eligible": f"WITH {_FULL} SELECT row_seq FROM valid WHERE status <> 'RED'",
    "f15_refused_orders": f"WITH {_FULL}, {_ORDERS} SELECT order_id, bool_or(status = 'RED') AS refused FROM orders2 JOIN valid USING (row_seq) GROUP BY order_id",
    "a10_ten_codes": f"WITH {_CONTRACT} SELECT code, count(*) FILTER (status <> 'GREEN') AS n FROM contract GROUP BY code",
    "a11_top_issues": f"WITH {_REASONS} SELECT reason, count(*) AS n FROM why GROUP BY reason ORDER BY n DESC, reason LIMIT 5",
    "a15_import_summary": f"WITH {_FULL}, t AS (SELECT file, count(*) AS total, {_COUNTS.format('imported', 'skipped', 'failed')} FROM valid GROUP BY file) SELECT *, CASE WHEN failed > 0 AND imported = 0 THEN 'ALL_FAILED' WHEN imported > 0 THEN 'OK' ELSE 'EMPTY' END AS status FROM t",
    "a16_pass_stats": f"WITH {_REASONS} SELECT status, reason, count(*) AS n FROM why GROUP BY ALL",
    "a17_deltas": f"WITH {_FULL}, a AS (SELECT file, status, count(*) AS now FROM valid GROUP BY ALL), b AS (SELECT file, CASE WHEN row_seq % 9 = 0 THEN 'GREEN' ELSE status END AS status, count(*) AS before FROM valid WHERE row_seq % 10 <> 0 GROUP BY ALL) SELECT coalesce(a.file, b.file) AS file, coalesce(a.status, b.status) AS status, coalesce(now, 0) AS now, coalesce(before, 0) AS before, coalesce(now, 0) - coalesce(before, 0) AS delta FROM a FULL JOIN b ON a.file = b.file AND a.status = b.status",
    "a18_page_stats": f"WITH {_FULL} SELECT file, page, count(*) AS n, {_r2('avg(fob)')} AS mean_fob, {_COUNTS.format('green', 'yellow', 'red')} FROM valid GROUP BY file, page",
    "a26_extraction_counts": f"WITH {_TEXT} SELECT file, count(*) AS total, count(*) FILTER (m = '') AS no_model, count(*) FILTER (coalesce(fob <= 0, true)) AS no_price, count(*) FILTER (coalesce(marca, '') IN ('', 'OTRO')) AS no_brand, count(*) FILTER (cat IN ('', 'OTRO')) AS no_category, count(*) FILTER ({_m('m', checks._PRICE)}) AS price_as_model, count(*) FILTER (length(m) < 3) AS short_model FROM t0 GROUP BY file",
    "k15_audit_csv": f"""WITH {_REASONS}, e AS (SELECT row_seq, sku, marca, modelo, variante, cat, fob, status, unnest(warnings) AS issue FROM valid) SELECT row_seq, issue, row_seq || ',"' || replace(sku, '"', '""') || '","' || replace(marca, '"', '""') || '","' || replace(modelo, '"', '""') || '","' || replace(variante, '"', '""') || '",' || cat || ',' || CASE WHEN fob = floor(fob) THEN fob::BIGINT::VARCHAR ELSE fob::VARCHAR END || ',' || status || ',' || issue || ',row,"' || replace('"' || issue || '"', '"', '""') || '"' AS text FROM e""",
    "t2_usd_price": f"WITH {d.SQL_ROWS}, p AS (SELECT row_seq, try_cast(replace(regexp_extract(raw, {_q(_PRICE_AT)}, 1), ',', '') AS DOUBLE) AS x FROM rows) SELECT row_seq, CASE WHEN x BETWEEN 0.10 AND 500 THEN x END AS value FROM p",
    "t3_price_token": f"WITH {d.SQL_ROWS}, p AS (SELECT row_seq, trim(raw) AS t, regexp_replace(trim(raw), '[$€£¥\\s]', '', 'g') AS c FROM rows) SELECT row_seq, CASE WHEN {_m('t', r'^[$€£¥]?\s?[\d.,]+$')} AND {_m('c', r'^\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?$')} THEN try_cast(regexp_replace(regexp_replace(c, '(\\d)[.,](\\d{{3}})(\\D|$)', '\\1\\2\\3'), '^([^,]*),', '\\1.') AS DOUBLE) END AS value FROM p",
    "t5_price_category": f"WITH {d.SQL_ROWS}, a AS (SELECT row_seq, fob, {_P1} AS c1 FROM rows) SELECT row_seq, CASE WHEN c1 = 'TECLADO' AND fob / 10 > 0 AND fob / 10 < 1 THEN 'SWITCH' WHEN c1 = 'AURICULAR' AND fob / 10 > 0 AND fob / 10 < 1 THEN 'ACCESORIO' ELSE c1 END AS value FROM a",
    "t8_model_variant": f"WITH {_TEXT} SELECT row_seq, CASE WHEN {_m('m', r'\([^)]+\)')} THEN trim(regexp_replace(m, '\\([^)]+\\)', '')) ELSE m END AS modelo, trim(regexp_extract(m, '\\(([^)]+)\\)', 1)) AS variante FROM t0",
    "t10_model_quality": f"WITH {_TEXT} SELECT row_seq, level, array_to_string(mq, '; ') AS reasons FROM quality",
    "t11_marketing_class": f"WITH {_TEXT} SELECT row_seq, kind AS value FROM t2",
    "t12_switch_token": f"WITH {_TEXT} SELECT row_seq, token AS value FROM t1",
    "t13_product_noun": f"WITH {_TEXT} SELECT row_seq, noun AS value FROM t1",
    "t21_expanded": f"WITH {d.SQL_ROWS} SELECT row_seq, {_EXPANDED} AS value FROM rows",
    "t28_model_classes": f"WITH {_TEXT}, o AS (SELECT *, {_ONE} AS one FROM t0), p AS (SELECT *, one <> '' AND NOT contains(one, ' ') AS single FROM o) SELECT row_seq, {_m('m', '(?i)' + v.TEMPLATES)} AS template, single AND one IN ({', '.join(map(_q, v.BARE_WORDS))}) AS bare, single AND one IN ({', '.join(map(_q, v.AMBIGUOUS_WORDS))}) AS ambiguous, single AND one IN ({', '.join(map(_q, v.WATCH_WORDS))}) AS watch, length(replace(m, '(', '')) < length(replace(m, ')', '')) AS truncated, single AND {_m('one', v.TYPE_WORDS)} AS bare_type, {_m('''array_to_string(list_reverse(list_reverse(regexp_split_to_array(m, chr(92) || 's+'))[2:]), ' ')'''.replace('chr(92) || ', ''), '(?i)' + v.TYPE_WORDS).replace("'s+'", "'" + chr(92) + "s+'")} AS type_inside FROM p",
    "x1_brand_of_line": f"WITH {d.SQL_ROWS} SELECT row_seq, coalesce(CASE WHEN {_m(_LOW, '(?i)no' + chr(92) + 's+brand')} THEN 'House' WHEN {_m(_LOW, '(?i)generic$')} THEN 'Any' END, {_BRAND.replace('@', _LOW)}, '-') AS value FROM rows",
    "x2_brand_of_content": f"WITH {d.SQL_ROWS}, t AS (SELECT row_seq, lower(substr(repeat('.', (row_seq % 2 * 2990)::INT) || raw, 1, 3000)) AS t FROM rows) SELECT row_seq, coalesce({_BRAND.replace('@', 't')}, '-') AS value FROM t",
    "x3_brand_of_file": f"WITH {d.SQL_ROWS} SELECT row_seq, CASE {' '.join('WHEN ' + ' AND '.join(f'contains(lower(file), {_q(w)})' for w in words) + f' THEN {_q(b)}' for b, words in v.BRAND_FILES)} ELSE 'OTRO' END AS value FROM rows",
    "x4_category": f"WITH {d.SQL_ROWS}, t AS (SELECT row_seq, marca, {_BOTH} AS t FROM rows), x AS (SELECT row_seq, CASE WHEN {_map(v.SINGLE_BRAND, 'marca')} IS NOT NULL THEN {{'category': {_map(v.SINGLE_BRAND, 'marca')}, 'confidence': 95, 'source': 'brand-exclusive', 'matched': marca}} {_TIERS} WHEN {_map(v.BRAND_FALLBACK, 'marca')} IS NOT NULL THEN {{'category': {_map(v.BRAND_FALLBACK, 'marca')}, 'confidence': 50, 'source': 'brand-fallback', 'matched': marca}} ELSE {{'category': 'OTRO', 'confidence': 0, 'source': 'no-match', 'matched': ''}} END AS x FROM t) SELECT row_seq, x.category AS category, x.confidence AS confidence, x.source AS source, x.matched AS matched FROM x",
    "x9_colour": """WITH p AS (SELECT p_partkey AS row_seq, (p_partkey * 37 % 256)::DOUBLE AS r, (p_partkey * 91 % 256)::DOUBLE AS g, (p_partkey * 53 % 256)::DOUBLE AS b FROM part), q AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM p), s AS (SELECT *, CASE WHEN hi > 0 THEN (hi - lo) / hi ELSE 0 END AS sat, hi / 255 AS light FROM q)
SELECT row_seq, CASE WHEN light < 0.22::DOUBLE THEN 'BLACK' WHEN sat < 0.12::DOUBLE AND light > 0.85::DOUBLE THEN 'WHITE' WHEN sat < 0.12::DOUBLE AND light > 0.55::DOUBLE THEN 'SILVER' WHEN sat < 0.12::DOUBLE THEN 'GRAY' WHEN r > g + 40 AND r > b + 40 THEN CASE WHEN g > 100 AND b < 80 THEN 'GOLD' WHEN g < 80 THEN 'RED' ELSE 'ORANGE' END
WHEN g > r + 25 AND g > b + 25 THEN 'GREEN' WHEN b > r + 30 AND b > g + 15 THEN CASE WHEN r > 80 AND g < 100 THEN 'PURPLE' WHEN g > 150 THEN 'CYAN' ELSE 'BLUE' END WHEN r > 140 AND g < 130 AND b > 120 THEN 'PINK' WHEN r > 120 AND g > 100 AND b < 80 THEN 'GOLD' ELSE 'MULTICOLOR' END AS value FROM s""",
}
