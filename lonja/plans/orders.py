"""Queries of orders: costing variants, scenarios, exports and records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions import exprs, rules
from lonja.operators import costing, tracker
from lonja.plans import domain as d
from lonja.plans.registry import _COSTED, _KEY, _TARIFFS, _door, _over, _r0, _r2
from lonja.sources import sinks

#: A configuration as a caller gives it: by weight, importer, own markups; numbers as text too.
_CONFIG = {"mode": "importer", "freight_mode": "weight", "kg": "120,5", "kg_usd": "1.012,00", "overrides": {"MOUSE": 3.1}, "duty_pct": "12"}
_OVERRIDES = {"MOUSE_CABLE": {"ncm": "3926.90.90"}, "MONITOR": {"ncm": "9999.99.99", "duty": 0.1}}


def _priced(s, sf):
    return costing.priced_lines(d.lines(s, sf))


def _errors(s, sf):
    return s.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type")


QUERIES = {
    "d1_weight_mode": lambda s, sf: costing.order_costing(d.lines(s, sf), _CONFIG),
    "d6_overrides": lambda s, sf: costing.door_to_door(d.lines(s, sf), bp_pct=0.01, overrides=_OVERRIDES),
    "d8_regime": lambda s, sf: d.records(s, sf).select("record", costing.regime(F.when(F.col("record") % 3 == 0, F.lit("courier")).when(F.col("record") % 3 == 1, ""), F.when(F.col("status") == "delivered", "courier")).alias("regime")),
    "d9_estimate": lambda s, sf: d.catalog(s, sf).select("sku", costing.estimate(F.col("fob")).alias("e")).select("sku", "e.*"),
    "d10_compare_local": lambda s, sf: d.records(s, sf).select("record", costing.compare_local(F.col("landed"), F.col("local_price"), 1400.0).alias("c")).select("record", "c.*"),
    "d12_insurance": lambda s, sf: costing.order_sums(d.lines(s, sf)).select("order_id", exprs.round2(costing.suggested_insurance(F.col("order_fob"), F.col("order_fob") * 0.15)).alias("insurance_usd")),
    "d13_gross_income": lambda s, sf: d.records(s, sf).select("record", costing.gross_income_pct(F.element_at(F.array(*map(F.lit, ("cab", "pba", "santa_fe", "otra"))), (F.col("record") % 4 + 1).cast("int")), F.when(F.col("record") % 8 == 3, 0.05)).alias("pct"), costing.eliminated_tax_line()["amount_usd"].alias("eliminated_usd")),
    "d15_prices": lambda s, sf: costing.scenario_prices(d.lines(s, sf), 1500.0, 10.0),
    "k1_order_csv": lambda s, sf: sinks.order_csv(_priced(s, sf)),
    "k3_packing_list": lambda s, sf: sinks.packing_list(_priced(s, sf)),
    "k4_executive_kpis": lambda s, sf: sinks.executive_kpis(_priced(s, sf)),
    "k4_executive_detail": lambda s, sf: sinks.executive_detail(_priced(s, sf)),
    "k5_quote_rows": lambda s, sf: sinks.quote_rows(_priced(s, sf)),
    "k6_quote_csv": lambda s, sf: sinks.quote_csv(_priced(s, sf)),
    "k7_quote_numbers": lambda s, sf: tracker.numbered(d.records(s, sf).select("record"), "record", 41, "NQ-"),
    "k8_quote_history": lambda s, sf: sinks.newest(d.records(s, sf).select("record", "landed"), ["landed", "record"]),
    "k9_currency": lambda s, sf: d.records(s, sf).select("record", exprs.currency_text(F.col("local_price") - F.col("landed")).alias("text")),
    "k10_wizard_summary": lambda s, sf: sinks.wizard_summary(d.lines(s, sf)),
    "k16_catalog_json": lambda s, sf: sinks.catalog_json(d.catalog(s, sf).select("row_seq", "sku", "marca", "modelo", "cat")),
    "k19_error_log": lambda s, sf: sinks.newest(_errors(s, sf), ["ts", "event_id"]).select("event_id", "event_type"),
    "k20_order_summary": lambda s, sf: sinks.order_summary(_priced(s, sf)),
    "w13_import_numbers": lambda s, sf: tracker.numbered(d.records(s, sf).select("record"), "record"),
    "st2_board": lambda s, sf: tracker.board(d.records(s, sf)),
    "m4_relevant_date": lambda s, sf: d.records(s, sf).select("record", tracker.relevant_date(F.col("status"), {"ordered": F.col("record"), "in_transit": F.when(F.col("record") % 2 == 0, F.col("record") + 1), "delivered": F.when(F.col("record") % 3 == 0, F.col("record") + 2)}).alias("at")),
    "m5_fresh": lambda s, sf: _errors(s, sf).select("event_id", tracker.fresh(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp"), 86_400 * 5).alias("fresh")),
}


def _num(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE ({x})::VARCHAR END)"


def _fix(x: str, digits: int = 2) -> str:
    return f"printf('%.{digits}f', coalesce({x}, 0)::DOUBLE)"


def _cell(x: str) -> str:
    return f"'\"' || replace(coalesce(({x})::VARCHAR, ''), '\"', '\"\"') || '\"'"


def _line(*cells: str) -> str:
    return " || ',' || ".join(map(_cell, cells))


def _head(names: list[str]) -> str:
    return "chr(65279) || '" + ",".join(f'"{n}"' for n in names) + "'"


def _money(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || 'US$' || chr(160) || translate(format('{{:,.2f}}', abs(coalesce({x}, 0))::DOUBLE), ',.', '.,')"


_PRICED = f"""{_COSTED}, priced AS (SELECT order_id, line, sku, cat, marca, modelo, variante, fob, qty, order_fob, {_r2('net')} AS order_net, unit_cost, price, vat_total, {_r2('vat_total * (CASE WHEN order_fob > 0 THEN fob * qty / order_fob ELSE 0 END)')} AS line_vat, row_number() OVER (PARTITION BY order_id ORDER BY line, sku, qty) AS number FROM v),
sums AS (SELECT order_id, count(*) AS n, sum(qty) AS q, any_value(order_fob) AS fob, any_value(order_net) AS net, any_value(vat_total) AS vat, {_r2('sum(price * qty)')} AS revenue FROM priced GROUP BY order_id)"""
_UNIT = "(CASE WHEN price <> 0 THEN price ELSE fob END)"
_QTY = "(CASE WHEN qty <> 0 THEN qty ELSE 1 END)"
_KPIS = ["fob", "net", _r2("vat"), f"net + {_r2('vat')}", "revenue", "revenue - net"]
_KPI_LABELS = ["Inversión Total FOB (China/Origen)", "Costo Neto Puesto (sin IVA)", "IVA separado / repercutible", "Total Bruto con IVA", "Facturación Total Proyectada (PVP)", "Ganancia Neta Limpia"]
_WEIGHT = f"""{d.SQL_LINES}, m AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in rules.MARKUPS)}) t(cat, cat_markup)),
o AS (SELECT order_id, {_r2('sum(fob * qty)')} AS order_fob, sum(qty) AS order_qty FROM lines GROUP BY order_id),
n AS (SELECT *, order_fob + 120.5::DOUBLE * 1012 + order_fob * (2::DOUBLE / 100) AS cif FROM o), n2 AS (SELECT *, cif + cif * (12::DOUBLE / 100) + cif * (3::DOUBLE / 100) + cif * (6::DOUBLE / 100) + 500 AS net, cif * (21::DOUBLE / 100) AS vat_total FROM n),
u AS (SELECT l.order_id, line, sku, l.cat, fob, qty, order_fob, net, vat_total, cat_markup, CASE WHEN order_fob > 0 THEN {_r2('fob * net / order_fob')} WHEN order_qty > 0 THEN {_r2('net / order_qty')} ELSE 0 END AS unit_cost FROM lines l JOIN n2 USING (order_id) LEFT JOIN m ON m.cat = upper(l.cat)),
v AS (SELECT *, {_r2("unit_cost * CASE WHEN cat = 'MOUSE' THEN 3.1::DOUBLE ELSE coalesce(cat_markup, 2.5::DOUBLE) END")} AS price FROM u)
SELECT order_id, line, sku, fob, qty, order_fob, {_r2('net')} AS order_net, unit_cost, price, {_r2('vat_total * (CASE WHEN order_fob > 0 THEN fob * qty / order_fob ELSE 0 END)')} AS line_vat, {_r0(_over('(price - unit_cost) * 100', 'price'))} AS margin_pct, {_r0(_over('(price - unit_cost) * 100', 'unit_cost'))} AS roi_pct FROM v"""
_OVER = f"""(SELECT a.tariff_key, coalesce(o.ncm, a.ncm) AS ncm, coalesce(o.duty, b.duty, a.duty) AS duty, coalesce(b.fee, a.fee) AS fee, coalesce(b.vat, a.vat) AS vat, coalesce(b.vat_add, a.vat_add) AS vat_add, coalesce(b.income, a.income) AS income, coalesce(b.gross, a.gross) AS gross, coalesce(b.certs, a.certs) AS certs
FROM {_TARIFFS} a LEFT JOIN (VALUES ('MOUSE_CABLE', '3926.90.90', NULL::DOUBLE), ('MONITOR', '9999.99.99', 0.1::DOUBLE)) o(tariff_key, ncm, duty) ON o.tariff_key = a.tariff_key LEFT JOIN (SELECT DISTINCT ON (ncm) * FROM {_TARIFFS}) b ON b.ncm = o.ncm)"""
_NUMBERED = "SELECT o_orderkey AS record, '{}' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS number FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + {} AS n FROM orders)"
_WIZARD = _door(_TARIFFS, "0").replace("\nSELECT order_id, line", ", dd AS (SELECT order_id, line", 1) + ")"
_WIZARD += f""", w AS (SELECT order_id, any_value(cert_usd) AS cert, {', '.join(f"sum({c}::DECIMAL(20,2))::DOUBLE AS {n}" for c, n in (('duty_usd', 'duty'), ('fee_usd', 'fee'), ('vat_usd', 'vat'), ('recoverable_usd', 'back')))} FROM dd GROUP BY order_id),
x AS (SELECT w.*, f.fob, f.fob * (1 + 0.15::DOUBLE + 0.015::DOUBLE) AS cif, duty + fee + back - vat AS taxes, 720 + cert AS fixed FROM w JOIN (SELECT order_id, {_r2('sum(fob * qty)')} AS fob FROM lines GROUP BY order_id) f USING (order_id))
SELECT order_id, position, label, {_r2('usd')} AS usd FROM (SELECT order_id, unnest(range(1, 11)) AS position, unnest({sinks.WIZARD_LABELS}) AS label, unnest([fob, fob * 0.15::DOUBLE, fob * 0.015::DOUBLE, cif, taxes, vat, fixed, cif + taxes + fixed + vat, cif + duty + fee + fixed, back]) AS usd FROM x)"""

ORACLE_SQL = {
    "d1_weight_mode": f"WITH {_WEIGHT}",
    "d6_overrides": f"WITH {_door(_OVER, '0.01')}",
    "d8_regime": f"WITH {d.SQL_RECORDS} SELECT record, CASE WHEN record % 3 = 0 OR status = 'delivered' THEN 'courier' ELSE 'importador' END AS regime FROM records",
    "d9_estimate": f"WITH {d.SQL_CATALOG}, e AS (SELECT sku, fob * 0.15::DOUBLE AS f, (fob + fob * 0.15::DOUBLE) * 0.21::DOUBLE AS v FROM catalog) SELECT sku, {_r2('f')} AS freight_usd, {_r0('f * 1400')} AS freight_local, {_r2('v')} AS vat_usd, {_r0('v * 1400')} AS vat_local FROM e",
    "d10_compare_local": f"WITH {d.SQL_RECORDS}, c AS (SELECT *, coalesce(local_price > 0, false) AS available, CASE WHEN local_price > 0 THEN CASE WHEN abs(local_price - landed) < 1e-6 THEN 0 ELSE local_price - landed END END AS diff FROM records) SELECT record, available, CASE WHEN NOT available THEN 'unavailable' WHEN diff = 0 THEN 'break_even' WHEN diff > 0 THEN 'cheaper' ELSE 'more_expensive' END AS verdict, {_r2('diff')} AS diff_usd, {_r2('diff / local_price * 100')} AS diff_pct, {_r2('diff * 1400')} AS diff_local FROM c",
    "d12_insurance": f"WITH {d.SQL_LINES} SELECT order_id, {_r2('(f + f * 0.15::DOUBLE) * 0.011::DOUBLE')} AS insurance_usd FROM (SELECT order_id, {_r2('sum(fob * qty)')} AS f FROM lines GROUP BY order_id)",
    "d13_gross_income": "SELECT o_orderkey AS record, CASE o_orderkey % 4 WHEN 0 THEN 0.025::DOUBLE WHEN 1 THEN 0.035::DOUBLE WHEN 2 THEN 0.03::DOUBLE ELSE CASE WHEN o_orderkey % 8 = 3 THEN 0.05::DOUBLE ELSE 0.025::DOUBLE END END AS pct, 0::DOUBLE AS eliminated_usd FROM orders",
    "d15_prices": f"WITH {_COSTED}, x AS (SELECT order_id, order_fob, order_qty, duty_rate, order_fob + order_fob * (15::DOUBLE * (1 + 10::DOUBLE / 100) / 100) + order_fob * (2::DOUBLE / 100) AS cif2 FROM n2), c AS (SELECT *, {_r2('cif2 + cif2 * duty_rate + cif2 * (3::DOUBLE / 100) + cif2 * (6::DOUBLE / 100) + order_qty * 8::DOUBLE')} AS cost FROM x), p AS (SELECT order_id, line, sku, cost / CASE WHEN c.order_fob <> 0 THEN c.order_fob ELSE 1 END * fob AS unit FROM lines JOIN c USING (order_id)) SELECT order_id, line, sku, {_r2('unit')} AS unit_cost, {_r2('unit / (1 - 35::DOUBLE / 100)')} AS price, {_r0('unit / (1 - 35::DOUBLE / 100) * 1500')} AS price_local FROM p",
    "k1_order_csv": f"WITH {_PRICED} SELECT order_id, number, {_line('sku', 'cat', 'marca', 'modelo', 'variante', _num('fob'), _num('qty'), _num('unit_cost'), _num(_r2(_over('line_vat', 'qty'))), _num('line_vat'))} AS text FROM priced UNION ALL SELECT order_id, 0, {_head(sinks.ORDER_HEADER)} FROM sums",
    "k3_packing_list": f"""WITH {_PRICED}, p AS (SELECT *, {_QTY} AS q, CASE WHEN unit_cost <> 0 THEN unit_cost WHEN order_net <> 0 AND order_fob <> 0 THEN fob * (order_net / order_fob) ELSE fob * 1.2::DOUBLE END AS cost, CASE WHEN sum(qty) OVER (PARTITION BY order_id) > 0 THEN 0::DOUBLE ELSE 0.25::DOUBLE END AS each FROM priced)
SELECT order_id, number, number::VARCHAR AS item, sku, CASE WHEN cat <> '' THEN cat ELSE 'PERIFERICOS_GAMER' END AS cat, marca, modelo, CASE WHEN variante <> '' THEN variante ELSE '-' END AS variante, {_num('q')} AS qty, {_fix('each * q')} AS kg, {_fix('fob')} AS fob, {_fix('fob * q')} AS fob_total, {_fix('cost')} AS cost, {_fix('cost * q')} AS cost_total, {_fix('line_vat')} AS vat FROM p
UNION ALL SELECT order_id, n + 1, '', '', '', '', '', '', '', '', '', '', '', '', '' FROM sums
UNION ALL SELECT order_id, n + 2, 'TOTALES', '', '', '', '', '', {_num('q')}, {_fix('CASE WHEN q > 0 THEN 0 ELSE 0.25 * q END')}, '', {_fix('fob')}, '', {_fix('net')}, {_fix(_r2('vat'))} FROM sums""",
    "k4_executive_kpis": f"WITH {_PRICED}, e AS (SELECT order_id, unnest(range(1, 7)) AS position, unnest({_KPI_LABELS}) AS label, unnest([{', '.join(_KPIS)}]) AS v FROM sums) SELECT order_id, position, label, {_fix('v')} AS usd, {_fix('v * 1400')} AS local FROM e",
    "k4_executive_detail": f"WITH {_PRICED}, p AS (SELECT *, {_QTY} AS q FROM priced) SELECT order_id, number, sku, cat, marca, modelo, variante, {_num('q')} AS qty, {_fix('fob')} AS fob, {_fix('unit_cost')} AS cost, {_fix('price')} AS price, {_r0('price * 1400')} AS price_local, {_fix('price * q')} AS revenue, {_fix('price * q - unit_cost * q')} AS profit, CASE WHEN price * q > 0 THEN {_fix('(price * q - unit_cost * q) / (price * q) * 100', 1)} ELSE '0' END || '%' AS margin FROM p",
    "k5_quote_rows": f"WITH {_PRICED} SELECT order_id, number, '<tr><td>' || number || '</td><td>' || sku || '</td><td>' || marca || '</td><td>' || modelo || '</td><td>' || CASE WHEN variante <> '' THEN variante ELSE '-' END || '</td><td>' || {_num('qty')} || '</td><td>' || {_money(_UNIT)} || '</td><td>' || {_money(f'{_UNIT} * {_QTY}')} || '</td></tr>' AS html FROM priced",
    "k6_quote_csv": f"WITH {_PRICED} SELECT order_id, number, {_line('number', 'sku', 'marca', 'modelo', 'variante', _num('qty'), _fix(_UNIT), _fix(f'{_UNIT} * {_QTY}'))} AS text FROM priced UNION ALL SELECT order_id, 0, {_head(sinks.QUOTE_HEADER)} FROM sums UNION ALL SELECT order_id, n + 1, '' FROM sums UNION ALL SELECT order_id, n + 2, {_line(chr(39) + 'TOTAL' + chr(39), *[chr(39) * 2] * 4, _num('q'), chr(39) * 2, _fix('revenue'))} FROM sums",
    "k7_quote_numbers": _NUMBERED.format("NQ-", 41),
    "k8_quote_history": "SELECT o_orderkey AS record, o_totalprice AS landed FROM orders ORDER BY landed DESC, record DESC LIMIT 50",
    "k9_currency": f"WITH {d.SQL_RECORDS} SELECT record, CASE WHEN local_price IS NULL THEN 'US$' || chr(160) || '0,00' ELSE {_money('(local_price - landed)')} END AS text FROM records",
    "k10_wizard_summary": f"WITH {_WIZARD}",
    "k16_catalog_json": f"WITH {d.SQL_CATALOG} SELECT row_seq, to_json({{'row_seq': row_seq, 'sku': sku, 'marca': marca, 'modelo': modelo, 'cat': cat}})::VARCHAR AS text FROM catalog",
    "k19_error_log": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "k20_order_summary": f"WITH {_PRICED} SELECT order_id, number, '• ' || {_num('qty')} || 'x ' || marca || ' ' || modelo || ' (' || sku || ') - PVP: $' || {_num('price')} AS text FROM priced UNION ALL SELECT order_id, n + 1, 'FOB Total: $' || {_num('fob')} || ' USD' FROM sums UNION ALL SELECT order_id, n + 2, 'Costo Puesto en País: $' || {_num('net')} || ' USD' FROM sums",
    "w13_import_numbers": _NUMBERED.format("IMP-", 0),
    "st2_board": f"WITH {d.SQL_RECORDS}, b AS (SELECT unnest(range(0, 6)) AS position, unnest({rules.STATUSES}) AS status) SELECT position, b.status, count(record) AS n, min(record) AS first_record FROM b LEFT JOIN records r ON r.status = b.status GROUP BY ALL",
    "st1_status_replay": f"""WITH e AS (SELECT user_id AS record, list({{'s': {rules.STATUSES[1:]}[event_id % 5 + 1], 'a': 0}} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
r AS (SELECT record, len(l) AS n, list_reduce(list_prepend({{'s': 'ordered', 'a': 0}}, l), lambda x, y: CASE WHEN x.s NOT IN ('delivered', 'cancelled') AND (y.s = 'cancelled' OR list_position({rules.STATUSES[:-1]}, y.s) = list_position({rules.STATUSES[:-1]}, x.s) + 1) THEN {{'s': y.s, 'a': x.a + 1}} ELSE x END) AS f FROM e)
SELECT record, f.s AS status, f.a::BIGINT AS accepted, (n - f.a)::BIGINT AS rejected FROM r""",
    "m4_relevant_date": f"WITH {d.SQL_RECORDS} SELECT record, CASE status WHEN 'in_transit' THEN CASE WHEN record % 2 = 0 THEN record + 1 ELSE record END WHEN 'delivered' THEN CASE WHEN record % 3 = 0 THEN record + 2 WHEN record % 2 = 0 THEN record + 1 ELSE record END END AS at FROM records",
    "m5_fresh": "SELECT event_id, coalesce(floor(epoch(TIMESTAMP '2024-01-15 00:00:00')) - floor(epoch(ts)) < 432000, false) AS fresh FROM events",
}
