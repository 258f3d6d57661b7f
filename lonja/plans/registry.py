"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions import exprs, rules
from lonja.operators import catalog as cat
from lonja.operators import audit, costing, images, mutations, quality, search, spatial, tracker
from lonja.plans import domain as d
from lonja.sources import files


def _r2(x: str) -> str:
    return f"(floor(({x}) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE)"


def _r0(x: str) -> str:
    return f"floor(({x}) + 0.5::DOUBLE)"


def _over(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0::DOUBLE END)"


def _values(rows, columns: str) -> str:
    def cell(x):
        if isinstance(x, list):
            return "[" + ", ".join(map(cell, x)) + "]::VARCHAR[]"
        return f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns}))"


_TARIFFS = _values(rules.TARIFFS, "tariff_key, ncm, duty, fee, vat, vat_add, income, gross, certs")
_MARKUPS = _values(rules.MARKUPS, "cat, cat_markup")
_RANGES = _values(rules.PRICE_RANGES, "cat, least, most, warn")
_KEY = "CASE WHEN cat = 'TECLADO' THEN 'TECLADO_CABLE' WHEN cat = 'MOUSE' THEN 'MOUSE_CABLE' WHEN cat = 'HEADSET' THEN 'HEADSET_CABLE' WHEN cat IN ('MONITOR', 'SWITCH') THEN cat ELSE 'OTRO' END"
_COSTED = f"""{d.SQL_LINES}, m AS {_MARKUPS}, t AS {_TARIFFS},
o AS (SELECT order_id, {_r2('sum(fob * qty)')} AS order_fob, sum(qty) AS order_qty, avg({_r0('duty * 100')}::INT) / 100::DOUBLE AS duty_rate FROM (SELECT lines.*, t.duty FROM lines JOIN t ON t.tariff_key = {_KEY}) GROUP BY order_id),
n AS (SELECT *, order_fob + order_fob * (15::DOUBLE / 100) + order_fob * (2::DOUBLE / 100) AS cif FROM o),
n2 AS (SELECT *, cif + cif * duty_rate + cif * (3::DOUBLE / 100) + cif * (6::DOUBLE / 100) + order_qty * 8::DOUBLE AS net, cif * (21::DOUBLE / 100) AS vat_total FROM n),
u AS (SELECT l.order_id, line, sku, cat, marca, modelo, variante, fob, qty, order_fob, net, vat_total, cat_markup, CASE WHEN order_fob > 0 THEN {_r2('fob * net / order_fob')} WHEN order_qty > 0 THEN {_r2('net / order_qty')} ELSE 0 END AS unit_cost FROM lines l JOIN n2 USING (order_id) LEFT JOIN m USING (cat)),
v AS (SELECT *, {_r2('unit_cost * coalesce(cat_markup, 2.5::DOUBLE)')} AS price FROM u),
costed AS (SELECT order_id, line, sku, fob, qty, order_fob, {_r2('net')} AS order_net, unit_cost, price, {_r2('vat_total * (CASE WHEN order_fob > 0 THEN fob * qty / order_fob ELSE 0 END)')} AS line_vat,
  {_r0(_over('(price - unit_cost) * 100', 'price'))} AS margin_pct, {_r0(_over('(price - unit_cost) * 100', 'unit_cost'))} AS roi_pct FROM v)"""
_TOTALS = f"""{_COSTED}, s AS (SELECT order_id, any_value(order_fob) AS order_fob, any_value(order_net) AS order_net, {_r2('sum(price * qty)')} AS revenue, count(*) AS n_lines, sum(qty) AS units FROM costed GROUP BY order_id),
s2 AS (SELECT *, {_r2('revenue - order_net')} AS margin FROM s), totals AS (SELECT *, {_r0(_over('margin * 100', 'revenue'))} AS margin_pct FROM s2)"""
_FENCES = """f AS (SELECT cat, count(*) AS total, list_sort(list(fob)) AS v FROM catalog WHERE fob > 0 GROUP BY cat HAVING count(*) >= 4),
q AS (SELECT cat, v[floor(total * 0.25::DOUBLE)::INT + 1] AS q1, v[floor(total * 0.5::DOUBLE)::INT + 1] AS median, v[floor(total * 0.75::DOUBLE)::INT + 1] AS q3 FROM f)"""
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) >= 3)"


def _costed(s, sf):
    return costing.order_costing(d.lines(s, sf))


def _totals(s, sf):
    return costing.order_totals(_costed(s, sf))


QUERIES = {
    "d1_order_costing": _costed,
    "d17_order_totals": _totals,
    "d5_courier_warnings": lambda s, sf: costing.courier_warnings(d.lines(s, sf), unit_kg=0.5),
    "d6_door_to_door": lambda s, sf: costing.door_to_door(d.lines(s, sf)),
    "d7_courier_regime": lambda s, sf: costing.courier_regime(d.lines(s, sf)),
    "d10_landed_verdict": lambda s, sf: d.records(s, sf).select("record", costing.landed_verdict(F.col("landed"), F.col("local_price")).alias("verdict")),
    "d14_profitability": lambda s, sf: tracker.profitability(d.records(s, sf)),
    "d15_scenarios": lambda s, sf: costing.scenarios(d.lines(s, sf), [1260.0, 1400.0, 1540.0], [-20.0, 0.0, 20.0]),
    "d16_break_even": lambda s, sf: _totals(s, sf).select("order_id", costing.break_even_units(F.lit(1000.0), F.col("revenue"), F.col("order_net"), F.col("units")).alias("units")),
    "a2_kpis": lambda s, sf: cat.kpis(d.catalog(s, sf)),
    "a3_facets": lambda s, sf: cat.facets(d.catalog(s, sf)),
    "a4_supplier_comparison": lambda s, sf: cat.supplier_comparison(d.catalog(s, sf)),
    "a5_rollups": lambda s, sf: tracker.rollups(d.records(s, sf)),
    "a7_duplicate_groups": lambda s, sf: cat.duplicate_groups(d.catalog(s, sf).withColumn("fob", F.floor("fob").cast("double"))),
    "a8_outliers": lambda s, sf: quality.outliers(d.catalog(s, sf)),
    "a9_minority_categories": lambda s, sf: quality.minority_categories(d.catalog(s, sf).withColumn("cat", F.concat_ws("-", "cat", F.floor("fob").cast("string")))),
    "a20_vocabulary": lambda s, sf: search.vocabulary(s.read.parquet(f"{sf}/documents.parquet"), "text"),
    "f1_search_filter": lambda s, sf: cat.search_filter(d.catalog(s, sf), text="ring", category="MOUSE", low=20.0, high=400.0),
    "f2_selected_only": lambda s, sf: cat.selected_only(d.catalog(s, sf), d.cart(s, sf)),
    "f12_integrity": lambda s, sf: quality.integrity(d.catalog(s, sf).withColumn("sku", F.substring("sku", 1, 9))),
    "j1_order_lines": lambda s, sf: cat.order_lines(d.cart(s, sf), d.catalog(s, sf)),
    "j2_cart_value": lambda s, sf: cat.cart_value(d.cart(s, sf), d.catalog(s, sf)),
    "j3_upsert": lambda s, sf: cat.upsert(d.catalog(s, sf).where("row_seq % 3 != 0"), d.catalog(s, sf).where("row_seq % 2 = 0").withColumn("fob", exprs.round2(F.col("fob") * (1 + (F.col("row_seq") % 4) / 100)))),
    "j4_orphans": lambda s, sf: cat.orphans(d.cart(s, sf), d.catalog(s, sf)),
    "o1_page": lambda s, sf: cat.page(d.catalog(s, sf), 3),
    "t22_allocated_sku": lambda s, sf: d.catalog(s, sf).select("row_seq", cat.allocated_sku().alias("generated"), exprs.identity_key(*map(F.col, ("marca", "modelo", "variante", "cat"))).alias("identity")),
    "t25_html_escape": lambda s, sf: s.read.parquet(f"{sf}/pages.parquet").select("page_id", exprs.html_escaped(F.col("html")).alias("escaped")),
    "v1_price_checks": lambda s, sf: quality.price_checks(d.catalog(s, sf)),
    "v4_graded": lambda s, sf: quality.graded(d.catalog(s, sf)),
    "f4_status_summary": lambda s, sf: quality.status_summary(quality.graded(d.catalog(s, sf))),
    "w2_first_wins": lambda s, sf: cat.first_wins(d.catalog(s, sf).withColumn("fob", F.floor("fob").cast("double"))).select("sku", "row_seq"),
    "x8_search": lambda s, sf: search.search(s.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query"), "text"), search.inverted_index(s.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")),
    "a6_assignment_metrics": lambda s, sf: images.assignment_metrics(d.imaged(s, sf)),
    "a12_image_audit": lambda s, sf: images.image_audit(d.imaged(s, sf)),
    "v11_integrity_gates": lambda s, sf: images.integrity_gates(d.imaged(s, sf)),
    "w4_row_bounds": lambda s, sf: spatial.row_bounds(d.page_items(s, sf).where("price IS NOT NULL")),
    "w15_row_heights": lambda s, sf: spatial.row_heights(d.page_items(s, sf)),
    "j13_nearest_above": lambda s, sf: spatial.nearest_above(d.page_items(s, sf), d.page_items(s, sf).where("item % 9 = 0")),
    "j14_grounding": lambda s, sf: spatial.grounded(d.page_items(s, sf).where("price IS NULL"), d.page_items(s, sf).where("price IS NOT NULL")),
    "s4_products": lambda s, sf: files.products(d.raw_list(s, sf)),
    "s4_skipped": lambda s, sf: files.skipped(d.raw_list(s, sf)),
    "dm2_set_prices": lambda s, sf: mutations.set_prices(d.catalog(s, sf), d.price_updates(s, sf)),
    "dm3_delete": lambda s, sf: mutations.delete(d.catalog(s, sf), d.cart(s, sf).where("qty = 0")),
    "dm5_merge_cart": lambda s, sf: mutations.merge_cart(d.cart(s, sf), d.cart(s, sf).where("qty > 2").select("sku", (F.lit(3.0) - F.col("qty")).alias("delta"))),
    "a24_discount": lambda s, sf: mutations.discounted(d.lines(s, sf), 0.07),
    "j5_sku_audit": lambda s, sf: audit.sku_audit(d.catalog(s, sf).where("row_seq % 5 != 0"), d.cart(s, sf), d.lines(s, sf).select("sku")),
    "a10_violations": lambda s, sf: audit.violations(quality.price_checks(d.catalog(s, sf)), ["NO_PRICE", "PRICE_RANGE", "PRICE_HIGH", "NO_MODEL"]),
    "a27_confusion": lambda s, sf: audit.confusion(s.read.parquet(f"{sf}/labels.parquet"), "toxic", "quality"),
    "a17_status_by_category": lambda s, sf: audit.status_by(quality.graded(d.catalog(s, sf)), "cat"),
    "t1_locale_number": lambda s, sf: d.number_texts(s, sf).select("row_seq", exprs.locale_number(F.col("text"), -1.0).alias("value"), exprs.leading_number(F.col("text")).alias("leading")),
    "st1_status_replay": lambda s, sf: tracker.replay(d.status_events(s, sf)),
}



def _door(tariffs: str, bp: str) -> str:
    return f"""{d.SQL_LINES}, t AS {tariffs},
r AS (SELECT lines.*, t.* FROM lines JOIN t ON t.tariff_key = {_KEY}),
o AS (SELECT order_id, {_r2('sum(fob * qty)')} AS total, sum(qty) AS units, {' + '.join(f"CASE WHEN bool_or(list_contains(certs, '{k}')) THEN {usd}::DOUBLE ELSE 0 END" for k, usd in rules.CERTIFICATES)} AS cert_usd FROM r GROUP BY order_id),
b AS (SELECT r.*, total, cert_usd, CASE WHEN total > 0 THEN fob * qty / total WHEN units > 0 THEN qty / units ELSE 0 END AS share FROM r JOIN o USING (order_id)),
c AS (SELECT *, (total + total * 0.15::DOUBLE + total * 0.015::DOUBLE) * share AS cif FROM b),
e AS (SELECT *, cif * duty AS duty_usd, cif * fee AS fee_usd FROM c), g AS (SELECT *, cif + duty_usd + fee_usd AS base, (720::DOUBLE + cert_usd) * share AS extra FROM e),
h AS (SELECT *, base * vat AS vat_usd, base * vat_add + base * income + base * gross AS paid FROM g), door AS (SELECT *, base + paid + base * {bp}::DOUBLE + extra AS out FROM h)
SELECT order_id, line, sku, ncm, {_r2('cif')} AS cif, {_r2('duty_usd')} AS duty_usd, {_r2('fee_usd')} AS fee_usd, {_r2('vat_usd')} AS vat_usd, {_r2('vat_usd + paid')} AS recoverable_usd, {_r2('base')} AS real_usd, cert_usd, {_r2('out')} AS door_usd, {_r2(_over('out', 'qty'))} AS unit_door_usd FROM door"""


_DOOR = _door(_TARIFFS, "0")
_CHECKS = f"""{d.SQL_CATALOG}, rg AS {_RANGES},
k AS (SELECT c.*, array_to_string(list_filter([CASE WHEN fob IS NULL OR fob <= 0 THEN 'NO_PRICE' END, CASE WHEN fob > 0 AND (fob < least OR fob > most) THEN 'PRICE_RANGE' END, CASE WHEN fob >= warn AND fob <= most THEN 'PRICE_HIGH' END, CASE WHEN trim(coalesce(modelo, '')) = '' THEN 'NO_MODEL' END], lambda x: x IS NOT NULL), ',') AS issues FROM catalog c LEFT JOIN rg USING (cat)),
checks AS (SELECT sku, cat, fob, issues, CASE WHEN issues LIKE '%NO_%' OR issues LIKE '%RANGE%' THEN 'RED' WHEN issues <> '' THEN 'YELLOW' ELSE 'GREEN' END AS status FROM k)"""
_OUT = f"""{_FENCES}, z AS (SELECT sku, c.cat, fob, median, q3 - q1 AS iqr, greatest(fob - q3, q1 - fob) AS over FROM catalog c JOIN q USING (cat) WHERE fob > 0),
outliers AS (SELECT sku, cat, fob, median, {_r2('iqr')} AS iqr, {_r2('over / CASE WHEN iqr = 0 THEN 1 ELSE iqr END')} AS factor, CASE WHEN over > iqr * 3 THEN 'RED' ELSE 'YELLOW' END AS status FROM z WHERE over > iqr * 1.5::DOUBLE)"""
_RANK = "CASE {} WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 ELSE 1 END"
_GRADED = f"""{_CHECKS}, {_OUT}, graded AS (SELECT c.sku, c.cat, c.fob, c.issues, CASE greatest({_RANK.format('c.status')}, {_RANK.format("coalesce(o.status, 'GREEN')")}) WHEN 3 THEN 'RED' WHEN 2 THEN 'YELLOW' ELSE 'GREEN' END AS status FROM checks c LEFT JOIN outliers o USING (sku))"""
_IDENT = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_IDKEY = " || '|' || ".join(_IDENT.format(c) for c in ("marca", "modelo", "variante", "cat"))
_SLUG = "substr(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), 1, {})"

_FACTS = f"""{d.SQL_IMAGED}, bm AS (SELECT img, {_IDENT.format('modelo')} || '|' || upper(cat) AS model_cat, count(*) AS n, min(row_seq) AS first FROM imaged WHERE img IS NOT NULL GROUP BY ALL),
bi AS (SELECT img, count(*) AS n, min(row_seq) AS first, count(DISTINCT cat) AS n_cats, count(DISTINCT lower(marca)) AS n_brands FROM imaged WHERE img IS NOT NULL GROUP BY img),
facts AS (SELECT bi.*, (SELECT count(*) FROM bm WHERE bm.img = bi.img) AS models, (SELECT model_cat FROM bm WHERE bm.img = bi.img ORDER BY n DESC, first LIMIT 1) AS kept_model FROM bi)"""

ORACLE_SQL = {
    "dm2_set_prices": f"WITH {d.SQL_CATALOG}, u AS (SELECT 'P-' || lpad((o_orderkey % 3000)::VARCHAR, 8, '0') AS sku, floor(o_totalprice * 2) AS new_fob, o_orderkey AS seq FROM orders), l AS (SELECT sku, max_by(new_fob, seq) AS new_fob FROM u WHERE new_fob > 0 AND new_fob <= 100000 GROUP BY sku) SELECT c.sku, marca, modelo, variante, cat, coalesce(new_fob, fob) AS fob, row_seq, new_fob IS NOT NULL AND new_fob <> fob AS changed FROM catalog c LEFT JOIN l USING (sku)",
    "dm3_delete": f"WITH {d.SQL_CART} SELECT * FROM catalog WHERE sku NOT IN (SELECT sku FROM cart WHERE qty = 0)",
    "dm5_merge_cart": f"WITH {d.SQL_CART} SELECT sku, greatest(0::DOUBLE, qty + CASE WHEN qty > 2 THEN 3 - qty ELSE 0 END) AS qty FROM cart WHERE qty + CASE WHEN qty > 2 THEN 3 - qty ELSE 0 END > 0",
    "a24_discount": f"WITH {d.SQL_LINES}, o AS (SELECT order_id, fob, {_r2('fob * (1 - 0.07::DOUBLE)')} AS off, CASE WHEN qty <> 0 THEN qty ELSE 1 END AS qty FROM lines) SELECT order_id, {_r2('sum(off * qty)')} AS fob_total, {_r2('sum((fob - off) * qty)')} AS saving FROM o GROUP BY order_id",
    "j5_sku_audit": f"WITH {d.SQL_CART}, k AS (SELECT sku FROM catalog WHERE row_seq % 5 <> 0), h AS (SELECT c.sku FROM lineitem JOIN catalog c ON c.row_seq = l_partkey) SELECT DISTINCT sku, 'cart_orphan' AS finding FROM cart WHERE sku NOT IN (SELECT sku FROM k) UNION ALL SELECT DISTINCT sku, 'history_orphan' FROM h WHERE sku NOT IN (SELECT sku FROM k)",
    "a10_violations": f"WITH {_CHECKS} SELECT code, (SELECT count(*) FROM checks WHERE list_contains(string_split(issues, ','), code)) AS n FROM (VALUES ('NO_PRICE'), ('PRICE_RANGE'), ('PRICE_HIGH'), ('NO_MODEL')) t(code)",
    "a27_confusion": "SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic <> 1 AND quality = 1) AS fp, count(*) FILTER (toxic = 1 AND quality <> 1) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 1) AS tn FROM labels",
    "a17_status_by_category": f"WITH {_GRADED} SELECT cat, count(*) FILTER (status = 'GREEN') AS green, count(*) FILTER (status = 'YELLOW') AS yellow, count(*) FILTER (status = 'RED') AS red FROM graded GROUP BY cat",
    "t1_locale_number": f"WITH {d.SQL_CATALOG}, t AS (SELECT row_seq, CASE row_seq % 4 WHEN 0 THEN '1.' || lpad((row_seq % 1000)::VARCHAR, 3, '0') || ',5' WHEN 1 THEN '2,' || lpad((row_seq % 1000)::VARCHAR, 3, '0') || '.25' WHEN 2 THEN row_seq::VARCHAR || ',75' ELSE 'x' END AS text FROM catalog) SELECT row_seq, CASE row_seq % 4 WHEN 0 THEN 1000 + row_seq % 1000 + 0.5::DOUBLE WHEN 1 THEN 2000 + row_seq % 1000 + 0.25::DOUBLE WHEN 2 THEN row_seq + 0.75::DOUBLE ELSE -1 END AS value, CASE row_seq % 4 WHEN 0 THEN regexp_extract(text, '^[0-9]+[.][0-9]+')::DOUBLE WHEN 1 THEN 2 WHEN 2 THEN row_seq END::DOUBLE AS leading FROM t",
    "a6_assignment_metrics": f"WITH {_FACTS} SELECT (SELECT count(*) FROM imaged) AS total, (SELECT count(img) FROM imaged) AS with_image, count(*) AS unique_images, count(*) FILTER (n > 1) AS shared_images, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS shared_rows, count(*) FILTER (n_cats > 1) AS cross_category, count(*) FILTER (n_brands > 1 AND models > 1) AS cross_brand FROM facts",
    "a12_image_audit": f"WITH {d.SQL_IMAGED} SELECT state, count(*) AS n FROM (SELECT CASE WHEN img IS NULL THEN 'missing' WHEN row_seq <> min(row_seq) OVER (PARTITION BY img) THEN 'duplicate' ELSE 'inline' END AS state FROM imaged) GROUP BY state",
    "v11_integrity_gates": f"WITH {_FACTS}, r AS (SELECT i.sku, i.row_seq, i.img, i.status, coalesce(n_cats > 1, false) AS across, coalesce(n_brands > 1 AND models > 1 AND {_IDENT.format('modelo')} || '|' || upper(cat) <> kept_model, false) AS brands, first FROM imaged i LEFT JOIN facts f ON f.img = i.img), l AS (SELECT *, CASE WHEN NOT ((across AND row_seq <> first) OR brands) THEN img END AS kept FROM r) SELECT sku, row_seq, kept AS img, CASE WHEN status = 'GREEN' AND (across OR kept IS NULL) THEN 'YELLOW' ELSE status END AS status, array_to_string(list_filter([CASE WHEN across THEN 'cross-category' END, CASE WHEN brands THEN 'cross-brand' END, CASE WHEN kept IS NULL THEN 'no-image' END], lambda x: x IS NOT NULL), ',') AS reasons FROM l",
    "w4_row_bounds": f"WITH {d.SQL_ITEMS} SELECT file, page, item, y, coalesce((lag(y) OVER w + y) / 2, y - 20) AS top, coalesce((lead(y) OVER w + y) / 2, y + 20) AS bottom FROM items WHERE price IS NOT NULL WINDOW w AS (PARTITION BY file, page ORDER BY y, item)",
    "w15_row_heights": f"WITH {d.SQL_ITEMS}, y AS (SELECT DISTINCT file, page, y FROM items), g AS (SELECT *, y - lag(y) OVER (PARTITION BY file, page ORDER BY y) AS gap FROM y) SELECT file, page, count(*) FILTER (gap > 5 AND gap < 300) AS gaps, {_r2('avg(gap) FILTER (gap > 5 AND gap < 300)')} AS height FROM g GROUP BY file, page",
    "j13_nearest_above": f"WITH {d.SQL_ITEMS}, h AS (SELECT * FROM items WHERE item % 9 = 0), c AS (SELECT i.file, i.page, i.item, i.y, max_by(h.item, (h.y, h.item)) AS header, max(h.y) AS hy FROM items i LEFT JOIN h ON h.file = i.file AND h.page = i.page AND h.y <= i.y GROUP BY ALL) SELECT file, page, item, CASE WHEN y - hy <= 260 THEN header END AS header, CASE WHEN y - hy <= 260 THEN y - hy END AS distance FROM c",
    "j14_grounding": f"WITH {d.SQL_ITEMS}, r AS (SELECT * FROM items WHERE price IS NULL), a AS (SELECT * FROM items WHERE price IS NOT NULL), m AS (SELECT r.item, min((abs(r.y - a.y) + abs(r.x - a.x), a.item)) AS b FROM r JOIN a ON a.file = r.file AND a.page = r.page AND abs(r.x - a.x) <= 40 AND abs(r.y - a.y) <= 30 AND abs(r.fob - a.price) < 0.01 GROUP BY r.item) SELECT r.item, b[2] AS anchor, {_r2('b[1]')} AS distance, b IS NOT NULL AS grounded FROM r LEFT JOIN m USING (item)",
    "s4_products": f"WITH {d.SQL_CATALOG} SELECT sku, marca, modelo, variante, fob, cat FROM (SELECT sku, marca, CASE WHEN row_seq % 10 = 0 THEN '' ELSE modelo END AS modelo, variante, CASE WHEN row_seq % 7 = 0 THEN NULL ELSE floor(fob) END AS fob, CASE WHEN row_seq % 3 = 0 THEN 'OTRO' ELSE cat END AS cat FROM catalog) WHERE modelo <> '' AND coalesce(fob, 0) <> 0",
    "s4_skipped": f"WITH {d.SQL_CATALOG} SELECT count(*) FILTER (row_seq % 10 = 0) AS no_model, count(*) FILTER (row_seq % 10 <> 0 AND (row_seq % 7 = 0 OR floor(fob) = 0)) AS no_price FROM catalog",
    "d1_order_costing": f"WITH {_COSTED} SELECT * FROM costed",
    "d17_order_totals": f"WITH {_TOTALS} SELECT *, CASE WHEN margin_pct >= 40 THEN 'healthy' WHEN margin_pct >= 20 THEN 'tight' ELSE 'low' END AS band FROM totals",
    "d5_courier_warnings": f"""WITH {d.SQL_LINES}, o AS (SELECT order_id, {_r2('sum(fob * qty)')} AS fob_total, sum(qty) * 0.5::DOUBLE AS kg, count(*) FILTER (qty > 3) AS n_commercial FROM lines GROUP BY order_id),
w AS (SELECT *, array_to_string(list_filter([CASE WHEN fob_total > 3000 THEN 'COURIER_FOB_EXCEEDED' END, CASE WHEN kg > 50 THEN 'COURIER_WEIGHT_EXCEEDED' END, CASE WHEN n_commercial > 0 THEN 'COURIER_SPECIES_WARNING' END], lambda x: x IS NOT NULL), ',') AS warnings FROM o) SELECT * FROM w WHERE warnings <> ''""",
    "d6_door_to_door": f"WITH {_DOOR}",
    "d7_courier_regime": f"WITH {d.SQL_LINES}, o AS (SELECT order_id, {_r2('sum(fob * qty)')} AS fob_total FROM lines GROUP BY order_id), c AS (SELECT *, fob_total + fob_total * 0.15::DOUBLE + fob_total * 0.015::DOUBLE AS cif FROM o), e AS (SELECT *, greatest(0::DOUBLE, cif - 400) * 0.5::DOUBLE AS duty, cif * 0.21::DOUBLE AS vat FROM c) SELECT order_id, fob_total, {_r2('cif')} AS cif, {_r2('duty')} AS duty_usd, {_r2('vat')} AS vat_usd, {_r2('cif + duty')} AS net_usd, {_r2('cif + duty + vat')} AS cash_usd FROM e",
    "d10_landed_verdict": f"WITH {d.SQL_RECORDS} SELECT record, CASE WHEN local_price IS NULL OR local_price <= 0 THEN 'unavailable' WHEN abs(local_price - landed) < 1e-6 THEN 'break_even' WHEN landed < local_price THEN 'cheaper' ELSE 'more_expensive' END AS verdict FROM records",
    "d14_profitability": f"WITH {d.SQL_RECORDS} SELECT record, status, landed, local_price, {_r2('local_price - landed')} AS profit, CASE WHEN local_price IS NOT NULL THEN {_r2(_over('(local_price - landed) * 100', 'landed'))} END AS roi_pct, CASE WHEN local_price IS NULL THEN 'unavailable' ELSE 'known' END AS verdict FROM records",
    "d15_scenarios": f"""WITH {_COSTED}, f AS (SELECT * FROM (VALUES (1260::DOUBLE), (1400::DOUBLE), (1540::DOUBLE)) x(rate), (VALUES (-20::DOUBLE), (0::DOUBLE), (20::DOUBLE)) y(freight_change)),
x AS (SELECT order_id, order_fob, order_qty, duty_rate, {_r2('net')} AS order_net, rate, freight_change, order_fob + order_fob * (15::DOUBLE * (1 + freight_change / 100) / 100) + order_fob * (2::DOUBLE / 100) AS cif2 FROM n2, f),
c AS (SELECT *, {_r2('cif2 + cif2 * duty_rate + cif2 * (3::DOUBLE / 100) + cif2 * (6::DOUBLE / 100) + order_qty * 8::DOUBLE')} AS cost_usd FROM x), g AS (SELECT *, cost_usd * (1 / (1 - 35::DOUBLE / 100)) AS goal FROM c)
SELECT order_id, rate, freight_change, cost_usd, {_r2('cost_usd - order_net')} AS cost_change, {_r2('goal')} AS target_revenue, {_r2('goal - cost_usd')} AS target_margin, {_r0('goal * rate')} AS target_local FROM g""",
    "d16_break_even": f"WITH {_TOTALS}, p AS (SELECT order_id, {_over('revenue - order_net', 'units')} AS profit FROM totals) SELECT order_id, CASE WHEN profit > 0 THEN ceil(1000::DOUBLE / profit) ELSE 0 END::BIGINT AS units FROM p",
    "a2_kpis": f"WITH {d.SQL_CATALOG} SELECT count(*) AS n, count(DISTINCT marca) AS brands, coalesce(min(fob) FILTER (fob > 0), 0) AS least, greatest(coalesce(max(fob), 0), 0) AS most, {_r2('coalesce(avg(fob) FILTER (fob > 0), 0)')} AS mean FROM catalog",
    "a3_facets": f"WITH {d.SQL_CATALOG} SELECT DISTINCT facet, value FROM (SELECT 'marca' AS facet, marca AS value FROM catalog UNION ALL SELECT 'cat', cat FROM catalog) WHERE value IS NOT NULL AND value <> ''",
    "a4_supplier_comparison": f"WITH {d.SQL_CATALOG}, k AS (SELECT *, lower(trim(modelo)) AS model_key FROM catalog), w AS (SELECT *, count(*) OVER g AS offers, min(fob) OVER g AS least, max(fob) OVER g AS most, row_number() OVER (PARTITION BY model_key ORDER BY fob, row_seq) AS place FROM k WHERE length(model_key) >= 3 WINDOW g AS (PARTITION BY model_key)) SELECT model_key, sku, fob, offers, least, most, {_r2('most - least')} AS diff, {_r2(_over('(most - least) * 100', 'least'))} AS diff_pct, place = 1 AS best, {_r2('fob - least')} AS over_best FROM w WHERE offers > 1",
    "a5_rollups": f"WITH {d.SQL_RECORDS} SELECT {_r2('coalesce(sum(landed::DECIMAL(20,2)), 0)::DOUBLE')} AS invested, {_r2('coalesce(sum((local_price - landed)::DECIMAL(20,2)), 0)::DOUBLE')} AS profit, count(*) FILTER (status NOT IN ('delivered', 'cancelled')) AS active, {', '.join(f'''count(*) FILTER (status = '{x}') AS n_{x}''' for x in rules.STATUSES)} FROM records",
    "a7_duplicate_groups": f"WITH {d.SQL_CATALOG} SELECT {' || chr(124) || '.join(_IDENT.format(c) for c in ('marca', 'cat', 'modelo', 'variante'))} || '|' || printf('%.2f', floor(fob)) AS dup_key, count(*) AS n, min(sku) AS first_sku FROM catalog GROUP BY 1 HAVING count(*) > 1",
    "a8_outliers": f"WITH {d.SQL_CATALOG}, {_OUT} SELECT * FROM outliers",
    "a9_minority_categories": f"WITH {d.SQL_CATALOG}, c AS (SELECT cat || '-' || floor(fob)::BIGINT AS cat, count(*) AS n FROM catalog GROUP BY 1) SELECT cat, n FROM c WHERE n <= 3 AND n < (SELECT sum(n) FROM c) * 0.02::DOUBLE AND cat <> 'OTRO'",
    "a20_vocabulary": f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token HAVING count(*) >= 3",
    "f1_search_filter": f"WITH {d.SQL_CATALOG} SELECT * FROM catalog WHERE contains(lower(sku || ' ' || marca || ' ' || modelo || ' ' || variante), 'ring') AND cat = 'MOUSE' AND fob >= 20 AND fob <= 400",
    "f2_selected_only": f"WITH {d.SQL_CART} SELECT * FROM catalog WHERE sku IN (SELECT sku FROM cart WHERE qty > 0)",
    "f12_integrity": f"WITH {d.SQL_CATALOG}, k AS (SELECT row_seq, substr(sku, 1, 9) AS sku, fob, modelo, row_number() OVER (PARTITION BY substr(sku, 1, 9) ORDER BY row_seq) AS place FROM catalog) SELECT row_seq, sku, 'DUPLICATE_SKU' AS issue FROM k WHERE place > 1 UNION ALL SELECT row_seq, sku, 'INVALID_FOB' FROM k WHERE fob IS NULL OR fob < 0 UNION ALL SELECT row_seq, sku, 'MISSING_MODEL' FROM k WHERE trim(coalesce(modelo, '')) = ''",
    "j1_order_lines": f"WITH {d.SQL_CART} SELECT sku, qty, marca, modelo, variante, cat, fob, row_seq FROM cart JOIN catalog USING (sku)",
    "j2_cart_value": f"WITH {d.SQL_CART} SELECT {_r2('coalesce(sum(coalesce(fob * qty, 0)), 0)')} AS value FROM cart LEFT JOIN catalog USING (sku)",
    "j3_upsert": f"WITH {d.SQL_CATALOG}, k AS (SELECT *, {_IDKEY} AS k FROM catalog), h AS (SELECT k, min_by(sku, row_seq) AS sku, min_by(fob, row_seq) AS fob FROM k WHERE row_seq % 3 <> 0 GROUP BY k), b AS (SELECT k, max_by(sku, row_seq) AS sku, max_by({_r2('fob * (1 + (row_seq % 4)::DOUBLE / 100)')}, row_seq) AS fob FROM k WHERE row_seq % 2 = 0 GROUP BY k), m AS (SELECT coalesce(h.k, b.k) AS k, coalesce(h.sku, b.sku) AS sku, h.fob AS old, b.fob AS new, CASE WHEN b.k IS NULL THEN 'keep' WHEN h.k IS NULL THEN 'insert' WHEN abs(b.fob - h.fob) >= 0.01::DOUBLE THEN 'update' ELSE 'skip' END AS action FROM h FULL JOIN b ON h.k = b.k) SELECT k, sku, CASE WHEN action IN ('update', 'insert') THEN new ELSE old END AS fob, action FROM m",
    "j4_orphans": f"WITH {d.SQL_CART} SELECT * FROM cart WHERE sku NOT IN (SELECT sku FROM catalog)",
    "o1_page": f"WITH {d.SQL_CATALOG} SELECT * FROM catalog ORDER BY row_seq LIMIT 50 OFFSET 100",
    "t22_allocated_sku": f"WITH {d.SQL_CATALOG} SELECT row_seq, {' || chr(45) || '.join(_SLUG.format(c, n) for c, n in (('marca', 6), ('cat', 4), ('modelo', 12), ('variante', 6)))} AS generated, {_IDKEY} AS identity FROM catalog",
    "t25_html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages",
    "v1_price_checks": f"WITH {_CHECKS} SELECT * FROM checks",
    "v4_graded": f"WITH {_GRADED} SELECT * FROM graded",
    "f4_status_summary": f"WITH {_GRADED} SELECT status, count(*) AS n, {_r2('count(*) * 100::DOUBLE / sum(count(*)) OVER ()')} AS pct FROM graded GROUP BY status",
    "w2_first_wins": f"WITH {d.SQL_CATALOG} SELECT min_by(sku, row_seq) AS sku, min(row_seq) AS row_seq FROM catalog GROUP BY lower(marca), lower(substr(modelo, 1, 50)), lower(substr(variante, 1, 30)), floor(fob)",
    "x8_search": f"WITH i AS (SELECT DISTINCT unnest({_TOKENS}) AS token, doc_id AS id FROM documents), a AS (SELECT item_id AS query, unnest({_TOKENS}) AS token FROM benchmark), n AS (SELECT query, count(*) AS n_tokens FROM a GROUP BY query), h AS (SELECT query, id, count(*) AS score FROM a JOIN i USING (token) GROUP BY query, id), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM h) SELECT query, id, score, place, {_r2('least(1::DOUBLE, score / greatest(2, n_tokens))')} AS confidence, least(1::DOUBLE, score / greatest(2, n_tokens)) >= 0.4::DOUBLE AND score >= 2 AS accepted FROM p JOIN n USING (query) WHERE place <= 3",
}
