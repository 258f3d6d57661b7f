"""Queries of changes to catalogs, carts and previews, of joins on pages, and of small inventory rows, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lonja.functions import exprs, rules, text
from lonja.operators import audit, catalog as cat, checks, mutations, spatial
from lonja.plans import domain as d
from lonja.plans.checks import _FULL
from lonja.plans.checks import ORACLE_SQL as _CHECKED
from lonja.plans.registry import _IDENT, _IDKEY, _SLUG, _TARIFFS, _r2

_WORDS = ["large", "small", "new", "cold", "red", "blue"]


def _cart(s, sf):
    return d.cart(s, sf)


def _updates(s, sf):
    """Edits of fields from orders: prices in words, brands, empty values."""
    o = s.read.parquet(f"{sf}/orders.parquet")
    field = F.element_at(F.array(*map(F.lit, ("fob", "marca", "modelo"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    value = F.when(F.col("o_orderkey") % 10 == 0, " ").when(field == "fob", F.concat(F.lit("$ "), F.col("o_custkey").cast("string"), F.lit(",5"))).otherwise(F.concat(F.lit("v"), F.col("o_custkey").cast("string")))
    return o.select(F.concat(F.lit("P-"), F.lpad((F.col("o_orderkey") % 2500).cast("string"), 8, "0")).alias("sku"), field.alias("field"), value.alias("value"), F.col("o_orderkey").alias("seq"))


def _renames(s, sf):
    return d.catalog(s, sf).where("row_seq % 4 = 0").select("sku", F.when(F.col("row_seq") % 8 == 0, F.concat(F.lit("n-"), F.floor(F.col("row_seq") / 16).cast("string"))).when(F.col("row_seq") % 12 == 0, F.lit("P-00000005")).otherwise(F.concat(F.lit(" q-"), "row_seq")).alias("new_sku"))


def _page_rows(s, sf):
    """Page items with a brand, category and a model that is a bare colour for some."""
    i = d.page_items(s, sf)
    return i.withColumns({"marca": F.concat(F.lit("B"), F.col("item") % 4), "cat": F.lit("MOUSE"), "modelo": F.when(F.col("item") % 4 == 1, "Black").otherwise(F.concat(F.lit("M"), F.col("item").cast("string"))), "fob": (F.col("item") % 37).cast("double")})


def _extracted(s, sf):
    return d.page_items(s, sf).where("item % 2 = 0").withColumns({"x": F.col("x") + F.col("item") % 5, "y": F.col("y") - F.col("item") % 7})


def _valid(s, sf):
    return checks.full_validation(d.items(s, sf))


def _allocated(s, sf):
    return cat.allocate(_batch(s, sf), d.catalog(s, sf).where("row_seq % 3 = 0"))


def _batch(s, sf):
    sku = F.when(F.col("row_seq") % 5 == 0, "").when(F.col("row_seq") % 7 == 0, F.concat(F.lit("P-"), F.lpad((F.col("row_seq") % 50 * 3).cast("string"), 8, "0"))).otherwise(F.col("sku"))
    return d.catalog(s, sf).where("row_seq % 2 = 0").withColumn("sku", sku)


def _verdicts(s, sf):
    """Verdict of the gates against what a reviewer says, and an earlier verdict."""
    return _valid(s, sf).select(F.when(F.col("status") == "RED", 1).otherwise(0).alias("verdict"), F.when((F.col("status") == "RED") != (F.col("row_seq") % 15 == 0), 1).otherwise(0).alias("truth"), F.when((F.col("status") == "RED") != (F.col("row_seq") % 9 == 0), 1).otherwise(0).alias("before"))


QUERIES = {
    "dm1_insert_blank": lambda s, sf: mutations.insert_blank(d.catalog(s, sf), "NEW-1"),
    "dm2_update_fields": lambda s, sf: mutations.update_fields(d.catalog(s, sf), _updates(s, sf)),
    "dm2_rename_skus": lambda s, sf: mutations.rename_skus(d.catalog(s, sf), _cart(s, sf), _renames(s, sf))[0].select("row_seq", "sku"),
    "dm2_moved_cart": lambda s, sf: mutations.rename_skus(d.catalog(s, sf), _cart(s, sf), _renames(s, sf))[1],
    "dm3_delete_from_cart": lambda s, sf: mutations.delete(_cart(s, sf), d.catalog(s, sf).where("fob > 50")),
    "dm4_clear": lambda s, sf: mutations.select_all(_cart(s, sf), d.catalog(s, sf), on=False),
    "dm5_set_cart": lambda s, sf: mutations.set_cart(_cart(s, sf), d.catalog(s, sf).select("sku", F.when(F.col("row_seq") % 2 == 0, "toggle").otherwise("set").alias("action"), (F.col("row_seq") % 4).cast("double").alias("qty"))),
    "dm6_select_all": lambda s, sf: mutations.select_all(_cart(s, sf), cat.search_filter(d.catalog(s, sf), text="ring", category="MOUSE")),
    "dm7_batch_set": lambda s, sf: mutations.batch_set(d.items(s, sf), F.col("row_seq") % 3 == 0, marca="Razer", cat="MOUSE").select("row_seq", "marca", "cat"),
    "dm8_edit_row": lambda s, sf: checks.item_validation(mutations.batch_set(d.items(s, sf), F.col("row_seq") == 9, modelo="AJ139 Pro").where("row_seq != 12")).select("row_seq", "modelo"),
    "dm9_select_visible": lambda s, sf: mutations.select_visible(_valid(s, sf).withColumn("selected", F.lit(False)), F.col("row_seq") % 2 == 0).select("row_seq", "selected"),
    "dm10_remove_lines": lambda s, sf: mutations.remove_lines(d.lines(s, sf), d.lines(s, sf).where("line = 1")).groupBy("order_id").agg(F.count("*").alias("n"), exprs.round2(F.sum(F.col("fob") * F.col("qty"))).alias("fob")),
    "dm11_replace_images": lambda s, sf: mutations.replace_images(d.items(s, sf).withColumn("sku", F.concat(F.lit("K"), "row_seq")), d.items(s, sf).select(F.concat(F.lit("K"), F.col("row_seq") + 1).alias("sku"), F.col("img").alias("new_img"))).select("row_seq", "img"),
    "dm12_clone_orders": lambda s, sf: mutations.clone_orders(d.lines(s, sf), d.records(s, sf).where("record % 50 = 0").select(F.col("record").alias("order_id"))),
    "dm13_brand_rules": lambda s, sf: mutations.upsert_brands(d.catalog(s, sf).select(F.col("marca").alias("name")).distinct().withColumn("pattern", F.lit("old")), d.items(s, sf).where("row_seq % 4 = 0").select(F.upper("marca").alias("name"), F.when(F.col("row_seq") % 8 == 0, F.lit("new")).alias("pattern"), F.col("row_seq").alias("seq"))),
    "j3_upsert": lambda s, sf: cat.upsert(d.catalog(s, sf).where("row_seq % 3 != 0"), d.catalog(s, sf).where("row_seq % 2 = 0").withColumn("fob", exprs.round2(F.col("fob") * (1 + (F.col("row_seq") % 4) / 100)))),
    "j8_code_lookup": lambda s, sf: cat.code_lookup(d.catalog(s, sf).select(F.element_at(F.array(*map(F.lit, ("8471 60 52", "85.18.30.00", "0000", "8473.30.99"))), (F.col("row_seq") % 4 + 1).cast("int")).alias("code")).distinct(), rules.tariffs(s)).select("code", "tariff_key", "duty"),
    "j9_duty_rates": lambda s, sf: cat.duty_rates(rules.tariffs(s), d.catalog(s, sf).where("row_seq % 2 = 0").select(F.when(F.col("cat") == "MOUSE", "8471.60.53").when(F.col("cat") == "MONITOR", "8528.52.00").alias("ncm"), (F.col("row_seq") / 1000).alias("duty")).where("ncm IS NOT NULL")),
    "j11_inherited_images": lambda s, sf: cat.inherit_image(d.imaged(s, sf)).select("row_seq", "img", "inherited"),
    "j12_recovered_models": lambda s, sf: spatial.recovered_models(_page_rows(s, sf), F.col("modelo") == "Black"),
    "j15_cell_texts": lambda s, sf: spatial.cell_texts(d.page_items(s, sf).where("price IS NOT NULL"), d.page_items(s, sf)),
    "j16_image_candidates": lambda s, sf: spatial.image_candidates(d.page_items(s, sf).where("item % 3 = 0"), d.page_items(s, sf).where("item % 7 = 0")),
    "j17_siblings": lambda s, sf: spatial.siblings(d.page_items(s, sf)),
    "j19_corrected": lambda s, sf: cat.corrected(d.catalog(s, sf), d.price_updates(s, sf).select("sku", F.col("seq").cast("string").alias("new_modelo")), _cart(s, sf)),
    "j20_matched_truth": lambda s, sf: spatial.matched_truth(d.page_items(s, sf).where("item % 4 = 0"), _extracted(s, sf)),
    "j21_confusion": lambda s, sf: audit.confusion(_verdicts(s, sf), "truth", "verdict"),
    "a21_calibration": lambda s, sf: audit.calibration(_verdicts(s, sf), "truth", "before", "verdict"),
    "a23_badges": lambda s, sf: audit.badges(d.catalog(s, sf), _cart(s, sf), d.records(s, sf)),
    "a13_receipt": lambda s, sf: cat.receipt(cat.sku_mapping(_batch(s, sf), _allocated(s, sf))),
    "a14_idempotence": lambda s, sf: cat.receipt(cat.sku_mapping(_batch(s, sf), _allocated(s, sf))).join(cat.receipt(cat.sku_mapping(_batch(s, sf).where("row_seq > 2"), _allocated(s, sf))).select(F.col("input_identity").alias("other"))).select((F.col("input_identity") == F.col("other")).alias("same")),
    "w11_allocated": lambda s, sf: _allocated(s, sf).groupBy("how").agg(F.count("*").alias("n"), F.count_distinct("sku").alias("skus")),
    "w12_sku_mapping": lambda s, sf: cat.sku_mapping(_batch(s, sf), _allocated(s, sf)).where("kind = 'preserved'").select("row_seq", "new_sku"),
    "w14_median_y": lambda s, sf: spatial.median_y(d.page_items(s, sf)),
    "o5_top_colours": lambda s, sf: d.items(s, sf).select("file", text.colour_name(*(F.pmod(F.col("row_seq") * k, F.lit(256)).cast("double") for k in (37, 91, 53))).alias("c")).where("c != 'MULTICOLOR'").groupBy("file", "c").count().groupBy("file").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "c"))), 1, 3).alias("t")).select("file", F.array_join(F.transform("t", lambda x: x["c"]), ",").alias("colours")),
    "o8_largest_group": lambda s, sf: d.catalog(s, sf).groupBy("cat", "marca").agg(F.count("*").alias("n"), F.min("row_seq").alias("first")).groupBy("cat").agg(F.max_by("marca", F.struct("n", -F.col("first"))).alias("marca")),
    "u1_concatenated": lambda s, sf: d.catalog(s, sf).where("row_seq % 2 = 0").drop("variante").unionByName(d.catalog(s, sf).where("row_seq % 5 = 0"), allowMissingColumns=True).groupBy("variante").agg(F.count("*").alias("n")),
    "u2_array_sets": lambda s, sf: d.catalog(s, sf).select("row_seq", F.split("modelo", " ").alias("w")).select("row_seq", F.array_join(F.array_distinct(F.concat("w", F.array(*map(F.lit, _WORDS[:2])))), ",").alias("union"), F.array_join(F.array_except("w", F.array(*map(F.lit, _WORDS[2:]))), ",").alias("rest"), F.array_contains("w", "ring").alias("held")),
    "u3_vocabulary": lambda s, sf: d.catalog(s, sf).select(F.col("marca").alias("name")).union(d.items(s, sf).select("marca")).where("name != ''").distinct(),
    "s12_fx_rate": lambda s, sf: d.records(s, sf).select("record", F.coalesce(F.when(F.col("record") % 3 != 0, F.nullif("local_price", F.lit(0.0))), F.col("landed")).alias("rate")),
    "s13_export_json": lambda s, sf: d.catalog(s, sf).select(F.to_json(F.struct(F.array(F.struct("row_seq", "sku")).alias("products"))).alias("j")).select(F.explode(F.from_json("j", "products array<struct<row_seq:long,sku:string>>")["products"]).alias("p")).select("p.*"),
    "t24_image_hash": lambda s, sf: d.items(s, sf).select("row_seq", F.sha2("img", 256).alias("hash")),
    "m3_dates": lambda s, sf: s.read.parquet(f"{sf}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "dd/MM").alias("label")),
    "m8_json": lambda s, sf: d.catalog(s, sf).select("row_seq", F.to_json(F.map_concat(F.create_map(F.lit("cat"), F.col("cat")), F.create_map(F.lit("marca"), F.col("marca")))).alias("j")).select("row_seq", F.get_json_object("j", "$.marca").alias("marca")),
}

_UPD = "CASE o_orderkey % 3 WHEN 0 THEN 'fob' WHEN 1 THEN 'marca' ELSE 'modelo' END"
_NEAR = "r.file = l.file AND r.page = l.page AND abs(r.x - l.x) <= {dx} AND r.y - l.y BETWEEN -{above} AND {below}"
_BATCH = f"{d.SQL_CATALOG}, b AS (SELECT * REPLACE (CASE WHEN row_seq % 5 = 0 THEN '' WHEN row_seq % 7 = 0 THEN 'P-' || lpad((row_seq % 50 * 3)::VARCHAR, 8, '0') ELSE sku END AS sku) FROM catalog WHERE row_seq % 2 = 0)"
_MADE = " || '-' || ".join(f"CASE WHEN {_SLUG.format(c, n)} = '' THEN 'X' ELSE {_SLUG.format(c, n)} END" for c, n in (("marca", 6), ("cat", 4), ("modelo", 12), ("variante", 6)))
_ALLOC = f"""{_BATCH}, h AS (SELECT *, {_IDKEY} AS k FROM catalog WHERE row_seq % 3 = 0), kn AS (SELECT k, min_by(sku, row_seq) AS known FROM h GROUP BY k), us AS (SELECT sku AS want, min_by(k, row_seq) AS owner FROM h GROUP BY sku),
ld AS (SELECT k, min_by(sku, row_seq) AS source, min_by(made, row_seq) AS made, min(row_seq) AS row_seq FROM (SELECT *, {_IDKEY} AS k, {_MADE} AS made FROM b) GROUP BY k),
l1 AS (SELECT ld.*, known, CASE WHEN known IS NULL AND source <> '' THEN source END AS w FROM ld LEFT JOIN kn ON kn.k = ld.k),
l2 AS (SELECT l1.*, owner, row_number() OVER (PARTITION BY coalesce(w, ' ' || l1.k) ORDER BY l1.row_seq) AS turn FROM l1 LEFT JOIN us ON us.want = l1.w),
l3 AS (SELECT *, CASE WHEN known IS NOT NULL THEN 'known' WHEN w IS NOT NULL AND ((owner IS NULL AND turn = 1) OR coalesce(owner = k, false)) THEN 'source' ELSE 'generated' END AS how FROM l2),
l4 AS (SELECT *, row_number() OVER (PARTITION BY made ORDER BY CASE WHEN how = 'generated' THEN 0 ELSE 1 END, row_seq) AS again FROM l3),
al AS (SELECT b.row_seq, b.sku AS old_sku, how, CASE how WHEN 'known' THEN known WHEN 'source' THEN source ELSE CASE WHEN again > 1 OR made IN (SELECT want FROM us) THEN made || '-' || upper(substr(sha256(k), 1, 8)) ELSE made END END AS sku FROM (SELECT *, {_IDKEY} AS bk FROM b) b JOIN l4 ON l4.k = bk),
mp AS (SELECT row_seq, old_sku, sku AS new_sku, CASE WHEN old_sku = sku THEN 'preserved' WHEN old_sku = '' THEN 'generated' ELSE 'deduplicated' END AS kind FROM al)"""
_REN = f"""{d.SQL_CART}, w AS (SELECT sku, upper(trim(CASE WHEN row_seq % 8 = 0 THEN 'n-' || (row_seq // 16) WHEN row_seq % 12 = 0 THEN 'P-00000005' ELSE ' q-' || row_seq END)) AS new_sku FROM catalog WHERE row_seq % 4 = 0),
free AS (SELECT any_value(sku) AS sku, new_sku FROM w GROUP BY new_sku HAVING count(*) = 1 AND new_sku NOT IN (SELECT sku FROM catalog))"""
_VERD = f"{_FULL}, vd AS (SELECT status = 'RED' AS p, (status = 'RED') <> (row_seq % 15 = 0) AS t, (status = 'RED') <> (row_seq % 9 = 0) AS b FROM valid)"


def _sets(n: str) -> str:
    return f"SELECT variante, count(*) AS n FROM ({n}) GROUP BY variante"


ORACLE_SQL = {
    "dm1_insert_blank": f"WITH {d.SQL_CATALOG} SELECT * FROM catalog UNION ALL SELECT 'NEW-1', '', '', '', 'OTRO', 0::DOUBLE, (SELECT min(row_seq) - 1 FROM catalog)",
    "dm2_update_fields": f"WITH {d.SQL_CATALOG}, u AS (SELECT 'P-' || lpad((o_orderkey % 2500)::VARCHAR, 8, '0') AS sku, {_UPD} AS field, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN (o_custkey + 0.5::DOUBLE)::VARCHAR ELSE 'v' || o_custkey END AS value, o_orderkey AS seq FROM orders), l AS (SELECT sku, field, max_by(value, seq) AS value FROM u WHERE value <> '' GROUP BY ALL) SELECT c.sku, coalesce((SELECT value FROM l WHERE l.sku = c.sku AND field = 'marca'), marca) AS marca, coalesce((SELECT value FROM l WHERE l.sku = c.sku AND field = 'modelo'), modelo) AS modelo, variante, cat, coalesce((SELECT value::DOUBLE FROM l WHERE l.sku = c.sku AND field = 'fob'), fob) AS fob, row_seq FROM catalog c",
    "dm2_rename_skus": f"WITH {_REN} SELECT row_seq, coalesce(new_sku, catalog.sku) AS sku FROM catalog LEFT JOIN free ON free.sku = catalog.sku",
    "dm2_moved_cart": f"WITH {_REN} SELECT coalesce(new_sku, cart.sku) AS sku, qty FROM cart LEFT JOIN free ON free.sku = cart.sku",
    "dm3_delete_from_cart": f"WITH {d.SQL_CART} SELECT * FROM cart WHERE sku NOT IN (SELECT sku FROM catalog WHERE fob > 50)",
    "dm4_clear": f"WITH {d.SQL_CART} SELECT * FROM cart WHERE false",
    "dm5_set_cart": f"WITH {d.SQL_CART}, g AS (SELECT sku, CASE WHEN row_seq % 2 = 0 THEN 'toggle' ELSE 'set' END AS action, (row_seq % 4)::DOUBLE AS given FROM catalog), x AS (SELECT coalesce(g.sku, cart.sku) AS sku, CASE action WHEN 'set' THEN given WHEN 'toggle' THEN CASE WHEN coalesce(qty, 0) > 0 THEN 0 ELSE 1 END ELSE qty END AS qty FROM g FULL JOIN cart ON cart.sku = g.sku) SELECT sku, qty::DOUBLE AS qty FROM x WHERE qty > 0",
    "dm6_select_all": f"WITH {d.SQL_CART}, f AS (SELECT sku FROM catalog WHERE contains(lower(sku || ' ' || marca || ' ' || modelo || ' ' || variante), 'ring') AND cat = 'MOUSE') SELECT * FROM cart WHERE sku NOT IN (SELECT sku FROM f) UNION ALL SELECT sku, 1::DOUBLE FROM f",
    "dm7_batch_set": f"WITH {d.SQL_ROWS} SELECT row_seq, CASE WHEN row_seq % 3 = 0 THEN 'Razer' ELSE marca END AS marca, CASE WHEN row_seq % 3 = 0 THEN 'MOUSE' ELSE cat END AS cat FROM rows",
    "dm8_edit_row": f"WITH {d.SQL_ROWS} SELECT row_seq, CASE WHEN row_seq = 9 THEN 'AJ139 Pro' ELSE modelo END AS modelo FROM rows WHERE row_seq <> 12",
    "dm9_select_visible": f"WITH {_FULL} SELECT row_seq, row_seq % 2 = 0 AND status <> 'RED' AS selected FROM valid",
    "dm10_remove_lines": f"WITH {d.SQL_LINES} SELECT order_id, count(*) AS n, {_r2('sum(fob * qty)')} AS fob FROM lines WHERE line <> 1 GROUP BY order_id",
    "dm11_replace_images": f"WITH {d.SQL_ROWS} SELECT a.row_seq, CASE WHEN regexp_matches(trim(b.img), '(?i)^data:image/(?:png|jpe?g|webp|gif);(?:base64,[a-z0-9+/=\\s]+|[^\\s]+)$') THEN b.img ELSE a.img END AS img FROM rows a LEFT JOIN rows b ON b.row_seq = a.row_seq - 1",
    "dm12_clone_orders": f"WITH {d.SQL_LINES} SELECT order_id, sku, sum(qty) AS qty, 'Pedido ' || order_id || ' (copia)' AS name FROM lines WHERE order_id % 50 = 0 AND order_id IN (SELECT o_orderkey FROM orders) GROUP BY order_id, sku",
    "dm13_brand_rules": f"WITH {d.SQL_ROWS}, g AS (SELECT lower(marca) AS key, max_by({{'name': upper(marca), 'pattern': CASE WHEN row_seq % 8 = 0 THEN 'new' END}}, row_seq) AS r FROM rows WHERE row_seq % 4 = 0 AND marca <> '' GROUP BY 1) SELECT DISTINCT marca AS name, 'old' AS pattern FROM catalog WHERE lower(marca) NOT IN (SELECT key FROM g) UNION ALL SELECT r.name, coalesce(r.pattern, lower(r.name)) FROM g",
    "j3_upsert": f"""WITH {d.SQL_CATALOG}, a AS (SELECT *, {_IDKEY} AS k FROM catalog WHERE row_seq % 3 <> 0), b AS (SELECT * REPLACE ({_r2('fob * (1 + (row_seq % 4)::DOUBLE / 100)')} AS fob), {_IDKEY} AS k FROM catalog WHERE row_seq % 2 = 0),
l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_seq DESC) = 1), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_seq) AS place FROM a)
SELECT f.sku, f.marca, f.modelo, f.variante, f.cat, CASE WHEN f.place = 1 AND abs(l.fob - f.fob) >= 0.01 THEN l.fob ELSE f.fob END AS fob, f.row_seq, CASE WHEN f.place > 1 OR l.k IS NULL THEN 'keep' WHEN abs(l.fob - f.fob) >= 0.01 THEN 'update' ELSE 'skip' END AS action FROM f LEFT JOIN l ON l.k = f.k
UNION ALL SELECT sku, marca, modelo, variante, cat, fob, row_seq, 'insert' FROM l WHERE k NOT IN (SELECT k FROM a)""",
    "j8_code_lookup": f"WITH c AS (SELECT unnest(['8471 60 52', '85.18.30.00', '0000', '8473.30.99']) AS code), t AS {_TARIFFS} SELECT code, min(tariff_key) AS tariff_key, min_by(duty, tariff_key) AS duty FROM c LEFT JOIN t ON regexp_replace(ncm, '[.\\s]', '', 'g') = regexp_replace(code, '[.\\s]', '', 'g') GROUP BY code",
    "j9_duty_rates": f"WITH {d.SQL_CATALOG}, q AS (SELECT CASE cat WHEN 'MOUSE' THEN '8471.60.53' ELSE '8528.52.00' END AS ncm, min(row_seq / 1000::DOUBLE) AS quoted FROM catalog WHERE row_seq % 2 = 0 AND cat IN ('MOUSE', 'MONITOR') GROUP BY 1), t AS {_TARIFFS} SELECT tariff_key, t.ncm, coalesce(quoted, duty) AS duty, quoted IS NOT NULL AS overridden FROM t LEFT JOIN q ON q.ncm = t.ncm",
    "j11_inherited_images": f"WITH {d.SQL_IMAGED}, f AS (SELECT *, first_value(img IGNORE NULLS) OVER (PARTITION BY marca, modelo, cat ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM imaged) SELECT row_seq, coalesce(img, first) AS img, img IS NULL AND first IS NOT NULL AS inherited FROM f",
    "j12_recovered_models": f"""WITH {d.SQL_ITEMS}, r AS (SELECT * REPLACE ((item % 37)::DOUBLE AS fob), 'B' || (item % 4) AS marca, CASE WHEN item % 4 = 1 THEN 'Black' ELSE 'M' || item END AS modelo FROM items),
c AS (SELECT p.item, min(({{'tier': CASE WHEN abs(p.fob - q.fob) <= 0.01 THEN 0 ELSE 1 END, 'd': abs(p.y - q.y) + CASE WHEN q.page <> p.page THEN 500 ELSE 0 END, 'parent': q.item, 'modelo': q.modelo}})) AS b FROM r p JOIN r q ON q.file = p.file AND q.marca = p.marca AND q.modelo <> 'Black' AND q.page IN (p.page, p.page - 1)
WHERE p.modelo = 'Black' AND (abs(p.fob - q.fob) <= 0.01 OR (q.page = p.page AND q.y < p.y AND p.y - q.y <= 250)) GROUP BY p.item) SELECT r.item, b.parent AS parent, b.modelo AS modelo FROM r LEFT JOIN c ON c.item = r.item WHERE r.modelo = 'Black'""",
    "j15_cell_texts": f"WITH {d.SQL_ITEMS} SELECT l.item AS anchor, count(*) AS n, min({{'y': r.y, 'x': r.x, 'item': r.item}}).item AS first FROM items l JOIN items r ON {_NEAR.format(dx=70, above=60, below=15)} AND r.item <> l.item WHERE l.price IS NOT NULL GROUP BY l.item",
    "j16_image_candidates": f"WITH {d.SQL_ITEMS} SELECT l.item AS item, r.item AS image, {_r2('sqrt((r.x - l.x) * (r.x - l.x) + (r.y - l.y) * (r.y - l.y))')} AS distance FROM items l JOIN items r ON {_NEAR.format(dx=200, above=100, below=250)} WHERE l.item % 3 = 0 AND r.item % 7 = 0",
    "j17_siblings": f"WITH {d.SQL_ITEMS} SELECT l.item AS item, count(r.item) AS n FROM items l LEFT JOIN items r ON r.file = l.file AND r.page = l.page AND abs(r.y - l.y) <= 30 AND r.item <> l.item GROUP BY l.item",
    "j19_corrected": f"WITH {d.SQL_CART}, u AS (SELECT 'P-' || lpad((o_orderkey % 3000)::VARCHAR, 8, '0') AS sku, max(o_orderkey::VARCHAR) AS m FROM orders GROUP BY 1) SELECT row_seq, c.sku, coalesce(m, modelo) AS modelo, c.sku IN (SELECT sku FROM cart) AS exempt FROM catalog c LEFT JOIN u ON u.sku = c.sku",
    "j20_matched_truth": f"WITH {d.SQL_ITEMS}, e AS (SELECT item, file, page, x + item % 5 AS x, y - item % 7 AS y FROM items WHERE item % 2 = 0), m AS (SELECT l.item, min({{'d': abs(r.x - l.x) + abs(r.y - l.y), 'm': r.item}}) AS b FROM items l JOIN e r ON {_NEAR.format(dx=60, above=60, below=60)} WHERE l.item % 4 = 0 GROUP BY l.item) SELECT i.item, b.m AS match, b.d AS distance FROM items i LEFT JOIN m ON m.item = i.item WHERE i.item % 4 = 0",
    "j21_confusion": f"WITH {_VERD} SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM vd",
    "a21_calibration": f"WITH {_VERD}, c AS (SELECT count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND b) AS fp0, count(*) FILTER (t AND NOT b) AS fn0 FROM vd) SELECT fp0 AS fp_before, fp AS fp_after, fn0 AS fn_before, fn AS fn_after, fp > fp0 OR fn > fn0 AS rejected FROM c",
    "a23_badges": f"WITH {d.SQL_CART}, {d.SQL_RECORDS} SELECT (SELECT count(*) FROM catalog) AS products, (SELECT count(*) FROM cart WHERE qty > 0) AS cart_lines, (SELECT sum(qty) FROM cart) AS units, (SELECT count(*) FROM records WHERE status NOT IN ('delivered', 'cancelled')) AS active_imports",
    "a13_receipt": f"WITH {_ALLOC} SELECT count(*) AS total, count(*) FILTER (kind = 'preserved') AS preserved, count(*) FILTER (kind = 'generated') AS generated, count(*) FILTER (kind = 'deduplicated') AS deduplicated, sum(row_seq)::BIGINT AS input_identity FROM mp",
    "a14_idempotence": f"WITH {_ALLOC} SELECT sum(row_seq) = sum(row_seq) FILTER (row_seq > 2) AS same FROM mp",
    "o5_top_colours": f"WITH {d.SQL_ROWS}, k AS ({_CHECKED['x9_colour']}), n AS (SELECT file, value AS c, count(*) AS n FROM rows JOIN k USING (row_seq) WHERE value <> 'MULTICOLOR' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, c) AS p FROM n) SELECT file, string_agg(c, ',' ORDER BY p) AS colours FROM r WHERE p <= 3 GROUP BY file",
    "w11_allocated": f"WITH {_ALLOC} SELECT how, count(*) AS n, count(DISTINCT sku) AS skus FROM al GROUP BY how",
    "w12_sku_mapping": f"WITH {_ALLOC} SELECT row_seq, new_sku FROM mp WHERE kind = 'preserved'",
    "w14_median_y": f"WITH {d.SQL_ITEMS} SELECT file, page, median(y) AS median_y FROM items GROUP BY file, page",
    "o8_largest_group": f"WITH {d.SQL_CATALOG}, g AS (SELECT cat, marca, count(*) AS n, min(row_seq) AS first FROM catalog GROUP BY cat, marca) SELECT cat, max_by(marca, {{'n': n, 'f': -first}}) AS marca FROM g GROUP BY cat",
    "u1_concatenated": f"WITH {d.SQL_CATALOG} {_sets('SELECT NULL AS variante FROM catalog WHERE row_seq % 2 = 0 UNION ALL SELECT variante FROM catalog WHERE row_seq % 5 = 0')}",
    "u2_array_sets": f"WITH {d.SQL_CATALOG}, w AS (SELECT row_seq, string_split(modelo, ' ') AS w FROM catalog) SELECT row_seq, array_to_string(list_concat(w, list_filter(['large', 'small'], lambda x: NOT list_contains(w, x))), ',') AS \"union\", array_to_string(list_filter(w, lambda x: x NOT IN ('new', 'cold', 'red', 'blue')), ',') AS rest, list_contains(w, 'ring') AS held FROM w",
    "u3_vocabulary": f"WITH {d.SQL_ROWS} SELECT DISTINCT name FROM (SELECT marca AS name FROM catalog UNION ALL SELECT marca FROM rows) WHERE name <> ''",
    "s12_fx_rate": f"WITH {d.SQL_RECORDS} SELECT record, coalesce(CASE WHEN record % 3 <> 0 THEN nullif(local_price, 0) END, landed) AS rate FROM records",
    "s13_export_json": f"WITH {d.SQL_CATALOG} SELECT row_seq, sku FROM catalog",
    "t24_image_hash": f"WITH {d.SQL_ROWS} SELECT row_seq, sha256(img) AS hash FROM rows",
    "m3_dates": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%d/%m') AS label FROM events",
    "m8_json": f"WITH {d.SQL_CATALOG} SELECT row_seq, marca FROM catalog",
}
