"""The driver's tables in the shape of the domain, and the same shapes as DuckDB expressions for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions.exprs import round2

_CATS = {"ECONOMY": "TECLADO", "SMALL": "MOUSE", "MEDIUM": "HEADSET", "PROMO": "MONITOR", "STANDARD": "SWITCH"}


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    p = _read(spark, sf, "part")
    cat = F.lit("OTRO")
    for kind, name in reversed(_CATS.items()):
        cat = F.when(F.col("p_type") == kind, name).otherwise(cat)
    sku = F.concat(F.lit("P-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return p.select(sku.alias("sku"), F.col("p_brand").alias("marca"), F.col("p_name").alias("modelo"), F.substring_index("p_name", " ", 1).alias("variante"), cat.alias("cat"), round2(F.col("p_retailprice") / F.col("p_size")).alias("fob"), F.col("p_partkey").alias("row_seq"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    items = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("row_seq"), F.col("l_quantity").alias("qty"))
    return items.join(catalog(spark, sf), "row_seq")


def cart(spark: SparkSession, sf: str) -> DataFrame:
    """Selected quantities: every customer's balance picks a sku; some skus are not in the catalog."""
    c = _read(spark, sf, "customer")
    return c.select(F.concat(F.lit("P-"), F.lpad((F.col("c_custkey") * 2).cast("string"), 8, "0")).alias("sku"), F.pmod(F.col("c_custkey"), F.lit(5)).cast("double").alias("qty"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    o = _read(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "in_customs").when(F.col("o_orderkey") % 11 == 0, "cancelled").otherwise("in_transit")
    local = F.when(F.col("o_orderkey") % 7 != 0, round2(F.col("o_totalprice") * (F.lit(0.8) + (F.col("o_orderkey") % 5) / 10)))
    return o.select(F.col("o_orderkey").alias("record"), status.alias("status"), F.col("o_totalprice").alias("landed"), local.alias("local_price"))


def status_events(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events")
    names = F.array(*map(F.lit, ("in_transit", "in_customs", "cleared", "delivered", "cancelled")))
    return e.select(F.col("user_id").alias("record"), F.struct("ts", "event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("target"))


def imaged(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog with an image key that several rows share, none for every sixth row."""
    img = F.when(F.col("row_seq") % 6 != 0, F.concat(F.lit("img"), (F.col("row_seq") % 700).cast("string")))
    return catalog(spark, sf).withColumn("img", img).withColumn("status", F.when(F.col("row_seq") % 13 == 0, "RED").otherwise("GREEN"))


def page_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text items on pages; every third carries a price."""
    o = _read(spark, sf, "orders")
    fob = (F.col("o_custkey") % 3).cast("double")
    y = F.floor(F.col("o_totalprice") % 60) * 15.0
    return o.select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 5).alias("file"), (F.col("o_orderkey") % 20).alias("page"), (F.col("o_custkey") % 30 * 10).cast("double").alias("x"), y.alias("y"), fob.alias("fob"), F.when(F.col("o_orderkey") % 3 == 0, fob).alias("price"))


def raw_list(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog as a price list with foreign headers and gaps."""
    c = catalog(spark, sf)
    price = F.when(F.col("row_seq") % 7 == 0, "$31").otherwise(F.concat(F.floor("fob").cast("string"), F.lit(",75")))
    return c.select(F.col("sku").alias("Código"), F.col("marca").alias("Brand"), F.when(F.col("row_seq") % 10 != 0, F.col("modelo")).alias("Product  Name"), F.col("variante").alias("Color/Variante"), F.when(F.col("row_seq") % 3 != 0, F.col("cat")).alias("Categoría"), price.alias("FOB unit USD"))


def price_updates(spark: SparkSession, sf: str) -> DataFrame:
    """New prices from orders, many for a sku, some out of range or for no product."""
    o = _read(spark, sf, "orders")
    return o.select(F.concat(F.lit("P-"), F.lpad((F.col("o_orderkey") % 3000).cast("string"), 8, "0")).alias("sku"), F.floor(F.col("o_totalprice") * 2).cast("double").alias("new_fob"), F.col("o_orderkey").alias("seq"))


def number_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as people write them, with either mark, and texts without one."""
    c, three = catalog(spark, sf), F.lpad((F.col("row_seq") % 1000).cast("string"), 3, "0")
    k = F.col("row_seq") % 4
    text = F.when(k == 0, F.concat(F.lit("1."), three, F.lit(",5"))).when(k == 1, F.concat(F.lit("2,"), three, F.lit(".25"))).when(k == 2, F.concat(F.col("row_seq").cast("string"), F.lit(",75"))).otherwise("x")
    return c.select("row_seq", text.alias("text"))


#: The same shapes in DuckDB.
SQL_CATALOG = """catalog AS (SELECT 'P-' || lpad(p_partkey::VARCHAR, 8, '0') AS sku, p_brand AS marca, p_name AS modelo, split_part(p_name, ' ', 1) AS variante,
  CASE p_type WHEN 'ECONOMY' THEN 'TECLADO' WHEN 'SMALL' THEN 'MOUSE' WHEN 'MEDIUM' THEN 'HEADSET' WHEN 'PROMO' THEN 'MONITOR' WHEN 'STANDARD' THEN 'SWITCH' ELSE 'OTRO' END AS cat,
  floor(p_retailprice / p_size * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE AS fob, p_partkey AS row_seq FROM part)"""
SQL_LINES = SQL_CATALOG + """, lines AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity AS qty, c.* FROM lineitem JOIN catalog c ON c.row_seq = l_partkey)"""
SQL_CART = SQL_CATALOG + """, cart AS (SELECT 'P-' || lpad((c_custkey * 2)::VARCHAR, 8, '0') AS sku, (c_custkey % 5)::DOUBLE AS qty FROM customer)"""
SQL_RECORDS = """records AS (SELECT o_orderkey AS record, CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'P' THEN 'in_customs' WHEN o_orderkey % 11 = 0 THEN 'cancelled' ELSE 'in_transit' END AS status, o_totalprice AS landed,
  CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice * (0.8::DOUBLE + (o_orderkey % 5)::DOUBLE / 10::DOUBLE) * 100::DOUBLE + 0.5::DOUBLE) / 100::DOUBLE END AS local_price FROM orders)"""
SQL_IMAGED = SQL_CATALOG + """, imaged AS (SELECT *, CASE WHEN row_seq % 6 <> 0 THEN 'img' || (row_seq % 700) END AS img, CASE WHEN row_seq % 13 = 0 THEN 'RED' ELSE 'GREEN' END AS status FROM catalog)"""
SQL_ITEMS = """items AS (SELECT *, CASE WHEN item % 3 = 0 THEN fob END AS price FROM (SELECT o_orderkey AS item, o_custkey % 5 AS file, o_orderkey % 20 AS page, (o_custkey % 30 * 10)::DOUBLE AS x, floor(o_totalprice % 60) * 15::DOUBLE AS y, (o_custkey % 3)::DOUBLE AS fob FROM orders))"""


#: Model names and source texts as supplier lists have them (every rule of the text functions meets some of them).
MODELS = [
    "AJ139 Pro", "Magnetic Switch T9", "Gateron Red Switch", "Hall Effect", "S98 Glacier Axis Universe", "M720 Wireless Mouse", "F75 Gasket Keyboard", "Ultra Crystalblade Gleam", "Master Wireless Mouse", "Rose", "Standard", "3.60±0.30mm",
    "PC SeaSalt PA Silent 47 5g POM", "Cobra (Black", "Total 45", "$12.50", "item", "x", "", "Flagship PRO 68 Keys", "104 Keys PBT keycaps", "Premium Charging Dock", "PAW3395 sensor", "K", "Receiver", "Mini", "Keyboard stand for desk", "Backpack 15 inch",
    "Specs sheet", "Viper V3 (White Edition)", "Cloud II headset", "Numeric keypad NP20", "a5", "Smart TV 50", "Coffee maker espresso", "Purple", "Legend", "Lake",
]
RAWS = [
    "8BitDo Ultimate 2C $18.50", "Attack Shark X3 ¥$25", "RK61 keyboard USD$ 1,299.00", "ATK RS6 $0.05", "logitech g502 mouse $ 45.5", "KZ ZSN Pro earphone", "6941234567890 Razer viper v3", "haimu seasalt switch $0.12", "AULA F75 $39,90", "MODEL AB123 generic",
    "MCHOSE K7 fan", "mars75 iyx printer", "no brand 12$45", "keychron monitor 144hz", "$1,299.00", "€12,50", "12.345.678", "1,5,5", "philips hairclipper HC5610",
]
FILES = ["8BitDo list.pdf", "RK Catalog 2024.pdf", "kz damulin.xlsx", "MARS iyx.pdf", "keyboard switch.csv", "attack.pdf", "prices.csv", "KZ.pdf"]
BRANDS = ["KZ", "Haimu", "8BitDo", "OTRO", "", "Razer", "AULA", "Polaroid"]
IMAGES = ["data:image/png;base64,iVBORw0KGgo=", "data:image/png;base64,", "data:image/webp;abc", "http://x/y.png", None]


def _pick(values: list, k, shift: int = 0):
    return F.element_at(F.array(*(F.lit(x) for x in values)), (F.pmod(k + shift, F.lit(len(values))) + 1).cast("int"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog as extracted rows: names and texts of supplier lists, odd images, grounding and status included."""
    k = F.col("row_seq")
    c = catalog(spark, sf)
    model = F.when(k % 3 == 0, F.col("modelo")).otherwise(_pick(MODELS, k))
    return c.select(
        F.when(k % 17 == 0, "").when(k % 19 == 0, "bad sku!").otherwise(F.col("sku")).alias("sku"), F.when(k % 4 == 0, _pick(BRANDS, F.floor(k / 4).cast("long"))).otherwise(F.col("marca")).alias("marca"), model.alias("modelo"),
        F.when(k % 23 == 0, model).when(k % 29 == 0, "$9.99").otherwise(F.col("variante")).alias("variante"), "cat", F.when(k % 31 == 0, 0.0).otherwise(F.col("fob")).alias("fob"), _pick(IMAGES, k, 2).alias("img"),
        F.when(k % 5 == 0, False).when(k % 11 != 0, True).alias("grounded"), _pick(["", "GREEN", "YELLOW", "RED", "odd"], F.floor(k / 7).cast("long")).alias("source_status"), _pick(RAWS, k, 3).alias("raw"), _pick(FILES, k).alias("file"), (k % 40).alias("page"), "row_seq",
    )


def _sql_pick(values: list, k: str, shift: int = 0) -> str:
    cells = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in values)
    return f"list_extract([{cells}]::VARCHAR[], (({k} + {shift}) % {len(values)} + 1)::INT)"


_SQL_MODEL = f"CASE WHEN row_seq % 3 = 0 THEN modelo ELSE {_sql_pick(MODELS, 'row_seq')} END"
SQL_ROWS = SQL_CATALOG + f""", rows AS (SELECT CASE WHEN row_seq % 17 = 0 THEN '' WHEN row_seq % 19 = 0 THEN 'bad sku!' ELSE sku END AS sku, CASE WHEN row_seq % 4 = 0 THEN {_sql_pick(BRANDS, 'row_seq // 4')} ELSE marca END AS marca, {_SQL_MODEL} AS modelo,
  CASE WHEN row_seq % 23 = 0 THEN {_SQL_MODEL} WHEN row_seq % 29 = 0 THEN '$9.99' ELSE variante END AS variante, cat, CASE WHEN row_seq % 31 = 0 THEN 0::DOUBLE ELSE fob END AS fob, {_sql_pick(IMAGES, 'row_seq', 2)} AS img,
  CASE WHEN row_seq % 5 = 0 THEN false WHEN row_seq % 11 <> 0 THEN true END AS grounded, {_sql_pick(['', 'GREEN', 'YELLOW', 'RED', 'odd'], 'row_seq // 7')} AS source_status, {_sql_pick(RAWS, 'row_seq', 3)} AS raw, {_sql_pick(FILES, 'row_seq')} AS file, row_seq % 40 AS page, row_seq FROM catalog)"""
