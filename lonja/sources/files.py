"""Product lists from files: headers by alias, rows to products, and checks of files and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions.exprs import ACCENTED, PLAIN, leading_number

# Header aliases of each logical field, in order of priority.
ALIASES = {
    "modelo": ["modelo", "model", "product name", "producto", "nombre", "descripcion", "description", "item name"],
    "marca": ["marca", "brand", "fabricante", "manufacturer"],
    "categoria": ["categoria", "cat", "category", "tipo", "type", "rubro"],
    "fob": ["fob usd", "fob unit usd", "fob", "precio", "price", "usd", "unit price", "precio usd", "valor"],
    "sku": ["sku", "codigo", "code", "id", "referencia", "ref", "part number", "pn"],
    "variante": ["color/variante", "variante", "color", "variacion", "variant", "color/variation"],
    "cantidad": ["cantidad", "qty", "quantity", "units", "unidades", "stock", "cant"],
}
REQUIRED, RECOMMENDED = ("modelo", "fob"), ("marca", "categoria", "sku")


def normalized(header: str) -> str:
    return " ".join(header.strip().lower().translate(str.maketrans(ACCENTED, PLAIN)).split())


def field(df: DataFrame, name: str) -> Column:
    """A logical field: the first alias with a column whose value is not null, an empty one included; '' without."""
    columns = {normalized(c): c for c in df.columns}
    found = [F.trim(F.col(f"`{columns[a]}`").cast("string")) for a in ALIASES[name] if a in columns]
    return F.coalesce(*found, F.lit(""))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def products(raw: DataFrame, default_category: str = "OTRO") -> DataFrame:
    """Products of raw rows: those with a model and a price, which is the number the text begins with."""
    fields = raw.select(*(field(raw, n).alias(n) for n in ("sku", "marca", "modelo", "variante", "categoria", "fob")))
    priced = fields.withColumn("fob", leading_number(F.col("fob"))).where((F.col("modelo") != "") & (F.coalesce(F.col("fob"), F.lit(0.0)) != 0))
    return priced.withColumn("cat", F.upper(F.coalesce(F.nullif("categoria", F.lit("")), F.lit(default_category)))).drop("categoria")


def skipped(raw: DataFrame) -> DataFrame:
    """Rows without a model, and rows with one but without a price."""
    no_model = field(raw, "modelo") == ""
    no_price = F.coalesce(leading_number(field(raw, "fob")), F.lit(0.0)) == 0
    return raw.agg(F.count_if(no_model).alias("no_model"), F.count_if(~no_model & no_price).alias("no_price"))


def missing_fields(headers: list[str]) -> dict[str, list[str]]:
    have = {normalized(h) for h in headers}
    lacks = lambda names: [n for n in names if not have & set(ALIASES[n])]
    return {"required": lacks(REQUIRED), "recommended": lacks(RECOMMENDED)}


def encoding(content: Column) -> Column:
    """Encoding by byte-order mark, UTF-8 without one."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").otherwise("utf-8")


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, "[.]"), -1))


def route(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("pedido") | n.contains("order") | n.contains("packing"), "order").when(n.contains("catalog") | n.contains("producto"), "catalog").otherwise("unknown")
