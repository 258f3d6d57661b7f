"""Changes of a catalog and a cart, each as a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.exprs import or_else, round2
from lonja.functions.text import image_state

#: A unit price is in (0, MOST_FOB].
MOST_FOB = 100_000.0


def set_prices(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Prices by sku (sku, new_fob): values out of range and nulls are ignored; of several the last by ``seq`` counts."""
    last = updates.where((F.col("new_fob") > 0) & (F.col("new_fob") <= MOST_FOB)).groupBy("sku").agg(F.max_by("new_fob", "seq").alias("new_fob"))
    return catalog.join(last, "sku", "left").withColumn("changed", F.col("new_fob").isNotNull() & (F.col("new_fob") != F.col("fob"))).withColumn("fob", F.coalesce("new_fob", "fob")).drop("new_fob")


def delete(catalog: DataFrame, skus: DataFrame) -> DataFrame:
    return catalog.join(skus.select("sku"), "sku", "left_anti")


def merge_cart(cart: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds quantities (sku, delta) to a cart; a line at zero or below goes."""
    base = cart.groupBy("sku").agg(F.sum("qty").alias("qty"))
    added = changes.groupBy("sku").agg(F.sum("delta").alias("delta"))
    both = base.join(added, "sku", "full_outer").select("sku", F.greatest(F.lit(0.0), F.coalesce("qty", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))).alias("qty"))
    return both.where("qty > 0")


def discounted(lines: DataFrame, pct: float) -> DataFrame:
    """Lines at a negotiated discount, with the saving of each order; a missing quantity is 1."""
    qty = or_else(F.col("qty"), 1.0)
    off = round2(F.col("fob") * (1 - pct))
    return lines.groupBy("order_id").agg(round2(F.sum(off * qty)).alias("fob_total"), round2(F.sum((F.col("fob") - off) * qty)).alias("saving"))


def insert_blank(catalog: DataFrame, sku: str) -> DataFrame:
    """A blank product above all others: row_seq one below the smallest."""
    top = catalog.agg(F.coalesce(F.min("row_seq") - 1, F.lit(0)).alias("top"))
    blank = {"sku": F.lit(sku), "row_seq": F.col("top"), "fob": F.lit(0.0), "cat": F.lit("OTRO")}
    types = {f.name: f.dataType for f in catalog.schema.fields}
    return catalog.unionByName(top.select(*(blank.get(c, F.lit("")).cast(types[c]).alias(c) for c in catalog.columns)))


def update_fields(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (sku, field, value, seq), the last of each field: a price must be a number in (0, MOST_FOB] in either
    notation, other empty values change nothing. Only fields of the catalog but the sku and row_seq are changed."""
    fields = [c for c in catalog.columns if c not in ("sku", "row_seq")]
    value = F.trim(F.coalesce("value", F.lit("")))
    number = F.regexp_replace(F.regexp_replace(value, ",", "."), "[$ ]", "").try_cast("double")
    good = F.when(F.col("field") == "fob", (number > 0) & (number <= MOST_FOB)).otherwise(value != "")
    last = updates.where(good).withColumn("value", F.when(F.col("field") == "fob", number.cast("string")).otherwise(value)).groupBy("sku").agg(*(F.max_by(F.when(F.col("field") == c, F.col("value")), F.when(F.col("field") == c, F.col("seq"))).alias(f"new_{c}") for c in fields))
    types = {f.name: f.dataType for f in catalog.schema.fields}
    joined = catalog.join(last, "sku", "left")
    return joined.select(*(F.coalesce(F.col(f"new_{c}").cast(types[c]), F.col(c)).alias(c) if c in fields else F.col(c) for c in catalog.columns))


def rename_skus(catalog: DataFrame, cart: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renames (sku, new_sku), normalised; a name that another row has or that two renames want is rejected. The cart's
    entries move with their product."""
    wanted = renames.select("sku", F.upper(F.trim("new_sku")).alias("new_sku")).where("new_sku != '' AND new_sku != sku").groupBy("sku").agg(F.max("new_sku").alias("new_sku"))
    unique = wanted.groupBy("new_sku").agg(F.count("*").alias("n"), F.first("sku").alias("sku")).where("n = 1").select("sku", "new_sku")
    free = unique.join(catalog.select(F.upper(F.trim("sku")).alias("new_sku")).distinct(), "new_sku", "left_anti").join(catalog.select("sku").distinct(), "sku", "left_semi")

    def moved(rows: DataFrame) -> DataFrame:
        return rows.join(free, "sku", "left").select(*(F.coalesce("new_sku", "sku").alias("sku") if c == "sku" else F.col(c) for c in rows.columns))

    return moved(catalog), moved(cart)


def set_cart(cart: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (sku, action, qty): set a quantity, or toggle between one and none; what is not positive goes."""
    both = cart.groupBy("sku").agg(F.sum("qty").alias("qty")).join(changes.withColumnRenamed("qty", "given"), "sku", "full_outer")
    held = F.coalesce("qty", F.lit(0.0))
    new = F.when(F.col("action") == "set", F.col("given")).when(F.col("action") == "toggle", F.when(held > 0, 0.0).otherwise(1.0)).otherwise(held)
    return both.select("sku", new.alias("qty")).where("qty > 0")


def select_all(cart: DataFrame, filtered: DataFrame, on: bool = True) -> DataFrame:
    """All filtered rows at quantity one, over what the cart holds of them; off: an empty cart."""
    if not on:
        return cart.limit(0)
    return cart.join(filtered.select("sku"), "sku", "left_anti").unionByName(filtered.select("sku", F.lit(1.0).alias("qty")))


def batch_set(rows: DataFrame, selected: Column, **values: str) -> DataFrame:
    """The same brand, category or other value on all selected rows of a preview."""
    return rows.withColumns({c: F.when(selected, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def select_visible(rows: DataFrame, visible: Column) -> DataFrame:
    """Selects the visible rows of a preview, RED ones never."""
    return rows.withColumn("selected", F.when(visible, F.col("status") != "RED").otherwise(F.col("selected")))


def replace_images(catalog: DataFrame, images: DataFrame) -> DataFrame:
    """New images (sku, new_img), where they are image data urls."""
    good = images.where(image_state(F.col("new_img")) == "valid").groupBy("sku").agg(F.max("new_img").alias("new_img"))
    return catalog.join(good, "sku", "left").withColumn("img", F.coalesce("new_img", "img")).drop("new_img")


def remove_lines(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Lines (order_id, line) taken out of their orders; costing the rest anew leaves no row of an emptied order."""
    return lines.join(removed.select("order_id", "line").distinct(), ["order_id", "line"], "left_anti")


def clone_orders(history: DataFrame, ids: DataFrame, suffix: str = " (copia)") -> DataFrame:
    """Copies of orders of the history as cart lines with the name of the copy."""
    picked = history.join(ids.select("order_id").distinct(), "order_id", "left_semi")
    return picked.groupBy("order_id", "sku").agg(F.sum("qty").alias("qty")).withColumn("name", F.concat(F.lit("Pedido "), F.col("order_id").cast("string"), F.lit(suffix)))


def upsert_brands(rules: DataFrame, given: DataFrame) -> DataFrame:
    """Brand rules (name, pattern) by name without regard to case: a new one replaces the old; no pattern: the name."""
    new = given.where("trim(name) != ''").groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max_by(F.struct(F.trim("name").alias("name"), "pattern"), "seq").alias("r"))
    new = new.select("key", "r.name", F.coalesce(F.when(F.trim("r.pattern") != "", F.col("r.pattern")), F.lower("r.name")).alias("pattern"))
    return rules.withColumn("key", F.lower(F.trim("name"))).join(new.select("key"), "key", "left_anti").select("name", "pattern").unionByName(new.select("name", "pattern"))
