"""Relational operators over a catalog (sku, marca, modelo, variante, cat, fob, row_seq) and a cart (sku, qty)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.exprs import identity_key, ratio, round2, slug, squeezed


def search_filter(catalog: DataFrame, text: str = "", brand: str = "", category: str = "", chip: str = "", low: float = 0.0, high: float = 0.0) -> DataFrame:
    """Rows that contain the text and fit brand, category (a chip overrides it) and price range; no or zero ``high`` is
    no upper bound."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("sku", "marca", "modelo", "variante"))))
    out = catalog.where(hay.contains(text.lower())) if text else catalog
    out = out.where(F.col("marca") == brand) if brand else out
    out = out.where(F.col("cat") == (chip or category)) if chip or category else out
    out = out.where(F.col("fob") >= low) if low else out
    return out.where(F.col("fob") <= high) if high else out


def selected_only(catalog: DataFrame, cart: DataFrame) -> DataFrame:
    return catalog.join(cart.where("qty > 0"), "sku", "left_semi")


def order_lines(cart: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cart lines with their product: of several rows of a sku the first counts."""
    first = catalog.groupBy("sku").agg(F.min_by(F.struct(*(c for c in catalog.columns if c != "sku")), "row_seq").alias("p"))
    return cart.join(first, "sku").select("sku", "qty", "p.*")


def orphans(cart: DataFrame, catalog: DataFrame) -> DataFrame:
    return cart.join(catalog, "sku", "left_anti")


def cart_value(cart: DataFrame, catalog: DataFrame) -> DataFrame:
    return cart.join(catalog.select("sku", "fob"), "sku", "left").agg(round2(F.coalesce(F.sum(F.coalesce(F.col("fob") * F.col("qty"), F.lit(0.0))), F.lit(0.0))).alias("value"))


def kpis(catalog: DataFrame) -> DataFrame:
    """Rows, brands, least positive, largest and mean positive price; 0 where there is none."""
    good = F.when(F.col("fob") > 0, F.col("fob"))
    return catalog.agg(
        F.count("*").alias("n"), F.count_distinct("marca").alias("brands"), F.coalesce(F.min(good), F.lit(0.0)).alias("least"), F.greatest(F.coalesce(F.max("fob"), F.lit(0.0)), F.lit(0.0)).alias("most"), round2(F.coalesce(F.avg(good), F.lit(0.0))).alias("mean")
    )


def facets(catalog: DataFrame) -> DataFrame:
    """Distinct brands and categories, blanks dropped."""
    rows = catalog.select(F.explode(F.create_map(F.lit("marca"), "marca", F.lit("cat"), "cat")).alias("facet", "value"))
    return rows.where("value IS NOT NULL AND value != ''").distinct()


def supplier_comparison(catalog: DataFrame) -> DataFrame:
    """Offers of the same model (name of three characters at least, two offers at least) with the spread of its prices."""
    key = F.lower(F.trim("modelo"))
    w = Window.partitionBy("model_key")
    rows = catalog.withColumn("model_key", key).where(F.length("model_key") >= 3)
    rows = rows.withColumns({"offers": F.count("*").over(w), "least": F.min("fob").over(w), "most": F.max("fob").over(w), "place": F.row_number().over(w.orderBy("fob", "row_seq"))}).where("offers > 1")
    diff = F.col("most") - F.col("least")
    return rows.select("model_key", "sku", "fob", "offers", "least", "most", round2(diff).alias("diff"), round2(ratio(diff * 100, F.col("least"))).alias("diff_pct"), (F.col("place") == 1).alias("best"), round2(F.col("fob") - F.col("least")).alias("over_best"))


def first_wins(catalog: DataFrame) -> DataFrame:
    """Of rows with equal brand, model (50 characters), variant (30) and price the first in input order."""
    key = [F.lower("marca"), F.lower(F.substring("modelo", 1, 50)), F.lower(F.substring("variante", 1, 30)), F.col("fob")]
    names = [f"_k{i}" for i in range(len(key))]
    kept = catalog.withColumns(dict(zip(names, key))).groupBy(*names).agg(F.min_by(F.struct(*catalog.columns), "row_seq").alias("r"))
    return kept.select("r.*")


def duplicate_groups(catalog: DataFrame) -> DataFrame:
    key = F.concat_ws("|", *(squeezed(F.col(c)) for c in ("marca", "cat", "modelo", "variante")), F.format_string("%.2f", "fob"))
    return catalog.groupBy(key.alias("dup_key")).agg(F.count("*").alias("n"), F.min("sku").alias("first_sku")).where("n > 1")


def inherit_image(catalog: DataFrame, image: str = "img") -> DataFrame:
    """Rows without an image take the first one of their brand, model and category."""
    w = Window.partitionBy("marca", "modelo", "cat").orderBy("row_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return catalog.withColumn("inherited", F.col(image).isNull() & F.first(image, ignorenulls=True).over(w).isNotNull()).withColumn(image, F.coalesce(image, F.first(image, ignorenulls=True).over(w)))


def page(catalog: DataFrame, number: int, size: int = 50) -> DataFrame:
    return catalog.orderBy("row_seq").offset(max(0, number - 1) * size).limit(size)


def allocated_sku() -> Column:
    """BRAND-CATEGORY-MODEL-VARIANT, upper-case letters and digits."""
    return F.concat_ws("-", *(F.coalesce(F.nullif(slug(F.col(c), n), F.lit("")), F.lit("X")) for c, n in (("marca", 6), ("cat", 4), ("modelo", 12), ("variante", 6))))


def upsert(catalog: DataFrame, batch: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Merges an import into a catalog by identity key: update where the price differs by the tolerance, skip where it
    does not, insert the rest. The whole new catalog, with the action on each row.

    Of catalog rows with one key the first takes the update, the others are kept; of rows of the batch with one key the
    last counts; rows without a model are kept and inserted as they are. Columns are those of the catalog."""
    key = identity_key(*(F.col(c) for c in ("marca", "modelo", "variante", "cat")))
    named = F.coalesce(F.trim("modelo"), F.lit("")) != ""
    names = catalog.columns
    incoming = batch.select(*names).withColumn("k", F.when(named, key))
    last = incoming.where("k IS NOT NULL").groupBy("k").agg(F.max_by(F.struct(*names), "row_seq").alias("new"))
    held = catalog.withColumn("k", F.when(named, key)).withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("row_seq")))
    first, rest = held.where("k IS NOT NULL AND place = 1"), held.where("k IS NULL OR place > 1")
    merged = first.select("k", F.struct(*names).alias("old")).join(last, "k", "full_outer")
    action = F.when(F.col("new").isNull(), "keep").when(F.col("old").isNull(), "insert").when(F.abs(F.col("new.fob") - F.col("old.fob")) >= tolerance, "update").otherwise("skip")
    fob = F.when(action == "update", F.col("new.fob"))
    out = merged.select(*(F.coalesce(*([fob] if c == "fob" else []), F.col("old")[c], F.col("new")[c]).alias(c) for c in names), action.alias("action"))
    return out.unionByName(rest.select(*names, F.lit("keep").alias("action"))).unionByName(incoming.where("k IS NULL").select(*names, F.lit("insert").alias("action")))


def allocate(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(row_seq, sku, how) of a batch: the sku of its identity if the catalog knows it, else its own sku if that is free
    or its identity's, else a generated one, salted where that is taken. Rows of one identity get one sku.

    Identities and skus are settled by windows on their own keys, so no row waits for the one before it; of identities
    that want one sku the first row's has it."""
    key = identity_key(*(F.col(c) for c in ("marca", "modelo", "variante", "cat")))

    def clean(c: str) -> Column:
        return F.upper(F.trim(F.coalesce(c, F.lit(""))))

    held = existing.withColumn("k", key).where(clean("sku") != "")
    known = held.groupBy("k").agg(F.min_by(F.trim("sku"), "row_seq").alias("known"))
    used = held.groupBy(clean("sku").alias("want")).agg(F.min_by("k", "row_seq").alias("owner"))
    rows = batch.withColumns({"k": key, "source": clean("sku"), "made": allocated_sku()})
    leader = rows.groupBy("k").agg(F.min_by(F.struct("source", "made", "row_seq"), "row_seq").alias("l")).select("k", "l.*").join(known, "k", "left")
    leader = leader.withColumn("want", F.when(F.col("known").isNull() & (F.col("source") != ""), F.col("source"))).join(used, "want", "left")
    turn = F.row_number().over(Window.partitionBy(F.coalesce("want", F.concat(F.lit(" "), "k"))).orderBy("row_seq"))
    own = F.col("want").isNotNull() & ((F.col("owner").isNull() & (turn == 1)) | F.coalesce(F.col("owner") == F.col("k"), F.lit(False)))
    leader = leader.withColumn("how", F.when(F.col("known").isNotNull(), "known").when(own, "source").otherwise("generated")).drop("owner")
    taken = used.select(F.col("want").alias("made"), F.lit(True).alias("taken")).distinct()
    again = F.row_number().over(Window.partitionBy("made").orderBy(F.when(F.col("how") == "generated", 0).otherwise(1), "row_seq"))
    leader = leader.withColumn("again", again).join(taken, "made", "left")
    salted = F.concat("made", F.lit("-"), F.upper(F.substring(F.sha2("k", 256), 1, 8)))
    sku = F.when(F.col("how") == "known", F.col("known")).when(F.col("how") == "source", F.col("source")).otherwise(F.when((F.col("again") > 1) | F.col("taken").isNotNull(), salted).otherwise(F.col("made")))
    return rows.select("row_seq", "k").join(leader.select("k", sku.alias("sku"), "how"), "k").select("row_seq", "sku", "how")


def sku_mapping(batch: DataFrame, allocated: DataFrame) -> DataFrame:
    """(row_seq, old_sku, new_sku, kind): preserved, generated or deduplicated, for the receipt of a migration."""
    both = batch.select("row_seq", F.trim(F.coalesce("sku", F.lit(""))).alias("old_sku")).join(allocated.select("row_seq", F.col("sku").alias("new_sku")), "row_seq")
    return both.withColumn("kind", F.when(F.col("old_sku") == F.col("new_sku"), "preserved").when(F.col("old_sku") == "", "generated").otherwise("deduplicated"))


def receipt(mapping: DataFrame) -> DataFrame:
    """One row: how many skus each kind has, and an order-free identity of the input for idempotence checks."""
    return mapping.agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("preserved", "generated", "deduplicated")), F.sum("row_seq").alias("input_identity"))


def code_lookup(codes: DataFrame, table: DataFrame) -> DataFrame:
    """Tariff rows of codes (code), whatever dots and spaces stand in either; the first row of a code counts."""
    plain = table.withColumn("plain", F.regexp_replace("ncm", r"[.\s]", "")).groupBy("plain").agg(F.min_by(F.struct(*table.columns), "tariff_key").alias("t"))
    return codes.withColumn("plain", F.regexp_replace("code", r"[.\s]", "")).join(plain, "plain", "left").select("code", "t.*")


def duty_rates(matrix: DataFrame, quoted: DataFrame) -> DataFrame:
    """The duty of every category: that of the tariff database for its code where it has one, else the matrix's."""
    db = quoted.groupBy("ncm").agg(F.min("duty").alias("quoted"))
    return matrix.join(db, "ncm", "left").select("tariff_key", "ncm", F.coalesce("quoted", "duty").alias("duty"), F.col("quoted").isNotNull().alias("overridden"))


def corrected(catalog: DataFrame, corrections: DataFrame, exemptions: DataFrame) -> DataFrame:
    """Side-channel corrections by sku (sku, new_modelo), and a flag on exempt rows."""
    fixed = catalog.join(corrections.groupBy("sku").agg(F.max("new_modelo").alias("new_modelo")), "sku", "left")
    return fixed.join(exemptions.select("sku", F.lit(True).alias("exempt")).distinct(), "sku", "left").select("row_seq", "sku", F.coalesce("new_modelo", "modelo").alias("modelo"), F.coalesce("exempt", F.lit(False)).alias("exempt"))
