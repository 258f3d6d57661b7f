"""Rows of the exports. Every export is a DataFrame with a key, a line number and the line's text or cells; line 0 is the
header, with a byte order mark in the CSV files. A sink writes them with ``write.text`` or as a table.

Orders are ``costing.priced_lines``; an order is an aggregate and a window by order_id, never a collected document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.exprs import csv_line, currency_text, html_escaped, money_text, number_text, ratio, round0, round2
from lonja.operators import costing

BOM = "﻿"
# Header lines of the exports.
ORDER_HEADER = ["SKU", "Categoría", "Marca", "Modelo", "Color/Variante", "FOB unit USD", "Cantidad", "Costo neto unit USD", "IVA unit USD", "IVA subtotal USD"]
QUOTE_HEADER = ["#", "SKU", "Marca", "Modelo", "Variante", "Cant", "P.Unit(USD)", "Subtotal(USD)"]
AUDIT_HEADER = "index,sku,marca,modelo,variante,cat,fob,status,issue_type,field,detail"
WIZARD_LABELS = ["FOB", "Flete", "Seguro", "CIF", "Derechos + Tasa + Anticipos", "IVA", "Gastos destino", "Caja (todo lo que sale)", "Costo neto real", "Crédito fiscal a favor"]


def _numbered(priced: DataFrame) -> DataFrame:
    return priced.withColumn("number", F.row_number().over(Window.partitionBy("order_id").orderBy("line", "sku", "qty")))


def _header(priced: DataFrame, text: Column) -> DataFrame:
    return priced.select("order_id").distinct().select("order_id", F.lit(0).alias("number"), text.alias("text"))


def order_csv(priced: DataFrame) -> DataFrame:
    """(order_id, number, text): a header and one quoted line for each order line, ten columns."""
    vat_unit = round2(ratio(F.col("line_vat"), F.col("qty")))
    cells = ["sku", "cat", "marca", "modelo", F.coalesce("variante", F.lit("")), *(number_text(c) for c in (F.col("fob"), F.col("qty"), F.col("unit_cost"), vat_unit, F.col("line_vat")))]
    lines = _numbered(priced).select("order_id", "number", csv_line(*(F.col(c) if isinstance(c, str) else c for c in cells)).alias("text"))
    return _header(priced, F.concat(F.lit(BOM), csv_line(*map(F.lit, ORDER_HEADER)))).unionByName(lines)


def packing_list(priced: DataFrame, weight_kg: float = 0.0, unit_kg: float = 0.25) -> DataFrame:
    """Thirteen cells a line, a blank line and a totals line. Weight is shared by quantity, ``unit_kg`` each without a
    total; a null or zero quantity is one unit in its line."""
    w = Window.partitionBy("order_id")
    units = F.sum("qty").over(w)
    each = F.when(units > 0, F.lit(weight_kg) / units).otherwise(F.lit(unit_kg)) if weight_kg > 0 else F.when(units > 0, F.lit(0.0)).otherwise(F.lit(unit_kg))
    qty = F.when(F.coalesce("qty", F.lit(0.0)) != 0, F.col("qty")).otherwise(1.0)
    cost = F.when(F.col("unit_cost") != 0, F.col("unit_cost")).otherwise(F.when((F.col("order_net") != 0) & (F.col("order_fob") != 0), F.col("fob") * (F.col("order_net") / F.col("order_fob"))).otherwise(F.col("fob") * 1.2))
    rows = _numbered(priced).withColumns({"each": each, "q": qty, "cost": cost})
    name = F.when(F.col("cat") != "", F.col("cat")).otherwise("PERIFERICOS_GAMER")
    lines = rows.select(
        "order_id", "number", F.col("number").cast("string").alias("item"), "sku", name.alias("cat"), "marca", "modelo", F.when(F.col("variante") != "", F.col("variante")).otherwise("-").alias("variante"), number_text(F.col("q")).alias("qty"), money_text(F.col("each") * F.col("q")).alias("kg"),
        money_text(F.col("fob")).alias("fob"), money_text(F.col("fob") * F.col("q")).alias("fob_total"), money_text(F.col("cost")).alias("cost"), money_text(F.col("cost") * F.col("q")).alias("cost_total"), money_text(F.col("line_vat")).alias("vat"),
    )
    t = priced.groupBy("order_id").agg(F.count("*").alias("n"), F.sum("qty").alias("q"), F.first("order_fob").alias("fob"), F.first("order_net").alias("net"), F.first("vat_total").alias("vat"))
    kg = F.lit(weight_kg) if weight_kg > 0 else F.when(F.col("q") > 0, F.lit(0.0)).otherwise(unit_kg * F.col("q"))
    none = F.lit("")
    ends = {"blank": {}, "total": {"item": F.lit("TOTALES"), "qty": number_text(F.col("q")), "kg": money_text(kg), "fob_total": money_text(F.col("fob")), "cost_total": money_text(F.col("net")), "vat": money_text(round2(F.col("vat")))}}
    for k, cells in enumerate(ends.values(), 1):
        lines = lines.unionByName(t.select("order_id", (F.col("n") + k).cast("int").alias("number"), *(cells.get(c, none).alias(c) for c in lines.columns[2:])))
    return lines


def executive_kpis(priced: DataFrame, rate: float = 1400.0) -> DataFrame:
    """(order_id, position, label, usd, local): the money rows of the executive summary, one row each."""
    t = priced.groupBy("order_id").agg(F.first("order_fob").alias("fob"), F.first("order_net").alias("net"), round2(F.first("vat_total")).alias("vat"), round2(F.sum(F.col("price") * F.col("qty"))).alias("revenue"))
    rows = {"Inversión Total FOB (China/Origen)": F.col("fob"), "Costo Neto Puesto (sin IVA)": F.col("net"), "IVA separado / repercutible": F.col("vat"), "Total Bruto con IVA": F.col("net") + F.col("vat"), "Facturación Total Proyectada (PVP)": F.col("revenue"), "Ganancia Neta Limpia": F.col("revenue") - F.col("net")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("position"), F.lit(label).alias("label"), v.alias("v")) for k, (label, v) in enumerate(rows.items(), 1)))).alias("r")
    return t.select("order_id", each).select("order_id", "r.position", "r.label", money_text(F.col("r.v")).alias("usd"), money_text(F.col("r.v") * rate).alias("local"))


def executive_detail(priced: DataFrame, rate: float = 1400.0) -> DataFrame:
    """The product sheet of the executive report: value, cost, price, profit and margin of each line."""
    q = F.when(F.coalesce("qty", F.lit(0.0)) != 0, F.col("qty")).otherwise(1.0)
    rows = _numbered(priced).withColumn("q", q)
    revenue, cost = F.col("price") * F.col("q"), F.col("unit_cost") * F.col("q")
    margin = F.concat(F.when(revenue > 0, money_text((revenue - cost) / revenue * 100, 1)).otherwise("0"), F.lit("%"))
    return rows.select("order_id", "number", "sku", "cat", "marca", "modelo", "variante", number_text(F.col("q")).alias("qty"), money_text(F.col("fob")).alias("fob"), money_text(F.col("unit_cost")).alias("cost"), money_text(F.col("price")).alias("price"), round0(F.col("price") * rate).alias("price_local"), money_text(revenue).alias("revenue"), money_text(revenue - cost).alias("profit"), margin.alias("margin"))


def quote_price() -> Column:
    return F.when(F.col("price") != 0, F.col("price")).otherwise(F.coalesce("fob", F.lit(0.0)))


def quote_csv(priced: DataFrame) -> DataFrame:
    """(order_id, number, text): header, one line each, a blank line and the total."""
    unit, qty = quote_price(), F.when(F.col("qty") != 0, F.col("qty")).otherwise(1.0)
    cells = [F.col("number").cast("string"), F.col("sku"), F.col("marca"), F.col("modelo"), F.coalesce("variante", F.lit("")), number_text(F.col("qty")), money_text(unit), money_text(unit * qty)]
    lines = _numbered(priced).select("order_id", "number", csv_line(*cells).alias("text"))
    t = priced.groupBy("order_id").agg(F.count("*").cast("int").alias("n"), F.sum("qty").alias("q"), round2(F.sum(F.col("price") * F.col("qty"))).alias("revenue"))
    none = F.lit("")
    total = t.select("order_id", (F.col("n") + 2).alias("number"), csv_line(F.lit("TOTAL"), none, none, none, none, number_text(F.col("q")), none, money_text(F.col("revenue"))).alias("text"))
    blank = t.select("order_id", (F.col("n") + 1).alias("number"), none.alias("text"))
    return _header(priced, F.concat(F.lit(BOM), csv_line(*map(F.lit, QUOTE_HEADER)))).unionByName(lines).unionByName(blank).unionByName(total)


def quote_rows(priced: DataFrame) -> DataFrame:
    """Table rows of a printable quote, escaped, with unit price and subtotal as currency."""
    unit, qty = quote_price(), F.when(F.col("qty") != 0, F.col("qty")).otherwise(1.0)
    cells = [F.col("number").cast("string"), F.col("sku"), F.col("marca"), F.col("modelo"), F.when(F.col("variante") != "", F.col("variante")).otherwise("-"), number_text(F.col("qty")), currency_text(unit), currency_text(unit * qty)]
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), html_escaped(c), F.lit("</td>")) for c in cells), F.lit("</tr>"))
    return _numbered(priced).select("order_id", "number", row.alias("html"))


def order_summary(priced: DataFrame) -> DataFrame:
    """(order_id, number, text): the lines of an order's plain-text summary, value and cost at the end."""
    line = F.concat(F.lit("• "), number_text(F.col("qty")), F.lit("x "), "marca", F.lit(" "), "modelo", F.lit(" ("), "sku", F.lit(") - PVP: $"), number_text(F.col("price")))
    lines = _numbered(priced).select("order_id", "number", line.alias("text"))
    t = priced.groupBy("order_id").agg(F.count("*").cast("int").alias("n"), F.first("order_fob").alias("fob"), F.first("order_net").alias("net"))
    ends = F.array(*(F.struct((F.col("n") + k).alias("number"), F.concat(F.lit(label), number_text(F.col(c)), F.lit(" USD")).alias("text")) for k, (label, c) in enumerate((("FOB Total: $", "fob"), ("Costo Puesto en País: $", "net")), 1)))
    return lines.unionByName(t.select("order_id", F.explode(ends).alias("e")).select("order_id", "e.number", "e.text"))


def wizard_summary(lines: DataFrame, insurance_pct: float = 0.015, freight_pct: float = 0.15, fixed_usd: float = 720.0) -> DataFrame:
    """(order_id, position, label, usd): the concepts of an import's summary, from its door-to-door cost."""
    door = costing.door_to_door(lines, freight_pct, insurance_pct, fixed_usd)
    t = door.groupBy("order_id").agg(F.first("cert_usd").alias("cert"), *(F.sum(F.col(c).cast("decimal(20,2)")).cast("double").alias(c) for c in ("duty_usd", "fee_usd", "vat_usd", "recoverable_usd")))
    t = t.join(costing.order_sums(lines).select("order_id", F.col("order_fob").alias("fob")), "order_id")
    cif = F.col("fob") * (1 + freight_pct + insurance_pct)
    taxes = F.col("duty_usd") + F.col("fee_usd") + F.col("recoverable_usd") - F.col("vat_usd")
    fixed = F.lit(fixed_usd) + F.col("cert")
    values = [F.col("fob"), F.col("fob") * freight_pct, F.col("fob") * insurance_pct, cif, taxes, F.col("vat_usd"), fixed, cif + taxes + fixed + F.col("vat_usd"), cif + F.col("duty_usd") + F.col("fee_usd") + fixed, F.col("recoverable_usd")]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("position"), F.lit(label).alias("label"), round2(v).alias("usd")) for k, (label, v) in enumerate(zip(WIZARD_LABELS, values), 1)))).alias("r")
    return t.select("order_id", each).select("order_id", "r.*")


def audit_csv(issues: DataFrame) -> DataFrame:
    """(row_seq, issue, text): one line for each issue, texts quoted, codes and numbers bare."""

    def quoted(c: str) -> Column:
        return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))

    cells = [F.col("row_seq").cast("string"), *map(quoted, ("sku", "marca", "modelo", "variante")), F.col("cat"), number_text(F.col("fob")), F.col("status"), F.col("issue"), F.col("field"), quoted("detail")]
    return issues.select("row_seq", "issue", F.concat_ws(",", *cells).alias("text"))


def catalog_json(catalog: DataFrame) -> DataFrame:
    """(row_seq, text): one JSON document a row; ``write.text`` makes it a JSON-lines file."""
    return catalog.select("row_seq", F.to_json(F.struct(*catalog.columns)).alias("text"))


def newest(rows: DataFrame, order: list[str], most: int = 50) -> DataFrame:
    """The newest rows of a history or an error log, by a top-k that no task sorts in full."""
    return rows.orderBy(*(F.col(c).desc() for c in order)).limit(most)
