"""Order costing, door-to-door import cost, price scenarios and profitability.

Lines are rows (order_id, line, sku, modelo, variante, cat, fob, qty). Rule tables have a fixed number of rows and are
broadcast; the only exchange is by order, which the totals and the lines share.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions import rules
from lonja.functions.exprs import ratio, round0, round2


def tariff_key(direct: list[str] | None = None) -> Column:
    """Tariff key of a line from its category and text; ``direct`` lists categories that are keys themselves."""
    cat = F.upper(F.coalesce("cat", F.lit("")))
    text = F.upper(F.concat_ws(" ", F.coalesce("modelo", F.lit("")), F.coalesce("variante", F.lit("")), F.coalesce("cat", F.lit(""))))
    radio = text.contains("WIRELESS") | text.contains("BT") | text.contains("BLUETOOTH")
    near = text.contains("WIRELESS") | text.contains("BT")
    direct = [k for k, *_ in rules.TARIFFS] if direct is None else direct
    return (
        F.when(cat.contains("TECLADO"), F.when(radio, "TECLADO_WIRELESS").otherwise("TECLADO_CABLE"))
        .when(cat.contains("MOUSE") & ~cat.contains("MOUSEPAD"), F.when(radio, "MOUSE_WIRELESS").otherwise("MOUSE_CABLE"))
        .when(cat.contains("HEADSET") | cat.contains("AURICULAR"), F.when(near, "HEADSET_WIRELESS").otherwise("HEADSET_CABLE"))
        .when(cat.isin(direct), cat)
        .otherwise("OTRO")
    )


def door_key() -> Column:
    """Tariff key as the door-to-door engine has it: controllers, monitors, pads and switches by substring, no
    appliances."""
    cat = F.upper(F.coalesce("cat", F.lit("")))
    plain = tariff_key([])
    return F.when(plain != "OTRO", plain).when(cat.contains("CONTROLLER"), "CONTROLLER_WIRELESS").when(cat.contains("MONITOR"), "MONITOR").when(cat.contains("MOUSEPAD"), "MOUSEPAD").when(cat.contains("SWITCH"), "SWITCH").otherwise("OTRO")


def with_tariff(lines: DataFrame, key: Column | None = None, table: DataFrame | None = None) -> DataFrame:
    """lines with the columns of their tariff; the fixed table is broadcast, a caller's only if Spark finds it small."""
    table = F.broadcast(rules.tariffs(lines.sparkSession)) if table is None else table
    return lines.withColumn("tariff_key", tariff_key() if key is None else key).join(table, "tariff_key")


def overridden_tariffs(overrides: dict[str, dict] | None = None) -> list[tuple]:
    """The fixed tariff rows with a caller's codes: a code that another row has brings that row's rates (the first one),
    an unknown code keeps the rates of the category; a duty given with it counts in both cases."""
    first: dict[str, tuple] = {}
    for row in rules.TARIFFS:
        first.setdefault(row[1], row)
    out = []
    for key, ncm, *rates in rules.TARIFFS:
        o = (overrides or {}).get(key, {})
        if o.get("ncm"):
            rates = list(first[o["ncm"]][2:]) if o["ncm"] in first else rates
            ncm = o["ncm"]
        if o.get("duty") is not None:
            rates = [o["duty"], *rates[1:]]
        out.append((key, ncm, *rates))
    return out


def order_config(inputs: dict | None = None) -> dict:
    """A costing configuration: what the caller gives, numbers also as text in either notation, over the defaults.

    freight_mode: percent, or weight (kg * kg_usd, if both are positive). duty_pct: none means the mean rate of the
    order's lines. overrides: markups by category."""
    c = {"freight_mode": "percent", "kg": 0.0, "kg_usd": 12.0, "duty_pct": None, "overrides": {}} | rules.ORDER_DEFAULTS
    for k, v in (inputs or {}).items():
        if isinstance(v, str) and k not in ("mode", "freight_mode"):
            both = "," in v and "." in v
            v = v.strip()
            v = v.replace(".", "").replace(",", ".") if both and v.rfind(",") > v.rfind(".") else v.replace(",", "") if both else v.replace(",", ".", 1)
            found = re.match(r"[+-]?(\d+\.?\d*|\.\d+)", v)
            v = float(found.group()) if found else c.get(k)
        c[k] = c.get(k) if v is None else v
    return c


def markup_of(cat: Column, by_matrix: Column, config: dict) -> Column:
    """A category's override, else the matrix if the global markup is the default, else the global markup."""
    given = F.lit(float(config["markup"]))
    out = F.coalesce(by_matrix, given) if abs(config["markup"] - 2.5) < 1e-9 else given
    own = config.get("overrides") or {}
    return F.coalesce(F.create_map(*(F.lit(x) for k, v in own.items() for x in (k, float(v))))[F.upper(cat)], out) if own else out


def priced_lines(lines: DataFrame, config: dict | None = None) -> DataFrame:
    """Every column of the lines with its order's sums, cost, price and VAT; see order_costing."""
    c = order_config(config)
    pct = {k: F.lit(float(c[f"{k}_pct"])) / 100 for k in ("freight", "insurance", "fee", "perception", "vat")}
    rated = with_tariff(lines.withColumns({"fob": F.coalesce("fob", F.lit(0.0)), "qty": F.coalesce("qty", F.lit(0.0))}))
    matrix = rules.markups(lines.sparkSession).withColumnRenamed("cat", "markup_of")
    rated = rated.join(F.broadcast(matrix), F.upper("cat") == F.col("markup_of"), "left").drop("markup_of")
    w = Window.partitionBy("order_id")
    duty = F.avg(round0(F.col("duty") * 100).cast("int")).over(w) / 100 if c["duty_pct"] is None else F.lit(float(c["duty_pct"])) / 100
    rated = rated.withColumns({"order_fob": round2(F.sum(F.col("fob") * F.col("qty")).over(w)), "order_qty": F.sum("qty").over(w), "duty_rate": duty})
    fob = F.col("order_fob")
    by_weight = c["freight_mode"] == "weight" and c["kg"] > 0 and c["kg_usd"] > 0
    rated = rated.withColumn("cif", fob + (F.lit(float(c["kg"] * c["kg_usd"])) if by_weight else fob * pct["freight"]) + fob * pct["insurance"])
    cif = F.col("cif")
    flat = F.col("order_qty") * F.lit(c["courier_usd"]) if c["mode"] == "courier" else F.lit(float(c["broker_usd"]))
    rated = rated.withColumn("net", cif + cif * F.col("duty_rate") + cif * pct["fee"] + cif * pct["perception"] + flat).withColumn("vat_total", cif * pct["vat"])
    unit = F.when(fob > 0, round2(F.col("fob") * F.col("net") / fob)).when(F.col("order_qty") > 0, round2(F.col("net") / F.col("order_qty"))).otherwise(0.0)
    rated = rated.withColumn("unit_cost", unit).withColumn("price", round2(F.col("unit_cost") * markup_of(F.col("cat"), F.col("cat_markup"), c)))
    share = F.when(fob > 0, F.col("fob") * F.col("qty") / fob).otherwise(0.0)
    return rated.withColumns({"order_net": round2(F.col("net")), "line_vat": round2(F.col("vat_total") * share)})


def order_costing(lines: DataFrame, config: dict | None = None) -> DataFrame:
    """Cost, price and margins of every line with its order's totals.

    Freight, insurance, duty (mean of the lines' rates), fee and perception are shares of the order's value; the courier
    takes a fee for each unit, an importer a flat one. VAT is reported and is in no cost. Without value, cost is shared
    by quantity; without both it is 0. Null prices and quantities count as 0."""
    cost, price = F.col("unit_cost"), F.col("price")
    return priced_lines(lines, config).select(
        "order_id", "line", "sku", "fob", "qty", "order_fob", "order_net", cost, price, "line_vat",
        round0(ratio((price - cost) * 100, price)).alias("margin_pct"), round0(ratio((price - cost) * 100, cost)).alias("roi_pct"),
    )


def order_sums(lines: DataFrame, config: dict | None = None) -> DataFrame:
    """(order_id, order_fob, order_qty, duty_rate, order_net) by one aggregate."""
    c = order_config(config)
    t = with_tariff(lines).groupBy("order_id").agg(round2(F.sum(F.col("fob") * F.col("qty"))).alias("order_fob"), F.sum("qty").alias("order_qty"), (F.avg(round0(F.col("duty") * 100).cast("int")) / 100).alias("duty_rate"))
    return t.withColumn("order_net", round2(net_of(c, F.lit(float(c["freight_pct"])))))


def net_of(c: dict, freight_pct: Column) -> Column:
    """Net cost of an order of order_fob, order_qty and duty_rate at a freight percentage."""
    fob = F.col("order_fob")
    cif = fob + fob * (freight_pct / 100) + fob * (F.lit(float(c["insurance_pct"])) / 100)
    flat = F.col("order_qty") * F.lit(c["courier_usd"]) if c["mode"] == "courier" else F.lit(float(c["broker_usd"]))
    return cif + cif * F.col("duty_rate") + cif * (F.lit(float(c["fee_pct"])) / 100) + cif * (F.lit(float(c["perception_pct"])) / 100) + flat


def order_totals(costed: DataFrame) -> DataFrame:
    """One row per order: value, cost, revenue, margin and its health band."""
    t = costed.groupBy("order_id").agg(F.first("order_fob").alias("order_fob"), F.first("order_net").alias("order_net"), round2(F.sum(F.col("price") * F.col("qty"))).alias("revenue"), F.count("*").alias("n_lines"), F.sum("qty").alias("units"))
    margin = round2(F.col("revenue") - F.col("order_net"))
    pct = round0(ratio(F.col("margin") * 100, F.col("revenue")))
    return t.withColumn("margin", margin).withColumn("margin_pct", pct).withColumn("band", F.when(pct >= 40, "healthy").when(pct >= 20, "tight").otherwise("low"))


def courier_warnings(lines: DataFrame, most_fob: float = 3000.0, most_qty: float = 3.0, unit_kg: float = 0.0, most_kg: float = 50.0) -> DataFrame:
    """Orders that a courier does not take: value over the limit, weight over it (where units have one), lines with more
    units than a personal import."""
    t = lines.groupBy("order_id").agg(round2(F.sum(F.col("fob") * F.col("qty"))).alias("fob_total"), (F.sum("qty") * unit_kg).alias("kg"), F.count_if(F.col("qty") > most_qty).alias("n_commercial"))
    warnings = F.array_compact(F.array(F.when(F.col("fob_total") > most_fob, "COURIER_FOB_EXCEEDED"), F.when(F.col("kg") > most_kg, "COURIER_WEIGHT_EXCEEDED"), F.when(F.col("n_commercial") > 0, "COURIER_SPECIES_WARNING")))
    return t.withColumn("warnings", F.array_join(warnings, ",")).where("warnings != ''")


def door_to_door(lines: DataFrame, freight_pct: float = 0.15, insurance_pct: float = 0.015, fixed_usd: float = 720.0, gross_pct: float | None = None, bp_pct: float = 0.0, kg: float = 0.0, kg_usd: float = 12.0, overrides: dict[str, dict] | None = None) -> DataFrame:
    """Importer's regime: taxes of every line on its share of the order's CIF, fixed and certificate costs by value.

    base = CIF + duty + fee; VAT, additional VAT, income and gross-income prepayments on the base are recoverable, the
    wealth-tax perception (bp_pct) is not. VAT is in no door cost, the other taxes are. An order's certificates count
    once each. A weight makes freight kg * kg_usd."""
    spark = lines.sparkSession
    table = spark.createDataFrame(overridden_tariffs(overrides), rules.tariffs(spark).schema)
    rated = with_tariff(lines, door_key(), table)
    w = Window.partitionBy("order_id")
    certs = sum((F.when(F.max(F.array_contains("certs", k)).over(w), usd).otherwise(0.0) for k, usd in rules.CERTIFICATES), F.lit(0.0))
    rated = rated.withColumns({"total": round2(F.sum(F.col("fob") * F.col("qty")).over(w)), "units": F.sum("qty").over(w), "cert_usd": certs})
    share = F.when(F.col("total") > 0, F.col("fob") * F.col("qty") / F.col("total")).when(F.col("units") > 0, F.col("qty") / F.col("units")).otherwise(0.0)
    freight = F.lit(kg * kg_usd) if kg > 0 else F.col("total") * freight_pct
    rated = rated.withColumn("share", share).withColumn("cif", (F.col("total") + freight + F.col("total") * insurance_pct) * F.col("share"))
    rated = rated.withColumn("duty_usd", F.col("cif") * F.col("duty")).withColumn("fee_usd", F.col("cif") * F.col("fee"))
    base = F.col("cif") + F.col("duty_usd") + F.col("fee_usd")
    gross = F.col("gross") if gross_pct is None else F.lit(gross_pct)
    vat, paid = base * F.col("vat"), base * F.col("vat_add") + base * F.col("income") + base * gross
    door = base + paid + base * bp_pct + (F.lit(fixed_usd) + F.col("cert_usd")) * F.col("share")
    return rated.select("order_id", "line", "sku", "ncm", round2(F.col("cif")).alias("cif"), round2(F.col("duty_usd")).alias("duty_usd"), round2(F.col("fee_usd")).alias("fee_usd"), round2(vat).alias("vat_usd"), round2(vat + paid).alias("recoverable_usd"), round2(base).alias("real_usd"), "cert_usd", round2(door).alias("door_usd"), round2(ratio(door, F.col("qty"))).alias("unit_door_usd"))


def courier_regime(lines: DataFrame, freight_pct: float = 0.15, insurance_pct: float = 0.015, free_usd: float = 400.0) -> DataFrame:
    """Simplified duty: half of the CIF over the free amount, VAT on all of it, no prepayments."""
    t = lines.groupBy("order_id").agg(round2(F.sum(F.col("fob") * F.col("qty"))).alias("fob_total"))
    t = t.withColumn("cif", F.col("fob_total") + F.col("fob_total") * freight_pct + F.col("fob_total") * insurance_pct)
    duty, vat = F.greatest(F.lit(0.0), F.col("cif") - free_usd) * 0.5, F.col("cif") * 0.21
    return t.select("order_id", "fob_total", round2(F.col("cif")).alias("cif"), round2(duty).alias("duty_usd"), round2(vat).alias("vat_usd"), round2(F.col("cif") + duty).alias("net_usd"), round2(F.col("cif") + duty + vat).alias("cash_usd"))


def scenarios(lines: DataFrame, rates: list[float], freight_changes: list[float], margin_pct: float = 35.0, config: dict | None = None) -> DataFrame:
    """Every order costed anew under every pair of exchange rate and change of the freight percentage (in percent), with
    the revenue that earns the margin; the scenarios are literals that each order's one row is unfolded to."""
    c, target = order_config(config), 1 / (1 - margin_pct / 100)
    table = F.array(*(F.struct(F.lit(float(a)).alias("rate"), F.lit(float(b)).alias("freight_change")) for a in rates for b in freight_changes))
    t = order_sums(lines, config).withColumn("_scenario", F.explode(table)).select("*", "_scenario.*").drop("_scenario")
    t = t.withColumn("cost_usd", round2(net_of(c, F.lit(float(c["freight_pct"])) * (1 + F.col("freight_change") / 100))))
    goal = F.col("cost_usd") * target
    return t.select("order_id", "rate", "freight_change", "cost_usd", round2(F.col("cost_usd") - F.col("order_net")).alias("cost_change"), round2(goal).alias("target_revenue"), round2(goal - F.col("cost_usd")).alias("target_margin"), round0(goal * F.col("rate")).alias("target_local"))


def scenario_prices(lines: DataFrame, rate: float, freight_change: float, margin_pct: float = 35.0, config: dict | None = None) -> DataFrame:
    """Unit cost and price of every line under one scenario: the order's cost by value, and what earns the margin."""
    t = scenarios(lines, [rate], [freight_change], margin_pct, config).select("order_id", "cost_usd")
    sums = order_sums(lines, config).select("order_id", "order_fob").join(t, "order_id")
    unit = F.col("cost_usd") / F.when(F.col("order_fob") != 0, F.col("order_fob")).otherwise(1.0) * F.col("fob")
    price = unit / (1 - margin_pct / 100)
    return lines.join(sums, "order_id").select("order_id", "line", "sku", round2(unit).alias("unit_cost"), round2(price).alias("price"), round0(price * rate).alias("price_local"))


def landed_verdict(landed: Column, local: Column, eps: float = 1e-6) -> Column:
    return F.when(local.isNull() | (local <= 0), "unavailable").when(F.abs(local - landed) < eps, "break_even").when(landed < local, "cheaper").otherwise("more_expensive")


def break_even_units(fixed: Column, revenue: Column, cost: Column, units: Column) -> Column:
    """Units that earn the fixed cost at the mean profit of a unit, 0 without profit."""
    profit = ratio(revenue - cost, units)
    return F.when(profit > 0, F.ceil(fixed / profit)).otherwise(0).cast("long")


def compare_local(landed: Column, local: Column, rate: float, eps: float = 1e-6) -> Column:
    """Struct of the verdict and the difference to the local price (USD, percent, local currency); null differences
    without a local price."""
    known = F.coalesce(local > 0, F.lit(False))
    diff = F.when(known, F.when(F.abs(local - landed) < eps, 0.0).otherwise(local - landed))
    return F.struct(known.alias("available"), landed_verdict(landed, local, eps).alias("verdict"), round2(diff).alias("diff_usd"), round2(diff / local * 100).alias("diff_pct"), round2(diff * rate).alias("diff_local"))


def regime(given: Column, mode: Column) -> Column:
    """The regime that is given, else courier in courier mode, else importer."""
    return F.coalesce(F.when(given != "", given), F.when(mode == "courier", "courier").otherwise("importador"))


def estimate(fob: Column, rate: float = 1400.0, freight_pct: float = 0.15, vat_pct: float = 0.21) -> Column:
    """Quick estimate of an item's freight and VAT, in USD and local currency."""
    freight = fob * freight_pct
    vat = (fob + freight) * vat_pct
    return F.struct(round2(freight).alias("freight_usd"), round0(freight * rate).alias("freight_local"), round2(vat).alias("vat_usd"), round0(vat * rate).alias("vat_local"))


def suggested_insurance(fob: Column, freight: Column) -> Column:
    """1.1 percent of value and freight; as a share of the value it is an insurance_pct."""
    return (F.coalesce(fob, F.lit(0.0)) + F.coalesce(freight, F.lit(0.0))) * 0.011


def gross_income_pct(jurisdiction: Column, own: Column) -> Column:
    """Gross-income rate of a jurisdiction: fixed for the two big ones, the caller's own for others, else the default."""
    table = F.create_map(*(F.lit(x) for k, v in rules.GROSS_INCOME.items() for x in (k, v)))
    return F.coalesce(table[jurisdiction], own, F.lit(rules.GROSS_DEFAULT))


def eliminated_tax_line() -> Column:
    """The tax that was abolished and is still shown, at zero."""
    return F.struct(F.lit("Impuesto PAIS").alias("label"), F.lit(0.0).alias("rate_pct"), F.lit(0.0).alias("amount_usd"), F.lit("eliminated").alias("status"))
