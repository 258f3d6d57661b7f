"""Fixed values of the catalog and costing rules, as small DataFrames of a known size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Tariff key, code, import duty, statistics fee, VAT, additional VAT, income prepayment, gross-income
# prepayment, certificates.
TARIFFS = [
    ("TECLADO_CABLE", "8471.60.52", 0.0, 0.0, 0.21, 0.20, 0.06, 0.025, []),
    ("TECLADO_WIRELESS", "8471.60.53", 0.0, 0.0, 0.21, 0.20, 0.06, 0.025, ["ENACOM", "LITIO_DG"]),
    ("MOUSE_CABLE", "8471.60.53", 0.0, 0.0, 0.21, 0.20, 0.06, 0.025, []),
    ("MOUSE_WIRELESS", "8471.60.53", 0.0, 0.0, 0.21, 0.20, 0.06, 0.025, ["ENACOM", "LITIO_DG"]),
    ("HEADSET_CABLE", "8518.30.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, []),
    ("HEADSET_WIRELESS", "8518.30.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["ENACOM", "LITIO_DG"]),
    ("CONTROLLER_WIRELESS", "9504.50.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["ENACOM", "LITIO_DG"]),
    ("MONITOR", "8528.52.00", 0.0, 0.0, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("MOUSEPAD", "3926.90.90", 0.35, 0.03, 0.21, 0.20, 0.06, 0.025, []),
    ("SWITCH", "8536.50.90", 0.16, 0.03, 0.21, 0.20, 0.06, 0.025, []),
    ("OTRO", "8473.30.99", 0.16, 0.03, 0.21, 0.20, 0.06, 0.025, []),
    ("IMPRESORA", "8443.32.90", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("LAVADORA", "8450.11.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("HELADERA", "8418.21.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("TV", "8528.72.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("MICROONDAS", "8516.50.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("AIRE", "8415.10.19", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("ASPIRADORA", "8508.11.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("CAFETERA", "8516.71.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("LICUADORA", "8509.40.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("PLANCHA", "8516.40.00", 0.20, 0.03, 0.21, 0.20, 0.06, 0.025, ["SEGURIDAD_ELECTRICA_SMARK"]),
    ("CELULAR", "8517.13.00", 0.0, 0.0, 0.21, 0.20, 0.06, 0.025, ["ENACOM", "LITIO_DG"]),
]
# Cost of a certificate in USD.
CERTIFICATES = [("ENACOM", 350.0), ("SEGURIDAD_ELECTRICA_SMARK", 850.0), ("LITIO_DG", 75.0)]
# Markup on net cost by category.
MARKUPS = [
    ("TECLADO", 2.5), ("MOUSE", 2.5), ("MOUSEPAD", 2.8), ("AURICULARES", 2.8), ("HEADSET", 2.8), ("EARBUDS", 2.8), ("CONTROLLER", 2.4), ("SWITCH", 2.2), ("KEYCAP", 2.6), ("CABLE", 2.0),
    ("HUB", 2.0), ("ADAPTER", 1.9), ("DOCK", 2.0), ("STAND", 2.2), ("WEBCAM", 2.3), ("CAMARA", 2.3), ("MONITOR", 1.8), ("SILLA", 1.6), ("DESK", 1.7), ("MICROFONO", 2.4), ("RECEIVER", 2.0),
    ("LAVADORA", 1.5), ("ELECTRODOMESTICO", 1.5), ("CELULAR", 1.35), ("TV", 1.4), ("IMPRESORA", 1.6), ("OTRO", 2.5),
]
# Plausible unit prices by category (least, most, warning from).
PRICE_RANGES = [
    ("MOUSE", 1.0, 300.0, 200.0), ("TECLADO", 1.0, 400.0, 300.0), ("HEADSET", 2.0, 500.0, 400.0), ("AURICULAR", 1.0, 200.0, 150.0), ("CONTROLLER", 3.0, 350.0, 250.0), ("MOUSEPAD", 1.0, 250.0, 200.0),
    ("SWITCH", 0.05, 15.0, 10.0), ("CAMARA", 5.0, 800.0, 500.0), ("SPEAKER", 5.0, 500.0, 400.0), ("SILLA_GAMING", 30.0, 1000.0, 800.0), ("ACCESORIO", 0.1, 600.0, 450.0), ("NUMPAD", 2.0, 80.0, 60.0),
    ("MONITOR", 30.0, 2000.0, 1500.0), ("CUIDADO_PERSONAL", 2.0, 300.0, 200.0),
]
# Brands that make a few categories only.
BRAND_LOCK = {
    "KZ": ["AURICULAR", "ACCESORIO"], "Haimu": ["SWITCH"], "Polaroid": ["CAMARA"], "8BitDo": ["CONTROLLER", "ACCESORIO", "TECLADO", "NUMPAD"],
    "Flydigi": ["CONTROLLER", "ACCESORIO"], "GameSir": ["CONTROLLER", "ACCESORIO"],
}
# Order costing in percent, flat fees and rates when the caller gives none.
ORDER_DEFAULTS = {"freight_pct": 15.0, "insurance_pct": 2.0, "fee_pct": 3.0, "perception_pct": 6.0, "vat_pct": 21.0, "broker_usd": 500.0, "courier_usd": 8.0, "markup": 2.5, "fx": 1400.0, "mode": "courier"}
# Life of an import record, in order, and its end states.
STATUSES = ["ordered", "in_transit", "in_customs", "cleared", "delivered", "cancelled"]
TERMINAL = ["delivered", "cancelled"]


def tariffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARIFFS, "tariff_key string, ncm string, duty double, fee double, vat double, vat_add double, income double, gross double, certs array<string>")


def markups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKUPS, "cat string, cat_markup double")


def price_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICE_RANGES, "cat string, least double, most double, warn double")


# Gross-income rate by jurisdiction, and the rate elsewhere.
GROSS_INCOME = {"cab": 0.025, "pba": 0.035, "santa_fe": 0.03}
GROSS_DEFAULT = 0.025
