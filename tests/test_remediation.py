"""Remediation: a second run changes nothing, odd rows do no harm, and image siblings equal a scan of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lonja.operators import gates, remediation
from lonja.plans import remediation as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Small tables and wide expressions: compiling them would take most of the time."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for k, x in settings.items():
        spark.conf.set(k, x)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_fixed_point_and_odd_rows(spark):
    rows = plans.damaged(spark, SF).withColumn("outcome_note", F.lit("extra"))
    odd = rows.limit(1)
    nulls = odd.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("row_seq", "status", "gates", "warnings") else (F.lit(-1).cast("bigint").alias("row_seq") if f.name == "row_seq" else F.lit("YELLOW").alias("status") if f.name == "status" else F.array().cast("array<string>").alias(f.name)) for f in rows.schema.fields))
    both = rows.unionByName(nulls)
    out, ledger = remediation.remediate(both)
    assert out.columns == both.columns and out.count() == both.count()
    counts = {(r["pass"], r["outcome"]): r["count"] for r in ledger.groupBy("pass", "outcome").count().collect()}
    assert counts[1, "promoted"] > 0 and max(p for p, _ in counts) <= remediation.MOST_PASSES
    green = out.where("status = 'GREEN' AND evidence IS NOT NULL")
    assert green.count() == green.where(remediation.traced()).count() == sum(n for (_, o), n in counts.items() if o == "promoted")
    assert gates.promotion_audit(out).agg(F.sum("false_promotions")).first()[0] == 0
    again, second = remediation.remediate(out)
    assert second.where("outcome = 'promoted'").isEmpty()
    assert sorted(map(str, again.select("row_seq", "status", "modelo", "cat").collect())) == sorted(map(str, out.select("row_seq", "status", "modelo", "cat").collect()))


def test_disabled_repairs_and_empty_table(spark):
    rows = plans.damaged(spark, SF)
    tried = remediation.attempted(rows, rows, disabled=("literalAnchorSearch", "codeAdoption"))
    assert tried.where("strategy IN ('literalAnchorSearch', 'codeAdoption')").isEmpty() and not tried.where("fix IS NOT NULL").isEmpty()
    assert remediation.remediation_pass(rows.limit(0), rows).isEmpty()


def test_image_siblings_equal_all_pairs(spark):
    r = random.Random(8)
    names = ["k1", "k1 pro", "K1 PRO max", "pro", "", None, "x", "kk1"]
    rows = [(i, f"s{i % 90}", r.choice(["A", "a", "B", None]), r.choice(names), r.choice(["MOUSE", "TECLADO", None]), r.choice(["i1", "i2", "", None]), r.choice([2.2, 0.5, 1.0, None])) for i in range(160)]
    t = spark.createDataFrame(rows, "row_seq long, sku string, marca string, modelo string, cat string, img string, aspect double")
    got = {x["row_seq"]: (x["sibling_sku"], x["sibling_cat"]) for x in remediation.image_siblings(t, t).collect()}

    def low(x):
        return (x or "").strip().lower()

    def unfit(cat, aspect):
        return cat == "MOUSE" and aspect > 1.9 or cat == "TECLADO" and aspect < 0.65

    want = {}
    for i, sku, brand, model, _, img, aspect in rows:
        for _, other, brand2, model2, cat2, img2, _ in rows:
            if img and img == img2 and sku != other and aspect is not None and (brand or "").upper() == (brand2 or "").upper() and low(model) and low(model2) and (low(model) in low(model2) or low(model2) in low(model)) and not unfit((cat2 or "").upper(), aspect):
                want[i] = (other, (cat2 or "").upper())
                break
    assert got == want and got
